"""Main-text extraction: boosted trees over DOM nodes, decoded along the tree.

Tags, attributes and comments are read by the rules of HTML, in linear time.
Every block element of a page is a node with features: its tag, the hashed tokens
of its attributes and what share of them speaks of clutter, the same of its
ancestors, the text and link density of its subtree, its
depth and its place among its siblings. Gradient-boosted trees give the
log-odds that a node belongs to the main text. Decoding keeps a node only below
kept ancestors and takes the best such choice for the whole page. The trees are
trained by Spark ML on pages made here from a rule, TRAIN_PAGES in number.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pages made for training; boosting rounds and depth of the trees.
TRAIN_PAGES, TREES, DEPTH = 400, 16, 5
#: Buckets that attribute tokens are hashed to; only those that the training pages fill are features.
TOKEN_BUCKETS = 4096
#: Pages whose nodes are scored together.
SCORED = 256

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg object canvas audio video textarea title".split())
BLOCK = frozenset(
    "html head body article main section div nav header footer aside form fieldset figure figcaption details summary dialog menu address hgroup search "
    "h1 h2 h3 h4 h5 h6 p ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre center hr select option button label".split()
) | RAW
#: Controls: nodes of their own that don't part the text around them.
INNER = frozenset("button select option label".split())
#: A start tag of the key closes an open element of the values.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES |= dict.fromkeys("thead tbody tfoot".split(), {"thead", "tbody", "tfoot", "tr", "td", "th"})
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}} | dict.fromkeys("tr td th thead tbody tfoot".split(), {"table"}) | {"option": {"select"}}
ENDS_P = BLOCK - {"option", "button", "label", "select"} - RAW
#: Attribute tokens that tell of clutter, and of content (fixed values).
CLUTTER = frozenset(
    "ad ads advert adverts advertisement advertising banner promo promoted promotion sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs header masthead "
    "footer foot sidebar side aside related recommended recommendations comment comments reply replies discussion disqus cookie cookies consent gdpr notice alert popup modal "
    "newsletter subscribe subscription signup login form search share sharing social widget toolbar pagination pager tags meta byline legal copyright disclaimer hidden".split()
)
CONTENT = frozenset("article content main post story entry body text page blog news document".split())
TAGS = {
    "content": {"article", "main"}, "clutter": {"nav", "header", "footer", "aside", "form", "menu", "dialog", "search", "address"},
    "raw": RAW | {"head"}, "control": {"select", "option", "button", "label", "fieldset"}, "heading": {"h1", "h2", "h3", "h4", "h5", "h6"},
    "paragraph": {"p", "blockquote", "pre"}, "list": {"ul", "ol", "li", "dl", "dt", "dd"}, "table": {"table", "tr", "td", "th", "tbody", "thead"},
}
#: Elements whose content is text up to their own end tag, and not part of the page's text.
OPAQUE = frozenset("script style textarea title noscript noembed noframes iframe template svg".split())
#: A start tag of ENDS_P closes an open p unless one of these is open inside it.
BARRIERS = ("table", "td", "th", "button")
_NAME = re.compile(r"[a-zA-Z][^\t\n\f\r />]*")
_ATTRIBUTE = re.compile(r"[\t\n\f\r /]*([^\t\n\f\r />][^\t\n\f\r />=]*)(?:[\t\n\f\r ]*=[\t\n\f\r ]*(?:\"([^\"]*)(\"|\Z)|'([^']*)('|\Z)|([^\t\n\f\r >]*)))?")
_TAG_END = re.compile(r"[\t\n\f\r /]*>")
_COMMENT_END = re.compile(r"--!?>")
_OPAQUE_END = {name: re.compile(rf"</{name}(?=[\t\n\f\r />])", re.I) for name in OPAQUE}
_SPLIT = re.compile(r"[^a-z0-9]+")


def bucket_of(token: str) -> int:
    return zlib.crc32(token.encode()) % TOKEN_BUCKETS


class Node:
    __slots__ = ("tag", "parent", "children", "clutter", "content", "hidden", "tokens", "text", "links", "kept", "index", "depth", "place")

    def __init__(self, tag: str, parent: Node | None, index: int):
        self.tag, self.parent, self.index = tag, parent, index
        self.children: list[Node] = []
        self.clutter = self.content = 0.0  # shares of the tokens of an attribute
        self.hidden = False
        self.tokens: list[int] = []
        self.text = self.links = 0
        self.depth = parent.depth + 1 if parent else 0
        self.place = len(parent.children) if parent else 0
        if parent:
            parent.children.append(self)

    def describe(self, attributes: list[tuple[str, str]]) -> None:
        for name, value in attributes:
            if name in ("class", "id", "role", "aria-label", "itemprop"):
                tokens = {t for t in _SPLIT.split(value.lower()) if t}
                if tokens:
                    self.clutter = max(self.clutter, len(CLUTTER & tokens) / len(tokens))
                    self.content = max(self.content, len(CONTENT & tokens) / len(tokens))
                    self.tokens += [bucket_of(t) for t in tokens]
            elif name == "style":
                self.hidden |= "display:none" in value.lower().replace(" ", "")
            elif name == "hidden":
                self.hidden = True


def tag_at(page: str, at: int) -> tuple[str, list[tuple[str, str]], int]:
    """Name, attributes and end of the tag whose name begins at ``at``; end -1 if the page ends inside it.

    A quote counts only right after the = of an attribute; every character is
    looked at a bounded number of times.
    """
    found = _NAME.match(page, at)
    name, at, attributes = found[0].lower(), found.end(), []
    while True:
        end = _TAG_END.match(page, at)
        if end:
            return name, attributes, end.end()
        found = _ATTRIBUTE.match(page, at)
        if not found or found[3] == "" or found[5] == "":
            return name, attributes, -1
        attributes.append((found[1].lower(), html.unescape(found[2] or found[4] or found[6] or "")))
        at = found.end()


class Open:
    """The open elements, with the places of each tag, so that no step searches the stack."""

    def __init__(self, root: Node, pieces: list[tuple[Node, str | None]]):
        self.stack: list[tuple[str, Node]] = [("#root", root)]
        self.places: dict[str, list[int]] = defaultdict(list)
        self.pieces = pieces

    def last(self, names) -> int:
        """Place of the innermost open element with one of the names, or -1."""
        return max((self.places[n][-1] for n in names if self.places[n]), default=-1)

    def push(self, tag: str, node: Node) -> None:
        self.places[tag].append(len(self.stack))
        self.stack.append((tag, node))

    def close(self, place: int) -> None:
        """Closes the element at a place and all inside it."""
        while len(self.stack) > place:
            tag, node = self.stack.pop()
            self.places[tag].pop()
            if tag in BLOCK and tag not in INNER:
                self.pieces.append((node, None))


def parse(page: str) -> tuple[list[Node], list[tuple[Node, str | None]]]:
    """The block nodes, root first, and the pieces of text in page order, in linear time.

    A piece is (node, text) with references decoded; text None is the border of
    a block, which br and hr are as well. Inline elements, formulas among them, are
    part of the block around them unless their attributes say something; controls
    are nodes inside it.
    """
    nodes = [Node("#root", None, 0)]
    pieces: list[tuple[Node, str | None]] = []
    opened = Open(nodes[0], pieces)
    at, begin, end = 0, 0, len(page)

    def text_upto(stop: int) -> None:
        if stop > begin:
            text, node = html.unescape(page[begin:stop]), opened.stack[-1][1]
            pieces.append((node, text))
            size = len(text) if not text.isspace() else 0
            node.text += size
            if opened.places["a"]:
                node.links += size

    while True:
        stop = page.find("<", at)
        if stop < 0:
            text_upto(end)
            break
        after = page[stop + 1 : stop + 3]
        closing = after[:1] == "/"
        if not (after[1:2] if closing else after[:1]).isascii() or not (after[1:2] if closing else after[:1]).isalpha():
            if not (closing or after[:1] in ("!", "?")) or (closing and len(after) < 2):
                at = stop + 1  # a < that begins no markup is text
                continue
            text_upto(stop)
            if page.startswith("<!--", stop):  # <!--> and <!---> are comments, too
                found = _COMMENT_END.search(page, stop + 4)
                short = page.startswith(">", stop + 4) * 5 or page.startswith("->", stop + 4) * 6
                at = begin = stop + short if short else found.end() if found else end
            else:
                found = page.find(">", stop)
                at = begin = found + 1 if found >= 0 else end
            continue
        text_upto(stop)
        name, attributes, at = tag_at(page, stop + 1 + closing)
        if at < 0:
            break
        begin = at
        if closing:
            if opened.places[name]:
                opened.close(opened.places[name][-1])
            continue
        if name in ENDS_P and opened.places["p"] and opened.last(BARRIERS) < opened.places["p"][-1]:
            opened.close(opened.places["p"][-1])
        if name in CLOSES:
            while (place := opened.last(CLOSES[name])) > opened.last(SCOPES[name]):
                opened.close(place)
        node = opened.stack[-1][1]
        if name == "br" or name == "hr":
            pieces.append((node, None))
            continue
        if name in VOID:
            continue
        if name in BLOCK:
            node = Node(name, node, len(nodes))
            nodes.append(node)
            node.describe(attributes)
            if name not in INNER:
                pieces.append((node, None))
        elif attributes:
            trial = Node(name, None, 0)
            trial.describe(attributes)
            if trial.clutter >= 0.5 or trial.hidden:
                node = Node(name, node, len(nodes))
                nodes.append(node)
                node.clutter, node.content, node.hidden, node.tokens = trial.clutter, trial.content, trial.hidden, trial.tokens
        if name in OPAQUE:
            found = _OPAQUE_END[name].search(page, at)
            at = begin = found.start() if found else end
            pieces.append((node, None))
            continue
        opened.push(name, node)
    return nodes, pieces


def features(nodes: list[Node], buckets: dict[int, int]) -> np.ndarray:
    """One row per node: FEATURES, then a column for each bucket of tokens (bucket -> column): 1 for the node's own, a half for its ancestors'."""
    n = len(nodes)
    text = np.array([x.text for x in nodes], float)
    links = np.array([x.links for x in nodes], float)
    size = np.ones(n)
    for x in reversed(nodes):  # children come after their parents
        if x.parent is not None:
            p = x.parent.index
            text[p] += text[x.index]
            links[p] += links[x.index]
            size[p] += size[x.index]
    before = np.concatenate([[0], np.cumsum([x.text for x in nodes])[:-1]]) / max(1.0, text[0])
    rows = np.zeros((n, len(FEATURES) + len(buckets)))
    above = np.zeros((n, 4))
    tags = [Counter(y.tag for y in x.children) for x in nodes]
    for k, x in enumerate(nodes):
        p = x.parent
        own = [x.tag in TAGS[t] for t in TAGS] + [x.clutter, x.content, x.hidden, len(x.tokens)]
        bad = own[1] or own[2] or own[3] or x.hidden
        if p is not None:
            above[k] = above[p.index]
        rows[k, : len(own)] = own
        rows[k, len(own) : len(own) + 4] = above[k]
        if bad:
            above[k, 0] = 1
        if own[0] or x.content:
            above[k, 1] = 1
        above[k, 2] += bool(bad)
        above[k, 3] = max(above[k, 3], x.clutter)
        family, alike = (len(p.children), tags[p.index][x.tag]) if p is not None else (1, 1)
        rows[k, len(own) + 4 : len(FEATURES)] = (
            np.log1p(text[k]), np.log1p(x.text), links[k] / max(1.0, text[k]), text[k] / size[k], x.depth, len(x.children),
            family, x.place / family, alike / family, text[k] / max(1.0, text[0]), before[k],
        )
        if p is not None:
            rows[k, len(FEATURES) :] = 0.5 * (rows[p.index, len(FEATURES) :] > 0)
        for b in x.tokens:
            if b in buckets:
                rows[k, len(FEATURES) + buckets[b]] = 1
    return rows


FEATURES = [*TAGS, "clutter", "content", "hidden", "tokens", "above_bad", "above_good", "above_count", "above_clutter"]
FEATURES += ["log_text", "log_own", "link_share", "density", "depth", "children", "siblings", "place", "same_tag", "share", "before"]


def decode(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """Which nodes stay: the choice with the largest sum of log-odds in which no kept node is below a dropped one."""
    best = odds.copy()
    for x in reversed(nodes):
        if x.index:
            best[x.parent.index] += max(0.0, best[x.index])
    kept = np.zeros(len(nodes), bool)
    for x in nodes:
        kept[x.index] = (best[x.index] > 0) and (x.parent is None or kept[x.parent.index])
    return kept


def main_text(pieces: list[tuple[Node, str | None]], kept: np.ndarray) -> str:
    blocks, now = [], []
    for node, text in [*pieces, (None, None)]:
        if text is not None:
            if kept[node.index]:
                now.append(text)
        elif now:
            block = " ".join("".join(now).split())
            if block:
                blocks.append(block)
            now = []
    return "\n".join(blocks)


# --- training -------------------------------------------------------------------------

#: Words of clutter that stand in the names of content as well, and words around those of clutter (fixed values).
WEAK = frozenset("tags meta header banner notice alert legal search share side related form hidden foot promo toolbar menu login advert".split())
AROUND = ("box", "slot", "wrap", "left", "area", "section", "container", "inner", "block", "list", "item")


def made_page(random: np.random.Generator) -> tuple[str, list[bool]]:
    """A page from a rule, and for each of its block nodes whether it is main text."""
    parts: list[str] = ["<!DOCTYPE html>"]
    labels = [True]

    def words(low: int, high: int) -> str:
        return " ".join("".join(chr(97 + int(c)) for c in random.integers(0, 26, int(random.integers(2, 10)))) for _ in range(int(random.integers(low, high))))

    def pick(*options: str) -> str:
        return options[int(random.integers(len(options)))]

    def element(tag: str, main: bool, inside, attributes: str = "") -> None:
        parts.append(f"<{tag}{attributes}>")
        labels.append(main)
        inside()
        parts.append(f"</{tag}>")

    def text(tag: str, main: bool, low: int, high: int, attributes: str = "") -> None:
        element(tag, main, lambda: parts.append(words(low, high)), attributes)

    def link_list(count: int) -> None:
        element("ul", False, lambda: [element("li", False, lambda: parts.append(f'<a href="/{words(1, 2)}">{words(1, 4)}</a>')) for _ in range(count)])

    def word() -> str:
        return "".join(chr(97 + int(c)) for c in random.integers(0, 26, int(random.integers(2, 9))))

    def named(*tokens: str) -> str:
        token = pick(*tokens)
        return f' {pick("class", "id")}="{pick(token, f"x-{token}", f"site {token}", f"box {token}", f"{token}-{pick(*AROUND)}", f"{word()}-{token}")}"'

    def odd_name() -> str:
        """A word of clutter in the name of content: one of several words, or one that often stands there."""
        strong = pick(*sorted(CLUTTER - WEAK))
        name = pick(f"{strong}-{word()}-{word()}", f"{word()}-{strong}-{word()}-{word()}", f"{pick(*sorted(WEAK))}-{pick('list', word())}", f"{word()}-{pick(*sorted(WEAK))}")
        return f' {pick("class", "id")}="{name}"'

    def clutter() -> None:
        kind = int(random.integers(8))
        if kind == 7:
            element("div", False, lambda: link_list(int(random.integers(1, 5))), named("tags", "share", "social", "meta", "breadcrumbs", "pagination", "related", "menu"))
        elif kind == 0:
            element("nav", False, lambda: link_list(int(random.integers(3, 9))))
        elif kind == 1:
            element(pick("aside", "div"), False, lambda: (text("h3", False, 1, 4), link_list(4)), named("sidebar", "related", "recommended", "widget"))
        elif kind == 2:
            text(pick("div", "section", "aside"), False, 3, 25, named("ad", "ads", "advert", "sponsored", "promo", "banner"))
        elif kind == 3:
            element(pick("div", "section"), False, lambda: [text("p", False, 5, 40) for _ in range(int(random.integers(1, 5)))], named("comments", "comment", "replies", "discussion"))
        elif kind == 4:
            element("form", False, lambda: (text("label", False, 1, 3), text("button", False, 1, 2)))
        elif kind == 5:
            element("div", False, lambda: text("p", False, 5, 25), named("cookie", "consent", "notice", "newsletter", "alert"))
        else:
            text(pick("script", "style"), False, 3, 9)

    def paragraph() -> None:
        kind = int(random.integers(12))
        if kind == 11:
            control = pick("button", "label", "select")
            element("p", True, lambda: (parts.append(words(2, 20) + " "), text(control, False, 1, 3), parts.append(" " + words(2, 20))))
        elif kind > 8:
            element(pick("section", "div"), True, lambda: [*([text("h2", True, 2, 8)] if random.random() < 0.5 else []), *[text("p", True, 8, 90) for _ in range(int(random.integers(1, 4)))]], odd_name())
        elif kind == 0:
            text(pick("h2", "h3"), True, 2, 8)
        elif kind == 1:
            element(pick("ul", "ol"), True, lambda: [text("li", True, 2, 20) for _ in range(int(random.integers(2, 6)))])
        elif kind == 2:
            element("blockquote", True, lambda: text("p", True, 5, 40))
        elif kind == 3:
            element("table", True, lambda: [element("tr", True, lambda: [text("td", True, 1, 5) for _ in range(3)]) for _ in range(3)])
        else:
            text("p", True, *((1, 4) if random.random() < 0.2 else (10, 90)))

    def article() -> None:
        if random.random() < 0.8:
            text("h1", True, 1, 12)
        for _ in range(int(random.integers(0, 4) if random.random() < 0.3 else random.integers(2, 16))):
            paragraph()
            if random.random() < 0.08:
                clutter()

    def body() -> None:
        if random.random() < 0.5:
            element(pick("header", "div"), False, lambda: (text("p", False, 1, 5), link_list(3)), named("header", "masthead", "navbar"))
        for _ in range(int(random.integers(0, 4))):
            clutter()
        kind = int(random.integers(5))
        if kind < 2:
            element("article", True, article)
        elif kind == 2:
            element("main", True, lambda: element(pick("article", "div"), True, article))
        else:
            element("div", True, article, named("content", "article", "post", "story", "entry", "main"))
        for _ in range(int(random.integers(0, 4))):
            clutter()
        if random.random() < 0.8:
            text(pick("footer", "div"), False, 2, 20, named("footer", "copyright", "legal"))

    def page() -> None:
        element("head", False, lambda: (text("title", False, 1, 9), text("style", False, 1, 4) if random.random() < 0.5 else None))
        element("body", True, body)

    element("html", True, page)
    return "".join(parts), labels


def training_rows(pages: int = TRAIN_PAGES) -> tuple[list[tuple[list[float], float]], dict[int, int]]:
    """Rows of features with their labels, and the buckets of tokens that are features: those of at least a page in fifty."""
    random = np.random.Generator(np.random.PCG64(2))
    made = [made_page(random) for _ in range(pages)]
    parsed = [parse(page)[0] for page, _ in made]
    seen = Counter(b for nodes in parsed for b in {b for x in nodes for b in x.tokens})
    buckets = {b: k for k, b in enumerate(sorted(b for b, n in seen.items() if 50 * n >= pages))}
    rows = []
    for nodes, (_, labels) in zip(parsed, made):
        assert len(nodes) == len(labels)
        rows += zip(features(nodes, buckets).tolist(), map(float, labels))
    return rows, buckets


class Model(NamedTuple):
    """Trees as (weight, nodes), node rows being feature (-1 in a leaf), threshold, left, right, value; and the columns of token buckets."""

    trees: list[tuple[float, np.ndarray]]
    buckets: dict[int, int]


def train(spark: SparkSession, pages: int = TRAIN_PAGES) -> Model:
    made, buckets = training_rows(pages)
    data = spark.createDataFrame(made, "f array<double>, label double").select(array_to_vector("f").alias("features"), "label").coalesce(1)
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=2).fit(data)

    def flat(node, rows: list[list[float]]) -> int:
        at = len(rows)
        rows.append([-1, 0, 0, 0, node.prediction()])
        if node.subtreeDepth():
            split = node.split()
            rows[at][:2] = [split.featureIndex(), split.threshold()]
            rows[at][2] = flat(node.leftChild(), rows)
            rows[at][3] = flat(node.rightChild(), rows)
        return at

    out = []
    for tree, weight in zip(model.trees, model.treeWeights):
        rows: list[list[float]] = []
        flat(tree._call_java("rootNode"), rows)
        out.append((float(weight), np.array(rows)))
    return Model(out, buckets)


_TRAINED: dict[tuple[str, int], Model] = {}


def trained(spark: SparkSession, pages: int = TRAIN_PAGES) -> Model:
    """The model, trained once in a Spark application."""
    key = spark.sparkContext.applicationId, pages
    if key not in _TRAINED:
        _TRAINED[key] = train(spark, pages)
    return _TRAINED[key]


def log_odds(model: Model, nodes: list[Node]) -> np.ndarray:
    return odds_of(model, features(nodes, model.buckets))


def odds_of(model: Model, rows: np.ndarray) -> np.ndarray:
    total = np.zeros(len(rows))
    everyone = np.arange(len(rows))
    for weight, tree in model.trees:
        at = np.zeros(len(rows), np.int64)
        for _ in range(DEPTH):
            feature = tree[at, 0].astype(np.int64)
            left = rows[everyone, feature] <= tree[at, 1]
            at = np.where(feature < 0, at, np.where(left, tree[at, 2], tree[at, 3]).astype(np.int64))
        total += weight * tree[at, 4]
    return 2 * total


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages.

    Null and empty html give an empty text; pages are read whole, in linear time,
    whatever their markup is worth; unclosed elements end where HTML ends them; a
    page cut off inside a tag, or inside a quoted value that never ends, ends
    before that tag. Repeated rows give repeated results; an empty table gives no
    row; other columns are not read. A br parts blocks. ``model``: that of train();
    else it is trained once in an application.
    """
    model = model or trained(pages.sparkSession)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SCORED):
                batch = whole.slice(at, SCORED)
                parsed = [parse(p or "") for p in batch.column(2).to_pylist()]
                rows = [features(nodes, model.buckets) for nodes, _ in parsed]
                odds = np.split(odds_of(model, np.concatenate(rows)), np.cumsum([len(r) for r in rows])[:-1])
                got = [main_text(pieces, decode(nodes, o)) for (nodes, pieces), o in zip(parsed, odds)]
                columns = [batch.column(0), batch.column(1), pa.array(got, pa.string()), pa.array(map(len, got), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
