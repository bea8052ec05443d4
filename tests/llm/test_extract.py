"""Main-text extraction: awkward markup, linear time, and pages against a plain reader."""

import time
from html.parser import HTMLParser

import pytest

from radlake.llm import extract

ARTICLE = "<article><p>{}</p></article>"


@pytest.fixture(scope="module")
def trees(spark):
    return extract.trained(spark)


def text_of(trees, page):
    nodes, pieces = extract.parse(page)
    return extract.main_text(pieces, extract.decode(nodes, extract.log_odds(trees, nodes)))


def everything(page):
    nodes, pieces = extract.parse(page)
    return extract.main_text(pieces, [True] * len(nodes))


@pytest.mark.parametrize(
    "page, text",
    [
        ("<p data-x=it's>Hello</p><p>don't go</p><p>end</p>", "Hello\ndon't go\nend"),
        ('<p>one</p><p title="foo>Hello there</p>', "one"),
        ("<p title='a>b' class=x>in</p>", "in"),
        ("<p>a &am<b>p;</b> b &amp;lt; c</p>", "a &amp; b &lt; c"),
        ("<p>1 < 2 and 3 <4 </p", "1 < 2 and 3 <4"),
        ("<p>x<!-- > -- --!>y<!-->z<!--->w</p><!-- no end <p>lost", "xyzw"),
        ("a<!DOCTYPE x><?php echo ?></>b</ no>c</", "abc</"),
        ("<script>if (a</b/.exec(x)) '</scriptx>'</script >after<style>p > q</style", "after"),
        ("<p>a<div>b<p>c<table><tr><td>d<td>e<tr><td>f</table>g", "a\nb\nc\nd\ne\nf\ng"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "a\nb\nc\nd"),
        ("<a href = \"x>y\" =z / b>t</a><br/>u<img alt='>'>v", "t\nuv"),
        ("<P CLASS=a>U<B>v</B></p>", "Uv"),
        ("<", "<"),
        ("", ""),
    ],
)
def test_markup(page, text):
    assert everything(page) == text


def test_references_are_decoded_by_piece(trees):
    assert "a &amp; b" in text_of(trees, ARTICLE.format("a &am<b>p;</b> b and some more words for the paragraph to be long enough"))


@pytest.mark.parametrize(
    "page",
    [
        "<a " * 100_000, "<p>" + "<b>" * 100_000 + "</i>" * 100_000, "<ul>" + "<li>x" * 100_000, "<div>" * 50_000 + "x", "<p><button>" + "<div>x" * 50_000, "<!" * 100_000, "</" * 100_000,
        '<p a="' * 100_000, "<svg>" * 100_000, "<" * 200_000, "<p " + "a " * 100_000 + ">x", "<p" + " " * 200_000 + "x", "<table>" + "<tr><td>x" * 50_000, "<p><i>" * 50_000, "&" * 200_000,
    ],
)
def test_linear_time(page):
    began = time.time()
    nodes, pieces = extract.parse(page)
    rows = extract.features(nodes, {1: 0})
    extract.main_text(pieces, extract.decode(nodes, rows[:, 0] + 1))
    assert time.time() - began < 20


class Article(HTMLParser):
    """The blocks of the article element, whatever is around it, without clutter inside."""

    VOID = {"br", "img", "hr", "meta", "link", "input"}
    #: Of its own: what begins a new line in a browser, and names that stand for clutter on pages of the kind.
    BLOCKS = {"html", "head", "body", "article", "section", "div", "nav", "header", "footer", "aside", "form", "h1", "h2", "h3", "h4", "p", "ul", "ol", "li", "blockquote", "table", "tr", "td", "title", "script", "style"}
    NAMES = {"ad", "ads", "advert", "sidebar", "comments", "cookie", "newsletter", "related", "share"}

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.inside, self.skip, self.blocks, self.now = 0, [], [], []

    def edge(self):
        text = " ".join("".join(self.now).split())
        if text:
            self.blocks.append(text)
        self.now = []

    def handle_starttag(self, tag, attrs):
        if tag in self.BLOCKS or tag == "br":
            self.edge()
        if tag == "article":
            self.inside += 1
        named = set(" ".join(v or "" for k, v in attrs if k in ("class", "id", "role")).lower().replace("-", " ").replace("_", " ").split())
        if tag not in self.VOID and (self.skip or tag in ("nav", "aside", "form", "header", "footer", "script", "style") or named & self.NAMES):
            self.skip.append(tag)

    def handle_endtag(self, tag):
        if tag in self.BLOCKS:
            self.edge()
        if tag == "article":
            self.inside -= 1
        if tag in self.skip:
            while self.skip.pop() != tag:
                pass

    def handle_data(self, data):
        if self.inside and not self.skip:
            self.now.append(data)

    def handle_entityref(self, name):
        self.handle_data(self.unescape_one(f"&{name};"))

    def handle_charref(self, name):
        self.handle_data(self.unescape_one(f"&#{name};"))

    @staticmethod
    def unescape_one(reference):
        import html

        return html.unescape(reference)


def test_pages_against_a_plain_reader(spark, trees):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in extract.extract(pages, trees).collect()}
    wrong = 0
    rows = pages.collect()
    for r in rows:
        plain = Article()
        plain.feed(r.html or "")
        plain.close()
        plain.edge()
        wrong += got[r.page_id] != "\n".join(plain.blocks)
    assert len(got) == len(rows) and wrong == 0


PARAGRAPHS = ["The council met on Tuesday to talk about the new bridge and what it will cost the town over the next ten years.", "Nobody spoke against it, although several members asked who would pay for the road that leads there.", "Work may begin in spring if the river is low enough, the engineer said in her report to the members.", "The old bridge is closed to lorries since last year, and buses take a longer way round through the village.", "A decision is expected before the summer, when the money for it has to be asked for."]


def article_with(part):
    before, after = ("".join(f"<p>{p}</p>" for p in ps) for ps in (PARAGRAPHS[:3], PARAGRAPHS[3:]))
    return f"<html><head><title>x</title></head><body><nav><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ul></nav><article><h1>The bridge over the river</h1>{before}{part}{after}</article><footer>all rights</footer></body></html>"


@pytest.mark.parametrize(
    "part, text",
    [
        ('<section id="comment-on-policy"><h2>What the minister said</h2><p>The minister told the paper that the policy will stay as it is for at least two more years.</p></section>', "What the minister said\nThe minister told the paper that the policy will stay as it is for at least two more years."),
        ('<div class="tags-list"><p>Each house in the street got a tag with its number, so that the workers know where the pipes are.</p></div>', "Each house in the street got a tag with its number, so that the workers know where the pipes are."),
        ("<p>Before it <math><mi>a</mi><mo>+</mo><mi>b</mi></math> after it, and some more of the sentence.</p>", "Before it a+b after it, and some more of the sentence."),
        ("<p>Before it <button>Press</button> after it, and some more of the sentence.</p>", "Before it after it, and some more of the sentence."),
        ('<div class="comments"><h3>Comments</h3><p>I do not believe a word of this, they said the same ten years ago.</p><p>Me neither.</p></div>', ""),
        ('<div class="tags"><ul><li><a href=/a>bridge</a></li><li><a href=/b>river</a></li></ul></div>', ""),
        ('<div class="ad">Buy one get one free, only today in our shop at the market place.</div>', ""),
        ('<aside class="related-links"><h3>More</h3><ul><li><a href=/1>The market</a></li><li><a href=/2>The mayor</a></li></ul></aside>', ""),
        ('<form><label>Mail</label><button>Send</button></form>', ""),
    ],
)
def test_names_alone_decide_nothing(trees, part, text):
    want = "\n".join(filter(None, ["The bridge over the river", *PARAGRAPHS[:3], text, *PARAGRAPHS[3:]]))
    assert text_of(trees, article_with(part)) == want


def test_empty_table_with_clashing_columns(spark, trees):
    schema = "page_id long, url string, html string, text int, n_chars string, label double, features int"
    assert extract.extract(spark.createDataFrame([], schema), trees).count() == 0
    got = extract.extract(spark.createDataFrame([(None, None, None, 1, "x", 0.5, 2), (None, None, "<p>", 1, "x", 0.5, 2)], schema), trees).collect()
    assert [(r.page_id, r.url, r.text, r.n_chars) for r in got] == [(None, None, "", 0)] * 2
