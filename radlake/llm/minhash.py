"""Near-duplicate documents by MinHash.

Many universal hash minima of each document's word shingles, cut into bands;
documents that share a band meet in a bucket. Documents with equal sets are one
class first, so only different texts meet. In a bucket not all pairs are formed:
a pivot, the member whose buckets are the fullest, is paired with the others; a
pair goes on if the signatures agree enough and counts if the full sets do.
Links make components by alternating large-star and small-star.

A bucket that then holds several components may hold links between them that no
pivot showed. The members of such buckets are joined by the prefix filter on
their shingles, rarest first, with length and position tests: pairs of different
components that pass are confirmed on the full sets as well. A copy with words
of its own has nothing but those in its prefix, and meets no one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import LOWER, HashMemo, Scratch, mix64, texts, windows

SHINGLE = 5
#: 24 bands of 4 rows: a pair of similarity 0.85 shares none with probability 2e-8, one of 0.8 with 3e-6.
BANDS, ROWS = 24, 4
#: Links: 100 * intersection >= percent * union; PERCENT is the default, QUERY_PERCENT that of op4_minhash.
PERCENT, QUERY_PERCENT = 80, 85
#: Members up to which all of a bucket are pivots.
SMALL = 6
_RANDOM = np.random.Generator(np.random.PCG64(20))
_A = _RANDOM.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingles(text: bytes, memo: HashMemo) -> np.ndarray:
    """The sorted distinct shingle hashes of a text; all its words if they are fewer than five."""
    words = text.translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = memo.of(words)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64)
    return np.unique(windows(hashes, SHINGLE))


def minima(values: np.ndarray) -> np.ndarray:
    """The least value of each universal hash function over a set, by blocks."""
    out = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(values), 512):
        block = values[at : at + 512]
        np.minimum(out, (_A[:, None] * block[None, :] + _B[:, None]).min(axis=1), out=out)
    return out


def least_agreeing(percent: int) -> int:
    """Equal minima below which a pair at the threshold would lie five deviations off."""
    p, n = percent / 100, BANDS * ROWS
    return int(n * p - 5 * (n * p * (1 - p)) ** 0.5)


def content_of(text):
    return F.xxhash64(F.coalesce(text, F.lit("")))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, content (a hash of the text), n_shingles, digest of the set (null if empty), band keys, signature (16 bits each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = HashMemo()
        band = np.arange(BANDS, dtype=np.uint64)
        for batch in batches:
            rows = []
            for doc_id, text, content in zip(batch.column(0).to_pylist(), texts(batch.column(1)), batch.column(2).to_pylist()):
                found = shingles(text, memo)
                if not len(found):
                    rows.append((doc_id, content, 0, None, None, None))
                    continue
                least = minima(found)
                keys = band.copy()
                for k in range(ROWS):
                    keys = mix64(keys + least[k::ROWS])
                rows.append((doc_id, content, len(found), xxhash.xxh3_128_hexdigest(found.tobytes()), keys.view(np.int64), (least >> np.uint64(48)).astype("<u2").tobytes()))
            if rows:
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], ["doc_id", "content", "n_shingles", "digest", "keys", "signature"])

    return docs.select(F.col("doc_id").cast("long"), "text", content_of(F.col("text"))).mapInArrow(run, "doc_id long, content long, n_shingles long, digest string, keys array<long>, signature binary")


def agreeing(pairs: DataFrame, least: int) -> DataFrame:
    """(a, b) of the pairs with (sa, sb) whose signatures agree in at least so many places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(batch.num_rows, -1) for c in ("sa", "sb"))
                yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= least))

    return pairs.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs with texts (ta, tb) whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = HashMemo()
        last, of_last = None, None
        for batch in batches:
            good = []
            for x, y in zip(texts(batch.column(2)), texts(batch.column(3))):
                if x != last:
                    last, of_last = x, shingles(x, memo)
                other = shingles(y, memo)
                both = len(np.intersect1d(of_last, other, assume_unique=True))
                good.append(100 * both >= percent * (len(of_last) + len(other) - both))
            if good:
                yield batch.select(["a", "b"]).filter(pa.array(good))

    return pairs.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) for every node with a link; the component is its smallest node.

    Alternating large-star and small-star on (u, v) with u > v, a table for each
    round, until a round changes nothing.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct()
    mark, step = None, 0
    while True:
        edges = scratch.save(edges, f"{name}-{step}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if step:
            scratch.drop(f"{name}-{step - 1}")
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
        mark, step = now, step + 1
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter((F.col("v") > F.col("u")) & (F.col("v") != F.col("m"))).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
        edges = small.filter("u != v").distinct()


def confirm(pairs: DataFrame, docs: DataFrame, rows: DataFrame, classes: DataFrame, percent: int, scratch: Scratch, name: str) -> DataFrame:
    """(a, b) of the pairs that are links: by signature, then by the full sets of their texts."""
    sets = classes.select("node", "signature")
    sides = [sets.select(F.col("node").alias(n), F.col("signature").alias(f"s{n}")) for n in "ab"]
    likely = scratch.save(agreeing(pairs.join(sides[0], "a").join(sides[1], "b"), least_agreeing(percent)).distinct(), f"likely-{name}")
    nodes = likely.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    words = scratch.save(docs.select(F.col("doc_id").cast("long"), "text").join(nodes, "doc_id", "left_semi"), f"texts-{name}")
    # the end with more pairs is joined last, so that its rows lie together and its set is made once
    more = likely.select(F.col("a").alias("n")).union(likely.select("b")).groupBy("n").agg(F.count("*").alias("c"))
    weighed = likely.join(more.select(F.col("n").alias("a"), F.col("c").alias("_x")), "a").join(more.select(F.col("n").alias("b"), F.col("c").alias("_y")), "b")
    turned = weighed.select(F.when(F.col("_x") >= F.col("_y"), F.struct("a", "b")).otherwise(F.struct(F.col("b").alias("a"), F.col("a").alias("b"))).alias("e")).select("e.a", "e.b")
    texts_of = lambda n: words.select(F.col("doc_id").alias(n), F.col("text").alias(f"t{n}"))
    links = scratch.save(confirmed(turned.join(texts_of("b"), "b").join(texts_of("a"), "a"), percent).distinct(), f"links-{name}")
    scratch.drop(f"likely-{name}", f"texts-{name}")
    return links


def shingle_rows(docs: DataFrame) -> DataFrame:
    """(node, size, shingle) from (node, text, component) rows; component is carried along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = HashMemo()
        for batch in batches:
            got = [shingles(t, memo).view(np.int64) for t in texts(batch.column(1))]
            if got:
                size = pa.array([len(g) for g in got], pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), size, pa.array(got, pa.list_(pa.int64()))], ["node", "component", "size", "s"])

    arrays = docs.select("node", "text", "component").mapInArrow(run, "node long, component long, size int, s array<long>")
    return arrays.select("node", "component", "size", F.explode("s").alias("s"))


def prefix_pairs(docs: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(a, b) of (node, text, component) rows that may be similar, of different components.

    Exact: sets x and y, x not smaller, are similar only if they share at least
    need = percent / (100 + percent) * (|x| + |y|) shingles, so they have one in
    common among the first |x| - need + 1 and |y| - need + 1 of their rarest,
    and enough are left behind the first common one.
    """
    rows = scratch.save(shingle_rows(docs), "shingles")
    often = rows.groupBy("s").agg(F.count("*").alias("df"), F.min("component").alias("_x"), F.max("component").alias("_y"))
    often = often.select("s", "df", (F.col("_x") != F.col("_y")).alias("mixed"))
    place = F.row_number().over(W.partitionBy("node").orderBy("df", "s")) - 1
    placed = rows.join(often, "s").withColumn("at", place)
    first = F.col("size") - F.ceil(F.col("size") * percent / 100) + 1
    kept = scratch.save(placed.filter((F.col("at") < first) & F.col("mixed")).select("node", "component", "size", "s", "at"), "prefixes")
    x, y = (kept.select("s", *[F.col(c).alias(f"{n}_{c}") for c in ("node", "component", "size", "at")]) for n in "xy")
    need = F.ceil((F.col("x_size") + F.col("y_size")) * percent / (100 + percent))
    larger = (F.col("x_size") > F.col("y_size")) | ((F.col("x_size") == F.col("y_size")) & (F.col("x_node") > F.col("y_node")))
    enough = (F.col("x_size") - F.col("x_at") >= need) & (F.col("y_size") - F.col("y_at") >= need)
    close = F.col("y_size") * 100 >= F.col("x_size") * percent
    met = x.join(y, (x["s"] == y["s"]) & (F.col("x_component") != F.col("y_component")) & larger & close & enough)
    return met.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, content, n_shingles, class_id, n_links, component_id, kept: one row per row of docs.

    content is a hash of the text, class_id the smallest doc_id with the same set, n_links the links found of
    that class, component_id the smallest doc_id that links lead to, kept whether
    it is the row's own. Null, empty and word-less texts have no shingle and link
    to nothing. Rows with the same doc_id are one node, whose links are those of
    any of them; a null doc_id takes part through its text, and is kept only if
    nothing with an id is like it. An empty table gives no row; other columns
    are not read.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    rows = scratch.save(signatures(docs), "signatures")
    classes = rows.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("node"), F.any_value("keys").alias("keys"), F.any_value("signature").alias("signature"))
    classes = scratch.save(classes, "classes")
    bands = classes.filter("node IS NOT NULL").select("node", F.explode("keys").alias("bucket"))
    full = bands.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1")
    met = scratch.save(bands.join(full, "bucket"), "met")
    met = scratch.save(met.join(met.groupBy("node").agg(F.sum("members").alias("score")), "node"), "buckets")
    scratch.drop("met")
    # the pivot of each bucket; in a small one everyone
    pivots = met.groupBy("bucket").agg(F.max(F.struct("score", (-F.col("node")).alias("n"))).alias("p")).select("bucket", (-F.col("p.n")).alias("_p"))
    small = met.filter(F.col("members") <= SMALL).select("bucket", F.col("node").alias("_p"))
    starred = met.join(pivots.union(small).distinct(), "bucket").filter(F.col("node") != F.col("_p"))
    pairs = scratch.save(starred.select(F.least("node", "_p").alias("a"), F.greatest("node", "_p").alias("b")).distinct(), "pairs")
    links = confirm(pairs, docs, rows, classes, percent, scratch, "stars")
    of = scratch.save(components(links, scratch, "first"), "first")
    named = met.filter(F.col("members") > SMALL).select("node", "bucket").join(of, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = named.groupBy("bucket").agg(F.min("component").alias("_x"), F.max("component").alias("_y")).filter("_x != _y").select("bucket")
    mixed = scratch.save(named.join(several, "bucket", "left_semi").select("node", "component").distinct(), "mixed")
    if not mixed.isEmpty():
        held = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(mixed, "node")
        more = scratch.save(prefix_pairs(held, percent, scratch), "more")
        links = links.union(confirm(more, docs, rows, classes, percent, scratch, "rest"))
        of = scratch.save(components(links, scratch, "last"), "last")
        scratch.drop("shingles", "prefixes")
    degrees = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    named = classes.select("digest", "node").join(of, "node", "left").join(degrees, "node", "left")
    named = named.select(F.col("digest").alias("_d"), F.col("node").alias("class_id"), F.coalesce("component", "node").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = rows.select("doc_id", "content", "n_shingles", "digest").join(named, F.col("digest") == F.col("_d"), "left")
    whole = out.select("doc_id", "content", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return whole.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


#: The same in SQL: an inverted index of the shingles, then components by recursion.
ORACLE = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t-\r]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, g FROM (
  SELECT doc_id, array_to_string(ws[i : i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)
  UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 4)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {QUERY_PERCENT} * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(comp.component_id, w.doc_id) AS component_id, w.doc_id = coalesce(comp.component_id, w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN comp USING (doc_id)
"""
