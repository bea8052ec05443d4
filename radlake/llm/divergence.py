"""Source divergence audit: how the terms of each source of a language differ from
the language's and from those of the other sources.

Terms are counted by (language, source) with partial sums in every task. Of a
language the V terms stand that enough of its documents hold, and each group
gives each of them p = 1 + floor(SCALE * (count + 2) / (N + 2 V)); f of two such
numbers is floor((p - q)^2 / (p + q)), all in integers.

Pairs of sources: where neither source has a term, f is that of the two baselines
(the p of no occurrence), which counts V times; only terms that one of the two
has are looked at, and each corrects the baseline by the difference. The terms
of a language are dealt out by hash, sources in blocks, so no task holds all
terms, nor all sources.

Top terms by radix selection: histograms over the digits of the value, the highest
first, find each group's k-th largest value; of the terms that have just this
value, histograms over bytes of their UTF-8, past the prefix that all share, find
the first ones. No group is sorted.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import LOWER, Scratch, texts

#: Documents of a language that a term needs; ranks of terms; parts of one.
LEAST, TOP, SCALE = 10, 10, 1_000_000_000
#: Bits of a value (below SCALE + 2) and of a digit; rows of a group under which ties are few.
BITS, DIGIT, FEW = 30, 10, 1000
#: Terms that a task counts before it hands them on; rows of a bucket of terms; sources of a block.
HELD, BUCKET, SOURCES = 400_000, 20_000, 128
#: Bytes of a text that are terms at a time.
BLOCK = 1 << 20
#: Bytes that aren't in [^\x00-\x40\x5B-\x60\x7B-\x7F] become spaces; A-Z become lower case before.
_TERMS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in LOWER)
GROUP = ["lang", "source"]


def terms_of(text: bytes) -> Counter[bytes]:
    """How often a text holds each term."""
    counts: Counter[bytes] = Counter()
    rest: list[bytes] = []
    for at in range(0, len(text), BLOCK):
        piece = text[at : at + BLOCK].translate(_TERMS)
        whole = piece if at + BLOCK >= len(text) else piece[: piece.rfind(b" ") + 1]
        if whole:
            counts.update(b"".join([*rest, whole]).split())
            rest = []
        rest.append(piece[len(whole) :])
    return counts


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): partial sums of occurrences and documents, by task."""
    names = ["lang", "source", "term", "n", "docs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, d) in sums.items():
                columns = [pa.array([lang] * len(n), pa.string()), pa.array([source] * len(n), pa.string()), pa.array(list(n), pa.binary()).cast(pa.string()), pa.array(list(n.values()), pa.int64()), pa.array(list(d.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names)
            sums.clear()

        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2))):
                n, d = sums.setdefault((lang, source), (Counter(), Counter()))
                before, own = len(n), terms_of(text)
                n.update(own)
                d.update(own.keys())  # in the order of n
                held += len(n) - before
                if held >= HELD:
                    yield from out()
                    held = 0
        yield from out()

    return docs.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def share(n: str, total: str, terms: str) -> str:
    """SQL of p, exact."""
    return f"1 + (CAST({n} AS DECIMAL(19, 0)) + 2) * {SCALE} DIV (CAST({total} AS DECIMAL(19, 0)) + 2 * CAST({terms} AS DECIMAL(19, 0)))"


def apart(p: str, q: str) -> str:
    """SQL of f."""
    return f"({p} - {q}) * ({p} - {q}) DIV ({p} + {q})"


def kept_terms(docs: DataFrame, least: int) -> DataFrame:
    """(lang, source, term, n, lang_n, head): terms of enough documents of their language; head: one row of each term."""
    # tasks have summed up already; one shuffle by term serves the sums by source and those over sources
    sums = counted(docs).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = W.partitionBy("lang", "term")  # as many rows as sources have the term
    with_sums = sums.withColumn("lang_n", F.sum("n").over(term)).withColumn("lang_docs", F.sum("docs").over(term)).withColumn("head", F.row_number().over(term.orderBy("source")) == 1)
    return with_sums.filter(F.col("lang_docs") >= least).drop("docs", "lang_docs")


def groups_of(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Every (lang, source): k (its number), total (N), p0 (of no occurrence), terms (V), lang_total, blocks and buckets of the language."""
    sums = kept.groupBy(*GROUP).agg(F.sum("n").alias("total"), F.count("*").alias("rows"), F.sum(F.col("head").cast("long")).alias("heads"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    every = docs.select(*GROUP).distinct().join(sums, GROUP, "left").select(*GROUP, zero("total"), zero("rows"), zero("heads"))
    lang = W.partitionBy("lang")  # as many rows as sources
    out = every.select(
        *GROUP, (F.row_number().over(lang.orderBy("source")) - 1).alias("k"), "total", F.sum("heads").over(lang).alias("terms"), F.sum("total").over(lang).alias("lang_total"),
        F.ceil(F.count("*").over(lang) / SOURCES).alias("blocks"), F.greatest(F.ceil(F.sum("rows").over(lang) / BUCKET), F.lit(1)).alias("buckets"),
    )
    return out.withColumn("p0", F.expr(f"CASE WHEN terms > 0 THEN {share('0', 'total', 'terms')} END"))


def corrections(p: list[np.ndarray], at: list[np.ndarray], p0: np.ndarray, terms: int, pairs: list[tuple[int, np.ndarray]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For (s, others): (s, others, sums of f less the baselines' f over the terms that one of the two has).

    p, at: of each source, the numbers and the terms it has; p0: the baselines.
    """
    whole = np.repeat(p0[:, None], terms, axis=1)
    has = np.zeros(whole.shape, bool)
    for k, (x, places) in enumerate(zip(p, at)):
        whole[k, places], has[k, places] = x, True
    f = lambda x, y: (x - y) ** 2 // (x + y)
    for s, others in pairs:
        base = f(p0[s], p0[others])
        own = np.array([f(p[s], whole[t, at[s]]).sum() for t in others], np.int64)
        union = np.full(len(others), len(at[s]), np.int64)
        for n, t in enumerate(others):
            alone = p[t][~has[s, at[t]]]
            own[n] += f(p0[s], alone).sum()
            union[n] += len(alone)
        yield s, others, own - union * base


def pair_sums(scored: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, k, other, delta): for k < other, what the terms add to the baselines' V times f."""
    key = ["lang", "a", "b", "bucket"]
    block = F.floor(F.col("k") / SOURCES)
    met = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    own = lambda df: df.withColumn("x", block).withColumn("y", met).withColumn("a", F.least("x", "y")).withColumn("b", F.greatest("x", "y"))
    rows = own(scored.withColumn("bucket", F.pmod(F.xxhash64("term"), "buckets"))).select(*key, "k", "p", "term")
    markers = groups.filter("terms > 0").withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("buckets") - 1)))
    markers = own(markers).select(*key, "k", F.col("p0").alias("p"), F.lit(None).cast("string").alias("term"))

    def run(group: pa.Table) -> pa.Table:
        lang, a, b = (group.column(c)[0].as_py() for c in ("lang", "a", "b"))
        term = group.column("term").combine_chunks().dictionary_encode()
        code = term.indices.fill_null(-1).to_numpy()
        k, p = group.column("k").to_numpy().astype(np.int64), group.column("p").to_numpy()
        ids = np.unique(k[code < 0])  # every source has a marker
        p0 = np.empty(len(ids), np.int64)
        p0[np.searchsorted(ids, k[code < 0])] = p[code < 0]
        order = np.argsort(k[code >= 0], kind="stable")
        k, p, code = k[code >= 0][order], p[code >= 0][order], code[code >= 0][order]
        cut = np.searchsorted(k, ids, side="left"), np.searchsorted(k, ids, side="right")
        rows, at = [p[i:j] for i, j in zip(*cut)], [code[i:j] for i, j in zip(*cut)]
        places = np.arange(len(ids))
        first = places[ids // SOURCES == a]
        pairs = [(int(s), places[(places > s) & (ids // SOURCES == b)]) for s in first]
        found = [(ids[np.full(len(o), s)], ids[o], d) for s, o, d in corrections(rows, at, p0, len(term.dictionary), pairs) if len(o)]
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 3
        return pa.Table.from_arrays([pa.array([lang] * len(columns[0]), pa.string()), *(pa.array(c, pa.int64()) for c in columns)], ["lang", "k", "other", "delta"])

    parts = rows.unionByName(markers).groupBy(*key).applyInArrow(run, "lang string, k long, other long, delta long")
    return parts.groupBy("lang", "k", "other").agg(F.sum("delta").alias("delta"))


def pairs_of(scored: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value of every source and other source of a language."""
    left = groups.select("lang", "source", "k", "p0", "terms")
    right = groups.select("lang", F.col("source").alias("item"), F.col("k").alias("other"), F.col("p0").alias("q0"))
    base = left.join(right, "lang").filter("k < other")
    both = base.join(pair_sums(scored, groups), ["lang", "k", "other"], "left")
    value = F.expr(f"CASE WHEN terms > 0 THEN terms * ({apart('p0', 'q0')}) + coalesce(delta, 0) ELSE 0L END").alias("value")
    half = both.select("lang", "source", "item", value)
    return half.union(half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))


def boundary(histogram: DataFrame, bucket: str, ascending: bool) -> DataFrame:
    """GROUP, bucket, need, n: the bucket in which the need-th row lies, how many of its n rows are still needed. histogram: GROUP, bucket, n, need."""
    order = F.col(bucket).asc() if ascending else F.col(bucket).desc()
    before = F.coalesce(F.sum("n").over(W.partitionBy(*GROUP).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    here = histogram.withColumn("before", before).filter((F.col("before") < F.col("need")) & (F.col("before") + F.col("n") >= F.col("need")))
    return here.select(*GROUP, bucket, (F.col("need") - F.col("before")).alias("need"), "n")


def top_values(values: DataFrame, top: int, scratch: Scratch, few: int = FEW) -> DataFrame:
    """The first ``top`` rows of (lang, source, term, value) in each group: largest value, then smallest term by bytes. Values are below 2**BITS."""
    state = None
    for shift in range(BITS - DIGIT, -1, -DIGIT):  # the digits, highest first
        digit = F.shiftright("value", shift).alias("digit")
        if state is None:
            counts = values.groupBy(*GROUP, digit).agg(F.count("*").alias("n")).withColumn("need", F.lit(top).cast("long"))
        else:
            inside = values.join(state.select(*GROUP, F.col("digit").alias("_d"), "need"), GROUP).filter(F.shiftright("value", shift + DIGIT) == F.col("_d"))
            counts = inside.groupBy(*GROUP, digit, "need").agg(F.count("*").alias("n"))
        state = scratch.save(boundary(counts, "digit", False), f"digit{shift}")
    edge = state.select(*GROUP, F.col("digit").alias("edge"), "need", "n")  # groups of fewer rows have none
    columns = [*GROUP, "term", "value"]
    met = values.join(edge, GROUP, "left")
    taken = scratch.save(met.filter("edge IS NULL OR value > edge OR value = edge AND n = need").select(*columns), "above")
    ties = scratch.save(met.filter("value = edge AND n > need").select(*columns, "need", "n"), "ties")
    step = 0
    while not ties.filter(F.col("n") > few).isEmpty():
        # past the bytes that all ties of a group share, two bytes are a digit
        ends = ties.groupBy(*GROUP).agg(F.min("term").alias("lo"), F.max("term").alias("hi"))
        differs = "array_position(transform(sequence(1, least(octet_length(lo), octet_length(hi)) + 1), i -> substring(encode(lo, 'UTF-8'), i, 1) <> substring(encode(hi, 'UTF-8'), i, 1)), true)"
        digits = ties.join(ends.select(*GROUP, F.expr(differs).alias("at")), GROUP).withColumn("digit", F.expr("substring(encode(term, 'UTF-8'), int(at), 2)"))
        digits = scratch.save(digits.drop("at", "n"), f"bytes{step}")
        edge = boundary(digits.groupBy(*GROUP, "digit", "need").agg(F.count("*").alias("n")), "digit", True).select(*GROUP, F.col("digit").alias("edge"), F.col("need").alias("left"), "n")
        met = digits.join(scratch.save(edge, f"edge{step}"), GROUP)
        taken = taken.union(met.filter("digit < edge OR digit = edge AND n = left").select(*columns))
        ties = scratch.save(met.filter("digit = edge AND n > left").select(*columns, F.col("left").alias("need"), "n"), f"ties{step}")
        step += 1
    rank = F.row_number().over(W.partitionBy(*GROUP).orderBy("term"))  # few rows
    return taken.union(ties.withColumn("_k", rank).filter("_k <= need").select(*columns))


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: what sets each source of a language apart.

    Part ``pair``: for each other source of the language f summed over all kept
    terms. Part ``term``: the first ``top`` kept terms that the source has and
    holds more of than the language, by f. Null lang, source and text are empty;
    a source without terms has the baselines; a language without kept terms has
    pairs of 0; a source alone in its language has no pair. Repeated rows are
    documents of their own; ids and other columns are not read; an empty table
    gives no row.
    """
    scratch = Scratch(docs.sparkSession, "audit")
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    docs = docs.select(blank("lang"), blank("source"), blank("text"))
    kept = scratch.save(kept_terms(docs, least), "kept")
    groups = scratch.save(groups_of(docs.select(*GROUP), kept), "groups")
    numbers = groups.select(*GROUP, "k", "total", "terms", "lang_total", "blocks", "buckets")
    scored = kept.join(numbers, GROUP).select(*GROUP, "k", "blocks", "buckets", "term", F.expr(share("n", "total", "terms")).alias("p"), F.expr(share("lang_n", "lang_total", "terms")).alias("q"))
    scored = scratch.save(scored, "scored")
    more = scratch.save(scored.filter("p > q").select(*GROUP, "term", F.expr(apart("p", "q")).alias("value")), "more")
    pairs = pairs_of(scored, groups).select(*GROUP, F.lit("pair").alias("part"), "item", "value")
    terms = top_values(more, top, scratch).select(*GROUP, F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    rank = F.row_number().over(W.partitionBy(*GROUP, "part").orderBy(F.col("value").desc(), "item"))  # as many rows as sources, or top
    return pairs.union(terms).withColumn("rank", rank)


ORACLE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), words AS (
  SELECT d, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (
  SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= 10
), groups AS (
  SELECT DISTINCT lang, source FROM docs
), counts AS (
  SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN kept USING (lang, term) GROUP BY ALL
), dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n, k.n::HUGEINT AS lang_n
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), p AS (
  SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER g + 2 * count(*) OVER g)::HUGEINT AS p,
         1 + (1000000000::HUGEINT * (lang_n + 2)) // (sum(lang_n) OVER g + 2 * count(*) OVER g)::HUGEINT AS q
  FROM dense WINDOW g AS (PARTITION BY lang, source)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL
), every AS (
  SELECT lang, source, 'pair' AS part, item, coalesce(value, 0)::BIGINT AS value FROM pairs
  UNION ALL
  SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM every
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""
