"""Mixing sources to target weights by hash-threshold histograms.

DataFrame functions only. Every document has a hash of its id and text. Per source the
words are summed by hash bucket; the bucket in which the running sum passes the
budget is refined by the next digits of the hash, and only its documents are
read for that. What lies below the threshold found is taken: a filter, no sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import Scratch

#: Hash digits (hexadecimal) by which a bucket is refined, and how often.
DIGITS, LEVELS = 3, 4
#: Rows of the plan per source, so that one source with most rows is spread.
SALTS = 32
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_of(doc_id, text):
    """The place of a document: null ids and ids that repeat are told apart by their text."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(" "), F.coalesce(text, F.lit("")))
    return F.substring(F.md5(key.cast("binary")), 1, DIGITS * LEVELS)


def ranked(sources: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds _r, the place of each source by code point, null last, from 0.

    Ranges of sources are numbered apart and moved by the sizes of the ranges
    before: the window over ranges has one row per partition.
    """
    ranged = sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("_part", F.spark_partition_id())
    ranged = scratch.save(ranged, "ranges")  # written: a partition keeps its number
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select(F.col("_part"), F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.row_number().over(W.partitionBy("_part").orderBy(F.col("source").asc_nulls_last())) - 1
    return ranged.withColumn("_w", within).join(before, "_part").withColumn("_r", F.col("_before") + F.col("_w")).drop("_part", "_w", "_before")


def targets(sources: DataFrame, scratch: Scratch, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """Adds target to (source, source_size): one row per source.

    Sources by code point, null last, take the weights in turn. A target above
    ``most`` times its source stops there and the rest is shared by weight: the
    targets are min(level * weight, most * size). The level rises, one small
    aggregate at a time, until no further source stops; sizes are whole numbers,
    so the level is the same quotient whatever the order of the sums.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_r") % len(weights) + 1).cast("int")).cast("double")
    at = ranked(sources, scratch).withColumn("_w", weight).withColumn("_cap", F.col("source_size").cast("double") * most).drop("_r")
    at, level, stopped = scratch.save(at, "weights"), 0.0, -1
    while True:
        full = F.col("_cap") < F.lit(level) * F.col("_w")
        free = F.sum(F.when(~full, F.col("_w")))
        got = at.agg(F.sum("source_size").cast("double") - F.coalesce(F.sum(F.when(full, F.col("_cap"))), F.lit(0.0)), free, F.count_if(full)).first()
        if got[1] is None or got[2] == stopped:
            break
        level, stopped = got[0] / got[1], got[2]
    return at.withColumn("target", F.least(F.lit(level) * F.col("_w"), F.col("_cap"))).drop("_w", "_cap")


def plan(sized: DataFrame, scratch: Scratch, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size, target, times, threshold, closed): one row per source.

    A document is taken ``times`` times, and once more if its hash is below the
    threshold, or equal to it and ``closed``.
    """
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), scratch, weights, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    at = sources.withColumn("times", whole)
    at = at.withColumn("need", F.col("target") - F.col("times") * F.col("source_size")).withColumn("threshold", F.lit(""))
    at = scratch.save(at, "budget0")
    for level in range(LEVELS):
        key = F.substring("h", level * DIGITS + 1, DIGITS)
        inside = sized.filter(F.col("size") > 0)
        if level:  # only the documents of the bucket that holds the boundary
            edge = at.select(F.col("source").alias("_s"), F.col("threshold").alias("_t"))
            inside = inside.join(edge, F.col("source").eqNullSafe(F.col("_s")) & (F.substring("h", 1, level * DIGITS) == F.col("_t")), "left_semi")
        histogram = inside.groupBy("source", key.alias("_key")).agg(F.sum("size").alias("_sum"))
        histogram = histogram.select(F.col("source").alias("_s"), "_key", "_sum", F.sum("_sum").over(W.partitionBy("source").orderBy("_key")).alias("_upto"))
        joined = at.join(histogram, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_upto") > F.col("need")), "left")
        first = F.min(F.struct("_key", "_sum", "_upto"))
        at = joined.groupBy("source", "source_size", "target", "times", "need", "threshold").agg(first.alias("_b"))
        rest = F.col("need") - (F.col("_b._upto") - F.col("_b._sum"))
        at = at.select(
            "source", "source_size", "target", "times", F.coalesce(rest, F.lit(0.0)).alias("need"),
            F.concat("threshold", F.coalesce("_b._key", F.lit(""))).alias("threshold"), F.coalesce("_b._sum", F.lit(0)).alias("_last"),
        )
        at = scratch.save(at, f"budget{level + 1}") if level == LEVELS - 1 else scratch.save(at.drop("_last"), f"budget{level + 1}")
    return at.select("source", "source_size", "target", "times", "threshold", (F.col("_last") - F.col("need") < F.col("need")).alias("closed"))


def take(docs: DataFrame, at: DataFrame) -> DataFrame:
    """Adds source_size, target and copies (how often it is taken) to rows with source and h."""
    salted = docs.withColumn("_salt", F.pmod(F.xxhash64("h"), F.lit(SALTS)).cast("int"))
    spread = at.withColumnRenamed("source", "_s").withColumn("_salt2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = salted.join(spread, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_salt") == F.col("_salt2")), "inner")
    once = (F.col("h") < F.col("threshold")) | ((F.col("h") == F.col("threshold")) & F.col("closed"))
    copies = F.col("times") + F.when(once, 1).otherwise(0)
    return joined.withColumn("copies", copies).drop("_salt", "_salt2", "_s", "times", "threshold", "closed")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for every row.

    Sizes are words; null text has none and a null source is a source of its
    own. Equal rows fall on the same side of a threshold. An
    empty table gives an empty result. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    sized = scratch.save(docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), hash_of(F.col("doc_id"), F.col("text")).alias("h")), "sized")
    taken = take(sized, plan(sized, scratch, weights, most))
    return taken.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE = f"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+'))::BIGINT AS size, substr(md5(coalesce(doc_id::VARCHAR, '') || ' ' || coalesce(text, '')), 1, {DIGITS * LEVELS}) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS r FROM s),
c AS (SELECT *, (r % 3 + 1)::DOUBLE AS w, 3 * source_size::DOUBLE AS cap FROM r),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER o, 0.0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0.0)) AS lv FROM c WINDOW o AS (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least((max(lv) OVER ()) * w, cap) AS target FROM l),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS times FROM t),
g AS (SELECT source, h, sum(size) AS s FROM sized WHERE size > 0 GROUP BY source, h),
u AS (SELECT source, h, s, sum(s) OVER (PARTITION BY source ORDER BY h) AS upto FROM g),
e AS (SELECT u.source, h, s, b.target - b.times * b.source_size - (upto - s) AS rest, row_number() OVER (PARTITION BY u.source ORDER BY h) AS k
      FROM u JOIN b ON u.source IS NOT DISTINCT FROM b.source WHERE upto > b.target - b.times * b.source_size)
SELECT d.doc_id, d.size, b.source_size, b.target,
       (d.size * (b.times + CASE WHEN d.h < e.h OR (d.h = e.h AND e.s - e.rest < e.rest) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized d JOIN b ON d.source IS NOT DISTINCT FROM b.source LEFT JOIN e ON e.k = 1 AND d.source IS NOT DISTINCT FROM e.source
"""
