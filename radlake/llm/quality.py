"""Quality rules: counts in the text, and line frequency across documents.

A line of any length is normalised (ASCII lower case, one space between words)
and hashed. Per host (source) the distinct documents that hold it are counted,
and the distinct texts. A line above the limit is removed; a document left with
too few words is depleted and rejected.

A text that was copied very often is above the limit with all its lines, though
it is no boilerplate. So a document is rejected for the lines that more texts
than the limit hold; one that only lines of fewer texts would deplete keeps
these, and near-duplicate removal decides about the copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, HashMemo, Scratch, texts, windows

#: Documents of a host that may share a line.
LINE_LIMIT = 50
#: Words, and hundredths of its words, that a document must keep.
LEAST_WORDS, LEAST_SHARE = 20, 20
#: Words of a window, for n_repeat_words.
WINDOW = 8
SYMBOLS = b"#*$%&|<>"
SALTS = 16

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SCHEMA = "doc_id long, source string, content long, " + ", ".join(f"{c} long" for c in COUNTS) + ", lines array<long>, line_words array<int>"


def repeated_words(hashes: np.ndarray, n: int = WINDOW) -> int:
    """Words that lie in an n-word window found twice or more, the first included."""
    w = windows(hashes, n)
    if len(w) < 2:
        return 0
    order = np.argsort(w, kind="stable")
    same = w[order[1:]] == w[order[:-1]]
    if not same.any():
        return 0
    again = np.zeros(len(w), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    edges = np.zeros(len(hashes) + 1, np.int64)
    starts = np.flatnonzero(again)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + n, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def key_of(words: list[bytes]) -> int:
    """The hash of a normalised line."""
    return xxhash.xxh3_64_intdigest(b" ".join(words).translate(LOWER)) - (1 << 63)


def measure(text: bytes, memo: HashMemo) -> tuple[list[int], list[int], list[int]]:
    """COUNTS, and the distinct normalised lines with their words in all."""
    words = text.split()
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode())
    seen: set[bytes] = set()
    whole: dict[int, int] = {}
    dup = 0
    for line in text.split(b"\n"):
        of_line = line.split()
        if not of_line:
            continue
        if line in seen:
            dup += 1
        else:
            seen.add(line)
        key = key_of(of_line)
        whole[key] = whole.get(key, 0) + len(of_line)
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    repeat = repeated_words(memo.of(words)) if len(words) > WINDOW else 0
    return [len(words), chars, symbols, dup, repeat], list(whole), list(whole.values())


def without_lines(text: Column, lines: Column) -> Column:
    """The text without the lines whose hashes are given; as it is if none are."""

    @F.pandas_udf("string")
    def cut(values: pd.Series, hashes: pd.Series) -> pd.Series:
        out = []
        for value, gone in zip(values, hashes):
            if value is None or gone is None:
                out.append(None)
                continue
            drop = set(gone.tolist())
            kept = [x for x in value.encode().split(b"\n") if not (w := x.split()) or key_of(w) not in drop]
            out.append(b"\n".join(kept).decode())
        return pd.Series(out, dtype=object)

    some = F.size(lines) > 0
    return F.when(some, cut(F.when(some, text), F.when(some, lines))).otherwise(text)


def content_of(text):
    return F.xxhash64(F.coalesce(text, F.lit("")))


def measured(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = HashMemo()
        for batch in batches:
            rows = []
            for doc_id, text, source, content in zip(batch.column(0).to_pylist(), texts(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                counts, keys, n = measure(text, memo)
                rows.append((doc_id, source, content, *counts, keys, n))
            if rows:
                types = [pa.int64(), pa.string(), *[pa.int64()] * 6, pa.list_(pa.int64()), pa.list_(pa.int32())]
                names = ["doc_id", "source", "content", *COUNTS, "lines", "line_words"]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)

    return docs.select(F.col("doc_id").cast("long"), "text", F.col("source").cast("string"), content_of(F.col("text"))).mapInArrow(run, SCHEMA)


def quality(docs: DataFrame, line_limit: int = LINE_LIMIT, spare_copies: bool = True) -> DataFrame:
    """doc_id, source, content (a hash of the text), the counts, n_left (words without removed lines), frequent_lines (hashes of the lines to remove from it), base_failed, kept.

    One row per row of docs. Documents are rows that differ in doc_id or text.
    Null text is empty and fails; a null source is a host of its own; rows with
    the same doc_id are told apart by their text, and equal rows get equal
    results; an empty table gives no row; other columns are not read.

    spare_copies: a document that is only depleted by lines which more than
    line_limit documents but at most line_limit different texts hold (so by copies
    of itself) keeps these lines and is not rejected. False: such lines count as
    all others, and every copy of a text that was copied that often goes.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    rows = scratch.save(measured(docs), "measured")
    lines = rows.select("doc_id", "source", "content", F.explode(F.arrays_zip("lines", "line_words")).alias("_l"))
    lines = lines.select("doc_id", "source", "content", F.col("_l.lines").alias("line"), F.col("_l.line_words").alias("words"))
    held = lines.select("source", "line", "content", "doc_id").distinct().groupBy("source", "line", "content").agg(F.count("*").alias("_n"))
    often = held.groupBy("source", "line").agg(F.sum("_n").alias("_documents"), F.count("*").alias("_texts")).filter(F.col("_documents") > line_limit)
    often = often.select(F.col("source").alias("_s"), F.col("line").alias("_line"), (F.col("_texts") > line_limit).alias("_strong"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    salted = lines.withColumn("_to", F.pmod("content", F.lit(SALTS)).cast("int"))
    hits = salted.join(often, F.col("source").eqNullSafe(F.col("_s")) & (F.col("line") == F.col("_line")) & (F.col("_to") == F.col("_salt")))
    hits = hits.groupBy(F.col("doc_id").alias("_d"), F.col("source").alias("_h"), F.col("content").alias("_c"), "line", "_strong").agg(F.max("words").alias("_w"))
    strong = F.when(F.col("_strong"), F.col("_w")).otherwise(0)
    removed = hits.groupBy("_d", "_h", "_c").agg(
        F.sum("_w").alias("_all"), F.sum(strong).alias("_some"), F.collect_list("line").alias("_lines"), F.collect_list(F.when(F.col("_strong"), F.col("line"))).alias("_fewer")
    )  # a list holds lines of one text
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("source").eqNullSafe(F.col("_h")) & (F.col("content") == F.col("_c"))
    out = rows.drop("lines", "line_words").join(removed, same, "left")
    depleted = lambda n: (F.col("n_words") - n < LEAST_WORDS) | (100 * (F.col("n_words") - n) < LEAST_SHARE * F.col("n_words"))
    if not spare_copies:
        out = out.withColumns({"_some": F.col("_all"), "_fewer": F.col("_lines")})
    spared = depleted(F.col("_all")) & ~depleted(F.col("_some"))
    out = out.withColumn("_lost", F.when(spared, F.col("_some")).otherwise(F.col("_all"))).withColumn("_gone", F.when(spared, F.col("_fewer")).otherwise(F.col("_lines")))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rejected = (F.coalesce("_some", F.lit(0)) > 0) & depleted(F.coalesce("_some", F.lit(0)))
    return out.select(
        "doc_id", "source", "content", *COUNTS, (F.col("n_words") - F.coalesce("_lost", F.lit(0))).alias("n_left"), F.coalesce("_gone", F.array().cast("array<long>")).alias("frequent_lines"),
        failed.alias("base_failed"), (~failed & ~rejected).alias("kept"),
    )


#: The same in SQL; lines themselves instead of their hashes.
ORACLE = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, regexp_extract_all(text, '[^ \t-\r]+') AS ws, string_split(text, chr(10)) AS ls FROM d),
grams AS (SELECT doc_id, i, array_to_string(ws[i : i + {WINDOW - 1}], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w WHERE len(ws) >= {WINDOW})),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, range({WINDOW}) t(k) GROUP BY doc_id),
lines AS (SELECT doc_id, source, text, unnest(ls) AS line FROM w),
worded AS (SELECT *, regexp_extract_all(line, '[^ \t-\r]+') AS lw FROM lines),
dup AS (SELECT doc_id, sum(c - 1) AS n FROM (SELECT doc_id, line, count(*) AS c FROM worded WHERE len(lw) > 0 GROUP BY doc_id, line) GROUP BY doc_id),
lined AS (SELECT doc_id, source, text, translate(array_to_string(lw, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line, len(lw) AS n FROM worded WHERE len(lw) > 0),
often AS (SELECT source, line, count(DISTINCT text) > {LINE_LIMIT} AS strong FROM lined GROUP BY source, line HAVING count(DISTINCT (doc_id, text)) > {LINE_LIMIT}),
gone AS (SELECT doc_id, text, sum(n) FILTER (strong) AS n FROM lined s JOIN often o ON o.line = s.line AND o.source IS NOT DISTINCT FROM s.source GROUP BY doc_id, text),
r AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, len(array_to_string(ws, ''))::BIGINT AS word_chars, len(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
      coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words, gone.n AS removed
      FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN gone USING (doc_id, text))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT (removed IS NOT NULL AND (n_words - removed < {LEAST_WORDS} OR 100 * (n_words - removed) < {LEAST_SHARE} * n_words)) AS kept
FROM r
"""
