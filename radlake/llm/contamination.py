"""Benchmark decontamination by Wu-Manber search for many strings at once, over words.

The strings are the windows of the benchmark's items. For strings of m words and
blocks of two words, the shift table says of each block that a string holds how
far the place may move until the block can end a string; every other block moves
it by m - 1 words. Where the shift is zero, the block selects a bucket of strings
that end with it, the first block narrows the bucket, and words are compared.

The strings are held by every task, so one pass takes at most SLICE words of
them; a larger benchmark is searched for in several passes, and the spans of a
text are merged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Scratch, texts

#: Words of a window.
WINDOW = 10
#: Words of windows that one pass holds, and of an item that one segment has.
SLICE, SEGMENT = 200_000, 2_000
#: Bytes of a text that are words at a time.
BLOCK = 1 << 20
#: Bytes that aren't in [^\x00-\x2F\x3A-\x60\x7B-\x7F] become spaces; A-Z become lower case before.
_WORDS = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in LOWER)


def words_of(text: bytes, block: int = BLOCK) -> Iterator[list[bytes]]:
    """The words of a text, of some ``block`` bytes at a time."""
    rest: list[bytes] = []
    for at in range(0, len(text), block):
        piece = text[at : at + block].translate(_WORDS)
        whole = piece if at + block >= len(text) else piece[: piece.rfind(b" ") + 1]
        if whole:
            yield b"".join([*rest, whole]).split()
            rest = []
        rest.append(piece[len(whole) :])


class Strings:
    """Tables for strings of m words: shifts by block, and strings by last and first block."""

    def __init__(self, m: int):
        self.m, self.width = m, min(2, m)
        self.most = m - self.width + 1
        self.shift: dict[bytes, int] = {}
        self.buckets: dict[bytes, dict[bytes, dict[bytes, set[str]]]] = {}

    def add(self, words: list[bytes], item: str | None) -> None:
        blocks = self.blocks(words)
        for k, block in enumerate(blocks):
            left = len(blocks) - 1 - k
            if left < self.shift.get(block, self.most):
                self.shift[block] = left
        held = self.buckets.setdefault(blocks[-1], {}).setdefault(blocks[0], {}).setdefault(b" ".join(words), set())
        if item is not None:
            held.add(item)

    def blocks(self, words: list[bytes]) -> list[bytes]:
        return words if self.width == 1 else list(map(b" ".join, zip(words, words[1:])))

    def occurrences(self, words: list[bytes]) -> Iterator[tuple[int, set[str]]]:
        """(number of the first word, items) of every place where a string stands."""
        m, width, most, shift = self.m, self.width, self.most, self.shift
        last = m - width  # the first place of a block that can end a string
        every = words[last::most] if width == 1 else map(b" ".join, zip(words[last::most], words[last + 1 :: most]))
        # places that are ``most`` apart rule out those between them if no string holds their block
        for k, block in enumerate(every):
            if block not in shift:
                continue
            at, end = last + k * most, min(last + (k + 1) * most, len(words) - width + 1)
            while at < end:
                block = b" ".join(words[at : at + width])
                step = shift.get(block, most)
                if not step:
                    start = at - last
                    bucket = self.buckets[block].get(b" ".join(words[start : start + width]))
                    items = bucket.get(b" ".join(words[start : start + m])) if bucket else None
                    if items is not None:
                        yield start, items
                at += step or 1


class Searcher:
    """All windows of one pass, by their length."""

    def __init__(self, windows: list[tuple[str | None, list[bytes]]], window: int):
        self.by_length: dict[int, Strings] = {}
        for item, words in windows:
            m = min(window, len(words))
            strings = self.by_length.setdefault(m, Strings(m))
            for k in range(len(words) - m + 1):
                strings.add(words[k : k + m], item)
        self.reach = max(self.by_length, default=1) - 1

    def search(self, text: bytes, block: int = BLOCK) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Words, spans of hit words (first, one after the last; apart from each other), items."""
        spans: list[list[int]] = []
        items: set[str] = set()
        carried: list[bytes] = []
        before = 0  # words before the carried ones
        for words in words_of(text, block):
            words = carried + words
            for strings in self.by_length.values():
                for start, own in strings.occurrences(words):
                    items |= own
                    start += before
                    if spans and spans[-1][0] <= start <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], start + strings.m)
                    else:
                        spans.append([start, start + strings.m])
            carried = words[-self.reach :] if self.reach else []
            before += len(words) - len(carried)
        return before + len(carried), merged([(a, b) for a, b in spans]), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def digest_of(items: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def segments(benchmark: DataFrame, window: int, length: int) -> DataFrame:
    """(item, words, n): the items' words joined by spaces, long items in segments that share window - 1 words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                held: list[bytes] = []
                some = False
                for words in words_of(text):
                    held += words
                    while len(held) >= length + window:
                        yield pa.RecordBatch.from_pydict({"item": pa.array([item], pa.string()), "words": [b" ".join(held[: length + window - 1])], "n": [length + window - 1]})
                        held, some = held[length:], True
                if held and (not some or len(held) >= window):
                    yield pa.RecordBatch.from_pydict({"item": pa.array([item], pa.string()), "words": [b" ".join(held)], "n": [len(held)]})

    return benchmark.select(F.col("item_id").cast("string"), "text").mapInArrow(run, "item string, words binary, n long")


def searched(docs: DataFrame, searcher: Searcher, block: int) -> DataFrame:
    """doc_id, digest of the text, n_words, spans, items of each row."""
    span = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(doc_id, hashlib.sha256(text).digest(), *searcher.search(text, block)) for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)))]
            if rows:
                ids, digests, n, spans, items = zip(*rows)
                flat = [[v for pair in s for v in pair] for s in spans]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.binary()), pa.array(n, pa.int64()), pa.array(flat, span), pa.array([sorted(i) for i in items], pa.list_(pa.string()))], ["doc_id", "digest", "n_words", "spans", "items"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, digest binary, n_words long, spans array<long>, items array<string>")


def finished(found: DataFrame) -> DataFrame:
    """The results of rows with doc_id, n_words, spans and items; spans that overlap are merged."""
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"]
    span = pa.list_(pa.struct([("first_word", pa.int64()), ("n_words", pa.int64())]))
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), span]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, n, flat, items in zip(*(c.to_pylist() for c in batch.columns)):
                spans = merged(list(zip(flat[::2], flat[1::2])))
                hit, own = sum(b - a for a, b in spans), set(items)
                rows.append((doc_id, n, hit, len(own), digest_of(own), hit > 0, [{"first_word": a, "n_words": b - a} for a, b in spans]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    sql = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<first_word:long,n_words:long>>"
    return found.select("doc_id", "n_words", "spans", "items").mapInArrow(run, sql)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slice_words: int = SLICE, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans per row of docs.

    A window is ``window`` consecutive words of an item; an item with fewer words
    is one window, one without words none. n_hit: words inside any occurrence of a
    window; n_items: items with an occurring window; items_sha256: of their ids as
    strings, sorted, joined by commas; spans: maximal runs of hit words. Null and
    empty texts have no words. Items without an id hit words and are not counted;
    rows that share an item_id are one item. Repeated documents give repeated
    results, documents without an id a result without one; an empty table of
    documents gives no row, an empty benchmark hits nothing; other columns are
    not read. The windows are counted first: more than ``slice_words`` words of
    them are searched for in several passes.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "contamination")
    held = scratch.save(segments(benchmark, window, min(SEGMENT, max(window, slice_words // 2))).distinct(), "segments")
    total = held.agg(F.sum("n")).head()[0] or 0
    passes = max(1, -(-total * 2 // slice_words))  # a slice by hash holds half of what it may, on average
    numbered = held.withColumn("slice", F.pmod(F.xxhash64("item", "words"), F.lit(passes)))
    found = None
    for k in range(passes):
        rows = numbered.filter(F.col("slice") == k).select("item", "words").collect()  # bounded by the size of a slice
        now = searched(docs, Searcher([(r.item, bytes(r.words).split()) for r in rows], window), block)
        if passes == 1:
            return finished(now)
        hits = now.filter(F.size("spans") > 0).groupBy("digest").agg(F.first("spans").alias("spans"), F.first("items").alias("items"))
        hits = scratch.save(hits, f"hits{k}")
        found = hits if found is None else found.union(hits)
    spans, items = F.flatten(F.collect_list("spans")), F.array_distinct(F.flatten(F.collect_list("items")))
    merged_hits = found.groupBy("digest").agg(spans.alias("spans"), items.alias("items"))
    every = searched(docs, Searcher([], window), block).select("doc_id", "digest", "n_words")
    joined = every.join(merged_hits, "digest", "left")
    return finished(joined.select("doc_id", "n_words", F.coalesce("spans", F.array().cast("array<long>")).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items")))


ORACLE = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, m, array_to_string(w[k : k + m - 1], ' ') AS s
  FROM (SELECT item_id, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM items WHERE len(w) > 0)
), places AS (
  SELECT doc_id, m, k, array_to_string(w[k : k + m - 1], ' ') AS s
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM words, (SELECT DISTINCT m FROM windows) WHERE len(w) >= m)
), found AS (
  SELECT doc_id, k, m, item_id FROM places JOIN windows USING (m, s)
), hit AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + m)) AS j FROM found) GROUP BY doc_id
), own AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM found) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN own USING (doc_id)
"""
