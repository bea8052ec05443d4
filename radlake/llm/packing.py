"""Packing by shortest-pack-first over the length histogram.

Texts are encoded and cut into pieces of at most the sequence length. The
histogram of piece lengths (at most as many rows as the sequence length) goes to
the driver, where lengths are placed longest first, each into the shortest pack
it fits in; packs with the same content are one pattern with a count. Patterns
join back to the pieces by the piece's rank within its length.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import Scratch, texts
from .tokens import END, default_tokenizer, encoder_of

LENGTH = 2048
#: Pieces for each part in which a length is ranked, and the most parts.
RANKED, PARTS = 1000, 4096


def pack(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """[(((piece length, times), ...), sequences)] by shortest-pack-first.

    Placing one length splits at most one pattern and opens at most one, so
    there are at most 2 * length patterns, whatever the counts are.
    """
    heap: list[tuple[int, int, tuple[tuple[int, int], ...], int]] = []
    made = 0
    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            if heap and heap[0][0] + size <= length:
                used, _, content, count = heapq.heappop(heap)
                some = min(left, count)
                made += 1
                if some < count:
                    heapq.heappush(heap, (used, made, content, count - some))
                    made += 1
                if content and content[-1][0] == size:
                    content = (*content[:-1], (size, content[-1][1] + 1))
                else:
                    content = (*content, (size, 1))
                heapq.heappush(heap, (used + size, made, content, some))
            else:
                some = left
                made += 1
                heapq.heappush(heap, (size, made, ((size, 1),), some))
            left -= some
    return [(content, count) for _, _, content, count in sorted(heap)]


def slots(patterns: list[tuple[tuple[tuple[int, int], ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(piece length, first rank, end rank, sequences, first sequence, offset)."""
    rank: dict[int, int] = {}
    out, sequence = [], 0
    for content, count in patterns:
        offset = 0
        for size, times in content:
            low = rank.get(size, 0)
            rank[size] = low + times * count
            out.append((size, low, low + times * count, count, sequence, offset))
            offset += size * times
        sequence += count
    return out


def cut(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): the pieces of whole texts."""
    path = tokenizer or default_tokenizer()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                ids = encoder.encode(text) + END
                for at in range(0, len(ids), 4 * length):
                    piece = ids[at : at + 4 * length]
                    rows.append((doc_id, at // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pieces, ", ".join(f"{n} long" for n in names))


def pack_documents(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) per piece.

    Null and empty texts are one piece, the end id. Rows with the same doc_id are
    packed each on its own. An empty table gives no row; other columns are not
    read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    pieces = scratch.save(cut(docs, tokenizer, length), "pieces")
    histogram = {r.length: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``length`` rows
    table = slots(pack(histogram, length)) or [(0, 0, 0, 1, 0, 0)]
    # at most 2 * length patterns with 63 distinct lengths each, by pack() and 1 + 2 + ... + 63 <= 2048
    places = F.broadcast(spark.createDataFrame(table, "_size long, _low long, _high long, _count long, _sequence long, _offset long"))
    parts = max(1, min(PARTS, sum(histogram.values()) // RANKED))
    dealt = pieces.withColumn("_part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(parts)))
    counts = dealt.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("length").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    before = counts.select("length", "_part", before.alias("_before"))
    within = F.row_number().over(W.partitionBy("length", "_part").orderBy("doc_id", "start", "ids_crc32"))
    ranked = dealt.withColumn("_within", within).join(before, ["length", "_part"]).withColumn("_rank", F.col("_before") + F.col("_within") - 1)
    placed = ranked.join(places, (F.col("length") == F.col("_size")) & (F.col("_rank") >= F.col("_low")) & (F.col("_rank") < F.col("_high")))
    turn = F.col("_rank") - F.col("_low")
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("_sequence") + turn % F.col("_count")).alias("sequence_id"),
        (F.col("_offset") + F.floor(turn / F.col("_count")).cast("long") * F.col("length")).alias("offset"),
    )
