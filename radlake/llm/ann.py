"""Nearest neighbours by shifted space-filling curves.

Vectors are projected at random to a few dimensions, shifted, and ordered along a
Hilbert curve, several times over. Each order is range-partitioned and cut into
blocks of neighbouring keys. A query meets its own block and the two beside it
on every curve; the best of all are merged and reranked on the original vectors.

On vectors without low-dimensional structure no curve finds all neighbours, so
the stated queries are then held against the blocks of the first curve: a block
is skipped if no vector in it can beat what a query has, by the angle between
the query and the block's centre and the block's radius. Blocks stay in tiles of
neighbours, which are shuffled once; the queries, a small share of the rows, go
to every tile. Vectors of different lengths never meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import Scratch

#: Curves; dimensions and bits of a key; vectors of a block.
CURVES, DIMENSIONS, BITS, BLOCK = 4, 8, 7, 256
NEAREST, EVERY = 5, 50
#: Queries that travel together; blocks of a tile, and tiles at least, if there are as many blocks.
PACK, TILE, TILES = 1024, 512, 48
FOUND = "query_id long, vec_id long, score double"


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place of each cell (row of unsigned coordinates) on the Hilbert curve."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(flip, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(units: np.ndarray, curve: int, dimensions: int = DIMENSIONS, bits: int = BITS) -> np.ndarray:
    """Keys of unit vectors on one curve: its own projection and shift."""
    random = np.random.Generator(np.random.PCG64([7, curve, units.shape[1]]))
    axes = np.linalg.qr(random.standard_normal((units.shape[1], min(dimensions, units.shape[1]))))[0]
    shift = random.random(axes.shape[1])
    spread = 3 / units.shape[1] ** 0.5  # a projected unit vector rarely goes further
    cells = np.floor(((units @ axes) / spread + 1) / 2 * ((1 << bits) - 1) + shift)
    return hilbert(np.clip(cells, 0, (1 << bits) - 1), bits)


def matrix(column: pa.Array) -> np.ndarray:
    """An Arrow column of equally long lists as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def by_length(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Runs of rows whose lists in a column are equally long, with that length."""
    sizes = batch.column(column).value_lengths().to_numpy()
    cut = np.flatnonzero(np.diff(sizes)) + 1
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(sizes)]):
        if a < b:
            yield int(sizes[a]), batch.slice(a, b - a)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): vectors with an id, of finite components, not all zero."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = vectors.filter(F.col("vec_id").isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0))
    return good.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def ordered_blocks(vectors: DataFrame, curve: int, scratch: Scratch) -> DataFrame:
    """(block, width, ids, data): the classes in the order of one curve, cut into blocks of BLOCK.

    ids: the class numbers, data: their vectors as doubles, all of one length
    (width). Blocks are numbered along the curve, across the partitions.
    """

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, rows in by_length(batch, 1):
                key = curve_keys(unit(matrix(rows.column(1))), curve)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.full(len(key), width, np.int32)), pa.array(key)], ["first", "v", "width", "key"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, of, rest = TaskContext.get().partitionId(), 0, 0, None
        out = lambda ids, x: pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "number": pa.array([number], pa.int32()), "width": pa.array([of], pa.int32()), "ids": [ids.tobytes()], "data": [x.tobytes()]})
        for batch in batches:
            for width, rows in by_length(batch, 1):
                ids, x = rows.column(0).to_numpy(), matrix(rows.column(1))
                if rest is not None and width == of:
                    ids, x = np.concatenate([rest[0], ids]), np.concatenate([rest[1], x])
                elif rest is not None and len(rest[0]):
                    yield out(*rest)
                    number += 1
                of, full = width, len(ids) // BLOCK * BLOCK
                for at in range(0, full, BLOCK):
                    yield out(ids[at : at + BLOCK], x[at : at + BLOCK])
                    number += 1
                rest = ids[full:], x[full:]
        if rest is not None and len(rest[0]):
            yield out(*rest)

    keys = vectors.select("first", "v").mapInArrow(keyed, "first long, v array<double>, width int, key long")
    ranged = keys.repartitionByRange("width", "key", "first").sortWithinPartitions("width", "key", "first").select("first", "v")
    cut = scratch.save(ranged.mapInArrow(blocks, "part int, number int, width int, ids binary, data binary"), f"curve{curve}")
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = cut.groupBy("part").agg(F.count("*").alias("n")).select("part", before.alias("before"))  # one row per partition
    return cut.join(offsets, "part").select((F.col("before") + F.col("number")).alias("block"), "width", "ids", "data")


def best(queries: np.ndarray, x: np.ndarray, keep: int) -> np.ndarray:
    """Places of the largest cosines of each query, ``keep`` of them or all, and one more."""
    scores = queries @ x.T
    keep = min(keep + 1, scores.shape[1])
    return np.argpartition(-scores, keep - 1, axis=1)[:, :keep]


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of the rows of x and y, in double precision."""
    return (x * y).sum(axis=-1) / (np.sqrt((x * x).sum(axis=-1)) * np.sqrt((y * y).sum(axis=-1)))


def meet(pairs: DataFrame, keep: int) -> DataFrame:
    """(query_id, vec_id, score): the best of each block for each query that meets it.

    pairs: qids, qdata, floor (what a score must reach), ids, data.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for qids, qdata, floor, ids, data in zip(*(batch.column(k).to_pylist() for k in range(5))):
                qids, floor, ids = np.frombuffer(qids, np.int64), np.frombuffer(floor, float), np.frombuffer(ids, np.int64)
                q, x = np.frombuffer(qdata, float).reshape(len(qids), -1), np.frombuffer(data, float).reshape(len(ids), -1)
                if q.shape[1] != x.shape[1]:  # a window may reach over the border of two lengths
                    continue
                uq, ux = unit(q), unit(x)
                centre = ux.mean(axis=0, keepdims=True)
                if np.abs(centre).max() > 0:
                    centre = unit(centre)
                    radius = np.arccos(np.clip(ux @ centre[0], -1, 1)).max()
                    reach = np.cos(np.maximum(0, np.arccos(np.clip(uq @ centre[0], -1, 1)) - radius))
                    some = reach >= floor - 1e-9
                    qids, floor, q, uq = qids[some], floor[some], q[some], uq[some]
                if not len(qids):
                    continue
                place = best(uq, ux, keep)
                score = exact(q[:, None, :], x[place])
                good = score >= floor[:, None]
                row = np.nonzero(good)[0]
                if len(row):
                    yield pa.RecordBatch.from_arrays([pa.array(qids[row]), pa.array(ids[place[good]]), pa.array(score[good])], ["query_id", "vec_id", "score"])

    return pairs.select("qids", "qdata", "floor", "ids", "data").mapInArrow(run, FOUND)


def packs(queries: DataFrame, by: str, size: int = PACK) -> DataFrame:
    """Rows (query_id, v, floor, by) packed by the length of v and ``by``: (width, by, qids, qdata, floor)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(3).to_numpy(zero_copy_only=False)
            order = np.lexsort((key, batch.column(1).value_lengths().to_numpy()))
            rows = []
            for width, part in by_length(batch.take(pa.array(order)), 1):
                key, ids, x, floor = part.column(3).to_numpy(zero_copy_only=False), part.column(0).to_numpy(), matrix(part.column(1)), part.column(2).to_numpy()
                cut = np.flatnonzero(np.diff(key)) + 1
                for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(key)]):
                    for at in range(a, b, size):
                        s = slice(at, min(b, at + size))
                        rows.append((width, int(key[at]), ids[s].tobytes(), x[s].tobytes(), floor[s].tobytes()))
            if rows:
                types = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["width", by, "qids", "qdata", "floor"])

    return queries.select("query_id", "v", "floor", by).mapInArrow(run, f"width int, {by} long, qids binary, qdata binary, floor binary")


def top(found: DataFrame, keep: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.distinct().withColumn("rank", rank).filter(F.col("rank") <= keep)


def neighbours(vectors: DataFrame, every: int = EVERY, nearest: int = NEAREST, curves: int = CURVES, complete: bool = True) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest by cosine of each vec_id divisible by ``every``.

    Nearest first, ties to the smaller vec_id; never the query's own id. Equal
    vectors are one class, of which the smallest ids can be results. Vectors that
    are null, zero, or hold null or non-finite components take no part, nor do
    null ids; a query's candidates are the vectors of its own length; fewer
    candidates give fewer rows;
    rows that repeat an id are one candidate, with the best of its vectors. An
    empty table gives no row; other columns are not read. ``complete`` False:
    only the windows of the curves, whose recall depends on the data.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    good = scratch.save(usable(vectors), "vectors")
    # the nearest + 1 smallest ids of each class of equal vectors
    rank = F.row_number().over(W.partitionBy("v").orderBy("vec_id"))
    some = good.distinct().withColumn("_k", rank).filter(F.col("_k") <= nearest + 1)
    classes = scratch.save(some.groupBy("v").agg(F.min("vec_id").alias("first"), F.sort_array(F.collect_list("vec_id")).alias("members")), "classes")
    asked = good.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v").distinct()
    asked = scratch.save(asked.join(classes, "v").select("query_id", "v", "first", F.lit(-2.0).alias("floor")), "queries")
    ordered = [scratch.save(ordered_blocks(classes, c, scratch), f"blocks{c}") for c in range(curves)]
    keep = nearest + 1  # classes: the query's own may be one of them
    found = None
    for c, blocks in enumerate(ordered):
        placed = blocks.select("block", F.col("ids"))

        def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    ids = np.frombuffer(ids, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), block)), pa.array(ids)], ["block", "first"])

        where = placed.mapInArrow(members, "block long, first long")
        windows = asked.join(where, "first").withColumn("block", F.explode(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1)))
        packed = packs(windows.repartition("block"), "block")
        near = meet(packed.drop("width").join(blocks, "block"), keep)
        found = near if found is None else found.union(near)
    found = scratch.save(top(found, keep), "windows")
    if complete:
        floor = found.filter(F.col("rank") == keep).select("query_id", F.col("score").alias("_s"))
        bounded = asked.drop("floor").join(floor, "query_id", "left").select("query_id", "v", F.coalesce("_s", F.lit(-2.0)).alias("floor"))
        # the stated queries against all blocks: packs of queries go to every tile of blocks
        tiles = ordered[0].groupBy("width").agg(F.count("*").alias("_n"))
        tiles = tiles.select("width", F.greatest(F.ceil(F.col("_n") / TILE), F.least("_n", F.lit(TILES))).alias("_tiles"))  # one row per length
        tiled = ordered[0].join(tiles, "width").withColumn("_tile", F.pmod("block", "_tiles")).drop("_tiles")
        packed = packs(bounded.withColumn("_part", F.lit(0).cast("long")).repartition("query_id"), "_part").drop("_part")
        sent = packed.join(tiles, "width").withColumn("_tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_tiles") - 1))).drop("_tiles")
        rest = meet(sent.join(tiled, ["width", "_tile"]), keep)
        found = scratch.save(top(found.select("query_id", "vec_id", "score").union(rest), keep), "all")
    names = classes.select(F.col("first").alias("vec_id"), "members")
    results = found.select("query_id", "vec_id", "score").join(names, "vec_id").select("query_id", F.explode("members").alias("vec_id"), "score").filter("query_id != vec_id")
    single = results.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return single.withColumn("rank", rank).filter(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")
