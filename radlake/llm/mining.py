"""Hard negatives by a pivot table.

Vectors get one more component that makes all of them equally long, and queries
a zero: then a large inner product is a small Euclidean distance. Of each row the
distances to a few pivots are stored. For an anchor and a row they bracket the
distance by the triangle inequality, |a - r| <= d <= a + r for every pivot, and
so the score; only rows whose bracket meets what is asked get the exact score.

Rows lie in tiles, in the order of their nearest pivot and the distance to it, and
a tile keeps the range of its distances to each pivot, so that whole tiles are
ruled out first. Anchors travel in packs and meet the tiles in waves, each 16
times as long as all before, so that what one wave has found bounds the next.
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

#: Anchors are ids divisible by EVERY; positives of an anchor; negatives of a positive; per cent of its score that a negative has.
EVERY, POSITIVES, NEGATIVES, BAND = 100, 5, 10, (30, 90)
#: Pivots, and rows among which they are chosen (of the smallest hashes of ids).
PIVOTS, SAMPLE = 16, 1024
#: Bytes of vectors in a tile; anchors in a pack; growth of the waves.
TILE_BYTES, PACK, GROWTH = 4 << 20, 256, 16
#: Share of the largest squares that rounding may move a bracket.
SLACK = 1e-9
LEAST, MOST = -(2**63), 2**63 - 1
EXACT = 2.0**53

ROW = "vec_id long, label long, width int, near int, away double, data binary, dist binary"
TILE = "part int, number int, width int, lo array<double>, hi array<double>, ids binary, labels binary, data binary, dist binary"
PACKED = "pack long, home long, width int, qlo array<double>, qhi array<double>, least2 double, most2 double, floor double, ceiling double, aids binary, alabels binary, adata binary, adist binary, slots binary"

SLOT = np.dtype([("anchor", "i4"), ("key", "i8"), ("floor", "i8"), ("floor_id", "i8"), ("high", "i8")])


def usable(vectors: DataFrame, relabel: int = 7, labels: int = 10) -> DataFrame:
    """(vec_id, label, v): rows with an id and a label, of finite components; every ``relabel``-th id with the next label."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(256 * x) == float("inf")))
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % relabel == 0, (label + 1) % labels).otherwise(label)
    good = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & ~bad)
    return good.select(F.col("vec_id").cast("long").alias("vec_id"), moved.alias("label"), v.alias("v"))


def one_per_id(rows: DataFrame) -> DataFrame:
    """Of rows that share an id the first by label and vector."""
    if rows.groupBy("vec_id").count().filter("count > 1").isEmpty():
        return rows
    rank = F.row_number().over(W.partitionBy("vec_id").orderBy("label", "v"))
    return rows.withColumn("_k", rank).filter("_k = 1").drop("_k")


def augmented(x: np.ndarray, m2: float) -> np.ndarray:
    """Rows with the component that makes all squares m2."""
    rest = np.sqrt(np.maximum(0, m2 - (x * x).sum(axis=1)))
    return np.concatenate([x, rest[:, None]], axis=1)


def choose(x: np.ndarray, m2: float, many: int = PIVOTS) -> np.ndarray:
    """Pivots among the augmented rows: each the farthest from those before."""
    y = augmented(x, m2)
    away, chosen = np.full(len(y), np.inf), [0]
    while len(chosen) < min(many, len(y)):
        away = np.minimum(away, ((y - y[chosen[-1]]) ** 2).sum(axis=1))
        if not away.max() > 0:
            break
        chosen.append(int(away.argmax()))
    return y[chosen]


def distances(y: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    out = np.zeros((len(y), len(pivots)))
    for k, p in enumerate(pivots):
        out[:, k] = np.sqrt(((y - p) ** 2).sum(axis=1))
    return out


def lists_by_width(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, 256 times the lists rounded down) for each length of the lists in a column."""
    sizes = batch.column(column).value_lengths().to_numpy(zero_copy_only=False)
    for width in np.unique(sizes):
        at = np.flatnonzero(sizes == width)
        x = batch.column(column).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
        yield int(width), at, np.floor(256 * x.reshape(len(at), int(width)))


def table(rows: DataFrame, pivots: dict[int, np.ndarray], m2: float) -> DataFrame:
    """The pivot table, ROW: of each row its distances to the pivots, the nearest pivot and the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, at, x in lists_by_width(batch, 2):
                own = pivots.get(width, np.zeros((0, width + 1)))
                dist = distances(augmented(x, m2), own)
                near = dist.argmin(axis=1).astype(np.int32) if len(own) else np.zeros(len(x), np.int32)
                away = dist[np.arange(len(x)), near] if len(own) else np.zeros(len(x))
                some = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array(np.full(len(at), width, np.int32)), pa.array(near), pa.array(away), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in dist], pa.binary())],
                    ["vec_id", "label", "width", "near", "away", "data", "dist"],
                )

    return rows.select("vec_id", "label", "v").mapInArrow(run, ROW)


def stacked(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), float).reshape(len(column), width)


def tiles(rows: DataFrame, scratch: Scratch, tile_bytes: int) -> tuple[DataFrame, int]:
    """The pivot table in tiles numbered along its order, and how many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, of, held = TaskContext.get().partitionId(), 0, -1, []

        def out(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal number
            t = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
            most = max(1, tile_bytes // (8 * max(1, of)))
            for at in range(0, len(t), most):
                some = t.slice(at, most)
                size = len(some.column(6)[0].as_py()) // 8
                dist = stacked(some.column(6), size)
                lo, hi = dist.min(axis=0).tolist(), dist.max(axis=0).tolist()
                row = (part, number, of, lo, hi, some.column(0).to_numpy().tobytes(), some.column(1).to_numpy().tobytes(), b"".join(some.column(5).to_pylist()), dist.tobytes())
                types = [pa.int32()] * 3 + [pa.list_(pa.float64())] * 2 + [pa.binary()] * 4
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, types)], [c.split()[0] for c in TILE.split(", ")])
                number += 1

        for batch in batches:
            widths = batch.column(2).to_numpy()
            cut = [0, *(np.flatnonzero(np.diff(widths)) + 1).tolist(), len(widths)]
            for a, b in zip(cut, cut[1:]):
                full = held and sum(map(len, held)) * 8 * max(1, of) >= tile_bytes
                if a < b and held and (full or widths[a] != of):
                    yield from out(held)
                    held = []
                if a < b:
                    of, held = int(widths[a]), [*held, batch.slice(a, b - a)]
        if held:
            yield from out(held)

    order = ["width", "near", "away", "vec_id"]
    cut = scratch.save(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, TILE), "cut")
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = cut.groupBy("part").agg(F.count("*").alias("n")).select("part", before.alias("before"))  # one row per partition
    numbered = cut.join(offsets, "part").select((F.col("before") + F.col("number")).alias("tile"), "width", "lo", "hi", "ids", "labels", "data", "dist")
    out = scratch.save(numbered, "tiles")
    return out, out.count()


def anchors_of(tiled: DataFrame, every: int, pivots: dict[int, np.ndarray]) -> DataFrame:
    """The rows of the tiles whose id is divisible by ``every``, with their tile and, as queries, their distances to the pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tile, width, ids, labels, data in zip(*(c.to_pylist() for c in batch.columns)):
                ids, labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
                at = np.flatnonzero(ids % every == 0)
                if len(at):
                    q = np.frombuffer(data, float).reshape(len(ids), width)[at]
                    dist = distances(np.concatenate([q, np.zeros((len(q), 1))], axis=1), pivots.get(width, np.zeros((0, width + 1))))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[at]), pa.array(labels[at]), pa.array(np.full(len(at), tile, np.int64)), pa.array(np.full(len(at), width, np.int32)), pa.array([v.tobytes() for v in q], pa.binary()), pa.array([v.tobytes() for v in dist], pa.binary())],
                        ["anchor_id", "label", "home", "width", "data", "dist"],
                    )

    return tiled.select("tile", "width", "ids", "labels", "data").mapInArrow(run, "anchor_id long, label long, home long, width int, data binary, dist binary")


def bounds(slots: np.ndarray) -> tuple[float, float]:
    """The scores between which slots ask for something; the ends of the longs stand for all beyond them."""
    floor, high = int(slots["floor"].min()), int(slots["high"].max())
    return -np.inf if floor == LEAST else float(floor), np.inf if high == MOST else float(high)


def packs(anchors: DataFrame, slots: DataFrame) -> DataFrame:
    """PACKED: anchors of neighbouring tiles together, with what they ask for.

    slots: (anchor_id, key, floor, floor_id, high), a few rows for each anchor. A
    slot asks for scores of at most high that beat (floor, floor_id).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held = TaskContext.get().partitionId(), 0, []

        def out(rows: list[dict]) -> Iterator[pa.RecordBatch]:
            nonlocal number
            width = rows[0]["width"]
            data = np.frombuffer(b"".join(r["data"] for r in rows), float).reshape(len(rows), width)
            dist = np.frombuffer(b"".join(r["dist"] for r in rows), float).reshape(len(rows), -1)
            slots = np.array([(k, s["key"], s["floor"], s["floor_id"], s["high"]) for k, r in enumerate(rows) for s in r["slots"]], SLOT)
            squares = (data * data).sum(axis=1)
            row = ((part << 32) + number, rows[0]["home"], width, dist.min(axis=0).tolist(), dist.max(axis=0).tolist(), float(squares.min()), float(squares.max()), *bounds(slots))
            row += (np.array([r["anchor_id"] for r in rows], np.int64).tobytes(), np.array([r["label"] for r in rows], np.int64).tobytes(), data.tobytes(), dist.tobytes(), slots.tobytes())
            types = [pa.int64(), pa.int64(), pa.int32(), *[pa.list_(pa.float64())] * 2, *[pa.float64()] * 4, *[pa.binary()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, types)], [c.split()[0] for c in PACKED.split(", ")])
            number += 1

        for batch in batches:
            for row in batch.to_pylist():
                if held and (len(held) == PACK or held[0]["width"] != row["width"]):
                    yield from out(held)
                    held = []
                held.append(row)
        if held:
            yield from out(held)

    asked = slots.groupBy("anchor_id").agg(F.collect_list(F.struct("key", "floor", "floor_id", "high")).alias("slots"))
    order = ["width", "home", "anchor_id"]
    return anchors.join(asked, "anchor_id").repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, PACKED)


def scores_of(x: np.ndarray, q: np.ndarray, at: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products of the rows ``at`` of x with q, as longs (beyond them: the nearest long)."""
    if exact:
        return (x[at] @ q if 2 * len(at) < len(x) else (x @ q)[at]).astype(np.int64)
    q = [int(v) for v in q]
    return np.array([min(MOST, max(LEAST, sum(int(a) * b for a, b in zip(x[k], q)))) for k in at], np.int64)


def first(score: np.ndarray, ids: np.ndarray, keep: int) -> np.ndarray:
    """Places of the ``keep`` largest scores, ties to the smaller id."""
    place = np.arange(len(score))
    if len(score) > keep:
        place = np.flatnonzero(score >= np.partition(score, len(score) - keep)[len(score) - keep])
    return place[np.lexsort((ids[place], -score[place]))[:keep]]


def survivors(dist: np.ndarray, own: np.ndarray, at: np.ndarray, square: float, m2: float, floor: float, ceiling: float) -> np.ndarray:
    """Those of the rows ``at`` whose bracket of the score reaches from floor to ceiling. dist: a line for each pivot."""
    slack = SLACK * (m2 + square)
    for line, a in zip(dist, own):
        r = line[at]
        near, far = (square + m2 - (r - a) ** 2) / 2 + slack, (square + m2 - (r + a) ** 2) / 2 - slack
        at = at[(near >= floor) & (far <= ceiling)]
    return at


def search(met: DataFrame, m2: float, same: bool, keep: int, prune: bool = True) -> DataFrame:
    """(anchor_id, key, vec_id, score): of each pack and tile that meet, the first ``keep`` rows of each slot.

    same: rows of the anchor's label but the anchor, else of other labels. prune
    False gives every row its exact score.
    """
    names = ["aids", "alabels", "adata", "adist", "slots", "width", "ids", "labels", "data", "dist"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for aids, alabels, adata, adist, slots, width, ids, labels, data, dist in zip(*(c.to_pylist() for c in batch.columns)):
                aids, alabels, ids, labels = (np.frombuffer(b, np.int64) for b in (aids, alabels, ids, labels))
                q, x = np.frombuffer(adata, float).reshape(len(aids), width), np.frombuffer(data, float).reshape(len(ids), width)
                own = np.frombuffer(adist, float).reshape(len(aids), -1)
                dist = np.ascontiguousarray(np.frombuffer(dist, float).reshape(len(ids), -1).T)
                exact = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * width < EXACT
                slots = np.frombuffer(slots, SLOT)
                rows: list[tuple[np.ndarray, ...]] = []
                for k, (anchor, label) in enumerate(zip(aids, alabels)):
                    mine = slots[slots["anchor"] == k]
                    at = np.flatnonzero((labels == label) & (ids != anchor) if same else labels != label)
                    if prune:
                        at = survivors(dist, own[k], at, float(q[k] @ q[k]), m2, *bounds(mine))
                    if not len(at):
                        continue
                    score = scores_of(x, q[k], at, exact)
                    for slot in mine:
                        good = np.flatnonzero((score <= slot["high"]) & ((score > slot["floor"]) | (score == slot["floor"]) & (ids[at] < slot["floor_id"])))
                        best = good[first(score[good], ids[at[good]], keep)]
                        if len(best):
                            rows.append((np.full(len(best), anchor), np.full(len(best), slot["key"]), ids[at[best]], score[best]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows)], ["anchor_id", "key", "vec_id", "score"])

    return met.select(*names).mapInArrow(run, "anchor_id long, key long, vec_id long, score long")


def waves(count: int, growth: int = GROWTH) -> list[tuple[int, int]]:
    edges = [0, 1]
    while edges[-1] < count:
        edges.append(min(count, edges[-1] * growth))
    return list(zip(edges, edges[1:])) if count else []


def bracket(m2: float):
    """Whether a pack and a tile can hold a pair that a slot asks for, by the ranges of their distances to the pivots."""
    gap = F.array_max(F.concat(F.zip_with("lo", "qhi", lambda a, b: a - b), F.zip_with("qlo", "hi", lambda a, b: a - b), F.array(F.lit(0.0))))
    far = F.array_min(F.concat(F.zip_with("hi", "qhi", lambda a, b: a + b), F.array(F.lit(1e300))))
    slack = SLACK * (F.col("most2") + m2)
    return ((F.col("most2") + m2 - gap * gap) / 2 + slack >= F.col("floor")) & ((F.col("least2") + m2 - far * far) / 2 - slack <= F.col("ceiling"))


def sweep(anchors: DataFrame, slots: DataFrame, tiled: DataFrame, count: int, m2: float, same: bool, keep: int, scratch: Scratch, name: str, prune: bool = True) -> DataFrame:
    """(anchor_id, key, vec_id, score, rank): the first ``keep`` rows of each slot among all tiles. slots: (anchor_id, key, low, high)."""
    ranges = tiled.select("tile", "width", "lo", "hi")
    order = W.partitionBy("anchor_id", "key").orderBy(F.col("score").desc(), "vec_id")
    found = None
    for k, (a, b) in enumerate(waves(count)):
        asked = slots.select("anchor_id", "key", (F.col("low") - 1).alias("floor"), F.lit(LEAST).alias("floor_id"), "high")
        if found is not None:
            last = found.filter(F.col("rank") == keep).select("anchor_id", "key", F.col("score").alias("_s"), F.col("vec_id").alias("_i"))
            asked = asked.join(last, ["anchor_id", "key"], "left").select("anchor_id", "key", F.coalesce("_s", "floor").alias("floor"), F.coalesce("_i", "floor_id").alias("floor_id"), "high")
        packed = scratch.save(packs(anchors, asked), f"{name}packs{k}")
        step = F.explode(F.sequence(F.lit(a).cast("long"), F.lit(b - 1).cast("long")))
        sent = packed.select("pack", "home", "width", "qlo", "qhi", "least2", "most2", "floor", "ceiling", step.alias("step")).withColumn("tile", (F.col("home") + F.col("step")) % count)
        pairs = sent.join(ranges, ["tile", "width"])
        pairs = (pairs.filter(bracket(m2)) if prune else pairs).select("pack", "tile")
        met = pairs.join(packed.select("pack", "aids", "alabels", "adata", "adist", "slots"), "pack").join(tiled, "tile")
        new = search(met, m2, same, keep, prune)
        both = new if found is None else found.select(*new.columns).union(new)
        found = scratch.save(both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep), f"{name}{k}")
    return found


def hard_negatives(vectors: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, band: tuple[int, int] = BAND, tile_bytes: int = TILE_BYTES, prune: bool = True) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of each anchor and positive.

    Anchors are the ids divisible by ``every``; their positives the rows of the
    largest inner products within the label, negatives the best of other labels
    whose score is within ``band`` per cent of the positive's. Equal scores go to
    the smaller id. Rows with a null id, label, vector or component, or a
    component that is not finite (times 256 either) take no part. Of rows that
    share an id the first by label and vector counts. Vectors of other lengths
    than the anchor's are no candidates. Scores beyond a long are the nearest
    long. A positive whose band holds nothing gives no row (always if its score
    is negative); nor does an empty table. Other columns are not read.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "mining")
    rows = scratch.save(one_per_id(usable(vectors)), "rows")
    scaled = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + F.pow(F.floor(256 * x).cast("double"), F.lit(2.0)))
    m2 = float(rows.agg(F.max(scaled(F.col("v")))).head()[0] or 0) * (1 + 1e-12)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow()  # bounded by SAMPLE
    pivots = {width: choose(x, m2) for batch in sample.combine_chunks().to_batches() for width, _, x in lists_by_width(batch, 0)}
    tiled, count = tiles(table(rows, pivots, m2), scratch, tile_bytes)
    anchors = scratch.save(anchors_of(tiled, every, pivots), "anchors")
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if not count:
        return empty
    every_row = anchors.select("anchor_id", F.lit(0).cast("long").alias("key"), F.lit(LEAST + 1).alias("low"), F.lit(MOST).alias("high"))
    best = sweep(anchors, every_row, tiled, count, m2, True, positives, scratch, "positives", prune)
    best = best.select("anchor_id", F.col("vec_id").alias("key"), F.col("score").alias("positive_score"))
    share = lambda per, up: f"CAST(FLOOR((CAST(positive_score AS DECIMAL(38, 0)) * {per} + {up}) / 100) AS LONG)"
    asked = best.select("anchor_id", "key", F.expr(share(band[0], 99)).alias("low"), F.expr(share(band[1], 0)).alias("high")).filter("low <= high")
    worst = sweep(anchors, asked, tiled, count, m2, False, negatives, scratch, "negatives", prune)
    out = worst.withColumnRenamed("score", "negative_score").join(best, ["anchor_id", "key"])
    return out.select("anchor_id", F.col("key").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"), "positive_score", "negative_score")


ORACLE = """
WITH good AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM good a JOIN good b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), pairs AS (
  SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank,
         s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
  FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT s.same AND 100 * s.score BETWEEN 30 * p.positive_score AND 90 * p.positive_score
)
SELECT * FROM pairs WHERE rank <= 10
"""
