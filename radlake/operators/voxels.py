"""Voxel analytics on sparse masks (mask rows i, j, k by comparison): overlap, margins, axis distances.

Overlap and set operations are joins and counts; kernels.py has what needs the
whole grid. A comparison is one pair of masks; comparisons are independent, so
they are the unit of partitioning.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import lines as L
from .lines import CELL


def membership(a: DataFrame, b: DataFrame) -> DataFrame:
    """(comparison_id, i, j, k, in_a, in_b) of every voxel of either mask, in any number of copies: one shuffle, of lines, and no join."""
    line = [F.col("comparison_id"), F.col("i"), F.col("j"), F.floor(F.col("k") / 64).cast("int").alias("w")]
    bit, zero = F.expr("shiftleft(1L, int(pmod(k, 64)))"), F.lit(0).cast("long")
    rows = a.select(*line, bit.alias("a"), zero.alias("b")).union(b.select(*line, zero, bit))
    both = rows.groupBy("comparison_id", "i", "j", "w").agg(F.bit_or("a").alias("_a"), F.bit_or("b").alias("_b"))
    each = both.select("*", F.explode(L.places(F.expr("_a | _b"))).alias("_n"))
    inside = lambda c: F.expr(f"(shiftright({c}, _n) & 1) = 1")
    cells = each.select("comparison_id", "i", "j", (F.col("w") * 64 + F.col("_n")).cast(dict(a.dtypes)["k"]).alias("k"), inside("_a").alias("in_a"), inside("_b").alias("in_b"))
    return cells.filter("in_a OR in_b")


def overlap(cells: DataFrame, grid: int) -> DataFrame:
    """dsc, jsc, voe, cs, vi per comparison, from counts; grid: voxels of the whole grid."""
    n = cells.groupBy("comparison_id").agg(
        F.count_if("in_a").alias("na"), F.count_if("in_b").alias("nb"), F.count_if(F.col("in_a") & F.col("in_b")).alias("nab"), F.count("*").alias("nu")
    )
    entropy = lambda x: F.when(x > 0, -(x / grid) * F.ln(x / grid)).otherwise(0.0)
    ha, hb = entropy(F.col("na")) + entropy(grid - F.col("na")), entropy(F.col("nb")) + entropy(grid - F.col("nb"))
    joint = entropy(F.col("nab")) + entropy(F.col("na") - F.col("nab")) + entropy(F.col("nb") - F.col("nab")) + entropy(grid - F.col("nu"))
    return n.select(
        "comparison_id", "na", "nb", "nab",
        F.when(F.col("na") + F.col("nb") == 0, 1.0).otherwise(2 * F.col("nab") / (F.col("na") + F.col("nb"))).alias("dsc"),
        F.when(F.col("nu") == 0, 1.0).otherwise(F.col("nab") / F.col("nu")).alias("jsc"),
        F.when(F.col("nu") == 0, 0.0).otherwise(1 - F.col("nab") / F.col("nu")).alias("voe"),
        F.when((F.col("na") == 0) | (F.col("nb") == 0), 0.0).otherwise(F.col("nab") / F.sqrt(F.col("na").cast("double") * F.col("nb"))).alias("cs"),
        (2 * joint - ha - hb).alias("vi"),
    )


def combine(cells: DataFrame, operation: str) -> DataFrame:
    """union, intersection, subtraction or xor of the two masks."""
    a, b = F.col("in_a"), F.col("in_b")
    test = {"union": a | b, "intersection": a & b, "subtraction": a & ~b, "xor": a != b}[operation]
    return cells.filter(test).select(*CELL)


def element(radii: tuple[int, int, int], shape: str = "ball") -> list[tuple[int, int, int]]:
    """Offsets of a structuring element with a radius in voxels for each axis."""
    out = []
    for x in range(-radii[0], radii[0] + 1):
        for y in range(-radii[1], radii[1] + 1):
            for z in range(-radii[2], radii[2] + 1):
                scaled = [(v / q) if q else 0.0 for v, q in zip((x, y, z), radii)]
                if {"ball": sum(v * v for v in scaled) <= 1.0 + 1e-9, "box": True, "cross": sum(v != 0 for v in (x, y, z)) <= 1}[shape]:
                    out.append((x, y, z))
    return out


def ball(margin: float, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), shape: str = "ball") -> list[tuple[int, int, int]]:
    """Offsets of a structuring element; its radius per axis is ceil(margin / spacing)."""
    return element(tuple(max(0, -int(-abs(margin) // s)) for s in spacing), shape)


def moved_by(mask: DataFrame, offsets: list[tuple[int, int, int]], grow: bool, size: tuple[int, int, int]) -> DataFrame:
    """Dilation or erosion by the offsets of an element, in a grid of that size; by lines, see lines.py."""
    return L.voxels(L.morph(L.lines(mask), [(grow, offsets, True)], size))


def margin(mask: DataFrame, millimetres: float, size: tuple[int, int, int], spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), shape: str = "ball") -> DataFrame:
    """Dilation (positive) or erosion (negative) in a grid of that size; 0 changes nothing."""
    if not millimetres:
        return mask.select(*CELL)
    return moved_by(mask, ball(millimetres, spacing, shape), millimetres > 0, size)


def directed_steps(millimetres: tuple[float, float, float], spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> list[L.Step]:
    """A margin for each axis: one ellipsoid if none shrinks or none grows, else one axis after the other."""
    radii = tuple(-int(-abs(m) // s) for m, s in zip(millimetres, spacing))
    if all(m >= 0 for m in millimetres) or all(m <= 0 for m in millimetres):
        return [(all(m >= 0 for m in millimetres), element(radii), True)]
    return [(m > 0, element(tuple(r if a == axis else 0 for a in range(3))), True) for axis, (m, r) in enumerate(zip(millimetres, radii)) if m]


def directed_margin(mask: DataFrame, millimetres: tuple[float, float, float], size: tuple[int, int, int], spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """A margin for each axis, see directed_steps; one shuffle of lines."""
    return L.voxels(L.morph(L.lines(mask), directed_steps(millimetres, spacing), size))


def expand_and_crop(mask: DataFrame, boundary: DataFrame, millimetres: float, size: tuple[int, int, int], spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """A mask with its margin, inside the boundary."""
    grown = L.morph(L.lines(mask), [(True, ball(millimetres, spacing), True)], size)
    return L.voxels(L.joined(grown, L.lines(boundary), "intersection"))


def subtract_with_margin(mask: DataFrame, other: DataFrame, millimetres: float, size: tuple[int, int, int], spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """A mask without another one and its margin."""
    grown = L.morph(L.lines(other), [(millimetres > 0, ball(millimetres, spacing), True)], size)
    return L.voxels(L.joined(L.lines(mask), grown, "subtraction"))


def resampled(mask: DataFrame, spacing: tuple[float, float, float], to: tuple[float, float, float], size: tuple[int, int, int]) -> DataFrame:
    """The mask in another spacing by the nearest voxel, in a grid of that size with the same first voxel: each voxel becomes those that are nearest to it."""
    for n, s, t, most in zip("ijk", spacing, to, size):
        # index x of the new grid has its middle at x * t; its nearest old voxel is floor(x * t / s + 0.5)
        low = F.greatest(F.lit(0), F.ceil((F.col(n) - 0.5) * s / t)).cast("int")
        high = F.least(F.lit(most - 1), F.ceil((F.col(n) + 0.5) * s / t) - 1).cast("int")
        others = [c for c in CELL if c != n]
        mask = mask.select(*CELL, low.alias("_low"), high.alias("_high")).filter("_low <= _high").select(*others, F.explode(F.sequence("_low", "_high")).alias(n))
    return mask.select(*CELL)


Geometry = tuple[tuple[float, ...], tuple[float, ...], tuple[float, ...]]


def index_map(of: Geometry, to: Geometry) -> tuple[list[list[float]], list[float]]:
    """(M, t): the index x of a grid ``to`` lies at M x + t in the grid ``of``. A geometry is origin, spacing, direction (nine cosines by row)."""
    axes = lambda g: np.array(g[2], float).reshape(3, 3) * np.array(g[1], float)  # noqa: E731  columns are steps along the axes
    back = np.linalg.inv(axes(of))
    return (back @ axes(to)).tolist(), (back @ (np.array(to[0], float) - np.array(of[0], float))).tolist()


def reoriented(mask: DataFrame, of: Geometry, to: Geometry, size: tuple[int, int, int]) -> DataFrame:
    """The mask in another grid, shifted, turned or of another spacing, by the nearest voxel: a voxel of the new grid is in it if the old voxel whose cell its middle lies in is.

    Each old voxel meets the new ones in the box around its cell, a number that
    the two grids bound, and those whose middle lies in the cell stay.
    """
    m, t = index_map(of, to)
    back = np.linalg.inv(np.array(m))
    shift, half = (back @ np.array(t)).tolist(), (np.abs(back).sum(axis=1) / 2).tolist()
    out = mask.select("comparison_id", *[F.col(n).alias(f"_{n}") for n in "ijk"])
    for r, n in enumerate("ijk"):
        middle = sum((F.lit(float(back[r, c])) * F.col(f"_{x}") for c, x in enumerate("ijk")), F.lit(-shift[r]))
        low, high = F.greatest(F.ceil(middle - half[r] - 1e-6), F.lit(0)), F.least(F.floor(middle + half[r] + 1e-6), F.lit(size[r] - 1))
        out = out.withColumn("_low", low.cast("int")).withColumn("_high", high.cast("int")).filter("_low <= _high").withColumn(n, F.explode(F.sequence("_low", "_high")))
    inside = [F.floor(F.lit(m[r][0]) * F.col("i") + F.lit(m[r][1]) * F.col("j") + F.lit(m[r][2]) * F.col("k") + F.lit(t[r] + 0.5)) == F.col(f"_{x}") for r, x in enumerate("ijk")]
    return out.filter(inside[0] & inside[1] & inside[2]).select(*CELL)


def transposed(mask: DataFrame, order: str = "kji") -> DataFrame:
    """The mask with its axes in another order: kji turns (i, j, k) into (k, j, i)."""
    return mask.select("comparison_id", *[F.col(a).alias(n) for n, a in zip("ijk", order)])


def same_geometry(images: DataFrame, a: str, b: str) -> Column:
    """Whether two geometries (size, spacing, origin, direction) agree: sizes exactly, numbers within 1e-5 of the second."""
    close = lambda f: F.forall(F.zip_with(F.col(f"{a}.{f}"), F.col(f"{b}.{f}"), lambda x, y: F.coalesce(F.abs(x - y) <= 1e-8 + 1e-5 * F.abs(y), F.lit(False))), lambda t: t)
    return F.coalesce((F.col(f"{a}.size") == F.col(f"{b}.size")) & close("spacing") & close("origin") & close("direction"), F.lit(False))


def axis_distance(cells: DataFrame, source: str, target: str, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """(cell, distance) of voxels in source and not in target: to the nearest target voxel along an axis; null if none."""
    best = []
    for axis, step in zip("ijk", spacing):
        line = W.partitionBy("comparison_id", *[n for n in "ijk" if n != axis]).orderBy(axis)
        here = F.when(F.col(target), F.col(axis))
        before = F.last(here, ignorenulls=True).over(line.rowsBetween(W.unboundedPreceding, 0))
        after = F.first(here, ignorenulls=True).over(line.rowsBetween(0, W.unboundedFollowing))
        cells = cells.withColumn(f"_{axis}", F.least(F.col(axis) - before, after - F.col(axis)) * step)
        best.append(f"_{axis}")
    return cells.filter(F.col(source) & ~F.col(target)).select(*CELL, F.least(*best).alias("distance"))


def mean_distances(cells: DataFrame, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """umdc (A without B to B), omdc (B without A to A), mdc their mean; 0 where there is nothing."""
    under = axis_distance(cells, "in_a", "in_b", spacing).groupBy("comparison_id").agg(F.avg("distance").alias("u"))
    over = axis_distance(cells, "in_b", "in_a", spacing).groupBy("comparison_id").agg(F.avg("distance").alias("o"))
    every = cells.select("comparison_id").distinct().join(under, "comparison_id", "left").join(over, "comparison_id", "left")
    u, o = F.coalesce("u", F.lit(0.0)), F.coalesce("o", F.lit(0.0))
    return every.select("comparison_id", u.alias("umdc"), o.alias("omdc"), ((u + o) / 2).alias("mdc"))


def nearest(x: DataFrame, y: DataFrame, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """(cell, d): distance of every voxel of x to the nearest one of y; exact, see lines.py."""
    return L.distances(L.lines(x), L.lines(y), spacing)


def voxel_distances(a: DataFrame, b: DataFrame) -> DataFrame:
    """msd and hd95, from the nearest voxel of the other mask."""
    def directed(x: DataFrame, y: DataFrame) -> DataFrame:
        near = nearest(x, y)
        return near.groupBy("comparison_id").agg(F.avg("d").alias("m"), F.percentile("d", F.lit(0.95)).alias("h"))

    p, q = directed(a, b), directed(b, a).select("comparison_id", F.col("m").alias("m2"), F.col("h").alias("h2"))
    return p.join(q, "comparison_id").select("comparison_id", ((F.col("m") + F.col("m2")) / 2).alias("msd"), F.greatest("h", "h2").alias("hd95"))


def extent(mask: DataFrame, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Voxels, volume and bounding box per comparison."""
    volume = spacing[0] * spacing[1] * spacing[2]
    return mask.groupBy("comparison_id").agg(F.count("*").alias("n"), (F.count("*") * F.lit(volume)).alias("volume"), *[f(n).alias(f"{m}_{n}") for n in "ijk" for m, f in (("min", F.min), ("max", F.max))])


def slice_counts(cells: DataFrame) -> DataFrame:
    """Per slice: voxels under (A only), over (B only) and common."""
    return cells.groupBy("comparison_id", "k").agg(F.count_if(F.col("in_a") & ~F.col("in_b")).alias("under"), F.count_if(F.col("in_b") & ~F.col("in_a")).alias("over"), F.count_if(F.col("in_a") & F.col("in_b")).alias("common"))


def slice_lists(cells: DataFrame, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Per slice the distances of voxels under (A only, to B) and over (B only, to A), sorted, and the comparison's common voxels.

    Slices without a difference have no row; distances that no axis gives are left out.
    """
    under = axis_distance(cells, "in_a", "in_b", spacing).select("comparison_id", "k", F.col("distance").alias("u"), F.lit(None).cast("double").alias("o"))
    over = axis_distance(cells, "in_b", "in_a", spacing).select("comparison_id", "k", F.lit(None).cast("double").alias("u"), F.col("distance").alias("o"))
    rows = under.union(over).groupBy("comparison_id", "k").agg(F.array_sort(F.collect_list("u")).alias("under_distances"), F.array_sort(F.collect_list("o")).alias("over_distances"))
    common = cells.groupBy("comparison_id").agg(F.count_if(F.col("in_a") & F.col("in_b")).alias("overlap_count"))
    return rows.join(common, "comparison_id")


def histogram(lists: DataFrame, column: str, width: float, buckets: int) -> DataFrame:
    """(comparison_id, bucket, n): how many distances of a column lie in each bucket of a width, from 1; the last takes the rest."""
    each = lists.select("comparison_id", F.explode(column).alias("d"))
    return each.groupBy("comparison_id", F.least(F.lit(buckets), F.floor(F.col("d") / width) + 1).cast("int").alias("bucket")).agg(F.count("*").alias("n"))
