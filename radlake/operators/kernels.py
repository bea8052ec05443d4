"""Grid kernels: exact distance transform, morphology, labelling, surface metrics.

A group is one mask or comparison, whose grid is bounded by the scanner; groups
are dealt out by Spark. Masks arrive as voxel rows and leave as voxel rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import lines as L
from .lines import CELL, envelope
from .voxels import ball


def dense(voxels: pd.DataFrame, size: tuple[int, int, int]) -> np.ndarray:
    out = np.zeros(size, bool)
    out[voxels.i.to_numpy(), voxels.j.to_numpy(), voxels.k.to_numpy()] = True
    return out


def sparse(mask: np.ndarray, comparison_id) -> pd.DataFrame:
    i, j, k = np.nonzero(mask)
    return pd.DataFrame({"comparison_id": comparison_id, "i": i.astype(np.int32), "j": j.astype(np.int32), "k": k.astype(np.int32)})


def distances(mask: np.ndarray, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> np.ndarray:
    """Euclidean distance of every voxel to the nearest one of the mask; exact, the envelopes of one axis after the other."""
    d = np.where(mask, 0.0, np.inf)
    for axis, step in enumerate(spacing):
        lines = np.ascontiguousarray(np.moveaxis(d, axis, 0))
        d = np.moveaxis(envelope(lines.reshape(len(lines), -1), step).reshape(lines.shape), 0, axis)
    return np.sqrt(d)


def shifted(mask: np.ndarray, offset: tuple[int, int, int], fill: bool = False) -> np.ndarray:
    out = np.full_like(mask, fill)
    to = tuple(slice(max(0, o), n + min(0, o)) for o, n in zip(offset, mask.shape))
    of = tuple(slice(max(0, -o), n - max(0, o)) for o, n in zip(offset, mask.shape))
    out[to] = mask[of]
    return out


def dilate(mask: np.ndarray, offsets: list[tuple[int, int, int]]) -> np.ndarray:
    return np.logical_or.reduce([shifted(mask, o) for o in offsets])


def erode(mask: np.ndarray, offsets: list[tuple[int, int, int]]) -> np.ndarray:
    return np.logical_and.reduce([shifted(mask, o) for o in offsets])


FACES = [(0, 0, 0)] + [tuple(s if a == x else 0 for a in range(3)) for x in range(3) for s in (-1, 1)]
CUBE = ball(1.0, shape="box")


def labels(mask: np.ndarray, full: bool = False) -> np.ndarray:
    """Number of the component of each voxel, 0 outside; components in order of their first voxel.

    Neighbours are joined by union-find: every voxel points to the least one it
    knows, roots hook to smaller roots, pointers are halved; rounds grow with the
    logarithm of a component.
    """
    at = np.flatnonzero(mask)
    number = np.full(mask.size, -1, np.int64)
    number[at] = np.arange(len(at))
    number = number.reshape(mask.shape)
    pairs = []
    for o in CUBE if full else FACES:
        if o > (0, 0, 0):  # each pair of neighbours once
            near = shifted(number + 1, o, 0) - 1
            both = (number >= 0) & (near >= 0)
            pairs.append(np.column_stack([number[both], near[both]]))
    edges = np.concatenate(pairs) if pairs else np.empty((0, 2), np.int64)
    root = np.arange(len(at))
    while len(edges):
        u, v = root[edges[:, 0]], root[edges[:, 1]]
        apart = u != v
        edges, u, v = edges[apart], u[apart], v[apart]
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while (root[root] != root).any():
            root = root[root]
    out = np.zeros(mask.size, np.int64)
    out[at] = np.searchsorted(np.unique(root), root) + 1
    return out.reshape(mask.shape)


def keep_largest(mask: np.ndarray, n: int = 1, full: bool = False) -> np.ndarray:
    label = labels(mask, full)
    sizes = np.bincount(label.ravel())
    sizes[0] = 0
    order = sorted(range(1, len(sizes)), key=lambda x: (-sizes[x], x))[:n]
    return np.isin(label, order)


def remove_small(mask: np.ndarray, least_volume: float, voxel: float = 1.0, full: bool = False) -> np.ndarray:
    label = labels(mask, full)
    sizes = np.bincount(label.ravel())
    good = np.flatnonzero(sizes >= int(np.ceil(least_volume / voxel)))
    return np.isin(label, good[good > 0])


def fill_holes(mask: np.ndarray, full: bool = False) -> np.ndarray:
    """Background that no face or corner path leads out of becomes foreground."""
    padded = np.pad(~mask, 1, constant_values=True)
    label = labels(padded, full)
    return mask | ~(label == label[0, 0, 0])[1:-1, 1:-1, 1:-1] & ~mask


def close(mask: np.ndarray, offsets) -> np.ndarray:
    pad = max(max(map(abs, o)) for o in offsets)
    grown = dilate(np.pad(mask, pad), offsets)
    return erode(grown, offsets)[tuple(slice(pad, -pad or None) for _ in range(3))]


def smooth(mask: np.ndarray, millimetres: float = 1.0, rounds: int = 1, spacing=(1.0, 1.0, 1.0)) -> np.ndarray:
    """Closing, then opening."""
    offsets = ball(millimetres, spacing)
    for _ in range(rounds):
        mask = dilate(erode(close(mask, offsets), offsets), offsets)
    return mask


def gauss(sigma: float) -> list[float]:
    """Weights of a Gaussian of so many voxels, out to three of them."""
    r = max(1, int(np.ceil(3 * sigma)))
    weights = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma))
    return (weights / weights.sum()).tolist()


def gaussian(mask: np.ndarray, sigma: float = 1.0, threshold: float = 0.5, spacing=(1.0, 1.0, 1.0)) -> np.ndarray:
    """Voxels whose blurred value is above a threshold; the border is carried on."""
    x = mask.astype(float)
    for axis, step in enumerate(spacing):
        weights = gauss(sigma / step)
        r = len(weights) // 2
        padded = np.pad(x, [(r, r) if a == axis else (0, 0) for a in range(3)], mode="edge")
        n = x.shape[axis]
        x = sum(w * np.take(padded, np.arange(k, k + n), axis) for k, w in enumerate(weights))
    return x > threshold


def contour(mask: np.ndarray) -> np.ndarray:
    """Voxels of the mask with a background voxel among their 26 neighbours."""
    return mask & ~erode(mask, CUBE)


def cropped(*masks: np.ndarray) -> tuple[np.ndarray, ...]:
    """Masks cut to the box around all of them, with a border of background: distances between them stay."""
    some = np.logical_or.reduce(masks)
    if not some.any():
        return masks
    box = tuple(slice(w.min(), w.max() + 1) for w in np.nonzero(some))
    return tuple(np.pad(m[box], 1) for m in masks)


def distance_map(mask: np.ndarray, spacing=(1.0, 1.0, 1.0), signed: bool = True) -> np.ndarray:
    """Distance of every voxel in millimetres: to the mask, or, signed, to its border voxels, negative inside."""
    if not signed:
        return distances(mask, spacing)
    border = mask & ~erode(mask, FACES)
    d = distances(border, spacing)
    return np.where(mask, -d, d)


def _runs(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of its run and the place in it of each element of runs of these lengths."""
    of = np.repeat(np.arange(len(lengths)), lengths)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def filled_all(points: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inner and edge pixels (contour, column, row) of contours of whole pixels, whose points lie one after the other.

    One point is a disc of radius 1, two are a line, more are a polygon filled
    by crossings; the pixels on its edges count as well. Edge pixels may repeat.
    """
    contour, place = _runs(counts)
    n = counts[contour]
    following = np.arange(len(points)) + 1 - np.where(place == n - 1, n, 0)
    cross = np.array([(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)])
    single = n == 1
    discs = np.column_stack([np.repeat(contour[single], 5), (points[single][:, None] + cross).reshape(-1, 2)])
    edges = (n > 2) | ((n == 2) & (place == 0))
    (x0, y0), (x1, y1), contour, n = points[edges].T, points[following[edges]].T, contour[edges], n[edges]
    steps = np.maximum(abs(x1 - x0), abs(y1 - y0))
    e, at = _runs(steps + 1)
    t = at / np.maximum(steps, 1)[e]
    lines = np.column_stack([contour[e], *(np.floor(a[e] + (b - a)[e] * t + 0.5).astype(np.int64) for a, b in ((x0, x1), (y0, y1)))])
    # each row from the lower end of an edge on, without the upper one, is crossed by it; crossings of a row come in pairs
    low = np.minimum(y0, y1)
    e, at = _runs(np.where(n > 2, abs(y1 - y0), 0))
    y = low[e] + at
    cut = x0[e] + (y - y0[e]) * (x1 - x0)[e] / (y1 - y0)[e]
    order = np.lexsort((cut, y, contour[e]))
    first, last = np.ceil(cut[order[::2]]).astype(np.int64), np.floor(cut[order[1::2]]).astype(np.int64)
    of, at = _runs(np.maximum(last - first + 1, 0))
    inner = np.column_stack([contour[e][order[::2]][of], first[of] + at, y[order[::2]][of]])
    return inner, np.concatenate([discs, lines])


def filled(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inner and edge pixels (column, row) of one contour, see filled_all."""
    inner, edge = filled_all(points, np.array([len(points)]))
    return np.unique(inner[:, 1:], axis=0), np.unique(edge[:, 1:], axis=0)


#: Pixels of contours, by their boxes, that are worked out side by side.
PIXELS = 1 << 20


def _pixel_lines(cells: np.ndarray, size: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(contour, row, word, bits) of pixels (contour, column, row) in the grid, 64 columns a word."""
    c, x, y = cells[(cells[:, 1:] >= 0).all(axis=1) & (cells[:, 1] < size[1]) & (cells[:, 2] < size[0])].T
    words = -(-size[1] // 64)
    cell = np.unique(((c * size[0] + y) * words + x // 64) * 64 + x % 64)
    line, start = np.unique(cell // 64, return_index=True)
    bits = np.bitwise_or.reduceat(np.uint64(1) << (cell % 64).astype(np.uint64), start) if len(cell) else np.zeros(0, np.uint64)
    return line // words // size[0], line // words % size[0], line % words, bits.view(np.int64)


def rasterised(contours: DataFrame, size: tuple[int, int]) -> DataFrame:
    """(comparison_id, i, j, k): voxels of contours (comparison_id, k, xs, ys: pixels as doubles) in slices of size (rows, columns).

    Points are rounded, ties to even. A pixel on an edge counts; one inside
    counts if an odd number of the contours of its mask and slice is around it.
    i is the row (y), j the column (x). Contours are dealt out by mask and slice;
    rows of pixels are shuffled as words of bits, not pixels.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys = batch.column("xs"), batch.column("ys")
            counts = pc.fill_null(pc.list_value_length(xs), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            points = np.around(np.column_stack([xs.flatten().to_numpy(zero_copy_only=False), ys.flatten().to_numpy(zero_copy_only=False)])).astype(np.int64)
            rows = np.flatnonzero(counts)
            starts = (np.cumsum(counts) - counts)[rows]
            if not len(rows):
                continue
            box = np.prod(np.maximum.reduceat(points, starts) - np.minimum.reduceat(points, starts) + 3, axis=1) + counts[rows]
            part = np.cumsum(box) // PIXELS
            for chosen in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(part)) + 1):
                first, last = chosen[0], chosen[-1]
                inner, edge = filled_all(points[starts[first] : starts[last] + counts[rows[last]]], counts[rows[chosen]])
                for cells, is_edge in ((edge, True), (inner, False)):
                    c, i, w, bits = _pixel_lines(cells, size)
                    at, none = pa.array(rows[first] + c), pa.array(np.zeros(len(c), np.int64))
                    columns = [batch.column("comparison_id").take(at), pa.array(i.astype(np.int32)), pa.array(w.astype(np.int32)), batch.column("k").take(at).cast(pa.int32())]
                    yield pa.RecordBatch.from_arrays([*columns, *((pa.array(bits), none) if is_edge else (none, pa.array(bits)))], ["comparison_id", "i", "w", "k", "edge", "around"])

    kind = dict(contours.dtypes)["comparison_id"]
    dealt = contours.select("comparison_id", "k", "xs", "ys").repartition("comparison_id", "k")
    rows = dealt.mapInArrow(run, f"comparison_id {kind}, i int, w int, k int, edge long, around long")
    words = rows.groupBy("comparison_id", "i", "w", "k").agg(F.expr("bit_or(edge) | bit_xor(around)").alias("bits")).filter("bits <> 0")
    each = words.select("comparison_id", "i", "w", "k", "bits", F.explode(F.sequence(F.lit(0), F.length(F.bin("bits")) - 1)).alias("b"))
    return each.filter("(shiftright(bits, b) & 1) = 1").select("comparison_id", "i", (F.col("w") * 64 + F.col("b")).cast("int").alias("j"), "k")


def surface_dice(a: np.ndarray, b: np.ndarray, tolerance: float = 3.0, spacing=(1.0, 1.0, 1.0), axis_mode: str = "reference") -> float:
    """axis_mode: reference gives the spacings to the axes in reverse, as the studied application does; anatomical as they are."""
    spacing = tuple(spacing)[::-1] if axis_mode == "reference" else tuple(spacing)
    ca, cb = contour(a), contour(b)
    if not ca.any() and not cb.any():
        return 1.0
    if not ca.any() or not cb.any():
        return 0.0
    good = (distances(cb, spacing)[ca] <= tolerance).sum() + (distances(ca, spacing)[cb] <= tolerance).sum()
    return float(good / (ca.sum() + cb.sum()))


def added_path(reference: np.ndarray, test: np.ndarray, threshold: float = 3.0, spacing=(1.0, 1.0, 1.0), axis: int = 0) -> float:
    """Contour of the reference that the widened contour of the test misses, slice by slice along an axis; widths by the mean of the first two spacings."""
    width = (spacing[0] + spacing[1]) / 2
    r = int(np.ceil(threshold / width))
    disc = [o for o in ball(float(r)) if o[axis] == 0]
    flat = [o for o in CUBE if o[axis] == 0]
    rim = lambda m: m & ~erode(m, flat)
    missed = rim(reference) & ~dilate(rim(test), disc)
    return float(missed.sum() * width)


def information(na: int, nb: int, nab: int, size: int) -> float:
    """Variation of information of two masks in a grid of that size, from counts."""
    h = lambda *counts: -sum(c / size * np.log(c / size) for c in counts if c)
    return float(2 * h(nab, na - nab, nb - nab, size - na - nb + nab) - h(na, size - na) - h(nb, size - nb))


def along_axes(source: np.ndarray, target: np.ndarray, spacing=(1.0, 1.0, 1.0)) -> np.ndarray:
    """From each voxel of the source the distance to the nearest one of the target along an axis; NaN if no axis meets one."""
    best = np.full(source.shape, np.inf)
    for axis, step in enumerate(spacing):
        place = np.arange(source.shape[axis]).reshape([-1 if a == axis else 1 for a in range(3)])
        before = np.maximum.accumulate(np.where(target, place, -np.inf), axis)
        after = np.flip(np.minimum.accumulate(np.flip(np.where(target, place, np.inf), axis), axis), axis)
        best = np.minimum(best, np.minimum(place - before, after - place) * step)
    found = best[source]
    return np.where(np.isfinite(found), found, np.nan)


def conformity(a: np.ndarray, b: np.ndarray, spacing=(1.0, 1.0, 1.0)) -> tuple[float, float, float]:
    """mdc, umdc, omdc: mean distances of what b misses and of what b has too much, and their mean; 0 where there is nothing."""
    def mean(source: np.ndarray, target: np.ndarray) -> float:
        d = along_axes(source, target, spacing)
        d = d[~np.isnan(d)]
        return float(d.mean()) if len(d) else 0.0

    under, over = mean(a & ~b, b), mean(b & ~a, a)
    return (under + over) / 2, under, over


def _by_comparison(rows: DataFrame, size, spacing, geometry: DataFrame | None, run, schema: str) -> DataFrame:
    """run(group, grid size, spacing) for the rows of each comparison, whose geometry is the same for all or comes beside the rows."""
    if geometry is None:
        size, spacing = tuple(size), tuple(map(float, spacing))
        return rows.groupBy("comparison_id").applyInPandas(lambda group: run(group, size, spacing), schema)
    names = [c.strip().split()[0] for c in schema.split(",")]

    def both(group: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if group.empty or own.empty:
            return pd.DataFrame(columns=names)
        g = own.iloc[0]
        return run(group, (int(g.nx), int(g.ny), int(g.nz)), (float(g.sx), float(g.sy), float(g.sz)))

    of = geometry.select("comparison_id", "nx", "ny", "nz", "sx", "sy", "sz")
    return rows.groupBy("comparison_id").cogroup(of.groupBy("comparison_id")).applyInPandas(both, schema)


def apply_mask(mask: DataFrame, size: tuple[int, int, int] | None, operation, geometry: DataFrame | None = None) -> DataFrame:
    """A grid operation on every mask: voxel rows in, voxel rows out.

    geometry: (comparison_id, nx, ny, nz, sx, sy, sz) if masks have grids of
    their own; the operation then takes the mask and its spacing.
    """

    own = geometry is not None

    def run(group: pd.DataFrame, shape: tuple[int, int, int], spacing: tuple[float, float, float]) -> pd.DataFrame:
        grid = dense(group, shape)
        return sparse(operation(grid, spacing) if own else operation(grid), group.comparison_id.iloc[0])

    return _by_comparison(mask.select(*CELL), size, (1.0, 1.0, 1.0), geometry, run, f"comparison_id {dict(mask.dtypes)['comparison_id']}, i int, j int, k int")


def distance_maps(mask: DataFrame, size: tuple[int, int, int] | None, spacing=(1.0, 1.0, 1.0), signed: bool = True, geometry: DataFrame | None = None) -> DataFrame:
    """(comparison_id, i, j, k, distance) of every voxel of each mask's grid: to the mask, or, signed, to its border voxels, negative inside.

    By planes and bands of lines, so that no task holds a grid. geometry: as in
    apply_mask.
    """
    rows = L.lines(mask)
    grid = L.whole_grid(rows, size if geometry is None else geometry)
    if geometry is not None:
        spacing = geometry.select("comparison_id", *[F.col(a).cast("double").alias(b) for a, b in zip(("sx", "sy", "sz"), ("si", "sj", "sk"))])
    named = lambda d, sign: d.select(*CELL, (F.col("d") * sign).alias("distance"))
    if not signed:
        return named(L.distances(grid, rows, spacing), 1.0)
    border = L.joined(rows, L.morph(rows, [(False, FACES, False)]), "subtraction")
    outside = L.distances(L.joined(grid, rows, "subtraction"), border, spacing)
    return named(L.distances(rows, border, spacing), -1.0).union(named(outside, 1.0))


def _chosen(parts: DataFrame, good: DataFrame) -> DataFrame:
    left = parts.join(good.select("comparison_id", *L.PART), ["comparison_id", *L.PART], "left_semi")
    return left.groupBy(*L.LINE).agg(F.bit_or("bits").alias("bits"))


def largest_parts(rows: DataFrame, n: int = 1, full: bool = False) -> DataFrame:
    """The n largest components of each mask as line rows; of equal ones the first."""
    parts = L.components(rows, lambda m: labels(m, full), full)
    rank = F.row_number().over(W.partitionBy("comparison_id").orderBy(F.col("n").desc(), "first"))
    return _chosen(parts, L.sizes(parts).withColumn("rank", rank).filter(F.col("rank") <= n))


def without_small_parts(rows: DataFrame, least_volume: float, voxel: float = 1.0, full: bool = False) -> DataFrame:
    """Line rows without the components under a volume, in whole voxels upwards."""
    parts = L.components(rows, lambda m: labels(m, full), full)
    return _chosen(parts, L.sizes(parts).filter(F.col("n") >= int(np.ceil(least_volume / voxel))))


def filled_parts(rows: DataFrame, size: tuple[int, int, int] | None = None, full: bool = False) -> DataFrame:
    """Line rows with the background that no path leads out of; size is not needed, as holes lie in the box around a mask."""
    low = F.expr("array_min(filter(sequence(0, 63), b -> (shiftright(bits, b) & 1) = 1))")
    high = F.expr("array_max(filter(sequence(0, 63), b -> (shiftright(bits, b) & 1) = 1))")
    ends = {"min_i": F.min("i"), "max_i": F.max("i"), "min_j": F.min("j"), "max_j": F.max("j"), "min_k": F.min(F.col("w") * 64 + low), "max_k": F.max(F.col("w") * 64 + high)}
    box = rows.groupBy("comparison_id").agg(*[(v + (-1 if n.startswith("min") else 1)).alias(n) for n, v in ends.items()])
    parts = L.components(L.joined(L.boxes(box), rows, "subtraction"), lambda m: labels(m, full), full)
    outside = parts.join(box.select("comparison_id", "min_i", "min_j", "min_k"), "comparison_id").filter("i = min_i AND j = min_j AND low = min_k").select("comparison_id", *L.PART)
    holes = parts.join(outside, ["comparison_id", *L.PART], "left_anti").select(*L.LINE, "bits")
    return rows.select(*L.LINE, "bits").union(holes).groupBy(*L.LINE).agg(F.bit_or("bits").alias("bits"))


def metrics(cells: DataFrame, size: tuple[int, int, int] | None, spacing=(1.0, 1.0, 1.0), geometry: DataFrame | None = None, axis_mode: str = "reference", tolerance: float = 3.0, threshold: float = 3.0, names: list[str] | None = None) -> DataFrame:
    """(comparison_id, metric, value, error): dsc, jsc, voe, cs, vi, msd, hd95, surface_dsc, apl, mdc, umdc and omdc of in_a against in_b.

    A metric that fails is null, with the reason; the others of its comparison
    are there. Distances are worked out in the box around both masks. names: only
    these metrics.
    """

    def run(group: pd.DataFrame, shape: tuple[int, int, int], step: tuple[float, float, float]) -> pd.DataFrame:
        a, b = dense(group[group.in_a], shape), dense(group[group.in_b], shape)
        both, some = int((a & b).sum()), int((a | b).sum())
        na, nb = int(a.sum()), int(b.sum())
        a, b = cropped(a, b)

        @cache
        def conform() -> tuple[float, float, float]:
            return conformity(a, b, step)

        @cache
        def directed() -> tuple[float, float]:
            if not na or not nb:
                return np.inf, np.inf
            x, y = distances(b)[a], distances(a)[b]
            return (x.mean() + y.mean()) / 2, max(np.percentile(x, 95), np.percentile(y, 95))

        wanted = {
            "dsc": lambda: 2 * both / (na + nb) if na + nb else 1.0, "jsc": lambda: both / some if some else 1.0, "voe": lambda: 1 - both / some if some else 0.0,
            "cs": lambda: both / np.sqrt(float(na) * nb) if na and nb else 0.0, "msd": lambda: directed()[0], "hd95": lambda: directed()[1],
            "surface_dsc": lambda: surface_dice(a, b, tolerance, step, axis_mode), "apl": lambda: added_path(a, b, threshold, step),
            "vi": lambda: information(na, nb, both, int(np.prod(shape))), "mdc": lambda: conform()[0], "umdc": lambda: conform()[1], "omdc": lambda: conform()[2],
        }
        rows = []
        for name, compute in wanted.items():
            if names is not None and name not in names:
                continue
            try:
                rows.append((name, float(compute()), None))
            except (ValueError, ArithmeticError, MemoryError) as e:
                rows.append((name, None, f"{type(e).__name__}: {e}"))
        out = pd.DataFrame(rows, columns=["metric", "value", "error"])
        out.insert(0, "comparison_id", group.comparison_id.iloc[0])
        return out

    return _by_comparison(cells.select(*CELL, "in_a", "in_b"), size, spacing, geometry, run, f"comparison_id {dict(cells.dtypes)['comparison_id']}, metric string, value double, error string")
