"""Masks as line rows: margins, distances and components of masks of any size.

A line row is (comparison_id, i, j, w, bits): 64 voxels along k from 64 * w on, as
the bits of a long. A mask is dealt out in slabs of neighbouring i, each with the
lines around it that an operation reaches, so a task holds a slab, never a grid,
and lines are shuffled, not voxels times offsets. In a slab an offset is a shift,
a dilation an OR, an erosion an AND.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = ["comparison_id", "i", "j", "k"]
LINE = ["comparison_id", "i", "j", "w"]
#: Slices (i) of a slab at least; it grows with the reach of an operation, so that under two copies of a line travel.
SLAB = 16
#: Planes (i) of the first passes of distances that a task does at a time, and lines (j) of the last pass.
PLANES, BAND = 8, 8
#: Words of the small blocks that a task works on side by side.
SIDE = 1 << 19
WORD = np.uint64(64)
ONE = np.uint64(1)

Offsets = list[tuple[int, int, int]]
#: (grow, offsets, keep to the grid) of one dilation or erosion.
Step = tuple[bool, Offsets, bool]


def lines(mask: DataFrame) -> DataFrame:
    """Voxel rows as line rows; equal voxels count once."""
    return mask.groupBy("comparison_id", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.floor(F.col("k") / 64).cast("int").alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, int(pmod(k, 64)))")).alias("bits")
    )


def places(bits: Column) -> Column:
    """The numbers of the bits of a long up to its last one."""
    return F.sequence(F.lit(0), F.length(F.bin(bits)) - 1)


def voxels(rows: DataFrame) -> DataFrame:
    """Line rows as voxel rows."""
    each = rows.select(*LINE, "bits", F.explode(places(F.col("bits"))).alias("b"))
    return each.filter("(shiftright(bits, b) & 1) = 1").select("comparison_id", "i", "j", (F.col("w") * 64 + F.col("b")).alias("k"))


def kind(df: DataFrame) -> str:
    return dict(df.dtypes)["comparison_id"]


def reach(offsets: Offsets, axis: int) -> int:
    return max((abs(o[axis]) for o in offsets), default=0)


def columns_of(offsets: Offsets) -> dict[tuple[int, int], list[int]]:
    out: dict[tuple[int, int], list[int]] = {}
    for x, y, z in offsets:
        out.setdefault((x, y), []).append(z)
    return out


def along(bits: np.ndarray, by: int) -> np.ndarray:
    """Lines of words moved by ``by`` voxels along the last axis; what leaves the words is lost."""
    words, rest = divmod(by, 64)
    out = np.zeros_like(bits)
    n = bits.shape[-1]
    for shift, part in ((words, bits << np.uint64(rest)), (words + 1, bits >> np.uint64(64 - rest) if rest else None)):
        if part is not None and abs(shift) < n:
            to, of = slice(max(0, shift), n + min(0, shift)), slice(max(0, -shift), n - max(0, shift))
            out[..., to] |= part[..., of]
    return out


def spread(bits: np.ndarray, zs: list[int], grow: bool) -> np.ndarray:
    """OR (or AND) of the lines moved by each of zs."""
    out = None
    for z in zs:
        moved = along(bits, z) if z else bits
        out = moved.copy() if out is None else (np.bitwise_or if grow else np.bitwise_and)(out, moved, out=out)
    return out


def morphed(bits: np.ndarray, offsets: Offsets, grow: bool) -> np.ndarray:
    """Dilation or erosion of words (.., i, j, w); outside there is nothing."""
    by_zs: dict[tuple[int, ...], list[tuple[int, int]]] = {}
    for (x, y), zs in columns_of(offsets).items():
        by_zs.setdefault(tuple(sorted(zs)), []).append((x, y))
    out = np.zeros_like(bits) if grow else np.full_like(bits, np.uint64(2**64 - 1))
    ni, nj = bits.shape[-3:-1]
    for zs, places in by_zs.items():
        part = spread(bits, list(zs) if grow else [-z for z in zs], grow)
        for x, y in places:
            if not grow:
                x, y = -x, -y
            to = ..., slice(max(0, x), ni + min(0, x)), slice(max(0, y), nj + min(0, y)), slice(None)
            of = ..., slice(max(0, -x), ni - max(0, x)), slice(max(0, -y), nj - max(0, y)), slice(None)
            if grow:
                out[to] |= part[of]
            else:
                moved = np.zeros_like(bits)
                moved[to] = part[of]
                out &= moved
    return out


def within(bits: np.ndarray, first: tuple[np.ndarray, np.ndarray, np.ndarray], size: tuple[int, int, int]) -> np.ndarray:
    """Words (block, i, j, w) without what lies outside the grid; first: the places of the first voxels."""
    n, ni, nj, nw = bits.shape
    i, j, k = (np.arange(m) + a[:, None] for m, a in zip((ni, nj, nw * 64), first))
    inside = [(x >= 0) & (x < m) for x, m in zip((i, j, k), size)]
    words = np.packbits(inside[2], axis=-1, bitorder="little").view(np.uint64)
    return np.where(inside[0][:, :, None, None] & inside[1][:, None, :, None], bits & words[:, None, None, :], np.uint64(0))


def slabs(rows: DataFrame, thick: int, halo: int) -> DataFrame:
    """Line rows with the number of each slab that needs them."""
    first, last = F.floor((F.col("i") - halo) / thick), F.floor((F.col("i") + halo) / thick)
    return rows.withColumn("slab", F.explode(F.sequence(first.cast("int"), last.cast("int"))))


def starts_of(table: pa.Table | pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """The rows where a group begins; groups lie together."""
    new = np.zeros(len(table), bool)
    new[:1] = True
    for key in keys:
        column = table.column(key)
        codes = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= np.diff(codes) != 0
    return np.flatnonzero(new)


def by_groups(rows: DataFrame, keys: list[str], run: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """run for tables of whole groups: many small ones, or a large one, at a time, so that masks of a few lines don't cost a call each."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []  # rows of the last group
        key = None
        for batch in batches:
            if not len(batch):
                continue
            cut = int(starts_of(batch, keys)[-1])
            last = [batch.column(c)[len(batch) - 1].as_py() for c in keys]
            if cut or last != key:
                whole = [b for b in (*waiting, batch.slice(0, cut)) if len(b)]
                if whole:
                    yield from run(pa.Table.from_batches(whole)).to_batches()
                waiting, key = [], last
            waiting.append(batch.slice(cut))
        if waiting:
            yield from run(pa.Table.from_batches(waiting)).to_batches()

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(each, schema)


def blocks(table: pa.Table, pad: tuple[int, int, int], thick: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """(row, bits, first) of groups by comparison and slab, those of about one shape side by side.

    bits: words (block, i, j, w), padded by pad in voxels. row: the first row of
    each group; first: the places of the first voxels. thick: of the slabs, for
    blocks of whole slabs; else a block has the i of its lines.
    """
    starts = starts_of(table, ["comparison_id", "slab"])
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(table))))
    i, j, w = (table.column(n).to_numpy() for n in ("i", "j", "w"))
    words = table.column("bits").to_numpy().view(np.uint64)
    pw = -(-pad[2] // 64)
    low = [np.minimum.reduceat(x, starts).astype(np.int64) - p for x, p in ((i, pad[0]), (j, pad[1]), (w, pw))]
    shape = [np.maximum.reduceat(x, starts) + p - a + 1 for (x, p), a in zip(((i, pad[0]), (j, pad[1]), (w, pw)), low)]
    if thick is not None:
        low[0] = table.column("slab").to_numpy()[starts].astype(np.int64) * thick - pad[0]
        shape[0] = np.full(len(starts), thick + 2 * pad[0])
    shape = np.column_stack([-(-shape[0] // 4) * 4 if thick is None else shape[0], -(-shape[1] // 4) * 4, shape[2]])
    every, of = np.unique(shape, axis=0, return_inverse=True)
    of = of.ravel()
    place = np.empty(len(starts), np.int64)
    for k, size in enumerate(every):
        members = np.flatnonzero(of == k)
        some = max(1, SIDE // int(np.prod(size)))
        for at in range(0, len(members), some):
            own = members[at : at + some]
            place[own] = np.arange(len(own))
            rows = np.concatenate([np.arange(starts[g], starts[g + 1] if g + 1 < len(starts) else len(table)) for g in own])
            g = group[rows]
            bits = np.zeros((len(own), *size), np.uint64)
            bits[place[g], i[rows] - low[0][g], j[rows] - low[1][g], w[rows] - low[2][g]] = words[rows]
            yield starts[own], bits, (low[0][own], low[1][own], low[2][own] * 64)


def table_of(table: pa.Table, rows: np.ndarray, ints: list[np.ndarray], names: list[str], **more: pa.Array) -> pa.Table:
    """The comparisons of some rows, with columns of int and others."""
    columns = [table.column("comparison_id").combine_chunks().take(pa.array(rows)), *(pa.array(np.asarray(x).astype(np.int32)) for x in ints)]
    return pa.Table.from_arrays([*columns, *more.values()], ["comparison_id", *names, *more])


def morph(rows: DataFrame, steps: list[Step], size: tuple[int, int, int] | None = None) -> DataFrame:
    """Line rows after dilations and erosions in order, in one shuffle. Outside the grid there is no mask."""
    steps = [s for s in steps if s[1] != [(0, 0, 0)]]
    if not steps:
        return rows.select(*LINE, "bits")
    pad = tuple(sum(reach(offsets, a) for _, offsets, _ in steps) for a in range(3))
    thick = max(SLAB, 4 * pad[0])

    def run(table: pa.Table) -> pa.Table:
        out = []
        for row, bits, first in blocks(table, pad, thick):
            for grow, offsets, keep in steps:
                bits = morphed(bits, offsets, grow)
                if keep and size is not None:
                    bits = within(bits, first, size)
            bits = bits[:, pad[0] : pad[0] + thick]
            g, i, j, w = np.nonzero(bits)
            ints = [i + first[0][g] + pad[0], j + first[1][g], w + first[2][g] // 64]
            out.append(table_of(table, row[g], ints, ["i", "j", "w"], bits=pa.array(bits[g, i, j, w].view(np.int64))))
        return pa.concat_tables(out)

    dealt = slabs(rows.select(*LINE, "bits"), thick, pad[0])
    return by_groups(dealt, ["comparison_id", "slab"], run, f"comparison_id {kind(rows)}, i int, j int, w int, bits long")


def closing(offsets: Offsets) -> list[Step]:
    """Gaps of the element are closed; the growth may leave the grid in between."""
    return [(True, offsets, False), (False, offsets, True)]


def opening(offsets: Offsets) -> list[Step]:
    return [(False, offsets, False), (True, offsets, True)]


def joined(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """Union, intersection, subtraction or xor of two masks as line rows: one shuffle of lines."""
    zero = F.lit(0).cast("long")
    both = a.select(*LINE, F.col("bits").alias("a"), zero.alias("b")).union(b.select(*LINE, zero, "bits"))
    sums = both.groupBy(*LINE).agg(F.bit_or("a").alias("a"), F.bit_or("b").alias("b"))
    test = {"union": "a | b", "intersection": "a & b", "subtraction": "a & ~b", "xor": "a ^ b"}[how]
    return sums.select(*LINE, F.expr(test).alias("bits")).filter("bits <> 0")


# --- distances --------------------------------------------------------------------------


#: Lines whose envelopes are worked out side by side.
TOGETHER = 4096


def envelope(f: np.ndarray, step: float) -> np.ndarray:
    """min over q of f[q] + ((p - q) * step)^2 for each p along the first axis: the lower envelope of parabolas.

    Lines (second axis) advance together, some at a time. Each parabola enters the
    envelope once and leaves it at most once, so the work is linear in the line.
    """
    out = np.empty_like(f)
    for at in range(0, f.shape[1], TOGETHER):
        out[:, at : at + TOGETHER] = _envelopes(f[:, at : at + TOGETHER], step)
    return out


def _envelopes(f: np.ndarray, step: float) -> np.ndarray:
    n, m = f.shape
    g = f / (step * step)
    place = np.zeros((n, m), np.int64)  # parabolas of the envelope
    start = np.full((n + 1, m), np.inf)  # where each begins
    top = np.full(m, -1)
    for q in range(n):
        alive = np.flatnonzero(np.isfinite(g[q]))
        waiting = alive
        while len(waiting):
            t = top[waiting]
            empty = t < 0
            last = place[np.maximum(t, 0), waiting]
            with np.errstate(divide="ignore", invalid="ignore"):
                cross = np.where(empty, -np.inf, (g[q, waiting] + q * q - g[last, waiting] - last * last) / (2.0 * np.where(empty, 1, q - last)))
            out = ~empty & (cross <= start[np.maximum(t, 0), waiting])
            stay = ~out
            w, c = waiting[stay], cross[stay]
            top[w] += 1
            place[top[w], w], start[top[w], w] = q, c
            waiting = waiting[out]
            top[waiting] -= 1
    result = np.full((n, m), np.inf)
    some = np.flatnonzero(top >= 0)
    at = np.zeros(len(some), np.int64)
    for p in range(n):
        while True:
            more = (at < top[some]) & (start[np.minimum(at + 1, n), some] < p)
            if not more.any():
                break
            at[more] += 1
        q = place[at, some]
        result[p, some] = ((p - q) * step) ** 2 + f[q, some]
    return result


def unpacked(bits: np.ndarray) -> np.ndarray:
    """Words (.., w) as voxels (.., k)."""
    return np.unpackbits(np.ascontiguousarray(bits).view(np.uint8).reshape(*bits.shape[:-1], -1), axis=-1, bitorder="little").astype(bool)


Spacing = tuple[float, float, float]


def stepped(rows: DataFrame, spacing: Spacing | DataFrame) -> DataFrame:
    """Rows with si, sj, sk: the steps of the axes, the same for all or by comparison_id (si, sj, sk)."""
    if isinstance(spacing, DataFrame):
        return rows.join(spacing.select("comparison_id", "si", "sj", "sk"), "comparison_id")
    return rows.withColumns({n: F.lit(float(v)) for n, v in zip(("si", "sj", "sk"), spacing)})


def squares(targets: DataFrame, box: DataFrame) -> DataFrame:
    """(comparison_id, band, i, d): squared distances to the targets within each plane i, for BAND lines j of the box.

    targets: line rows. box: (comparison_id, min_j, max_j, min_k, max_k, sj, sk).
    Along k and j in one task for some planes; a plane without a target has no row.
    """

    def run(group: pa.Table) -> pa.Table:
        key = group.column("comparison_id")[0].as_py()
        j0, j1, k0, k1, sj, sk = (group.column(n)[0].as_py() for n in ("min_j", "max_j", "min_k", "max_k", "sj", "sk"))
        i, j, w = (group.column(n).to_numpy() for n in ("i", "j", "w"))
        planes, place = np.unique(i, return_inverse=True)
        lo, hi, wlo, whi = min(j0, int(j.min())), max(j1, int(j.max())), min(k0 // 64, int(w.min())), max(k1 // 64, int(w.max()))
        bits = np.zeros((len(planes), hi - lo + 1, whi - wlo + 1), np.uint64)
        bits[place.ravel(), j - lo, w - wlo] = group.column("bits").to_numpy().view(np.uint64)
        d = np.moveaxis(np.where(unpacked(bits), 0.0, np.inf), 2, 0)  # (k, plane, j)
        d = envelope(d.reshape(len(d), -1), sk).reshape(d.shape)[k0 - wlo * 64 : k1 + 1 - wlo * 64]
        d = np.moveaxis(d, 2, 0)  # (j, k, plane)
        d = envelope(d.reshape(len(d), -1), sj).reshape(d.shape)[j0 - lo : j1 + 1 - lo]
        d = np.moveaxis(d, 2, 0)  # (plane, j, k)
        bands = range(j0 // BAND, j1 // BAND + 1)
        rows = [np.ascontiguousarray(p[max(0, b * BAND - j0) : (b + 1) * BAND - j0]).tobytes() for p in d for b in bands]
        columns = [pa.array([key] * len(rows), group.schema.field("comparison_id").type), pa.array(np.tile(np.array(bands, np.int32), len(planes))), pa.array(np.repeat(planes.astype(np.int32), len(bands))), pa.array(rows, pa.binary())]
        return pa.Table.from_arrays(columns, ["comparison_id", "band", "i", "d"])

    some = targets.join(box, "comparison_id").withColumn("planes", F.floor(F.col("i") / PLANES))
    return some.groupBy("comparison_id", "planes").applyInArrow(run, f"comparison_id {kind(targets)}, band int, i int, d binary")


def distances(sources: DataFrame, targets: DataFrame, spacing: Spacing | DataFrame = (1.0, 1.0, 1.0)) -> DataFrame:
    """(comparison_id, i, j, k, d): of every source voxel the distance to the nearest target voxel; exact.

    Line rows in. Two shuffles: planes of targets, then bands of lines with the
    sources. Comparisons without targets have no row. spacing: of the axes, for
    all or by comparison.
    """
    box = sources.groupBy("comparison_id").agg(F.min("j").alias("min_j"), F.max("j").alias("max_j"), (F.min("w") * 64).alias("min_k"), (F.max("w") * 64 + 63).alias("max_k"))
    box = stepped(box, spacing)
    planes = squares(targets, box)
    own = sources.join(box, "comparison_id").withColumn("band", F.floor(F.col("j") / BAND).cast("int"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = [*CELL, "d"]
        if not len(left) or not len(right):
            return pa.Table.from_arrays([pa.array([], left.schema.field("comparison_id").type), *(pa.array([], pa.int32()) for _ in "ijk"), pa.array([], pa.float64())], names)
        key, band = left.column("comparison_id")[0].as_py(), left.column("band")[0].as_py()
        j0, j1, k0, k1, si = (left.column(n)[0].as_py() for n in ("min_j", "max_j", "min_k", "max_k", "si"))
        first, nk = max(j0, band * BAND), k1 - k0 + 1
        nj = min(j1, band * BAND + BAND - 1) - first + 1
        i, j, w = (left.column(n).to_numpy() for n in ("i", "j", "w"))
        of = right.column("i").to_numpy()
        lo, hi = min(int(i.min()), int(of.min())), max(int(i.max()), int(of.max()))
        field = np.full((hi - lo + 1, nj * nk), np.inf)
        field[of - lo] = np.frombuffer(b"".join(right.column("d").to_pylist()), float).reshape(len(of), nj * nk)
        field = envelope(field, si).reshape(hi - lo + 1, nj, nk)
        at, b = np.nonzero(unpacked(left.column("bits").to_numpy().view(np.uint64)[:, None]))
        i, j, k = i[at], j[at], w[at] * 64 + b
        d = np.sqrt(field[i - lo, j - first, k - k0])
        return pa.Table.from_arrays([pa.array([key] * len(i), left.schema.field("comparison_id").type), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(d)], names)

    return own.groupBy("comparison_id", "band").cogroup(planes.groupBy("comparison_id", "band")).applyInArrow(run, f"comparison_id {kind(sources)}, i int, j int, k int, d double")


def whole_grid(rows: DataFrame, size: tuple[int, int, int] | DataFrame) -> DataFrame:
    """Line rows of the whole grid of every comparison; size: for all, or by comparison (nx, ny, nz)."""
    full = rows.select("comparison_id").distinct()
    if isinstance(size, DataFrame):
        full = full.join(size.select("comparison_id", "nx", "ny", "nz"), "comparison_id")
    else:
        full = full.withColumns({n: F.lit(v) for n, v in zip(("nx", "ny", "nz"), size)})
    return boxes(full.select("comparison_id", *[e for n, c in zip("ijk", ("nx", "ny", "nz")) for e in (F.lit(0).alias(f"min_{n}"), (F.col(c) - 1).alias(f"max_{n}"))]))


def boxes(box: DataFrame) -> DataFrame:
    """Line rows of all voxels of a box (comparison_id, min_i, max_i, ...) for each comparison."""
    full = box.withColumn("i", F.explode(F.sequence("min_i", "max_i"))).withColumn("j", F.explode(F.sequence("min_j", "max_j")))
    full = full.withColumn("w", F.explode(F.sequence(F.floor(F.col("min_k") / 64).cast("int"), F.floor(F.col("max_k") / 64).cast("int"))))
    # shifts by 64 are shifts by 0, so a word is cut at either end on its own
    low = F.expr("shiftleft(-1L, greatest(min_k - w * 64, 0))")
    high = F.expr("shiftrightunsigned(-1L, greatest(w * 64 + 63 - max_k, 0))")
    return full.select(F.col("comparison_id"), F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), "w", low.bitwiseAND(high).alias("bits"))


# --- components -------------------------------------------------------------------------


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest number that each of 0..n-1 is joined with, by pairs (union-find)."""
    root = np.arange(n)
    while len(a):
        u, v = root[a], root[b]
        apart = u != v
        a, b, u, v = a[apart], b[apart], u[apart], v[apart]
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while (root[root] != root).any():
            root = root[root]
    return root


PART = ["slab", "part"]


def components(mask: DataFrame, label: Callable[[np.ndarray], np.ndarray], full: bool = False, thick: int = SLAB) -> DataFrame:
    """(comparison_id, slab, part, i, j, w, bits, low): line rows by component, which (slab, part) names; low: the first k.

    Voxels are labelled slab by slab (``label`` numbers the components of a
    grid); where two slabs touch, the labels of neighbouring voxels are joined,
    and the smallest of a chain of joined labels names the component.
    """
    schema = f"comparison_id {kind(mask)}, slab int, part int, i int, j int, w int, bits long, low int"

    def run(table: pa.Table) -> pa.Table:
        out = []
        for row, bits, first in blocks(table, (0, 0, 0)):
            n, ni, nj, nw = bits.shape
            used = np.flatnonzero(unpacked(np.bitwise_or.reduce(bits, (0, 1, 2))))
            k0, nk = int(used[0]), int(used[-1] - used[0]) + 1
            grid = np.zeros((n, ni + 1, nj, nk), bool)  # an empty plane keeps the blocks apart
            grid[:, :ni] = unpacked(bits)[..., k0 : k0 + nk]
            numbers = label(grid.reshape(-1, nj, nk)).reshape(grid.shape)
            g, i, j, k = np.nonzero(numbers)  # in order of lines
            least = np.minimum.reduceat(numbers[g, i, j, k], np.searchsorted(g, np.arange(n)))
            part, k = numbers[g, i, j, k] - least[g] + 1, k + k0
            w = k // 64
            line = (((g * ni + i) * nj + j) * nw + w).astype(np.int64)
            order = np.lexsort((k, part, line))
            g, i, j, k, w, part, line = (x[order] for x in (g, i, j, k, w, part, line))
            at = np.flatnonzero(np.concatenate([[True], (np.diff(line) != 0) | (np.diff(part) != 0)]))
            words = np.bitwise_or.reduceat(ONE << (k % 64).astype(np.uint64), at)
            g, i, j, k, w, part = (x[at] for x in (g, i, j, k, w, part))
            slab = table.column("slab").to_numpy()[row[g]]
            ints = [slab, part, i + first[0][g], j + first[1][g], w + first[2][g] // 64]
            out.append(table_of(table, row[g], ints, [*PART, "i", "j", "w"], bits=pa.array(words.view(np.int64)), low=pa.array((k + first[2][g]).astype(np.int32))))
        return pa.concat_tables(out)

    own = by_groups(mask.select(*LINE, "bits").filter("bits <> 0").withColumn("slab", F.floor(F.col("i") / thick).cast("int")), ["comparison_id", "slab"], run, schema)
    above = own.filter(f"pmod(i, {thick}) = {thick - 1}").select("comparison_id", (F.col("i") + 1).alias("i"), "j", "w", F.col("slab").alias("s1"), F.col("part").alias("p1"), F.col("bits").alias("b1"))
    if full:  # a neighbour may lie one further along j, k or both
        words = "array(struct(0 AS x, b1 | shiftleft(b1, 1) | shiftrightunsigned(b1, 1) AS b), struct(1 AS x, shiftrightunsigned(b1, 63) AS b), struct(-1 AS x, shiftleft(b1, 63) AS b))"
        above = above.withColumn("y", F.explode(F.array(*map(F.lit, (-1, 0, 1))))).withColumn("o", F.explode(F.expr(words)))
        above = above.select("comparison_id", "i", (F.col("j") + F.col("y")).alias("j"), (F.col("w") + F.col("o.x")).alias("w"), "s1", "p1", F.col("o.b").alias("b1"))
    below = own.filter(f"pmod(i, {thick}) = 0").select(*LINE, F.col("slab").alias("s2"), F.col("part").alias("p2"), F.col("bits").alias("b2"))
    touching = above.join(below, LINE).filter("(b1 & b2) <> 0").select("comparison_id", "s1", "p1", "s2", "p2").distinct()

    def join(table: pa.Table) -> pa.Table:
        row = starts_of(table, ["comparison_id"])
        of = np.repeat(np.arange(len(row)), np.diff(np.append(row, len(table))))
        ends = [np.column_stack([of, table.column(s).to_numpy(), table.column(p).to_numpy()]).astype(np.int64) for s, p in (("s1", "p1"), ("s2", "p2"))]
        every, index = np.unique(np.concatenate(ends), axis=0, return_inverse=True)
        index = index.ravel()
        to = every[roots(index[: len(ends[0])], index[len(ends[0]) :], len(every))]
        return table_of(table, row[every[:, 0]], [every[:, 1], every[:, 2], to[:, 1], to[:, 2]], [*PART, "to_slab", "to_part"])

    # pairs of labels at the borders of slabs of one mask: far fewer than its lines
    same = by_groups(touching, ["comparison_id"], join, f"comparison_id {kind(mask)}, slab int, part int, to_slab int, to_part int")
    named = own.join(same, ["comparison_id", *PART], "left")
    return named.select("comparison_id", F.coalesce("to_slab", "slab").alias("slab"), F.coalesce("to_part", "part").alias("part"), "i", "j", "w", "bits", "low")


def sizes(parts: DataFrame) -> DataFrame:
    """(comparison_id, slab, part, n, first) of each component: its voxels and the first of them."""
    return parts.groupBy("comparison_id", *PART).agg(F.sum(F.bit_count("bits")).alias("n"), F.min(F.struct("i", "j", "low")).alias("first"))
