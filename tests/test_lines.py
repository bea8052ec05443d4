"""Masks as line rows against grids of numpy, and pipelines by their vocabulary."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from radlake.operators import kernels as K
from radlake.operators import lines as L
from radlake.operators import voxels as V
from radlake.plans import masks as P

SIZE = (40, 23, 70)
RNG = np.random.default_rng(0)
GRIDS = {1: RNG.random(SIZE) < 0.01, 2: RNG.random(SIZE) < 0.4, 3: RNG.random(SIZE) < 0.6}


def rows_of(spark, grids):
    df = spark.createDataFrame(pd.concat([K.sparse(m, c) for c, m in grids.items()]))
    return df.select(F.col("comparison_id").cast("long").alias("comparison_id"), *[F.col(n).cast("int").alias(n) for n in "ijk"])


@pytest.fixture(scope="module")
def mask(spark):
    return rows_of(spark, GRIDS).cache()


def same(got, f, grids=GRIDS, size=SIZE):
    found = {c: np.zeros(size, bool) for c in grids}
    for r in got.toPandas().itertuples():
        found[r.comparison_id][r.i, r.j, r.k] = True
    return all((found[c] == f(m)).all() for c, m in grids.items())


@pytest.mark.parametrize("shape", P.KERNELS)
def test_margins(mask, shape):
    spacing = (1.0, 1.0, 0.7)
    assert same(V.margin(mask, 2.0, SIZE, spacing, shape), lambda m: K.dilate(m, V.ball(2.0, spacing, shape)))
    assert same(V.margin(mask, -1.0, SIZE, shape=shape), lambda m: K.erode(m, V.ball(1.0, shape=shape)))


def test_steps_in_one_shuffle(mask):
    b = V.ball(1.0)
    assert same(L.voxels(L.morph(L.lines(mask), L.closing(b) + L.opening(b), SIZE)), K.smooth)
    assert same(V.directed_margin(mask, (1.0, -1.0, 2.0), SIZE), lambda m: K.dilate(K.erode(K.dilate(m, V.element((1, 0, 0))), V.element((0, 1, 0))), V.element((0, 0, 2))))


@pytest.mark.parametrize("full", [False, True])
def test_components_over_slabs(mask, full):
    rows = L.lines(mask)
    assert same(L.voxels(K.largest_parts(rows, 2, full)), lambda m: K.keep_largest(m, 2, full))
    assert same(L.voxels(K.without_small_parts(rows, 4.5, 1.0, full)), lambda m: K.remove_small(m, 4.5, 1.0, full))
    assert same(L.voxels(K.filled_parts(rows, SIZE, full)), lambda m: K.fill_holes(m, full))


def test_a_snake_through_all_slabs(spark):
    """One component that turns back at every slab's end."""
    grid = np.zeros((80, 12, 5), bool)
    for j in range(0, 12, 2):
        grid[:, j, 2] = True
        grid[-1 if j % 4 == 0 else 0, min(j + 1, 11), 2] = True
    assert K.labels(grid).max() == 1
    parts = L.components(L.lines(rows_of(spark, {1: grid})), K.labels)
    assert L.sizes(parts).select("n").collect()[0].n == grid.sum() and L.sizes(parts).count() == 1
    assert parts.select(F.floor(F.col("i") / L.SLAB)).distinct().count() == 5  # of one mask, five tasks


def test_voxels_left_of_the_origin(spark):
    rows = spark.createDataFrame([("a", -3, -70, -65), ("a", -3, -70, 64), ("a", 5, 0, 63), ("a", 5, 0, 63)], "comparison_id string, i int, j int, k int")
    assert sorted(tuple(r) for r in L.voxels(L.lines(rows)).collect()) == [("a", -3, -70, -65), ("a", -3, -70, 64), ("a", 5, 0, 63)]
    grown = L.voxels(L.morph(L.lines(rows), [(True, V.ball(1.0), False)]))
    assert grown.count() == 21 and {(-3, -70, -66), (-3, -71, -65), (5, 0, 64), (6, 0, 63)} <= {(r.i, r.j, r.k) for r in grown.collect()}
    assert K.filled_parts(L.lines(rows)).count() == 3 and L.lines(rows.limit(0)).count() == 0


def test_distances_by_planes_and_bands(mask):
    spacing = (1.5, 1.0, 0.7)
    got = K.distance_maps(mask, SIZE, spacing).toPandas()
    for c, m in GRIDS.items():
        x = got[got.comparison_id == c]
        d = np.full(SIZE, np.nan)
        d[x.i, x.j, x.k] = x.distance
        assert len(x) == m.size and np.allclose(d, K.distance_map(m, spacing))


def test_envelopes_are_linear():
    """Four times as long lines take about four times as long, not sixteen."""
    took = []
    for n in (256, 1024):
        f = np.where(np.random.default_rng(n).random((n, 512)) < 0.5, 0.0, 7.0) + np.random.default_rng(1).random((n, 512))
        began = time.process_time()
        got = L.envelope(f, 0.5)
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0]
    p = np.arange(1024)
    assert np.allclose(got[:, 3], (f[None, :, 3] + ((p[:, None] - p) * 0.5) ** 2).min(1))
    assert np.isinf(L.envelope(np.full((4, 2), np.inf), 1.0)).all()


def test_lines_travel_not_voxels(spark):
    """A ball of radius 5 has 515 offsets; each line goes to under two slabs."""
    ball = spark.range(96 * 96 * 96).selectExpr("1L AS comparison_id", "int(id / 9216) AS i", "int(id / 96 % 96) AS j", "int(id % 96) AS k").filter("(i-48)*(i-48) + (j-48)*(j-48) + (k-48)*(k-48) < 1600")
    rows = L.lines(ball)
    halo = 5
    assert L.slabs(rows, max(L.SLAB, 4 * halo), halo).count() < 2 * rows.count()
    grown = V.margin(ball, 5.0, (96, 96, 96))
    assert grown._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2  # lines, slabs
    grid = np.zeros((96, 96, 96), bool)
    at = ball.toPandas()
    grid[at.i, at.j, at.k] = True
    assert grown.count() == int((K.distances(grid) <= 5 + 1e-9).sum())


def test_vocabulary(spark):
    one = spark.createDataFrame([(1, 3, 3, 3)], "comparison_id int, i int, j int, k int")
    other = spark.createDataFrame([(1, 4, 3, 3), (1, 3, 3, 3)], "comparison_id int, i int, j int, k int")
    size, rois = (7, 7, 7), {"a": one, "b": other}
    n = lambda *steps, **more: P.run(list(steps), rois, size, **more).count()
    step = lambda kind, **p: {"type": kind, "parameters": p}
    first = {"type": "margin", "structures": ["a"]}
    assert n(first) == 1 and n(first, step("expand", margin_mm=1.0, kernel_type="box")) == 27 and n(first, step("expand", margin_mm=1.0, kernel_type="CROSS")) == 7 and n(first, step("expand", margin_mm=1, kernel_type="star")) == 7
    assert n(first, step("union", other_roi="b")) == 2 and n(first, step("intersection", other_roi="b")) == 1
    assert n({"type": "margin", "structures": ["b"]}, step("subtract", other_roi="a")) == 1 and n({"type": "margin", "structures": ["b"]}, step("subtract", other_roi="a", margin_mm=1.0)) == 0
    assert n(first, step("anisotropic_margin", margin_x_mm=2.0, margin_y_mm=0.0, margin_z_mm=0.0)) == 5
    assert n(first, step("expand", margin_mm=1.0) | {"output_name": "grown"}, step("crop_to_boundary", boundary_roi="b"), {"type": "margin", "source_roi": "grown"}) == 7
    assert n(step("expand", margin_mm=1.0), step("remove_small_components", min_size_mm3=8), start=one) == 0
    assert n(step("keep_largest"), step("fill_holes", fully_connected=True), step("close_gaps", gap_size_mm=1.0), step("remove_protrusions", protrusion_size_mm=1.0), start=one) == 0
    for bad, why in ((step("subtract", other="b"), "step 2: subtract has no parameter other"), (step("close_gaps", gap_mm=1.0), "no parameter gap_mm"), (step("union"), "step 2: union needs"), (step("union", other_roi="z"), "step 2: no mask z"), (step("hull"), "step 2: no operation hull")):
        with pytest.raises(ValueError, match=why):
            n(first, bad)


def test_executed_definitions(spark):
    frame = lambda *cells: spark.createDataFrame([(1, *c) for c in cells], "comparison_id int, i int, j int, k int")
    rois = {"a": frame((1, 1, 1)), "b": frame((5, 5, 5)), "c": frame((5, 5, 5), (3, 3, 3))}
    run = lambda *steps: {(r.i, r.j, r.k) for r in P.run(list(steps), rois, (7, 7, 7), dialect="executor").collect()}
    step = lambda kind, *names, **p: {"type": kind, "structures": list(names), "parameters": p}
    assert run(step("union", "a", "b"), step("subtract", "c", "b")) == {(3, 3, 3)}  # c without b, not the union
    assert len(run(step("subtract", "c", "b", margin_mm=1.0))) == 7  # the result grows
    assert run(step("expand", "a", margin_mm=1.0), step("union", "a", "b")) == {(1, 1, 1), (5, 5, 5)}  # the margin is lost
    assert run(step("expand", "a", margin_mm=9.0), step("crop_to_boundary", "c")) == {(3, 3, 3), (5, 5, 5)}
    assert run(step("union", "a", "b"), {"type": "smooth"}) == set()  # 2 mm
    for bad, why in ((step("expand", "a", "b"), "takes 1"), (step("union", "a"), "2 or more"), ({"type": "smooth"}, "step 1: smooth needs a result"), (step("close_gaps"), "no operation"), (step("keep_largest", n=2), "no parameter n"), (step("subtract", "a", "b", other_roi="c"), "no parameter")):
        with pytest.raises(ValueError, match=why):
            run(bad)


def test_reoriented_grids(spark):
    """Against every voxel of the new grid mapped back."""
    grid = np.random.default_rng(5).random((12, 9, 10)) < 0.3
    mask = rows_of(spark, {1: grid})
    c, s = np.cos(0.4), np.sin(0.4)
    plain = (1, 0, 0, 0, 1, 0, 0, 0, 1)
    cases = [((0, 0, 0), (1, 1, 2), plain, (0, 0, 0), (1, 1, 2), plain), ((5, -3, 1), (1, 1, 2), plain, (2.5, -1, 0), (0.5, 2.0, 1.2), plain), ((0, 0, 0), (1, 1.5, 2), (c, -s, 0, s, c, 0, 0, 0, 1), (-4, 2, 1), (1.3, 0.7, 1.9), (1, 0, 0, 0, c, -s, 0, s, c)), ((0, 0, 0), (1, 1, 1), plain, (11, 0, 0), (1, 1, 1), (-1, 0, 0, 0, 1, 0, 0, 0, 1))]
    for o1, s1, d1, o2, s2, d2 in cases:
        size = (14, 13, 12)
        m, t = V.index_map((o1, s1, d1), (o2, s2, d2))
        at = np.indices(size).reshape(3, -1)
        old = np.floor(np.array(m) @ at + np.array(t)[:, None] + 0.5).astype(int)
        good = ((old >= 0) & (old < np.array(grid.shape)[:, None])).all(0)
        want = {tuple(map(int, p)) for p, o, g in zip(at.T, old.T, good) if g and grid[tuple(o)]}
        got = {(r.i, r.j, r.k) for r in V.reoriented(mask, (o1, s1, d1), (o2, s2, d2), size).collect()}
        assert got == want and want
