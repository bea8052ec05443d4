"""Distances of masks in larger grids."""

import tracemalloc

import numpy as np

from radlake.operators import kernels as K
from radlake.operators import voxels as V


def test_distances_take_a_few_grids():
    m = np.zeros((96, 96, 96), bool)
    m[3, 90, 40] = m[50, 2, 7] = True
    tracemalloc.start()
    d = K.distances(m)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * m.size * 8
    at = np.indices(m.shape)
    assert np.allclose(d, np.sqrt(np.minimum(*[sum((at[k] - p[k]) ** 2 for k in range(3)) for p in ((3, 90, 40), (50, 2, 7))])))


def test_nearest_by_lines_without_pairs(spark):
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 40, (60, 3)), rng.integers(5, 60, (40, 3))
    frame = lambda v: spark.createDataFrame([(1, *map(int, c)) for c in {tuple(c) for c in v}], "comparison_id long, i int, j int, k int")
    got = {(r.i, r.j, r.k): r.d for r in V.nearest(frame(x), frame(y)).collect()}
    assert got == {tuple(map(int, c)): float(np.sqrt(((c - y) ** 2).sum(1).min())) for c in x}
