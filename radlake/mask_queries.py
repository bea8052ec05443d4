"""Queries of mask operations and metrics; SQL by joins with offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import kernels as K
from .operators import voxels as V
from .plans import masks as P
from .queries import SIZE, VOXELS_SQL, _axis, _axis_rows, _cells, _marked, _mask
from .registry import ORACLE_SQL, query

_GRID = "i BETWEEN 0 AND 7 AND j BETWEEN 0 AND 7 AND k BETWEEN 0 AND 6"


def _grown(source: str, offsets: list[tuple[int, int, int]], grid: bool = True) -> str:
    rows = f"SELECT DISTINCT comparison_id, i + x AS i, j + y AS j, k + z AS k FROM {source}, (VALUES {', '.join(map(str, offsets))}) o(x, y, z)"
    return f"SELECT * FROM ({rows}) WHERE {_GRID}" if grid else rows


def _shrunk(source: str, offsets: list[tuple[int, int, int]]) -> str:
    return f"SELECT comparison_id, i, j, k FROM (SELECT comparison_id, i + x AS i, j + y AS j, k + z AS k FROM {source}, (VALUES {', '.join(map(str, offsets))}) o(x, y, z)) GROUP BY ALL HAVING count(*) = {len(offsets)}"


def _rim(source: str, offsets: list[tuple[int, int, int]]) -> str:
    return f"SELECT * FROM {source} EXCEPT ({_shrunk(source, offsets)})"


_FLAT = [(0, y, z) for y in (-1, 0, 1) for z in (-1, 0, 1)]
#: Spacings of the axes i, j, k in the metrics below.
_STEP = (1.5, 1.0, 2.0)


def _surface_sql(step: tuple[float, float, float], tolerance: float) -> str:
    """The Dice of border voxels within a tolerance; steps of the axes in reverse, as the metric takes them."""
    d = " + ".join(f"((x.{n} - y.{n}) * {s}) ** 2" for n, s in zip("ijk", step[::-1]))
    near = lambda x, y: f"SELECT x.comparison_id, min(sqrt({d})) AS d FROM {x} x JOIN {y} y USING (comparison_id) GROUP BY x.comparison_id, x.i, x.j, x.k"
    return VOXELS_SQL + f""", ca AS ({_rim('a', K.CUBE)}), cb AS ({_rim('b', K.CUBE)}) SELECT comparison_id, count(*) FILTER (d <= {tolerance}) / count(*) AS value FROM ({near('ca', 'cb')} UNION ALL {near('cb', 'ca')}) GROUP BY 1"""


def _path_sql(width: float, radius: int) -> str:
    """Border voxels of slices along i that the widened border of the other mask misses, times a width."""
    disc = [o for o in V.ball(float(radius)) if o[0] == 0]
    return VOXELS_SQL + f""", ra AS ({_rim('a', _FLAT)}), rb AS ({_rim('b', _FLAT)}), wide AS ({_grown('rb', disc, False)}), e AS (SELECT DISTINCT comparison_id FROM c2)
SELECT comparison_id, (SELECT count(*) FROM (SELECT * FROM ra EXCEPT SELECT * FROM wide) m WHERE m.comparison_id = e.comparison_id) * {width}::DOUBLE AS value FROM e"""


@query(_surface_sql(_STEP, 1.2))
def voxel_surface_dsc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At unequal spacings, which the axes take in reverse."""
    m = K.metrics(_cells(spark, sf_dir), SIZE, _STEP, tolerance=1.2, names=["surface_dsc"])
    return m.filter("metric = 'surface_dsc'").select("comparison_id", "value")


@query(_path_sql(1.25, 1))
def voxel_apl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At unequal spacings: the threshold and the path in means of the first two."""
    m = K.metrics(_cells(spark, sf_dir), SIZE, _STEP, threshold=1.0, names=["apl"])
    return m.filter("metric = 'apl'").select("comparison_id", "value")


_B1 = V.ball(1.0)


@query(VOXELS_SQL + f""", g AS ({_grown('a', _B1, False)}), cl AS (SELECT * FROM ({_shrunk('g', _B1)}) WHERE {_GRID}), er AS ({_shrunk('cl', _B1)}) {_grown('er', _B1)}""")
def voxel_closed_opened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closing, then opening."""
    a = _mask(spark, sf_dir, "A")
    return P.run([{"type": "close_gaps", "parameters": {"gap_size_mm": 1.0}}, {"type": "remove_protrusions", "parameters": {"protrusion_size_mm": 1.0}}], {}, SIZE, start=a)


@query(VOXELS_SQL + f"""SELECT comparison_id, 'all' AS way, i, j, k FROM ({_grown('a', V.element((2, 1, 0)))}) UNION ALL
SELECT comparison_id, 'mixed', i, j, k FROM ({_grown('(' + _shrunk('(' + _grown('a', V.element((1, 0, 0))) + ')', V.element((0, 1, 0))) + ')', V.element((0, 0, 1)))})""")
def voxel_directed_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A margin for each axis: all growing at once, mixed signs one after the other."""
    a = _mask(spark, sf_dir, "A")
    both = [V.directed_margin(a, m, SIZE, (1.0, 1.0, 2.0)).select("comparison_id", F.lit(n).alias("way"), "i", "j", "k") for n, m in (("all", (2.0, 1.0, 0.0)), ("mixed", (1.0, -1.0, 2.0)))]
    return both[0].unionByName(both[1])


@query(VOXELS_SQL + f"SELECT * FROM ({_grown('a', _B1)}) INTERSECT SELECT * FROM b")
def voxel_expand_and_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.expand_and_crop(_mask(spark, sf_dir, "A"), _mask(spark, sf_dir, "R"), 1.0, SIZE)


@query(VOXELS_SQL + f"SELECT * FROM a EXCEPT ({_grown('b', V.element((1, 1, 1)))})")
def voxel_subtract_with_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.subtract_with_margin(_mask(spark, sf_dir, "A"), _mask(spark, sf_dir, "R"), 1.0, SIZE, (1.0, 1.0, 2.0))


_ALL = "e AS (SELECT DISTINCT comparison_id FROM a), g AS (SELECT comparison_id, i, j, k FROM e, range(8) x(i), range(8) y(j), range(7) z(k))"


@query(VOXELS_SQL + f""", {_ALL}, r AS ({_rim('a', K.FACES)}), d AS (SELECT g.comparison_id, g.i, g.j, g.k, min(sqrt(((g.i - r.i) * 1.5) ** 2 + (g.j - r.j) ** 2 + ((g.k - r.k) * 2.0) ** 2)) AS d FROM g JOIN r ON r.comparison_id = g.comparison_id GROUP BY ALL)
SELECT comparison_id, i::INT AS i, j::INT AS j, k::INT AS k, round(CASE WHEN (comparison_id, i, j, k) IN (SELECT (comparison_id, i, j, k) FROM a) THEN -d ELSE d END, 9) + 0.0 AS distance FROM d""")
def voxel_distance_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = K.distance_maps(_mask(spark, sf_dir, "A"), SIZE, _STEP)
    return d.withColumn("distance", F.round("distance", 9) + 0.0)


@query(VOXELS_SQL + f""", {_ALL.replace('range(8) x(i), range(8) y(j), range(7) z(k)', 'range(6) x(i), range(16) y(j), range(7) z(k)')} SELECT g.comparison_id, g.i::INT AS i, g.j::INT AS j, g.k::INT AS k FROM g JOIN a ON a.comparison_id = g.comparison_id AND a.i = floor(g.i * 1.5 + 0.5) AND a.j = floor(g.j * 0.5 + 0.5) AND a.k = g.k""")
def voxel_resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the nearest voxel, coarser along i and finer along j."""
    return V.resampled(_mask(spark, sf_dir, "A"), (1.0, 1.0, 1.0), (1.5, 0.5, 1.0), (6, 16, 7))


@query(VOXELS_SQL + "SELECT comparison_id, k AS i, j, i AS k FROM a")
def voxel_transposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.transposed(_mask(spark, sf_dir, "A"))


@query("SELECT s_suppkey, s_suppkey % 4 = 0 AS same FROM supplier")
def geometry_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal but for noise, another spacing, another size, a missing origin."""
    from .sources import tables as T

    k = F.col("s_suppkey") % 4
    numbers = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    one = lambda spacing, size, origin: F.struct(size.alias("size"), spacing.alias("spacing"), origin.alias("origin"), numbers(1, 0, 0, 0, 1, 0, 0, 0, 1).alias("direction"))
    a = one(numbers(1, 1, 2.5), F.array(F.lit(512), F.lit(512), F.lit(90)), numbers(-250, -250, 0))
    b = one(F.when(k == 1, numbers(1, 1, 3)).otherwise(numbers(1, 1, 2.50001)), F.when(k == 2, F.array(F.lit(256), F.lit(512), F.lit(90))).otherwise(F.array(F.lit(512), F.lit(512), F.lit(90))), F.when(k != 3, numbers(-250.0001, -250, 0)))
    rows = T.table(spark, sf_dir, "supplier").select("s_suppkey", a.alias("a"), b.alias("b"))
    return rows.select("s_suppkey", V.same_geometry(rows, "a", "b").alias("same"))


@query("SELECT c_custkey AS comparison_id, (c_custkey % 5)::INT AS k, CASE c_custkey % 3 WHEN 0 THEN 99 - 9 + 14 + 3 WHEN 1 THEN 99 - 9 + 14 + 1 ELSE 99 - 9 + 13 END::BIGINT AS n FROM customer")
def contour_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contours become masks: a polygon with a hole, a line and a point for each patient."""
    from .sources import tables as T

    o = F.col("c_custkey")
    shapes = [([2, 12, 12, 2], [2, 2, 10, 10]), ([4, 8, 8, 4], [4, 4, 8, 8]), ([1, 14], [13, 15]), ([15], [0])]
    double = lambda x: F.array(*[F.lit(float(v)) for v in x])
    each = F.explode(F.array(*[F.struct(double(x).alias("xs"), double(y).alias("ys")) for x, y in shapes])).alias("s")
    contours = T.table(spark, sf_dir, "customer").select(o.alias("comparison_id"), (o % 5).cast("int").alias("k"), each).select("comparison_id", "k", "s.xs", "s.ys")
    moved = contours.withColumn("xs", F.transform("xs", lambda x: x + F.col("comparison_id") % 3))
    return K.rasterised(moved, (16, 16)).groupBy("comparison_id", "k").agg(F.count("*").alias("n"))


@query(VOXELS_SQL + f""", n AS (SELECT comparison_id, k, count(*) FILTER (in_a AND NOT in_b) AS under, count(*) FILTER (in_b AND NOT in_a) AS over FROM c2 GROUP BY 1, 2), o AS (SELECT comparison_id, count(*) FILTER (in_a AND in_b) AS overlap_count FROM c2 GROUP BY 1),
u AS (SELECT comparison_id, k, string_agg(d::INT::VARCHAR, ',' ORDER BY d) AS l FROM ({_axis_rows('a', 'b')}) GROUP BY 1, 2), v AS (SELECT comparison_id, k, string_agg(d::INT::VARCHAR, ',' ORDER BY d) AS l FROM ({_axis_rows('b', 'a')}) GROUP BY 1, 2)
SELECT comparison_id, k, overlap_count, coalesce(u.l, '') AS under_distances, coalesce(v.l, '') AS over_distances FROM n JOIN o USING (comparison_id) LEFT JOIN u USING (comparison_id, k) LEFT JOIN v USING (comparison_id, k) WHERE under + over > 0""")
def voxel_slice_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices with the lists of their distances."""
    shown = lambda c: F.array_join(F.transform(c, lambda d: d.cast("int").cast("string")), ",").alias(c)
    return V.slice_lists(_cells(spark, sf_dir)).select("comparison_id", "k", "overlap_count", shown("under_distances"), shown("over_distances"))


def _blurred(source: str, axis: str, last: int, weights: list[float]) -> str:
    r = len(weights) // 2
    taps = ", ".join(f"({o - r}, {w!r}::DOUBLE)" for o, w in enumerate(weights))
    others = [n for n in "ijk" if n != axis]
    return f"SELECT s.comparison_id, s.i, s.j, s.k, sum(w * t.x) AS x FROM {source} s, (VALUES {taps}) o(o, w) JOIN {source} t ON t.comparison_id = s.comparison_id AND t.{others[0]} = s.{others[0]} AND t.{others[1]} = s.{others[1]} AND t.{axis} = least(greatest(s.{axis} + o, 0), {last}) GROUP BY ALL"


@query(VOXELS_SQL + f""", e AS (SELECT DISTINCT comparison_id FROM a), x0 AS (SELECT g.comparison_id, g.i, g.j, g.k, CASE WHEN a.i IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS x FROM (SELECT comparison_id, i::INT AS i, j::INT AS j, k::INT AS k FROM e, range(8) p(i), range(8) q(j), range(7) r(k)) g LEFT JOIN a USING (comparison_id, i, j, k)),
x1 AS ({_blurred('x0', 'i', 7, K.gauss(1.0))}), x2 AS ({_blurred('x1', 'j', 7, K.gauss(1.0))}), x3 AS ({_blurred('x2', 'k', 6, K.gauss(0.5))}) SELECT comparison_id, i, j, k FROM x3 WHERE x > 0.3137""")
def voxel_gaussian(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A blurred mask above a threshold, at unequal spacings."""
    return P.run([{"type": "gaussian_smooth", "parameters": {"sigma_mm": 1.0, "threshold": 0.3137}}], {}, SIZE, (1.0, 1.0, 2.0), start=_marked(spark, sf_dir, "A"))


_NEAR = ", ".join(str(o) for o in K.FACES if o != (0, 0, 0))


def _parts(source: str) -> str:
    """The component of each cell: (comparison_id, i, j, k, label, n), label its first cell's number, n its size."""
    return f"""w AS (SELECT comparison_id, i, j, k, i * 56 + j * 7 + k AS label FROM {source}),
r AS (SELECT comparison_id, label AS start, i, j, k FROM w UNION SELECT r.comparison_id, start, w.i, w.j, w.k FROM r, (VALUES {_NEAR}) o(x, y, z) JOIN w ON w.comparison_id = r.comparison_id AND w.i = r.i + x AND w.j = r.j + y AND w.k = r.k + z),
l AS (SELECT comparison_id, i, j, k, min(start) AS label FROM r GROUP BY ALL), parts AS (SELECT *, count(*) OVER (PARTITION BY comparison_id, label) AS n FROM l)"""


_RECURSIVE = VOXELS_SQL.replace("WITH ", "WITH RECURSIVE ", 1)


@query(_RECURSIVE + f", {_parts('a')}, best AS (SELECT comparison_id, label FROM (SELECT comparison_id, label, row_number() OVER (PARTITION BY comparison_id ORDER BY n DESC, label) AS q FROM (SELECT DISTINCT comparison_id, label, n FROM parts)) WHERE q = 1) SELECT comparison_id, i, j, k FROM parts JOIN best USING (comparison_id, label)")
def voxel_largest_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.run([{"type": "keep_largest"}], {}, SIZE, start=_marked(spark, sf_dir, "A"))


@query(_RECURSIVE + f", {_parts('a')} SELECT comparison_id, i, j, k FROM parts WHERE n >= 5")
def voxel_without_small_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components under 10 mm3 at 2.5 mm3 a voxel and a bit more go: five voxels are needed."""
    return P.run([{"type": "remove_small_components", "parameters": {"min_size_mm3": 10.1}}], {}, SIZE, (1.0, 1.0, 2.5), start=_marked(spark, sf_dir, "A"))


@query(_RECURSIVE + f""", u AS (SELECT * FROM a UNION SELECT * FROM b), e AS (SELECT DISTINCT comparison_id FROM u), g AS (SELECT comparison_id, i, j, k FROM e, range(-1, 9) x(i), range(-1, 9) y(j), range(-1, 8) z(k)), f AS (SELECT * FROM g EXCEPT SELECT * FROM u),
r AS (SELECT comparison_id, -1::BIGINT AS i, -1::BIGINT AS j, -1::BIGINT AS k FROM e UNION SELECT r.comparison_id, f.i, f.j, f.k FROM r, (VALUES {_NEAR}) o(x, y, z) JOIN f ON f.comparison_id = r.comparison_id AND f.i = r.i + x AND f.j = r.j + y AND f.k = r.k + z)
SELECT comparison_id, i::INT AS i, j::INT AS j, k::INT AS k FROM (SELECT * FROM g EXCEPT SELECT * FROM r) WHERE {_GRID}""")
def voxel_filled_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.run([{"type": "fill_holes"}], {}, SIZE, start=V.combine(_cells(spark, sf_dir), "union"))


@query(VOXELS_SQL + f"""SELECT comparison_id, 'gaps' AS way, i, j, k FROM (SELECT * FROM ({_shrunk('(' + _grown('a', _B1, False) + ')', _B1)}) WHERE {_GRID}) UNION ALL SELECT comparison_id, 'protrusions', i, j, k FROM ({_grown('(' + _shrunk('(SELECT * FROM a UNION SELECT * FROM b)', _B1) + ')', _B1)})""")
def voxel_gaps_and_protrusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, both = _marked(spark, sf_dir, "A"), V.combine(_cells(spark, sf_dir), "union")
    closed = P.run([{"type": "close_gaps", "structures": ["a"], "parameters": {"gap_size_mm": 1.0}}], {"a": a}, SIZE)
    opened = P.run([{"type": "remove_protrusions", "structures": ["a"], "parameters": {"protrusion_size_mm": 1.0}}], {"a": both}, SIZE)
    named = lambda df, n: df.select("comparison_id", F.lit(n).alias("way"), "i", "j", "k")
    return named(closed, "gaps").unionByName(named(opened, "protrusions"))


# --- pipelines; the masks are the lines returned (A), refused (R) and neither (N) ------------


def _holes(source: str, name: str) -> str:
    """CTEs up to ``name``: the source with its holes filled."""
    return f"""e_{name} AS (SELECT DISTINCT comparison_id FROM {source}), g_{name} AS (SELECT comparison_id, i, j, k FROM e_{name}, range(-1, 9) x(i), range(-1, 9) y(j), range(-1, 8) z(k)), f_{name} AS (SELECT comparison_id, i, j, k FROM g_{name} EXCEPT SELECT comparison_id, i, j, k FROM {source}),
r_{name} AS (SELECT comparison_id, -1::BIGINT AS i, -1::BIGINT AS j, -1::BIGINT AS k FROM e_{name} UNION SELECT r.comparison_id, f.i, f.j, f.k FROM r_{name} r, (VALUES {_NEAR}) o(x, y, z) JOIN f_{name} f ON f.comparison_id = r.comparison_id AND f.i = r.i + x AND f.j = r.j + y AND f.k = r.k + z),
{name} AS (SELECT comparison_id, i::INT AS i, j::INT AS j, k::INT AS k FROM (SELECT * FROM g_{name} EXCEPT SELECT * FROM r_{name}) WHERE {_GRID})"""


def _smoothed(source: str, name: str, offsets: list[tuple[int, int, int]]) -> str:
    """CTEs up to ``name``: the source closed, then opened."""
    return f"{name}1 AS ({_grown(source, offsets, False)}), {name}2 AS (SELECT * FROM ({_shrunk(name + '1', offsets)}) WHERE {_GRID}), {name}3 AS ({_shrunk(name + '2', offsets)}), {name} AS ({_grown(name + '3', offsets)})"


_N_MASK = "n AS (SELECT DISTINCT l_suppkey AS comparison_id, (l_partkey % 8)::INT AS i, (l_orderkey % 8)::INT AS j, (l_linenumber - 1)::INT AS k FROM lineitem WHERE l_returnflag = 'N')"


def _rois(spark: SparkSession, sf_dir: str, **names: str) -> dict[str, DataFrame]:
    return {name: _marked(spark, sf_dir, flag) for name, flag in names.items()}


@query(_RECURSIVE + f", m AS ({_grown('a', _B1)}), s AS (SELECT * FROM m EXCEPT SELECT * FROM b), {_holes('s', 'h')}, {_parts('h')} SELECT comparison_id, i, j, k FROM parts WHERE n >= 4")
def mask_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Margin, subtraction, holes and small components, handed on from step to step."""
    steps = [
        {"type": "expand", "structures": ["reference"], "parameters": {"margin_mm": 1.0}}, {"type": "subtract", "parameters": {"other_roi": "test"}},
        {"type": "fill_holes"}, {"type": "remove_small_components", "parameters": {"min_size_mm3": 4}},
    ]
    return P.run(steps, _rois(spark, sf_dir, reference="A", test="R"), SIZE)


_TEXT = "union(other_roi=test) | close_gaps(gap_size_mm=1.0) | crop_to_boundary(boundary_roi='body') | margin(margin_mm=-1.0, kernel_type=cross) | anisotropic_margin(margin_x_mm=1.0, margin_z_mm=2.0) | subtract(other_roi=test, margin_mm=1.0)"


@query(VOXELS_SQL + f""", {_N_MASK}, u AS (SELECT * FROM a UNION SELECT * FROM b), c1 AS ({_grown('u', _B1, False)}), c3 AS (SELECT * FROM ({_shrunk('c1', _B1)}) WHERE {_GRID}), c4 AS (SELECT * FROM c3 INTERSECT (SELECT * FROM a UNION SELECT * FROM n)),
c5 AS ({_shrunk('c4', V.element((1, 1, 1), 'cross'))}), c6 AS ({_grown('c5', V.element((1, 0, 2)))}) SELECT * FROM c6 EXCEPT ({_grown('b', _B1)})""")
def mask_pipeline_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pipeline in text form, from a start mask."""
    rois = _rois(spark, sf_dir, reference="A", test="R")
    rois["body"] = _marked(spark, sf_dir, "A").union(_marked(spark, sf_dir, "N"))
    return P.run(P.parse_text(_TEXT), rois, SIZE, start=rois["reference"])


@query(VOXELS_SQL + f", s AS (SELECT * FROM a EXCEPT SELECT * FROM b) {_grown('s', _B1)}")
def mask_pipeline_subtract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored definition as it is executed: subtraction starts anew from its structures, its margin is that of the result."""
    text = '{"operations": [{"type": "expand", "structures": ["b"], "parameters": {"margin_mm": 1.0}}, {"type": "subtract", "structures": ["a", "b"], "parameters": {"margin_mm": 1.0}}]}'
    return P.run(P.parse_json(text), _rois(spark, sf_dir, a="A", b="R"), SIZE, dialect="executor")


@query(VOXELS_SQL + _grown("a", V.element((3, 3, 2))))
def mask_pipeline_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clinical target with 5 mm, which is more than one voxel and less than three."""
    text = '{"operations": [{"type": "expand", "structures": ["CTV"], "parameters": {"margin_mm": 5.0, "kernel_type": "ball"}}]}'
    return P.run(P.parse_json(text), _rois(spark, sf_dir, CTV="A"), SIZE, (2.0, 2.0, 2.5), dialect="executor")


@query(VOXELS_SQL + f", u AS (SELECT * FROM a UNION SELECT * FROM b), {_smoothed('u', 's', V.element((1, 1, 1)))} SELECT * FROM s")
def mask_pipeline_bilateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left and right in one structure, smoothed."""
    text = '{"operations": [{"type": "union", "structures": ["Parotid_L", "Parotid_R"]}, {"type": "smooth", "parameters": {"smoothing_mm": 2.0, "iterations": 1}}]}'
    return P.run(P.parse_json(text), _rois(spark, sf_dir, Parotid_L="A", Parotid_R="R"), SIZE, (2.0, 2.0, 2.5), dialect="executor")


_B113 = V.element((1, 2, 1))


@query(_RECURSIVE + f", {_N_MASK}, u AS (SELECT * FROM a UNION SELECT * FROM b UNION SELECT * FROM n), {_smoothed('u', 's', _B113)}, {_smoothed('s', 't', _B113)}, {_holes('t', 'h')} SELECT * FROM h")
def mask_pipeline_avoidance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several steps: the margins of the first two are lost, as the union starts anew from the structures."""
    text = """{"operations": [
      {"type": "expand", "structures": ["Lung_L"], "parameters": {"margin_mm": 3.0, "kernel_type": "ball"}}, {"type": "expand", "structures": ["Lung_R"], "parameters": {"margin_mm": 3.0, "kernel_type": "ball"}},
      {"type": "union", "structures": ["Lung_L", "Lung_R", "Heart"]}, {"type": "smooth", "parameters": {"smoothing_mm": 2.5, "iterations": 2}}, {"type": "fill_holes"}]}"""
    return P.run(P.parse_json(text), _rois(spark, sf_dir, Lung_L="A", Lung_R="R", Heart="N"), SIZE, (2.5, 1.5, 3.0), dialect="executor")


@query(VOXELS_SQL + f"SELECT comparison_id, 'box' AS shape, i, j, k FROM ({_grown('a', V.element((1, 1, 1), 'box'))}) UNION ALL SELECT comparison_id, 'cross', i, j, k FROM ({_grown('a', V.element((1, 2, 1), 'cross'))})")
def voxel_margin_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Margins by box and cross."""
    a = _mask(spark, sf_dir, "A")
    both = [V.margin(a, 1.0, SIZE, s, shape).select("comparison_id", F.lit(shape).alias("shape"), "i", "j", "k") for shape, s in (("box", (1.0, 1.0, 1.0)), ("cross", (1.0, 0.5, 1.0)))]
    return both[0].unionByName(both[1])


@query("SELECT p_partkey, step::INT AS step, kind, margin FROM (SELECT p_partkey, unnest([0, 1]) AS step, unnest(['expand', 'smooth']) AS kind, unnest([p_size::VARCHAR, NULL]) AS margin FROM part)")
def pipeline_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored definitions, one row per step."""
    from .sources import tables as T

    text = F.format_string('{"operations": [{"type": "expand", "structures": ["x"], "parameters": {"margin_mm": %d}}, {"type": "smooth", "parameters": {}}]}', F.col("p_size").cast("int"))
    steps = P.describe(T.table(spark, sf_dir, "part").select("p_partkey", text.alias("definition")))
    return steps.select("p_partkey", "step", F.col("operation.type").alias("kind"), F.try_element_at("operation.parameters", F.lit("margin_mm")).alias("margin"))


@query(VOXELS_SQL + """, n AS (SELECT comparison_id, count(*) FILTER (in_a)::DOUBLE AS na, count(*) FILTER (in_b)::DOUBLE AS nb, count(*) FILTER (in_a AND in_b)::DOUBLE AS nab, 448.0::DOUBLE AS g FROM c2 GROUP BY 1),
p AS (SELECT comparison_id, [nab, na - nab, nb - nab, g - na - nb + nab] AS j, [na, g - na] AS x, [nb, g - nb] AS y FROM n),
h AS (SELECT comparison_id, list_sum(list_transform(j, lambda c: CASE WHEN c > 0 THEN -c / 448 * ln(c / 448) ELSE 0 END)) AS hj, list_sum(list_transform(x, lambda c: CASE WHEN c > 0 THEN -c / 448 * ln(c / 448) ELSE 0 END)) AS hx, list_sum(list_transform(y, lambda c: CASE WHEN c > 0 THEN -c / 448 * ln(c / 448) ELSE 0 END)) AS hy FROM p),
u AS (""" + _axis("a", "b", _STEP) + "), o AS (" + _axis("b", "a", _STEP) + """), m AS (SELECT comparison_id, 2 * hj - hx - hy AS vi, coalesce(u.d, 0) AS umdc, coalesce(o.d, 0) AS omdc FROM h LEFT JOIN u USING (comparison_id) LEFT JOIN o USING (comparison_id))
SELECT comparison_id, metric, round(value, 9) AS value FROM (SELECT comparison_id, unnest(['vi', 'mdc', 'umdc', 'omdc']) AS metric, unnest([vi, (umdc + omdc) / 2, umdc, omdc]) AS value FROM m)""")
def voxel_bulk_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four metrics of the driver at unequal spacings."""
    m = K.metrics(_cells(spark, sf_dir), SIZE, _STEP, names=["vi", "mdc", "umdc", "omdc"])
    return m.select("comparison_id", "metric", F.round("value", 9).alias("value"))


#: A grid and another one, turned by 30 degrees about the last axis, shifted and of another spacing.
_FROM = ((0.0, 0.0, 0.0), (1.0, 1.0, 2.0), (1, 0, 0, 0, 1, 0, 0, 0, 1))
_TO = ((-1.3, 2.1, 0.7), (0.8, 0.9, 1.5), (0.866, -0.5, 0, 0.5, 0.866, 0, 0, 0, 1))
_TO_SIZE = (11, 10, 9)


def _mapped(r: int) -> str:
    m, t = V.index_map(_FROM, _TO)
    return f"a.{'ijk'[r]} = floor({m[r][0]!r}::DOUBLE * g.i + {m[r][1]!r}::DOUBLE * g.j + {m[r][2]!r}::DOUBLE * g.k + {t[r] + 0.5!r}::DOUBLE)"


@query(VOXELS_SQL + f", e AS (SELECT DISTINCT comparison_id FROM a), g AS (SELECT comparison_id, i::INT AS i, j::INT AS j, k::INT AS k FROM e, range({_TO_SIZE[0]}) x(i), range({_TO_SIZE[1]}) y(j), range({_TO_SIZE[2]}) z(k)) SELECT g.* FROM g JOIN a ON a.comparison_id = g.comparison_id AND " + " AND ".join(map(_mapped, range(3))))
def voxel_reoriented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In a grid that is turned, shifted and of another spacing."""
    return V.reoriented(_mask(spark, sf_dir, "A"), _FROM, _TO, _TO_SIZE)


# --- masks in a grid of a scanner -------------------------------------------------------

SCAN = (128, 128, 128)


def _scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One mask for each return flag, in a grid of 128 voxels a side."""
    from .sources import tables as T

    line = T.table(spark, sf_dir, "lineitem")
    return line.select(
        F.col("l_returnflag").alias("comparison_id"), (F.col("l_partkey") * 37 % 128).cast("int").alias("i"), (F.col("l_orderkey") % 128).cast("int").alias("j"), ((F.col("l_suppkey") * 11 + F.col("l_linenumber")) % 128).cast("int").alias("k")
    ).distinct()


_SCAN_SQL = "WITH m AS (SELECT DISTINCT l_returnflag AS comparison_id, (l_partkey * 37 % 128)::INT AS i, (l_orderkey % 128)::INT AS j, ((l_suppkey * 11 + l_linenumber) % 128)::INT AS k FROM lineitem)"


@query(_SCAN_SQL + f""", g AS ({_grown('m', V.element((3, 3, 2)), False)}), r AS (SELECT DISTINCT * FROM g WHERE i BETWEEN 0 AND 127 AND j BETWEEN 0 AND 127 AND k BETWEEN 0 AND 127)
SELECT comparison_id, k::INT AS k, count(*) AS n, sum(i)::BIGINT AS si, sum(i * j)::BIGINT AS sij FROM r GROUP BY ALL""")
def voxel_margin_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A margin of 3 mm around large masks: voxels and sums of places by slice."""
    grown = V.margin(_scan(spark, sf_dir), 3.0, SCAN, (1.0, 1.0, 2.0))
    return grown.groupBy("comparison_id", "k").agg(F.count("*").alias("n"), F.sum("i").alias("si"), F.sum(F.col("i") * F.col("j")).alias("sij"))


@query(_SCAN_SQL + """, d AS (SELECT a.i, a.j, a.k, min((a.i - r.i) ** 2 + ((a.j - r.j) * 1.5) ** 2 + ((a.k - r.k) * 2) ** 2) AS d FROM m a, m r WHERE a.comparison_id = 'A' AND r.comparison_id = 'R' GROUP BY ALL)
SELECT k, count(*) AS n, round(sum(sqrt(d)), 6) AS total, round(max(sqrt(d)), 6) AS most FROM d GROUP BY k""")
def voxel_distance_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each voxel of one large mask to the nearest of another, by slice."""
    m = _scan(spark, sf_dir)
    a, r = (m.filter(F.col("comparison_id") == f).withColumn("comparison_id", F.lit("A-R")) for f in "AR")
    return V.nearest(a, r, (1.0, 1.5, 2.0)).groupBy("k").agg(F.count("*").alias("n"), F.round(F.sum("d"), 6).alias("total"), F.round(F.max("d"), 6).alias("most"))


# queries of queries.py whose SQL is here
ORACLE_SQL["voxel_smooth"] = ORACLE_SQL["voxel_closed_opened"]
ORACLE_SQL["voxel_components"] = ORACLE_SQL["voxel_largest_component"]
ORACLE_SQL["voxel_surface_metrics"] = f"SELECT *, 'surface_dsc' AS metric FROM ({_surface_sql((1, 1, 1), 3.0)}) UNION ALL SELECT *, 'apl' FROM ({_path_sql(1, 3)})"
