"""Catalog, rules, values, queries, reports and voxels against hand-made cases."""

import datetime as dt

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from radlake.functions import scalar as S
from radlake.functions import vr as VR
from radlake.operators import catalog as C
from radlake.operators import cfind as Q
from radlake.operators import kernels as K
from radlake.operators import lists as L
from radlake.operators import rules as R
from radlake.operators import voxels as V
from radlake.plans import masks as P


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "vr,value,ok",
    [
        ("AS", "065Y", True), ("AS", "65Y", False), ("DA", "20230229", False), ("DA", "20240229", True), ("DS", "1.23E-4", True), ("IS", "2147483648", False),
        ("IS", "2147483647", True), ("TM", "143000.123456", True), ("UI", "1.2.840.", False), ("CS", "lower_ok", True), ("US", "65536", False), ("AT", "(0018,00FF)", True),
        ("LO", "a\\b", False), ("DA", "", True), ("ZZ", "x" * 1025, False), ("PN", "A^B=C", True), ("FL", "3.5e38", False), ("FD", "1_000", False), ("SS", "-32768", True),
        ("DT", " 20240101 ", True), ("TM", "1430 ", True), ("UI", " 1.2.3\t", True), ("AE", "A\x7f", True), ("AE", "A\t", False), ("IS", "\t5 ", True), ("AT", "(0018,00FG)", False),
    ],
)
def test_value_representations(spark, vr, value, ok):
    assert one(spark, VR.valid(F.col("v"), F.col("r")), v=value, r=vr) is ok


def test_guidance(spark):
    rows = spark.createDataFrame([("DA",), ("ZZ",), (None,)], "vr string")
    got = {r.vr: (r.format, r.example) for r in VR.guidance(rows, "vr").collect()}
    assert got["DA"] == ("YYYYMMDD format", "19930822 (August 22, 1993)") and got["ZZ"][1] == got[None][1] == "Refer to DICOM documentation"


def test_requests_jobs_and_files(spark):
    asked = spark.createDataFrame([(1, "A", "10.0.2.7"), (2, "A", "10.0.3.7"), (3, "B", "10.0.2.7"), (4, "C", "10.0.2.7"), (5, "A", "110.0.2.9")], "id int, ae_title string, ip string")
    titles = spark.createDataFrame([("A", True), ("B", False)], "ae_title string, is_active boolean")
    of = lambda n: sorted(r.id for r in L.allowed(asked, titles, n).collect())
    assert of(["10.0.2.7/32"]) == [1] and of([]) == [1, 2, 5] and of(["0.2."]) == [1, 5]
    jobs = spark.createDataFrame([(5, 0, 1), (5, 5, 1), (5, 5, 0), (5, 2, 0)], "t int, d int, f int")
    assert [r.x for r in jobs.select(L.job_status(F.col("t"), F.col("d"), F.col("f")).alias("x")).collect()] == ["partial", "completed", "completed", "completed"]
    files = spark.createDataFrame([(False, None, None, "a", "x", "y"), (False, "RTSTRUCT", None, "a", "", "y"), (True, "CT", "b", "a", None, "y"), (True, "RTSTRUCT", "b", "a", "y", "y"), (True, "RTSTRUCT", None, "a", "y", "y")], "readable boolean, modality string, referenced_series string, expected_series string, header_checksum string, checksum string")
    assert [r.reason for r in L.accepted(files).collect()] == ["checksum", "unreadable", "modality", "series", None]


def test_matching_of_names(spark):
    names = spark.createDataFrame([("parotid l",), ("Cord",), ("Spinal-Cord",), ("lens",), ("EyeL",), ("eye l big",)], "name string")
    templates = spark.createDataFrame([("Parotid_L", 1), ("CORD", 2), ("cord", 3), ("spinal cord", 4), ("Lens R", 5), ("Eye_L", 6), ("LENS r", 7), ("Eye L", 8)], "name string, position int")
    got = {r.name: (r.template, r.tier) for r in C.tiered_match(names, templates).collect()}
    assert got == {"parotid l": ("Parotid_L", 2), "Cord": ("cord", 1), "Spinal-Cord": ("spinal cord", 3), "lens": ("LENS r", 4), "EyeL": ("Eye L", 3), "eye l big": ("Eye L", 4)}


def test_metrics_at_unequal_spacing():
    a, b = np.zeros((6, 9, 9), bool), np.zeros((6, 9, 9), bool)
    a[1:4, 1:4, 1:4], b[1:4, 1:4, 4:7] = True, True
    assert K.added_path(a, b, 0.5, (2.0, 4.0, 9.0)) == 15 * 3.0 and K.added_path(a, b, 6.5, (2.0, 4.0, 9.0)) == 0
    assert K.surface_dice(a, b, 3.0, (3.0, 1.0, 1.0), "anatomical") == 1.0 and K.surface_dice(a, b, 2.9, (3.0, 1.0, 1.0)) == 0.0 and K.surface_dice(a, b, 3.0, (3.0, 1.0, 1.0)) < 1


def test_operator_lists(spark):
    sizes = {c: one(spark, F.size(VR.operators(F.col("r"))), r=c) for c in ("DS", "LO", "DA", "SQ")}
    assert sizes == {"DS": 6, "LO": 8, "DA": 12, "SQ": 2}


@pytest.mark.parametrize(
    "text,color",
    [
        ("Yellow", "255\\255\\0"), ("red", "255\\0\\0"), ("Segment - Cyan", "0\\255\\255"), ("Segment-Magenta", "255\\0\\255"), ("Translucent - Blue", "0\\0\\255"),
        ("Contour Yellow", "255\\255\\0"), ("Transparent Orange", "255\\165\\0"), ("Opaque - Purple", "128\\0\\128"), ("skin", "255\\224\\189"), ("RGB 0 255 255", "0\\255\\255"),
        ("#00FFFF", "0\\255\\255"), ("", None), ("InvalidColor", None), (None, None), ("16711680", "255\\0\\0"), ("FF0000", "255\\0\\0"), ("123456", "18\\52\\86"), ("RGB 300 0 0", "0\\117\\48"),
        ("12", None), ("  Bone Rendering\t", "255\\245\\238"), ("Grey", "128\\128\\128"), ("Segment", None), ("segmentRed", "255\\0\\0"), ("65793", "1\\1\\1"),
    ],
)
def test_colors(spark, text, color):
    assert one(spark, S.color(F.col("v")), v=text) == color


@pytest.mark.parametrize(
    "label,short",
    [
        ("PAROTID_GLAND_RIGHT", "PAROTID_GL_RIGHT"), ("SUBMANDIBULAR_L", "SUBMANDIBULAR_L"), ("VERY_LONG_STRUCTURE_NAME_R", "VERY_LONG_STRU_R"), ("VERY LONG STRUCTURE R", "VERY LONG STRUCT"),
        ("Optic nerve long  _Lt", "Optic nerve l_Lt"), ("a_very_long_name_left", "a_very_long_left"), (None, None),
    ],
)
def test_short_labels(spark, label, short):
    assert one(spark, S.short_label(F.col("v")), v=label) == short


@pytest.mark.parametrize("label,ok", [("PAROTID_R", True), ("THIS_IS_TOO_LONG_LABEL", False), ("", False)])
def test_labels(spark, label, ok):
    assert one(spark, S.valid_label(F.col("v")), v=label) is ok


@pytest.mark.parametrize("color,ok", [("255\\0\\0", True), ("256\\0\\0", False), ("255\\0", False), ("abc\\def\\ghi", False)])
def test_color_values(spark, color, ok):
    assert one(spark, S.valid_color(F.col("v")), v=color) is ok


def test_scrub_and_times(spark):
    text = "mail a.b@c.org see https://x.y/z at 10.0.0.1, 123-45-6789, 123456789 or 555-123-4567"
    assert one(spark, S.scrub(F.col("v")), v=text) == "mail [EMAIL] see [URL] at [IP], [SSN], [ID] or [PHONE]"
    assert one(spark, S.scrub(F.col("v")), v="") == "#"
    assert one(spark, S.dicom_time(F.col("v")), v="1430.5") == "143000"
    assert one(spark, S.dicom_time(F.col("v")), v="256000") is None
    assert one(spark, S.dicom_date(F.col("v")), v="20240230") is None
    assert one(spark, S.uptime(F.lit(90061))) == "1d 1h 1m"


@pytest.mark.parametrize(
    "operator,tag,value,ok",
    [
        ("NOT_EQUALS", None, "x", False), ("GREATER_THAN", "abc", "5", False), ("GREATER_THAN", "5.5", "5", True), ("EQUALS", "3.0", "3", False), ("LESS_THAN", "nan", "5", False),
        ("CASE_SENSITIVE_STRING_CONTAINS", "abc", "", True), ("CASE_INSENSITIVE_STRING_DOES_NOT_CONTAIN", "HEAD", "neck", True), ("LESS_THAN", "3.0d", "5", False),
    ],
)
def test_predicates(spark, operator, tag, value, ok):
    assert one(spark, R.satisfied(F.col("o"), F.col("t"), F.col("v")), o=operator, t=tag, v=value) is ok


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.sampled_from(["AND", "OR", "XOR"])), max_size=6))
def test_fold_is_left_to_right(spark, steps):
    expected = False
    for k, (value, _) in enumerate(steps):
        if k == 0:
            expected = value
        else:
            how = steps[k - 1][1]
            expected = (expected and value) if how == "AND" else (expected or value) if how == "OR" else False
    rows = [[(k, k, v, c) for k, (v, c) in reversed(list(enumerate(steps)))]]
    df = spark.createDataFrame([(rows[0],)], "r array<struct<order:int,id:int,result:boolean,combine:string>>")
    assert df.select(R.fold(F.col("r")).alias("x")).first().x == expected


def test_rule_chain(spark):
    tags = spark.createDataFrame([("s1", {"Modality": "CT", "(0008,1030)": "CT HEAD"}), ("s2", {"Modality": "MR"})], "series_uid string, tags map<string,string>")
    rules = spark.createDataFrame(
        [(1, 1, 1, "Modality", "x", "EQUALS", "CT", "AND"), (1, 2, 2, "Study Description", "(0008,1030)", "CASE_INSENSITIVE_STRING_CONTAINS", "head", "AND"), (2, 1, 3, "Modality", "x", "EQUALS", "CT", "OR")],
        "set_id int, rule_order int, rule_id int, tag_name string, tag_id string, operator string, value string, combine string",
    )
    groups = spark.createDataFrame([(1, "T", 1, 1, "OR"), (2, "U", 2, 1, "OR")], "group_id int, template_id string, set_id int, set_order int, combine string")
    got = R.assign(R.match(tags, rules, groups))
    assert {r.series_uid: r.status for r in got.collect()} == {"s1": "MULTIPLE_RULES_MATCHED", "s2": "RULE_NOT_MATCHED"}


@pytest.mark.parametrize(
    "rules,modality,matched",
    [
        # (set, order, tag, operator, value, combinator); the groups are (set, order, combinator)
        ([(1, 1, "Modality", "EQUALS", "CT", "AND"), (1, 2, "Slice Thickness", "LESS_THAN", "5", "AND"), (1, 3, "Body Part Examined", "EQUALS", "HEAD", "AND")], "CT", (True, 1)),
        ([(1, 1, "Modality", "EQUALS", "CT", "AND"), (1, 2, "Slice Thickness", "LESS_THAN", "5", "AND"), (1, 3, "Body Part Examined", "EQUALS", "HEAD", "AND")], "MR", (False, 0)),
        ([(1, 1, "Modality", "EQUALS", "CT", "OR"), (1, 2, "Slice Thickness", "GREATER_THAN", "5", "OR"), (1, 3, "Body Part Examined", "EQUALS", "NECK", "OR")], "CT", (True, 1)),
        ([(1, 1, "Modality", "EQUALS", "CT", "OR"), (1, 2, "Slice Thickness", "GREATER_THAN", "5", "OR"), (1, 3, "Body Part Examined", "EQUALS", "NECK", "OR")], "MR", (False, 0)),
        ([(1, 1, "Modality", "EQUALS", "CT", "AND"), (1, 2, "Body Part Examined", "EQUALS", "NECK", "OR"), (1, 3, "Slice Thickness", "EQUALS", "3.0", "AND")], "CT", (True, 1)),  # T and F or T
        ([(1, 1, "Modality", "EQUALS", "CT", "OR"), (1, 2, "Body Part Examined", "EQUALS", "HEAD", "AND"), (1, 3, "Slice Thickness", "EQUALS", "9", "AND")], "CT", (False, 0)),  # T or T and F
        ([(1, 1, "Modality", "EQUALS", "CT", "AND"), (2, 1, "Body Part Examined", "EQUALS", "NECK", "AND")], "CT", (True, 1)),
        ([(1, 1, "Modality", "EQUALS", "CT", "AND"), (2, 1, "Body Part Examined", "EQUALS", "HEAD", "AND")], "CT", (True, 2)),
        ([(2, 1, "Body Part Examined", "EQUALS", "HEAD", "AND")], "CT", (True, 1)),  # the first set has no rules
    ],
)
def test_rule_combinations(spark, rules, modality, matched):
    tags = spark.createDataFrame([("s", {"Modality": modality, "Body Part Examined": "HEAD", "Slice Thickness": "3.0"})], "series_uid string, tags map<string,string>")
    schema = "set_id int, rule_order int, tag_name string, operator string, value string, combine string"
    table = spark.createDataFrame(rules, schema).withColumn("rule_id", F.col("rule_order")).withColumn("tag_id", F.lit("x"))
    for how, want in (("OR", matched), ("AND", (matched[1] == 2, matched[1]))):
        groups = spark.createDataFrame([(1, "T", 1, 1, how), (1, "T", 2, 2, how)], "group_id int, template_id string, set_id int, set_order int, combine string")
        got = R.evaluate_groups(R.match(tags, table, groups)).first()
        assert (got.result, got.matched_sets) == want


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 2**32 - 1))
def test_compiled_rules_equal_rules_as_rows(spark, seed):
    """Random rules, missing tags, unknown operators and combinators."""
    rng = np.random.default_rng(seed)
    pick = lambda *x: x[int(rng.integers(len(x)))]
    operators = ["EQUALS", "NOT_EQUALS", "GREATER_THAN", "LESS_THAN_OR_EQUAL_TO", "CASE_INSENSITIVE_STRING_CONTAINS", "CASE_SENSITIVE_STRING_DOES_NOT_CONTAIN", "odd", None]
    rules = [(pick(1, 2, 3, 4), int(rng.integers(3)), k, pick("A", "B", None), pick("(1)", "(2)", None), pick(*operators), pick("5", "x", "nan", " 7 ", "", None), pick("AND", "OR", "XOR", None)) for k in range(int(rng.integers(0, 9)))]
    places = [(pick(1, 2, None), pick("T", None), pick(1, 2, 3, 9), int(rng.integers(3)), pick("AND", "OR", "", None)) for _ in range(int(rng.integers(0, 6)))]
    tags = [(str(k), {n: pick("5", "7.0", "X", "xx", "", "inf") for n in ("A", "B", "(1)", "(2)") if rng.random() < 0.6}) for k in range(12)]
    t = spark.createDataFrame(tags, "series_uid string, tags map<string,string>")
    r = spark.createDataFrame(rules, "set_id int, rule_order int, rule_id int, tag_name string, tag_id string, operator string, value string, combine string")
    h = spark.createDataFrame(places, "group_id int, template_id string, set_id int, set_order int, combine string")
    rows = lambda df: sorted(map(str, df.collect()))
    one, other = R.match(t, r, h), R._matched_by_rows(t, r, h)
    if rules and places:
        assert rows(R.evaluate_groups(one)) == rows(R.evaluate_groups(other))
        assert rows(R.assign(one)) == rows(R.assign(other))
        each = t.crossJoin(R._rule_sets(r))
        assert rows(R.evaluate_sets(t, r)) == rows(each.select("series_uid", F.explode(R._set_results()).alias("set_id", "result")))
    assert R.assign(one).count() == 12 and R.evaluate_sets(t, r).count() == 12 * len({x[0] for x in rules})


def test_compiled_rules_are_generated_code(spark, monkeypatch):
    tags = spark.createDataFrame([("s", {"A": "5"})], "series_uid string, tags map<string,string>")
    rules = spark.createDataFrame([(1, 1, 1, "A", "x", "GREATER_THAN", "4", "AND"), (1, 2, 2, "A", "x", "LESS_THAN", "6", "AND")], "set_id int, rule_order int, rule_id int, tag_name string, tag_id string, operator string, value string, combine string")
    groups = spark.createDataFrame([(1, "T", 1, 1, "OR")], "group_id int, template_id string, set_id int, set_order int, combine string")
    matched = R.match(tags, rules, groups)
    plan = matched._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and "Exchange" not in plan and "*(1) Project" in plan and plan.count("RLIKE") == 1
    monkeypatch.setattr(R, "MOST", 1)
    assert "lambda" in R.match(tags, rules, groups)._jdf.queryExecution().executedPlan().toString()
    assert R.assign(matched).collect() == R.assign(R.match(tags, rules, groups)).collect()


@pytest.mark.parametrize(
    "pattern,text,ok", [("smith*", "Smith^John", True), ("smith*", "Blacksmith", False), ("CT?23", "ct123", True), ("CT?23", "ct1234", False), ("1.2*", "1.2.840", True), ("1.2*", "1x2.840", False), ("a(b", "A(B", True)]
)
def test_wildcards(spark, pattern, text, ok):
    assert one(spark, Q.wildcard(F.col("v"), pattern), v=text) is ok


def test_date_ranges(spark):
    days = spark.createDataFrame([(dt.date(2024, 1, 1),), (dt.date(2024, 1, 31),), (dt.date(2024, 2, 1),), (dt.date(2023, 1, 1),)], "d date")
    n = lambda v, **k: days.filter(Q.date_match(F.col("d"), v, **k)).count()
    assert [n("20240101-20240131"), n("20240101-"), n("abc"), n("2024"), n("20240201"), n("202401*")] == [2, 4, 4, 4, 1, 2]
    assert n("20240101-", strict=True) == 3 and n("-20240101", strict=True) == 2


def test_skip_reasons(spark):
    now = dt.datetime(2024, 1, 1, 12)
    rows = [(now, "CT", "1", "Axial", "20240101"), (now - dt.timedelta(hours=1), "US", "1", "Axial", ""), (now - dt.timedelta(hours=1), "CT", "", "Topogram", ""), (now - dt.timedelta(hours=1), "CT", "1", "CT SCOUT 1", ""),
            (now - dt.timedelta(hours=1), "CT", "1", "scouting", "bad"), (now - dt.timedelta(hours=1), "CT", "1", None, "20200101"), (now - dt.timedelta(days=9), "CT", "1", "x", "20240101")]
    df = spark.createDataFrame(rows, "mtime timestamp, modality string, sop_uid string, series_description string, study_date string")
    got = C.skip_reason(df, F.lit(now), F.lit(now - dt.timedelta(days=5)), F.lit(dt.datetime(2023, 1, 1)))
    assert [r.reason for r in got.collect()] == ["recently_modified", "modality", "missing_sop_uid", "localizer_series", None, "study_date_before_filter", "before_date_filter"]


def masks(spark, *cells):
    return spark.createDataFrame([(1, *map(int, c)) for c in cells], "comparison_id long, i int, j int, k int")


BOX = [(i, j, k) for i in range(2) for j in range(2) for k in range(2)]


def test_overlap_of_shifted_boxes(spark):
    a, b = masks(spark, *BOX), masks(spark, *[(i + 1, j, k) for i, j, k in BOX])
    r = V.overlap(V.membership(a, b), 64).first()
    assert (r.dsc, round(r.jsc, 9), round(r.voe, 9)) == (0.5, round(1 / 3, 9), round(2 / 3, 9))
    d = V.voxel_distances(a, b).first()
    assert (d.msd, d.hd95) == (0.5, 1.0)
    m = {x.metric: x.value for x in K.metrics(V.membership(a, b), (4, 4, 4)).collect()}
    assert (m["msd"], m["hd95"]) == (0.5, 1.0)


def test_axis_distances(spark):
    a, b = masks(spark, (0, 0, 0), (5, 5, 5)), masks(spark, (3, 0, 0))
    got = {(r.i, r.j, r.k): r.distance for r in V.axis_distance(V.membership(a, b), "in_a", "in_b", (2.0, 1.0, 1.0)).collect()}
    assert got == {(0, 0, 0): 6.0, (5, 5, 5): None}


@settings(max_examples=15, deadline=None)
@given(st.integers(0, 2**32 - 1))
def test_kernels_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    m = rng.random((5, 4, 6)) < 0.3
    m[0, 0, 0] = True
    spacing = (1.0, 2.0, 0.5)
    on = np.argwhere(m)
    every = np.argwhere(np.ones(m.shape, bool))
    brute = np.sqrt((((every[:, None] - on[None]) * spacing) ** 2).sum(-1).min(1)).reshape(m.shape)
    assert np.allclose(K.distances(m, spacing), brute)
    label, seen = K.labels(m), {}
    for c in on:  # flood fill
        todo = [tuple(c)]
        if tuple(c) in seen:
            continue
        n = len(set(seen.values())) + 1
        while todo:
            x = todo.pop()
            if x in seen or any(v < 0 or v >= s for v, s in zip(x, m.shape)) or not m[x]:
                continue
            seen[x] = n
            todo += [tuple(np.add(x, o)) for o in K.FACES[1:]]
    assert all(label[x] == n for x, n in seen.items()) and (label > 0).sum() == len(seen)


def test_fill_and_morphology():
    m = np.ones((5, 5, 5), bool)
    m[2, 2, 2] = False
    assert K.fill_holes(m).all()
    open_hole = m.copy()
    open_hole[2, 2, 3:] = False
    assert (K.fill_holes(open_hole) == open_hole).all()
    assert K.keep_largest(np.array([[[1, 1, 0, 1]]], bool)).tolist() == [[[True, True, False, False]]]
    assert K.surface_dice(m, m) == 1.0 and K.surface_dice(m, np.zeros_like(m)) == 0.0 and K.added_path(m, m) == 0.0


def test_margin_matches_kernel(spark):
    a = masks(spark, *BOX, (3, 3, 3))
    for mm, f in ((1.5, K.dilate), (-1.0, K.erode)):
        got = {(r.i, r.j, r.k) for r in V.margin(a, mm, (5, 5, 5)).collect()}
        grid = f(K.dense(a.toPandas(), (5, 5, 5)), V.ball(mm))
        assert got == {tuple(map(int, x)) for x in np.argwhere(grid)}


def test_pipeline_text_and_errors(spark):
    steps = P.parse_text("expand(margin_mm=1.0) | crop_to_boundary(boundary_roi=Body) | smooth(smoothing_mm=2, iterations=1)")
    assert [s["type"] for s in steps] == ["expand", "crop_to_boundary", "smooth"] and steps[2]["parameters"] == {"smoothing_mm": 2, "iterations": 1}
    steps[0]["structures"] = ["a"]
    body = masks(spark, *[(i, j, 0) for i in range(4) for j in range(4)])
    out = P.run(steps[:2], {"a": masks(spark, (1, 1, 0)), "Body": body}, (4, 4, 4))
    assert out.count() == 5
    with pytest.raises(ValueError, match="step 1"):
        P.run([{"type": "nothing"}], {}, (4, 4, 4))
    with pytest.raises(ValueError, match="no mask"):
        P.run([{"type": "union", "structures": ["z"]}], {}, (4, 4, 4))


def test_tiers(spark):
    names = spark.createDataFrame([("Heart",), ("spinal cord",), ("Lung-L",), ("xx kidney yy",), ("none",)], "name string")
    templates = spark.createDataFrame([("HEART", 1), ("spinal_cord", 2), ("lung_l", 3), ("kidney", 4)], "name string, position int")
    got = {r.name: (r.template, r.tier) for r in C.tiered_match(names, templates).collect()}
    assert got == {"Heart": ("HEART", 1), "spinal cord": ("spinal_cord", 2), "Lung-L": ("lung_l", 3), "xx kidney yy": ("kidney", 4)}


def test_texts_inside_others(spark):
    import random

    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcé") for _ in range(n))
    names = [word(rng.randint(0, 9)) for _ in range(150)] + ["%_a", "a%", None, "A b"]
    templates = [(word(rng.randint(1, 5)), k) for k in range(60)] + [("%", 60), (None, 61), ("AB", 62), ("ab", 63)]
    x, y = {t.lower() for t, _ in templates if t}, {n.lower() for n in names if n}
    frame = lambda v, c: spark.createDataFrame([(t,) for t in v], f"{c} string")
    assert {tuple(r) for r in C.contained(frame(x, "x"), frame(y, "y")).collect()} == {(a, b) for a in x for b in y if a in b}
    for extra in ([], [("", 70)]):
        table = templates + extra
        forms = [str.lower, lambda v: v.lower().replace(" ", "_"), lambda v: v.lower().replace(" ", "").replace("_", "").replace("-", "")]

        def best(n):
            for tier, f in enumerate(forms, 1):
                hit = [t for t, _ in table if t is not None and f(t) == f(n)]
                if hit:
                    return hit[-1], tier
            last, first = {}, {}
            for t, k in table:
                if t is not None:
                    last[t.lower()] = t
                    first.setdefault(t.lower(), k)
            hit = [(first[f], last[f]) for f in last if f in n.lower() or n.lower() in f]
            return (min(hit)[1], 4) if hit else None

        want = {n: best(n) for n in names if n is not None and best(n)}
        got = C.tiered_match(frame(names, "name"), spark.createDataFrame(table, "name string, position int"))
        assert {r.name: (r.template, r.tier) for r in got.collect()} == want
    assert "NestedLoop" not in C.contained(frame(x, "x"), frame(y, "y"))._jdf.queryExecution().executedPlan().toString()


def test_medians(spark, monkeypatch):
    from radlake.operators import reports as RE

    rng = np.random.default_rng(8)
    rows = [("skewed", float(v)) for v in np.exp(rng.normal(0, 8, 3000))] + [("ties", 5.0)] * 700 + [("ties", 6.0)] * 700 + [("one", 3.0), (None, 4.0), (None, 2.0), ("none", None), ("none", None)]
    rows += [("odd", float(v)) for v in rng.integers(-5, 5, 1001)] + [("wide", s * 1.7e308) for s in (-1, 1)] * 60 + [("small", k * 5e-324) for k in range(90)] + [("inf", float("inf")), ("inf", 1.0), ("inf", 1.7976931348623157e308)] * 40
    rows += [("nan", float("nan"))] * 50 + [("nan", 1.0)] * 49
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    want = {r.g: r.m for r in df.groupBy("g").agg(F.median("v").alias("m")).collect()}
    for few in (2048, 10):
        monkeypatch.setattr(RE, "FEW", few)
        got = {r.g: r.median for r in RE.medians(df, ["g"], "v").collect()}
        assert set(got) == set(want) and all(got[g] == want[g] or want[g] is not None and (np.isclose(got[g], want[g], rtol=1e-12) or np.isnan(got[g]) and np.isnan(want[g])) for g in want)
    assert RE.medians(df.limit(0), ["g"], "v").count() == 0


def test_unknown_level_has_no_answer(spark):
    catalog = {"patients": spark.createDataFrame([("1", "A")], "patient_id string, patient_name string"), "studies": spark.createDataFrame([("1", "2")], "patient_id string, study_uid string")}
    assert Q.query("WORLD", {}, catalog).count() == 0


def test_labels_of_components():
    rng = np.random.default_rng(0)
    for full in (False, True):
        mask = rng.random((9, 8, 7)) < 0.3
        label = K.labels(mask, full)
        offsets = K.CUBE if full else K.FACES
        seen, n = np.zeros(mask.shape, int), 0
        for start in zip(*np.nonzero(mask)):
            if not seen[start]:
                n += 1
                stack = [start]
                while stack:
                    at = stack.pop()
                    if all(0 <= x < m for x, m in zip(at, mask.shape)) and mask[at] and not seen[at]:
                        seen[at] = n
                        stack += [tuple(a + b for a, b in zip(at, o)) for o in offsets]
        assert (seen == label).all()
    snake = np.zeros((60, 60, 1), bool)
    snake[::2], snake[1::4, -1], snake[3::4, 0] = True, True, True
    assert K.labels(snake).max() == 1


def test_filled_contours():
    inner, edge = K.filled(np.array([(1, 1), (5, 1), (5, 4), (1, 4)]))
    assert {tuple(p) for p in np.concatenate([inner, edge]).tolist()} == {(x, y) for x in range(1, 6) for y in range(1, 5)}
    assert len(K.filled(np.array([(3, 3)]))[1]) == 5 and {tuple(p) for p in K.filled(np.array([(0, 0), (3, 3)]))[1].tolist()} == {(k, k) for k in range(4)}
    triangle = np.concatenate(K.filled(np.array([(0, 0), (6, 0), (0, 6)])))
    assert {tuple(p) for p in triangle.tolist()} == {(x, y) for x in range(7) for y in range(7 - x)}


def test_rasterised_holes_and_borders(spark):
    square = lambda a, b: ([float(x) for x in (a, b, b, a)], [float(x) for x in (a, a, b, b)])
    rows = [(1, 0, *square(0, 9)), (1, 0, *square(3, 6)), (1, 1, [20.0], [20.0]), (2, 0, [-5.0, 5.0], [2.0, 2.0]), (2, 3, [], [])]
    got = {}
    for r in K.rasterised(spark.createDataFrame(rows, "comparison_id int, k int, xs array<double>, ys array<double>"), (10, 10)).collect():
        got.setdefault((r.comparison_id, r.k), set()).add((r.i, r.j))
    assert got[1, 0] == {(i, j) for i in range(10) for j in range(10)} - {(i, j) for i in (4, 5) for j in (4, 5)} and got[2, 0] == {(2, j) for j in range(6)} and set(got) == {(1, 0), (2, 0)}


def test_masks_with_grids_of_their_own(spark):
    mask = spark.createDataFrame([(1, 0, 0, 0), (1, 0, 1, 0), (2, 5, 5, 5)], "comparison_id int, i int, j int, k int")
    geometry = spark.createDataFrame([(1, 2, 2, 1, 1.0, 1.0, 1.0), (2, 9, 9, 9, 2.0, 2.0, 2.0)], "comparison_id int, nx int, ny int, nz int, sx double, sy double, sz double")
    grown = K.apply_mask(mask, None, lambda m, s: K.dilate(m, V.ball(2.0, s)), geometry)
    assert {r.comparison_id: r["count"] for r in grown.groupBy("comparison_id").count().collect()} == {1: 4, 2: 7}
    d = K.distance_maps(mask, None, signed=False, geometry=geometry).filter("comparison_id = 2 AND i = 5 AND j = 5 AND k = 8").first()
    assert d.distance == 6.0


def test_metrics_of_empty_masks(spark):
    cells = spark.createDataFrame([(1, 0, 0, 0, True, False), (2, 1, 1, 1, True, True)], "comparison_id int, i int, j int, k int, in_a boolean, in_b boolean")
    got = {(r.comparison_id, r.metric): (r.value, r.error) for r in K.metrics(cells, (4, 4, 4)).collect()}
    assert got[1, "dsc"] == (0.0, None) and got[1, "msd"] == (float("inf"), None) and got[1, "surface_dsc"] == (0.0, None) and got[2, "hd95"] == (0.0, None) and got[2, "cs"] == (1.0, None)


def test_slice_lists_and_histogram(spark):
    cells = spark.createDataFrame([(1, 0, 0, 0, True, True), (1, 2, 0, 0, True, False), (1, 0, 3, 0, False, True), (1, 7, 7, 1, True, False)], "comparison_id int, i int, j int, k int, in_a boolean, in_b boolean")
    lists = V.slice_lists(cells)
    got = {r.k: (r.under_distances, r.over_distances, r.overlap_count) for r in lists.collect()}
    assert got == {0: ([2.0], [3.0], 1), 1: ([], [], 1)}
    assert [(r.bucket, r.n) for r in V.histogram(lists, "under_distances", 1.0, 5).collect()] == [(3, 1)]


def test_pipelines_there_and_back(spark):
    from radlake.registry import OPERATIONS, register_operation

    steps = P.parse_text("expand(margin_mm=5.0) | crop_to_boundary(boundary_roi='Body') | keep_largest(n=2) | fill_holes")
    assert steps[1]["parameters"] == {"boundary_roi": "Body"} and P.parse_text(P.to_text(steps)) == steps and P.parse_json(P.to_json(steps)) == steps
    mask = spark.createDataFrame([(1, 1, 1, 1)], "comparison_id int, i int, j int, k int")
    register_operation("shift")(lambda m, others, p, size, spacing: m.withColumn("i", F.col("i") + p["by"]))
    try:
        assert [r.i for r in P.run([{"type": "shift", "structures": ["a"], "parameters": {"by": 2}}], {"a": mask}, (9, 9, 9)).collect()] == [3]
    finally:
        del OPERATIONS["shift"]
    with pytest.raises(ValueError, match="step 1"):
        P.run([{"type": "shift", "structures": ["a"]}], {"a": mask}, (9, 9, 9))


@pytest.mark.parametrize("path,ok", [("/app/x/../datastore/a", True), ("/app/datastore", True), ("/app/datastore/../../etc", False), ("app/datastore/a", False), ("/app/datastore2", False), ("/app/datastore/a\x00", False), ("", False), (None, False), ("/../../app/datastore/b", True)])
def test_paths_inside(spark, path, ok):
    df = spark.createDataFrame([(path,)], "v string")
    assert df.select(S.inside(F.col("v"), "/app/datastore").alias("x")).first().x is ok


@pytest.mark.parametrize("value,kinds", [("https://a.bc/c?d", (True, False, False)), ("ftp://localhost:21", (True, False, False)), ("x.PNG", (False, True, False)), ("data:image/png;base64,x", (False, True, False)), ("1e5", (False, False, True)), ("1_0", (False, False, True)), ("abc", (False, False, False)), (" nan ", (False, False, True)), (None, (False, False, False))])
def test_kinds_of_values(spark, value, kinds):
    df = spark.createDataFrame([(value,)], "v string")
    v = F.col("v")
    assert tuple(df.select(S.is_url(v), S.is_image(v), S.is_number(v)).first()) == kinds


def test_names_of_fields_and_files(spark):
    row = spark.createDataFrame([("left_border_description", "roiUrl", "../a\\b/..", "")], "a string, b string, c string, d string")
    got = row.select(S.humanized(F.col("a")), S.humanized(F.col("b")), S.file_name(F.col("c")), S.file_name(F.col("d")), S.progress(F.lit(1), F.lit(3)), S.cleanup_target(F.lit(100.0))).first()
    assert tuple(got) == ("Left Border Description", "Roi URL".replace("Roi", "ROI"), "__a_b__", "unnamed", 33.3, 20.0)


def test_metrics_of_the_driver():
    rng = np.random.default_rng(7)
    step = (1.5, 1.0, 2.0)
    for _ in range(5):
        a, b = rng.random((5, 6, 7)) < 0.3, rng.random((5, 6, 7)) < 0.2
        want = []
        for source, target in ((a & ~b, b), (b & ~a, a)):
            d = []
            for p in np.argwhere(source):
                near = [abs(q[x] - p[x]) * step[x] for q in np.argwhere(target) for x in range(3) if all(q[y] == p[y] for y in range(3) if y != x)]
                d += [min(near)] if near else []
            want.append(float(np.mean(d)) if d else 0.0)
        assert np.allclose(K.conformity(a, b, step), ((want[0] + want[1]) / 2, *want))
        x, y = a.ravel().astype(int), b.ravel().astype(int)
        joint = np.histogram2d(x, y, 2)[0] / x.size
        h = lambda p: -sum(v * np.log(v) for v in np.ravel(p) if v > 0)
        assert np.isclose(K.information(int(a.sum()), int(b.sum()), int((a & b).sum()), a.size), 2 * h(joint) - h(joint.sum(0)) - h(joint.sum(1)))
    none = np.zeros((3, 3, 3), bool)
    assert K.conformity(none, none) == (0.0, 0.0, 0.0) and K.information(0, 0, 0, 27) == 0.0


def test_ages_of_logs(spark):
    now = dt.datetime(2024, 3, 1)
    files = [(f"/l/a.log.{k}{'.gz' if k % 2 else ''}", now - dt.timedelta(days=d)) for k, d in enumerate((40, 40, 20, 20, 3, 3))] + [("/l/a.log", now - dt.timedelta(days=99))]
    got = {r.path[-4:]: r.action for r in L.retained(spark.createDataFrame(files, "path string, mtime timestamp"), F.lit(now)).collect()}
    assert got == {"og.0": "delete", "1.gz": "delete", "og.2": "compress", "3.gz": "keep", "og.4": "keep", "5.gz": "keep"}


def test_refused_urls(spark):
    rows = spark.createDataFrame([("http://x/",), ("http://x",), ("",), (None,)], "u string")
    assert [r.e is None for r in rows.select(L.url_error(F.col("u")).alias("e")).collect()] == [True, False, True, True]


def test_storage_flag(spark):
    usage = spark.createDataFrame([(3, 100.0)], "n_files long, used double")
    row = lambda limit, cleanup, least=5.0: tuple(L.storage_check(usage, limit, cleanup, least).select("exceeded", "to_free").first())
    assert row(100.0, True) == (True, 20.0) and row(100.0, True, 50.0) == (True, 50.0) and row(100.0, False) == (True, None) and row(100.1, True) == (False, None)
    gone = spark.createDataFrame([(60,)], "size long")
    assert tuple(L.after_cleanup(usage, gone, 50.0).first()) == (2, 40.0, False, 1, 60)
