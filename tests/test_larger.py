"""Queries on small tables of which a key or a count is as in much larger ones; compared with their SQL."""

import datetime as dt

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from radlake import queries, stream_queries
from radlake.operators import cfind as Q
from radlake.operators import kernels as K
from radlake.operators import lines as L
from radlake.operators import voxels as V
from radlake.streaming import completion


def differs(spark, name, folder, tables):
    """Rows of the query that its SQL lacks, and the other way round."""
    c = duckdb.connect()
    for t, rows in tables.items():
        rows.to_parquet(folder / f"{t}.parquet")
        c.register(t, rows)
    got, want = queries.QUERIES[name](spark, str(folder)).toPandas(), c.sql(queries.ORACLE_SQL[name]).df()
    assert len(want) and sorted(got.columns) == sorted(want.columns)
    rows = lambda d: sorted(map(str, d[sorted(want.columns)].astype(object).where(lambda x: x.notna(), None).values.tolist()))
    return [x for x in zip(rows(got), rows(want)) if x[0] != x[1]] or len(got) - len(want)


@pytest.mark.parametrize("name", ["compare_same_names", "compare_both_sides", "compare_of_series", "metrics_latest", "metrics_long_export", "metrics_replaced"])
def test_ids_of_more_than_six_digits(spark, tmp_path, name):
    """Orders beyond a million; an order with two parts of a supplier; keys that begin with the same six digits."""
    line = [(o, p, s) for s in range(8) for o, p in ((17, 1), (1234567, 2), (1234568, 3), (9000001, 1), (9000001, 2), (999999, 3), (10000000, 4), (5, 4))]
    tables = {
        "lineitem": pd.DataFrame(line, columns=["l_orderkey", "l_partkey", "l_suppkey"]),
        "part": pd.DataFrame({"p_partkey": [1, 2, 3, 4], "p_name": ["a", "b", "c", "a"]}),
        "supplier": pd.DataFrame({"s_suppkey": range(8), "s_name": [f"S{n}" for n in range(8)]}),
    }
    assert not differs(spark, name, tmp_path, tables)


def test_series_within_a_batch_are_no_state(spark, tmp_path):
    """One sender, 60 series of 5 files in a batch, the last of which stays open: state is written for that one only."""
    t = dt.datetime(2024, 1, 1)
    rows = [(n, t + dt.timedelta(seconds=n), 1, f"s{n // 5}", f"{n}", f"/{n}", False) for n in range(300)]
    schema = "event_id long, ts timestamp, ae long, series_uid string, sop_uid string, path string, released boolean"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    writer = completion.series_stream(stream).writeStream.format("memory").queryName("within").outputMode("append").option("checkpointLocation", str(tmp_path / "c"))
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination()
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert [(r.series_uid, r.n, len(r.paths)) for r in spark.table("within").orderBy("first").collect()] == [(f"s{k}", 5, 5) for k in range(59)]
    assert max(p.stateOperators[0].numRowsUpdated for p in q.recentProgress if p.numInputRows) < 20


def test_contours_are_dealt_out_as_words(spark):
    """Contours of one partition are worked out by several tasks; rows of pixels are shuffled; equal to one contour after the other."""
    g = np.random.default_rng(3)
    shapes = [(int(g.integers(0, 9)), g.integers(-9, 150, (int(g.integers(1, 8)), 2))) for _ in range(60)]
    rows = [(k % 5, k // 20, [float(x) for x in p[:, 0]], [float(y) for y in p[:, 1]]) for k, (_, p) in enumerate(shapes)]
    out = K.rasterised(spark.createDataFrame(rows, "comparison_id int, k int, xs array<double>, ys array<double>").coalesce(1), (100, 130))
    around, edges = {}, set()
    for k, (_, p) in enumerate(shapes):
        inner, edge = K.filled(p)
        for x, y in inner.tolist():
            around[k % 5, y, x, k // 20] = around.get((k % 5, y, x, k // 20), 0) + 1
        edges |= {(k % 5, y, x, k // 20) for x, y in edge.tolist()}
    want = {c for c in edges | {c for c, n in around.items() if n % 2} if 0 <= c[1] < 100 and 0 <= c[2] < 130}
    got = [tuple(r) for r in out.collect()]
    assert set(got) == want and len(got) == len(want)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan[plan.index("MapInArrow") :] and "bit_xor" in plan


def test_membership_shuffles_lines(spark):
    """Copies of voxels count once; lines are grouped, not voxels."""
    a = spark.createDataFrame([(1, 0, 0, 0), (1, 0, 0, 0), (1, 0, 0, 63), (1, 0, 0, 64), (2, 0, 0, 200)], "comparison_id int, i int, j int, k int")
    b = spark.createDataFrame([(1, 0, 0, 63), (1, 0, 1, 5), (1, 0, 1, 5)], "comparison_id int, i int, j int, k int")
    cells = V.membership(a, b)
    assert sorted(map(tuple, cells.collect())) == [(1, 0, 0, 0, True, False), (1, 0, 0, 63, True, True), (1, 0, 0, 64, True, False), (1, 0, 1, 5, False, True), (2, 0, 0, 200, True, False)]
    assert dict(cells.dtypes)["k"] == "int" and "bit_or" in cells._jdf.queryExecution().optimizedPlan().toString()


def test_levels_without_a_limit(spark, tmp_path):
    """All answers are counted; they don't pass one task."""
    plan = queries.QUERIES["query_levels"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "GlobalLimit" not in plan and "Sort" not in plan


def shuffles(spark, name):
    """Shuffles of a query when no table is small enough to be sent to every task."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    return plan.count("Exchange hashpartitioning")


STORE = {
    "lineitem": pd.DataFrame({
        "l_orderkey": [1, 1, 1, 1, 2, 2, 3, 9, 4], "l_partkey": [5, 5, 6, 7, 5, 8, 6, 5, 5], "l_suppkey": [1, 1, 1, 2, 1, 7, 3, 1, 3], "l_linenumber": [1, 1, 2, 1, 1, 1, 3, 1, 2], "l_quantity": 30.0, "l_extendedprice": 1.0,
        "l_returnflag": list("AARNARAAN"), "l_linestatus": "F", "l_shipdate": dt.datetime(2000, 1, 1),
    }),
    "orders": pd.DataFrame({"o_orderkey": [1, 2, 3, 4], "o_custkey": [1, 1, 2, 3], "o_orderdate": dt.datetime(1999, 1, 2), "o_orderpriority": ["1-URGENT", "5-LOW", "1-URGENT", "5-LOW"], "o_orderstatus": "F"}),
    "customer": pd.DataFrame({"c_custkey": [1, 2, 3], "c_name": ["a b", "Cd", "e-f"], "c_mktsegment": "M"}),
    "supplier": pd.DataFrame({"s_suppkey": [1, 2, 3, 3], "s_name": list("abcd")}),
    "part": pd.DataFrame({"p_partkey": [5, 6, 8], "p_name": list("xyz"), "p_type": ["PROMO", "SMALL", "PROMO"]}),
}


def test_all_levels_have_their_answers(spark, tmp_path):
    """Images are a level, too: an image that comes twice, one of two series, some without a study or a series; a structure set."""
    assert not differs(spark, "query_levels", tmp_path, STORE)
    got = queries.QUERIES["query_levels"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [("PATIENT", 3), ("STUDY", 4), ("SERIES", 8), ("IMAGE", 10), ("WORLD", 0)]
    assert {r.level for r in got} == {*Q.FILTERS, "WORLD"}


@pytest.mark.parametrize("name", ["deid_tags", "deid_sop_uids"])
def test_images_are_shuffled_once(spark, tmp_path, name):
    """Images that come twice, a supplier that does, one that is missing, an image without a study; few shuffles."""
    assert not differs(spark, name, tmp_path, STORE)
    assert shuffles(spark, name) <= 7


def test_groups_are_judged_once(spark, tmp_path):
    """No test of the array of groups before they are rows; a part that is missing; the first image is found without a shuffle of its own."""
    assert not differs(spark, "rule_group_match", tmp_path, STORE)
    assert "size(" not in queries.QUERIES["rule_group_match"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert shuffles(spark, "rule_group_match") <= 4


def test_names_are_made_safe_before_layouts(spark, tmp_path):
    """What the five paths of an image share is worked out before there are five rows; images are shuffled once."""
    assert not differs(spark, "storage_layout", tmp_path, STORE)
    plan = queries.QUERIES["storage_layout"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan[: plan.index("Generate")] and plan.count("Join") == 2
    assert shuffles(spark, "storage_layout") <= 4


def test_files_of_a_batch_grow_in_number(spark, tmp_path, monkeypatch):
    """Five batches, however many images there are; a file holds no more of them."""
    monkeypatch.setattr(stream_queries, "INGESTED", 20)
    folder = tmp_path / "shared"
    monkeypatch.setattr(stream_queries.files, "shared_folder", lambda spark, name: str(folder))
    line = pd.concat([STORE["lineitem"].assign(l_orderkey=STORE["lineitem"].l_orderkey + 10 * n) for n in range(60)])
    assert not differs(spark, "stream_ingest_restart", tmp_path, {"lineitem": line})
    sizes = [len(pd.read_parquet(f)) for f in (folder / "in").glob("*.parquet")]
    assert sum(sizes) == 540 and len(sizes) > 20 and max(sizes) <= 60
    assert sorted(x.name for x in (folder / "out").glob("batch=*")) == [f"batch={n}" for n in range(5)]


def test_small_masks_side_by_side(spark):
    """Masks of a few lines share a block; equal to one mask after the other where batches cut through masks."""
    few = pa.table({"comparison_id": np.repeat(np.arange(300), 3), "slab": np.zeros(900, int), "i": np.tile([0, 1, 3], 300), "j": np.tile([2, 0, 3], 300), "w": np.zeros(900, int), "bits": np.full(900, 5)})
    assert [(len(row), bits.shape[0]) for row, bits, _ in L.blocks(few, (1, 1, 1), 16)] == [(300, 300)]
    g = np.random.default_rng(5)
    grids = {c: g.random((20, 6, 7)) < 0.6 for c in range(5)}
    rows = L.lines(spark.createDataFrame(pd.concat([K.sparse(m, c) for c, m in grids.items()]), "comparison_id long, i int, j int, k int"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        b = L.morph(rows, L.closing(K.ball(1.0)) + L.opening(K.ball(1.0)), (20, 6, 7))
        got = {n: sorted(tuple(r) for r in L.voxels(d).collect()) for n, d in (("smooth", b), ("holes", K.filled_parts(rows, (20, 6, 7))))}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for name, f in (("smooth", K.smooth), ("holes", K.fill_holes)):
        assert got[name] == sorted((c, *map(int, x)) for c, m in grids.items() for x in np.argwhere(f(m)))
    assert "FlatMapGroups" not in b._jdf.queryExecution().optimizedPlan().toString()
