"""The imaging catalog read from the star-schema tables: a documented re-reading.

patient = customer, study = orders, series = lineitem by order and supplier,
instance = lineitem, transactions and the receive stream = events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").cast("string").alias("patient_id"), F.col("c_name").alias("patient_name"), F.col("c_mktsegment").alias("gender"))


def studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").cast("string").alias("study_uid"), F.col("o_custkey").cast("string").alias("patient_id"), F.col("o_orderdate").cast("date").alias("study_date"),
        F.col("o_orderpriority").alias("study_description"), F.col("o_orderstatus").alias("modality"), F.concat(F.lit("ACC"), F.col("o_orderkey").cast("string")).alias("accession"),
    )


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per file; the SOP uid repeats, as in a store that received files twice."""
    line = table(spark, sf_dir, "lineitem")
    order, supplier = F.col("l_orderkey").cast("string"), F.col("l_suppkey").cast("string")
    return line.select(
        F.concat_ws(".", order, F.col("l_linenumber").cast("string")).alias("sop_uid"), F.concat_ws(".", order, supplier).alias("series_uid"), order.alias("study_uid"),
        F.concat_ws("/", F.lit("/store"), order, supplier, F.concat(F.col("l_partkey").cast("string"), F.lit(".dcm"))).alias("path"),
        F.col("l_linenumber").alias("instance_number"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"), F.col("l_quantity").alias("slice_thickness"),
        F.col("l_extendedprice").alias("size"), F.col("l_returnflag").alias("modality"), F.col("l_linestatus").alias("line_status"), F.col("l_shipdate").alias("mtime"),
    )


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    s = line.groupBy("l_orderkey", "l_suppkey").agg(F.count("*").alias("instance_count"))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("series_description"))
    s = s.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return s.select(
        F.concat_ws(".", F.col("l_orderkey").cast("string"), F.col("l_suppkey").cast("string")).alias("series_uid"), F.col("l_orderkey").cast("string").alias("study_uid"), "series_description", "instance_count"
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "ts", F.col("user_id").alias("ae"), F.col("event_type").alias("kind"), F.col("value").alias("bytes"), "props")


def structure_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned structure sets: one per order and supplier with returned lines. Some have no series, no path, no class or no review."""
    line = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' AND l_linestatus = 'F'").groupBy("l_orderkey", "l_suppkey").agg(F.min("l_shipdate").alias("created"))
    o, s = F.col("l_orderkey"), F.col("l_suppkey")
    order, series = o.cast("string"), F.concat_ws(".", o.cast("string"), s.cast("string"))
    return line.select(
        F.concat(F.lit("RT."), series).alias("rt_id"), F.when(s % 7 != 0, series).alias("series_uid"), F.concat(F.lit("R."), order).alias("rt_study_uid"),
        F.concat(F.lit("RT."), series).alias("rt_series_uid"), F.concat(F.lit("RT."), series, F.lit(".1")).alias("rt_sop_uid"), F.when(s % 3 == 0, F.lit("1.2.3")).alias("rt_sop_class_uid"),
        F.when(s % 5 != 0, F.concat(F.lit("/rt/"), series, F.lit(".dcm"))).alias("rt_path"), F.when(o % 2 == 0, F.col("created").cast("date")).alias("reviewed"),
        F.when(o % 4 == 0, (o % 60).cast("int")).alias("minutes"), F.when(o % 3 == 0, (o % 5 + 1).cast("int")).alias("rating"), "created",
    )


def vois(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rt_id, volume_name, modification, modification_types): volumes of the structure sets, by part; some sets have none."""
    line = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' AND l_linestatus = 'F' AND l_orderkey % 11 <> 0")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand", "p_type")
    rows = line.join(part, "l_partkey")
    key = F.concat(F.lit("RT."), F.col("l_orderkey").cast("string"), F.lit("."), F.col("l_suppkey").cast("string")).alias("rt_id")
    return rows.groupBy(key, F.col("p_name").alias("volume_name")).agg(F.max("p_brand").alias("modification"), F.array_sort(F.collect_set("p_type")).alias("modification_types"))


#: The same for SQL.
SQL = {
    "patient": "patient AS (SELECT c_custkey::VARCHAR AS patient_id, c_name AS patient_name, c_mktsegment AS gender FROM customer)",
    "study": "study AS (SELECT o_orderkey::VARCHAR AS study_uid, o_custkey::VARCHAR AS patient_id, o_orderdate::DATE AS study_date, o_orderpriority AS study_description, o_orderstatus AS modality, 'ACC' || o_orderkey AS accession FROM orders)",
    "instance": "instance AS (SELECT l_orderkey || '.' || l_linenumber AS sop_uid, l_orderkey || '.' || l_suppkey AS series_uid, l_orderkey::VARCHAR AS study_uid, '/store/' || l_orderkey || '/' || l_suppkey || '/' || l_partkey || '.dcm' AS path, l_linenumber AS instance_number, l_partkey AS part, l_suppkey AS supplier, l_quantity AS slice_thickness, l_extendedprice AS size, l_returnflag AS modality, l_linestatus AS line_status, l_shipdate AS mtime FROM lineitem)",
    "series": "series AS (SELECT l_orderkey || '.' || l_suppkey AS series_uid, l_orderkey::VARCHAR AS study_uid, s_name AS series_description, count(*) AS instance_count FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_orderkey, l_suppkey, s_name)",
    "rt": "rt AS (SELECT 'RT.' || x AS rt_id, CASE WHEN l_suppkey % 7 <> 0 THEN x END AS series_uid, 'R.' || l_orderkey AS rt_study_uid, 'RT.' || x AS rt_series_uid, 'RT.' || x || '.1' AS rt_sop_uid, CASE WHEN l_suppkey % 3 = 0 THEN '1.2.3' END AS rt_sop_class_uid, CASE WHEN l_suppkey % 5 <> 0 THEN '/rt/' || x || '.dcm' END AS rt_path, CASE WHEN l_orderkey % 2 = 0 THEN created::DATE END AS reviewed, CASE WHEN l_orderkey % 4 = 0 THEN (l_orderkey % 60)::INT END AS minutes, CASE WHEN l_orderkey % 3 = 0 THEN (l_orderkey % 5 + 1)::INT END AS rating, created FROM (SELECT l_orderkey, l_suppkey, l_orderkey || '.' || l_suppkey AS x, min(l_shipdate) AS created FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' GROUP BY ALL))",
    "voi": "voi AS (SELECT 'RT.' || l_orderkey || '.' || l_suppkey AS rt_id, p_name AS volume_name, max(p_brand) AS modification, list_sort(list(DISTINCT p_type)) AS modification_types FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_orderkey % 11 <> 0 GROUP BY 1, 2)",
}


def cte(*names: str) -> str:
    return "WITH " + ", ".join(SQL[n] for n in names) + " "
