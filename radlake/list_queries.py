"""Queries of lists, checks and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import catalog as C
from .operators import lists as L
from .operators import reports as R
from .registry import query
from .sources import tables as T
from .sources.tables import cte

# --- checks -------------------------------------------------------------------------------

_NODES = "WITH n AS (SELECT s_suppkey AS node, s_suppkey % 3 <> 1 AS e, s_suppkey % 8 = 0 AS p, s_suppkey % 3 = 0 AS f, CASE WHEN s_suppkey % 5 > 0 THEN s_suppkey % 40 END AS pr FROM supplier), w AS (SELECT count(*) FILTER (e) AS es, count(*) FILTER (p) AS ps FROM n), t AS (SELECT pr, count(*) AS c FROM n WHERE f AND pr IS NOT NULL GROUP BY 1) "


@query(_NODES + """SELECT node, unnest(list_filter([CASE WHEN e AND es > 1 THEN 'another_destination' END, CASE WHEN (p OR f) AND NOT e THEN 'not_a_destination' END, CASE WHEN p AND f THEN 'primary_and_fallback' END, CASE WHEN f AND ps - p::INT < 1 THEN 'no_primary' END,
CASE WHEN f AND pr IS NULL THEN 'no_priority' END, CASE WHEN NOT f AND pr IS NOT NULL THEN 'priority_without_fallback' END, CASE WHEN f AND c > 1 THEN 'priority_taken' END], lambda x: x IS NOT NULL)) AS error FROM n LEFT JOIN t USING (pr), w""")
def destination_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    nodes = T.table(spark, sf_dir, "supplier").select(s.alias("node"), (s % 3 != 1).alias("is_export"), (s % 8 == 0).alias("is_primary"), (s % 3 == 0).alias("is_fallback"), F.when(s % 5 > 0, s % 40).alias("priority"))
    return L.destination_errors(nodes)


@query("""SELECT c_custkey, CASE WHEN i AND (f OR m OR g) THEN 'bidirectional' WHEN i THEN 'incoming' WHEN f OR m OR g THEN 'outgoing' ELSE 'unconfigured' END AS kind,
coalesce(nullif(array_to_string(list_filter([CASE WHEN i THEN 'C-STORE (receive)' END, CASE WHEN f THEN 'C-FIND' END, CASE WHEN m THEN 'C-MOVE' END, CASE WHEN g THEN 'C-GET' END], lambda x: x IS NOT NULL), ', '), ''), 'No capabilities configured') AS can
FROM (SELECT c_custkey, c_custkey % 2 = 0 AS i, c_custkey % 3 = 0 AS f, c_custkey % 5 = 0 AS m, c_custkey % 7 = 0 AS g FROM customer)""")
def node_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = [F.col("c_custkey") % k == 0 for k in (2, 3, 5, 7)]
    return T.table(spark, sf_dir, "customer").select("c_custkey", L.node_kind(flags[0], flags[1:]).alias("kind"), L.capabilities(*flags).alias("can"))


@query("""SELECT c_custkey AS config, unnest(list_filter([CASE WHEN c_custkey % 2 = 0 THEN 'title' END, CASE WHEN c_custkey % 3 = 0 THEN 'address' END, CASE WHEN c_custkey % 5 = 0 THEN 'service' END, CASE WHEN c_custkey % 7 = 0 THEN 'syntax' END], lambda x: x IS NOT NULL)) AS error FROM customer""")
def server_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    configs = T.table(spark, sf_dir, "customer").select(
        k.alias("config"), F.when(k % 2 == 0, "A_TITLE_THAT_IS_LONG").otherwise("SHORT").alias("ae_title"), (k % 4 != 1).alias("check_ips") | (k % 3 == 0).alias("x"),
        F.when(k % 3 == 0, "10.0.0.1, 10.0.0").otherwise("10.0.0.1/8,1.2.3.4").alias("allowed_ips"), *[(k % 5 > n).alias(f"s{n}") for n in range(2)], *[(k % 7 > n).alias(f"t{n}") for n in range(3)],
    )
    configs = configs.toDF("config", "ae_title", "check_ips", "allowed_ips", "s0", "s1", "t0", "t1", "t2")
    return L.server_errors(configs, ["s0", "s1"], ["t0", "t1", "t2"])


@query("SELECT p_partkey, concat_ws(',', CASE WHEN p_size % 2 = 0 THEN 'PatientID' END, CASE WHEN p_size % 3 = 0 THEN 'StudyInstanceUID' END, 'SOPInstanceUID') AS missing FROM part")
def missing_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    tags = F.create_map(F.lit("PatientID"), F.when(size % 2 > 0, "p"), F.lit("StudyInstanceUID"), F.when(size % 3 > 0, "s"), F.lit("SeriesInstanceUID"), F.lit(""))
    return T.table(spark, sf_dir, "part").select("p_partkey", F.array_join(L.missing_tags(tags, L.REQUIRED), ",").alias("missing"))


@query("""WITH w AS (SELECT p_partkey, p_type AS template, upper(p_name) AS label FROM part), e AS (SELECT p_type AS template, lower(p_name) AS l, 'additional' AS s FROM part WHERE p_partkey % 9 = 0 UNION ALL SELECT p_type, lower(p_name), 'property' FROM part WHERE p_partkey % 11 = 0 UNION ALL SELECT p_type, lower(p_name), 'structure' FROM part WHERE p_partkey % 7 = 0)
SELECT p_partkey, template, label, (SELECT min(s) FROM e WHERE e.template = w.template AND l = lower(label)) AS source FROM w WHERE EXISTS (SELECT 1 FROM e WHERE e.template = w.template AND l = lower(label))""")
def taken_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("template"), F.col("p_name").alias("label"))
    some = lambda n: p.filter(F.col("p_partkey") % n == 0).select("template", "label")
    return L.taken_labels(p.withColumn("label", F.upper("label")), some(9), some(11), some(7))


@query(cte("series", "instance") + """, a AS (SELECT CASE WHEN o_orderkey % 17 = 0 THEN '' WHEN o_orderkey % 19 = 0 THEN 'none' ELSE x END AS series_uid, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderkey % 12 END AS template_id FROM (SELECT o_orderkey, min(series_uid) AS x FROM orders JOIN series ON study_uid = o_orderkey::VARCHAR GROUP BY 1)),
f AS (SELECT series_uid, count(*) AS n, count(*) FILTER (part % 23 > 0) AS k FROM instance GROUP BY 1)
SELECT a.series_uid, template_id, CASE WHEN a.series_uid = '' THEN 'no_series_uid' WHEN template_id IS NULL THEN 'no_template_id' WHEN a.series_uid = 'none' THEN 'unknown_series' WHEN template_id >= 10 THEN 'unknown_template' WHEN template_id = 9 THEN 'no_models' WHEN template_id = 8 THEN 'no_structures' WHEN k < n THEN 'missing_files' END AS error FROM a LEFT JOIN f ON f.series_uid = a.series_uid""")
def selection_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, series, files = T.table(spark, sf_dir, "orders"), T.series(spark, sf_dir), T.instances(spark, sf_dir)
    first = series.groupBy(F.col("study_uid").alias("s")).agg(F.min("series_uid").alias("x"))
    k = F.col("o_orderkey")
    asked = o.join(first, k.cast("string") == F.col("s")).select(F.when(k % 17 == 0, "").when(k % 19 == 0, "none").otherwise(F.col("x")).alias("series_uid"), F.when(k % 13 != 0, k % 12).alias("template_id"))
    templates = spark.range(10).withColumnRenamed("id", "template_id")
    models = spark.range(18).select(F.col("id").alias("model_id"), F.floor(F.col("id") / 2).alias("template_id"))
    structures = spark.range(17).select(F.col("id").alias("model_id"))
    there = files.filter("part % 23 > 0").select("path")
    return L.selection_errors(asked, series, templates, models, structures, files.select("series_uid", "path"), there)


@query("""SELECT event_id, '' AS patient_id, 'n' || user_id AS patient_name, event_type AS modality, CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%d') END AS study_date, CASE WHEN event_id % 3 > 0 THEN (event_id % 3)::INT END AS number_of_instances FROM events""")
def captured_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best effort: dates and numbers that can't be read are null."""
    e, k = T.transactions(spark, sf_dir), F.col("event_id")
    tags = F.map_filter(F.create_map(
        F.lit("PatientName"), F.concat(F.lit("n"), F.col("ae").cast("string")), F.lit("Modality"), F.col("kind"), F.lit("StudyDate"), F.when(k % 2 == 0, F.date_format("ts", "yyyyMMdd")).otherwise("2024"),
        F.lit("NumberOfSeriesRelatedInstances"), F.when(k % 3 == 1, "1").when(k % 3 == 0, "many"), F.lit("NumberOfStudyRelatedInstances"), F.lit("2"),
    ), lambda n, v: v.isNotNull())
    out = L.captured(e.select("event_id", tags.alias("tags")))
    return out.select("event_id", "patient_id", "patient_name", "modality", F.col("study_date").cast("string").alias("study_date"), "number_of_instances")


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'SENT_TO_DRAW_SERVER' WHEN 3 THEN 'RTSTRUCTURE_EXPORTED' ELSE 'UNPROCESSED' END AS status FROM orders")
def cancelled_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, ("SENT_TO_DRAW_SERVER", "RULE_MATCHED", "DEIDENTIFICATION_FAILED", "RTSTRUCTURE_EXPORTED"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return T.table(spark, sf_dir, "orders").select("o_orderkey", L.cancelled(status).alias("status"))


# --- lists ------------------------------------------------------------------------------------


@query("""SELECT p_partkey AS id, p_name || ' of the left side_L' AS name, CASE WHEN length(p_name || ' of the left side_L') > 16 THEN (p_name || ' of the left side')[1:14] || '_L' END AS short_name FROM part WHERE p_partkey % 3 <> 0""")
def unmapped_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" of the left side_L")).alias("name"))
    return L.unmapped_structures(p, p.filter("id % 3 = 0"))


@query("""WITH c AS (SELECT p_partkey AS place, p_type AS template, CASE p_partkey % 7 WHEN 0 THEN ' ' WHEN 1 THEN p_name || ' is much too long' ELSE CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name || ' ' END END AS label FROM part),
b AS (SELECT *, CASE WHEN trim(label) = '' THEN 'required' WHEN length(trim(label)) > 16 THEN 'length' END AS bad FROM c)
SELECT place, template, label, CASE WHEN bad IS NOT NULL THEN bad WHEN row_number() OVER (PARTITION BY template, bad IS NULL, lower(trim(label)) ORDER BY place) > 1 THEN 'duplicate' END AS error FROM b""")
def label_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    label = F.when(k % 7 == 0, " ").when(k % 7 == 1, F.concat("p_name", F.lit(" is much too long"))).when(k % 2 == 0, F.upper("p_name")).otherwise(F.concat("p_name", F.lit(" ")))
    return L.label_errors(T.table(spark, sf_dir, "part").select(k.alias("place"), F.col("p_type").alias("template"), label.alias("label")))


@query(cte("rt", "voi") + """, g AS (SELECT DISTINCT series_uid FROM rt WHERE series_uid LIKE '%1'), f AS (SELECT series_uid, arg_min(rt_id, (created, rt_id)) AS rt_id FROM rt JOIN g USING (series_uid) GROUP BY 1)
SELECT voi.rt_id, volume_name, CASE WHEN f.rt_id IS NOT NULL AND volume_name = 'red bolt' THEN 'changed' ELSE modification END AS modification FROM voi LEFT JOIN f USING (rt_id) UNION ALL
SELECT rt_id, v, 'changed' FROM f, (VALUES ('red bolt'), ('new one')) t(v) WHERE NOT EXISTS (SELECT 1 FROM voi WHERE voi.rt_id = f.rt_id AND volume_name = v)""")
def rating_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    imports = T.structure_imports(spark, sf_dir).withColumn("assessor", F.lit(None).cast("string"))
    one = lambda n: F.struct(F.lit(n).alias("volume_name"), F.lit("changed").alias("modification"), F.array(F.lit("x")).alias("modification_types"))
    ratings = imports.filter("series_uid LIKE '%1'").select("series_uid").distinct().withColumns({"minutes": F.lit(3), "rating": F.lit(4), "volumes": F.array(one("red bolt"), one("new one"))})
    return L.rated(imports, T.vois(spark, sf_dir), ratings, "me", F.lit("2024-01-01").cast("date"))[1].select("rt_id", "volume_name", "modification")


@query(cte("rt") + """, f AS (SELECT series_uid, arg_min(rt_id, (created, rt_id)) AS rt_id FROM rt WHERE series_uid LIKE '%1' GROUP BY 1)
SELECT rt.rt_id, CASE WHEN f.rt_id IS NOT NULL THEN 3 ELSE minutes END AS minutes, CASE WHEN f.rt_id IS NOT NULL THEN 4 ELSE rating END AS rating, CASE WHEN f.rt_id IS NOT NULL THEN 'me' END AS assessor, (CASE WHEN f.rt_id IS NOT NULL THEN DATE '2024-01-01' ELSE reviewed END)::VARCHAR AS reviewed FROM rt LEFT JOIN f ON f.rt_id = rt.rt_id""")
def rating_upsert_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    imports = T.structure_imports(spark, sf_dir).withColumn("assessor", F.lit(None).cast("string"))
    one = F.struct(F.lit("red bolt").alias("volume_name"), F.lit("changed").alias("modification"), F.array(F.lit("x")).alias("modification_types"))
    ratings = imports.filter("series_uid LIKE '%1'").select("series_uid").distinct().withColumns({"minutes": F.lit(3), "rating": F.lit(4), "volumes": F.array(one)})
    out = L.rated(imports, T.vois(spark, sf_dir), ratings, "me", F.lit("2024-01-01").cast("date"))[0]
    return out.select("rt_id", "minutes", "rating", "assessor", F.col("reviewed").cast("string").alias("reviewed"))


@query(cte("instance") + """SELECT series_uid, 1::BIGINT * count(*) FILTER (part % 2 = 0) + CASE WHEN count(*) FILTER (part % 2 = 0) = 0 THEN 99 ELSE 0 END AS instance_count FROM instance GROUP BY 1""")
def instance_count_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch that is read again makes its own count the series' count."""
    i = T.instances(spark, sf_dir)
    series = i.select("series_uid").distinct().withColumn("instance_count", F.lit(99).cast("long"))
    return L.instance_counts(series, i.filter("part % 2 = 0"), i)


@query(cte("series", "instance") + "SELECT series_uid, arg_min(path, (sop_uid, path)) AS path FROM instance JOIN series USING (series_uid) WHERE instance_count > 1 AND series_description LIKE '%2' GROUP BY 1")
def series_to_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = T.series(spark, sf_dir).select("series_uid", (F.col("instance_count") > 1).alias("fully_read"), F.when(F.col("series_description").endswith("2"), "UNPROCESSED").otherwise("RULE_MATCHED").alias("status"))
    return L.to_match(s, T.instances(spark, sf_dir).select("series_uid", "path", F.struct("sop_uid", "path").alias("place")))


@query(cte("patient", "study", "series", "rt") + """, n AS (SELECT series_uid, count(*) AS n FROM rt WHERE rt_path IS NOT NULL GROUP BY 1) SELECT series_uid, patient_id, CASE WHEN gender = 'BUILDING' THEN 'N/A' ELSE patient_name END AS patient_name, series_description, modality, instance_count, coalesce(n, 0) AS n_structures
FROM series JOIN study USING (study_uid) JOIN patient USING (patient_id) LEFT JOIN n USING (series_uid) WHERE series_uid LIKE '%9'""")
def export_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = T.series(spark, sf_dir).join(T.studies(spark, sf_dir), "study_uid").join(T.patients(spark, sf_dir), "patient_id")
    s = s.withColumn("patient_name", F.when(F.col("gender") == "BUILDING", "").otherwise(F.col("patient_name")))
    asked = s.filter("series_uid LIKE '%9'").select("series_uid").union(spark.createDataFrame([("unknown",)], "series_uid string"))
    return L.export_details(asked, s, T.structure_imports(spark, sf_dir))


@query(cte("series") + """SELECT series_uid, '***FIELD_MASKED***' AS patient_name, 'RULE_MATCHED' AS status, 'T' || (instance_count % 3) || ',U' AS templates, CASE WHEN instance_count > 1 THEN 'PENDING' END AS transfer_status, CASE WHEN instance_count > 1 THEN 't' || series_uid END AS task_id, NULL::VARCHAR AS error FROM series WHERE series_uid LIKE '1%'
UNION ALL SELECT 'unknown', NULL, NULL, NULL, NULL, NULL, 'Series not found'""")
def selection_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = T.series(spark, sf_dir)
    asked = s.filter("series_uid LIKE '1%'").select("series_uid").union(spark.createDataFrame([("unknown",)], "series_uid string"))
    templates = s.select("series_uid", F.explode(F.array(F.concat(F.lit("T"), (F.col("instance_count") % 3).cast("string")), F.lit("U"))).alias("template_name"))
    exports = s.filter("instance_count > 1").select("series_uid", F.lit("PENDING").alias("transfer_status"), F.concat(F.lit("t"), "series_uid").alias("task_id"))
    out = L.selection_status(asked, s.select("series_uid", F.lit("name").alias("patient_name"), F.lit("RULE_MATCHED").alias("status")), templates, exports)
    return out.withColumn("templates", F.array_join("templates", ","))


@query("SELECT max(ts)::VARCHAR AS last_run, '2024-05-01 11:30:00' AS never FROM events")
def last_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = T.transactions(spark, sf_dir).select(F.col("ts").alias("created"))
    as_of = F.lit("2024-05-01 12:00:00").cast("timestamp_ntz")
    text = lambda df, n: df.select(F.col("last_run").cast("string").alias(n))
    return text(L.last_run(s, as_of), "last_run").crossJoin(text(L.last_run(s.limit(0), as_of), "never"))  # one row each


@query("SELECT CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_name END AS value, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_name END AS label, p_type AS model FROM part")
def available_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = T.table(spark, sf_dir, "part").select(F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).when(F.col("p_size") % 3 == 0, "").alias("roi_label"), F.col("p_name").alias("name"), F.col("p_type").alias("model"))
    return L.available_structures(part)


@query("SELECT event_id FROM events WHERE user_id = 7 AND event_type = 'view'")
def query_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.transactions(spark, sf_dir).select("event_id", F.col("ae").cast("string").alias("user"), F.col("kind").alias("status"))
    return L.history(e, "7", "view").select("event_id")


@query("""SELECT event_id, CASE WHEN ts < TIMESTAMP '2024-01-28' - INTERVAL 20 DAY THEN 'delete' WHEN ts < TIMESTAMP '2024-01-28' - INTERVAL 7 DAY AND event_id % 2 = 0 THEN 'compress' ELSE 'keep' END AS action FROM events WHERE event_id % 3 > 0 OR event_id % 2 > 0""")
def retained_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ages: deleted, and compressed."""
    k = F.col("event_id")
    files = T.transactions(spark, sf_dir).select(k, F.col("ts").alias("mtime"), F.concat(F.lit("/logs/a.log"), F.when(k % 3 > 0, ".1").otherwise(""), F.when(k % 2 > 0, ".gz").otherwise("")).alias("path"))
    return L.retained(files, F.lit("2024-01-28").cast("timestamp_ntz"), 20, 7).select("event_id", "action")


@query("""SELECT event_id, event_id % 4 = 0 OR ts < TIMESTAMP '2024-01-20' - INTERVAL 30 MINUTE AS stale, CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'http://x/' ELSE 'http://x/y/' END AS url,
event_id % 3 = 1 AS refused FROM events""")
def stale_caches(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    url = F.when(k % 3 == 0, "").when(k % 3 == 1, "http://x").otherwise("http://x/y//")
    return T.transactions(spark, sf_dir).select(k, L.stale(F.when(k % 4 > 0, F.col("ts")), F.lit("2024-01-20").cast("timestamp_ntz")).alias("stale"), L.with_slash(url).alias("url"), L.url_error(url).isNotNull().alias("refused"))


@query("""WITH f AS (SELECT event_id, ts, CAST(round(value * 100) AS BIGINT) AS size FROM events), u AS (SELECT count(*) AS n, sum(size) AS used FROM f), g AS (SELECT size FROM (SELECT *, sum(size) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS freed FROM f) WHERE freed - size < 300000)
SELECT n - (SELECT count(*) FROM g) AS n_files, (used - (SELECT sum(size) FROM g))::BIGINT AS used, used - (SELECT sum(size) FROM g) >= 1500000 AS exceeded, (SELECT count(*) FROM g) AS deleted, (SELECT sum(size) FROM g)::BIGINT AS freed FROM u""")
def storage_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store is above its limit: the clean-up frees a fifth of the limit, oldest files first, and the flag is set anew."""
    limit = 1_500_000
    files = T.transactions(spark, sf_dir).withColumn("size", F.round(F.col("bytes") * 100).cast("long"))
    checked = L.storage_check(files.agg(F.count("*").alias("n_files"), F.sum("size").alias("used")), limit, cleanup=True, least=0.0)
    to_free = checked.head().to_free  # one row
    deleted = C.until_freed(files, "size", ["ts", "event_id"], to_free) if to_free is not None else files.limit(0)
    return L.after_cleanup(checked, deleted, limit)


@query("""SELECT kind AS name, CASE WHEN event_id % 2 = 0 THEN 'idle' WHEN ts < TIMESTAMP '2024-01-30 23:00:00' - INTERVAL 180 MINUTE THEN 'stale' ELSE 'running' END AS state FROM (SELECT user_id::VARCHAR AS kind, max(ts) AS ts, arg_max(event_id, ts) AS event_id FROM events GROUP BY 1)""")
def chain_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = T.transactions(spark, sf_dir).select(F.col("ae").cast("string").alias("name"), F.col("ts").alias("started"), F.when(F.col("event_id") % 2 == 0, F.col("ts")).alias("finished"))
    return L.chain_status(runs, F.lit("2024-01-30 23:00:00").cast("timestamp_ntz"))


@query(cte("rt", "voi") + """SELECT 'SOP' || rt_id AS rt_id, (row_number() OVER (PARTITION BY rt_id ORDER BY volume_name))::INT AS roi_number, volume_name AS roi_name, NULL::DOUBLE AS volume FROM voi WHERE rt_id NOT LIKE '%3'""")
def structure_registration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volumes of the files that are new; a SOP UID that is known keeps its set."""
    v = T.vois(spark, sf_dir).withColumn("number", F.row_number().over(R.W.partitionBy("rt_id").orderBy("volume_name")))
    files = v.groupBy(F.concat(F.lit("SOP"), "rt_id").alias("sop_uid")).agg(F.collect_list(F.struct("number", F.col("volume_name").alias("name"))).alias("rois")).withColumn("label", F.lit("new"))
    known = files.filter("sop_uid LIKE '%3'").select("sop_uid", F.lit("old").alias("label"))
    return L.registered(files, known)[1]


@query("""SELECT '1d 2h 3m' AS uptime, count(*) AS files, sum(CAST(round(value * 100) AS BIGINT))::DOUBLE AS bytes, sum(CAST(round(value * 100) AS BIGINT))::DOUBLE / count(*) / 1048576 AS average_mb, sum(CAST(round(value * 100) AS BIGINT))::DOUBLE * 100 / 1e9 AS percent, count(*) AS transactions, count(*) FILTER (event_type = 'error') AS failures FROM events""")
def service_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.transactions(spark, sf_dir)
    files = e.select(F.round(F.col("bytes") * 100).cast("long").cast("double").alias("size"))
    stamp = lambda s: F.lit(s).cast("timestamp_ntz")
    return L.service_status(e.select(F.when(F.col("kind") == "error", "FAILURE").otherwise("SUCCESS").alias("status")), files, stamp("2024-01-01 00:00:00"), stamp("2024-01-02 02:03:04"), 1e9)


# --- reports ----------------------------------------------------------------------------------

_COUNTERS = [
    ("unique_patients", "customer", "c_acctbal > 5000"), ("unique_dicom_studies", "orders", "true"), ("unique_dicom_series", "lineitem", "true"), ("unique_dicom_instances", "lineitem", "true"), ("rt_struct_files_downloaded", "lineitem", "l_returnflag = 'R'"),
    ("series_with_matching_rulesets", "lineitem", "l_quantity > 10"), ("series_with_failed_segmentation", "orders", "o_orderstatus = 'F'"), ("series_with_failed_deidentification", "orders", "o_orderstatus = 'P'"), ("series_with_failed_export", "lineitem", "l_linestatus = 'F'"),
    ("series_exported_successfully", "lineitem", "l_linestatus = 'O'"), ("series_completing_segmentation", "orders", "o_orderstatus = 'O'"),
]
_TIME = {"customer": "TIMESTAMP '1997-07-01'", "orders": "o_orderdate", "lineitem": "l_shipdate"}


@query(" UNION ALL ".join(f"SELECT '{n}_since_last_run' AS parameter_name, (SELECT count(*) FROM {t} WHERE {_TIME[t]} > TIMESTAMP '1997-06-01' AND {c})::VARCHAR AS parameter_value" for n, t, c in _COUNTERS))
def stats_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eleven counters since the last run, one pass over each table."""
    tables = {t: T.table(spark, sf_dir, t).withColumn("_at", F.expr(_TIME[t]).cast("timestamp_ntz")) for t in _TIME}
    return R.counters(tables, F.lit("1997-06-01").cast("timestamp_ntz"), {f"{n}_since_last_run": (t, F.expr(c), "_at") for n, t, c in _COUNTERS})


@query("SELECT count(*) AS total, count(*) FILTER (o_orderpriority[1:1] IN ('1', '2')) AS in_progress, count(*) FILTER (o_orderpriority[1:1] = '3') AS completed, count(*) FILTER (o_orderpriority[1:1] = '5') AS failed FROM orders")
def status_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = T.table(spark, sf_dir, "orders").withColumn("status", F.substring("o_orderpriority", 1, 1))
    return R.buckets(o, "status", {"in_progress": ["1", "2"], "completed": ["3"], "failed": ["5"]})


@query("SELECT DISTINCT source FROM documents WHERE source IS NOT NULL AND source <> ''")
def choice_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.choices(T.table(spark, sf_dir, "documents"), "source")


@query(cte("series", "rt") + ", n AS (SELECT series_uid, count(*) AS n, count(reviewed) AS r FROM rt GROUP BY 1) SELECT series_uid, coalesce(n, 0) AS n_structures, coalesce(r, 0) AS n_rated FROM series LEFT JOIN n USING (series_uid)")
def structure_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.structure_counts(T.series(spark, sf_dir).select("series_uid"), T.structure_imports(spark, sf_dir))


@query(cte("rt", "voi") + ", n AS (SELECT rt_id, count(*) AS n FROM voi GROUP BY 1) SELECT rt_id, coalesce(n, 0) AS voi_count, reviewed IS NOT NULL OR minutes IS NOT NULL OR rating IS NOT NULL AS has_rating FROM rt LEFT JOIN n USING (rt_id)")
def rated_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rt = T.structure_imports(spark, sf_dir)
    n = R.counts_per(rt, T.vois(spark, sf_dir), "rt_id", "volume_name", "voi_count")
    return n.select("rt_id", "voi_count", R.has_rating().alias("has_rating"))


@query(cte("patient", "study", "series", "rt", "voi") + """, v AS (SELECT rt_id, list(volume_name ORDER BY volume_name) AS vois FROM voi GROUP BY 1), q AS (SELECT series_uid, list({'rt_id': rt_id, 'voi_count': coalesce(len(vois), 0), 'has_rating': reviewed IS NOT NULL OR minutes IS NOT NULL OR rating IS NOT NULL} ORDER BY rt_id) AS structures FROM rt LEFT JOIN v USING (rt_id) GROUP BY 1)
SELECT patient_id, count(DISTINCT study_uid) AS n_studies, count(series_uid) AS n_series, coalesce(sum(len(structures)), 0)::BIGINT AS n_structures, coalesce(sum(list_sum(list_transform(structures, lambda x: x.voi_count))), 0)::BIGINT AS n_vois, coalesce(sum(len(list_filter(structures, lambda x: x.has_rating))), 0)::BIGINT AS n_rated
FROM patient LEFT JOIN study USING (patient_id) LEFT JOIN series USING (study_uid) LEFT JOIN q USING (series_uid) GROUP BY 1""")
def patient_document_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five levels of every patient's document, counted in the document itself."""
    docs = R.patient_documents(T.patients(spark, sf_dir), T.studies(spark, sf_dir), T.series(spark, sf_dir), T.structure_imports(spark, sf_dir), T.vois(spark, sf_dir))
    schema = "studies array<struct<study_uid:string,series:array<struct<series_uid:string,structures:array<struct<rt_id:string,voi_count:long,has_rating:boolean,vois:array<struct<volume_name:string>>>>>>>>"
    d = docs.select("patient_id", F.from_json("document", schema).alias("d"))
    flat = lambda a, field: F.flatten(F.transform(a, lambda x: F.coalesce(x[field], F.array())))
    series = flat(F.coalesce(F.col("d.studies"), F.array()), "series")
    structures = flat(series, "structures")
    return d.select(
        "patient_id", F.size(F.coalesce("d.studies", F.array())).cast("long").alias("n_studies"), F.size(series).cast("long").alias("n_series"), F.size(structures).cast("long").alias("n_structures"),
        F.size(flat(structures, "vois")).cast("long").alias("n_vois"), F.size(F.filter(structures, lambda x: x["has_rating"])).cast("long").alias("n_rated"),
    )


@query(cte("patient", "study", "series", "rt", "voi") + """SELECT patient_id, patient_name AS name, gender, '' AS date_of_birth, series_uid AS series_instance_uid, strftime(reviewed, '%Y-%m-%d') AS date_contour_reviewed, coalesce(nullif(minutes::VARCHAR, '0'), '') AS contour_modification_time_required, '' AS assessor_name, coalesce(rating::VARCHAR, '') AS overall_rating,
coalesce(volume_name, '') AS volume_name, coalesce(modification, '') AS contour_modification, coalesce(array_to_string(modification_types, ', '), '') AS contour_modification_type, '' AS contour_modification_comments FROM rt JOIN series USING (series_uid) JOIN study USING (study_uid) JOIN patient USING (patient_id) LEFT JOIN voi USING (rt_id) WHERE reviewed IS NOT NULL""")
def ratings_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = T.series(spark, sf_dir).join(T.studies(spark, sf_dir), "study_uid").join(T.patients(spark, sf_dir), "patient_id")
    return R.ratings_export(T.structure_imports(spark, sf_dir), T.vois(spark, sf_dir), s)


@query("""WITH s AS (SELECT p_type, p_brand, p_size::VARCHAR AS k, max(p_name) AS nm FROM part GROUP BY ALL), m AS (SELECT p_type AS template_id, p_brand, count(*) AS n, string_agg(k || '=' || nm, ',' ORDER BY k) AS names FROM s GROUP BY 1, 2)
SELECT template_id, count(*) AS n_models, sum(n)::BIGINT AS n_maps, string_agg(template_id || '/' || p_brand || ':' || p_brand || '[' || names || ']', ';' ORDER BY template_id || '/' || p_brand) AS models FROM m GROUP BY 1""")
def template_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates as nested documents, read again and shown."""
    p = T.table(spark, sf_dir, "part")
    model = F.concat_ws("/", "p_type", "p_brand").alias("model_id")
    models = p.select(F.col("p_type").alias("template_id"), model, F.col("p_brand").alias("name")).distinct().withColumns({c: F.lit("x") for c in ("config", "trainer_name", "postprocess")})
    docs = R.template_documents(p.select(F.col("p_type").alias("template_id"), F.col("p_type").alias("template_name")).distinct(), models, p.select(model, F.col("p_size").alias("map_id"), F.col("p_name").alias("name")))
    read = docs.select("template_id", F.from_json("document", "name string, protocol string, models map<string,struct<name:string,map:map<string,string>>>").alias("d")).filter("d.protocol = 'DRAW' AND d.name = template_id")
    maps = F.aggregate(F.map_values("d.models"), F.lit(0), lambda a, m: a + F.size(m["map"]))
    names = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m["value"]["map"])), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    shown = F.array_join(F.transform(F.array_sort(F.transform(F.map_entries("d.models"), lambda m: F.struct(m["key"].alias("key"), m["value"]["name"].alias("name"), names(m).alias("names")))), lambda m: F.concat(m["key"], F.lit(":"), m["name"], F.lit("["), m["names"], F.lit("]"))), ";")
    return read.select("template_id", F.size("d.models").cast("long").alias("n_models"), maps.cast("long").alias("n_maps"), shown.alias("models"))


@query("SELECT r_regionkey, coalesce(n, 0) AS n_children, coalesce(c, 0) AS n_grandchildren FROM region LEFT JOIN (SELECT n_regionkey, count(*) AS n, sum(k)::BIGINT AS c FROM (SELECT n_regionkey, n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS k FROM nation WHERE n_regionkey <> 3) GROUP BY 1) ON n_regionkey = r_regionkey")
def group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups with their rule sets and rules, counted apart: regions, nations, customers."""
    nations = T.table(spark, sf_dir, "nation").filter("n_regionkey <> 3").select(F.col("n_regionkey").alias("r_regionkey"), F.col("n_nationkey").alias("k"))
    return R.hierarchy_counts(T.table(spark, sf_dir, "region").select("r_regionkey"), nations, T.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), "r_regionkey", "k")


_BRIDGE = cte("instance") + ", b AS (SELECT DISTINCT series_uid, part % 9 AS rule_set FROM instance), g AS (SELECT range AS rule_set, 'G' || (range % 4) AS group_name FROM range(9)) "


def _bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = spark.range(9).select(F.col("id").alias("rule_set"), F.concat(F.lit("G"), (F.col("id") % 4).cast("string")).alias("group_name"))
    return T.instances(spark, sf_dir).select("series_uid", (F.col("part") % 9).alias("rule_set")).distinct().join(sets, "rule_set")


@query(_BRIDGE + "SELECT series_uid, string_agg(DISTINCT group_name, ', ' ORDER BY group_name) AS groups FROM b JOIN g USING (rule_set) GROUP BY 1")
def bridge_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names at the other end of a many-to-many relation, each once."""
    return _bridge(spark, sf_dir).groupBy("series_uid").agg(F.array_join(F.array_sort(F.collect_set("group_name")), ", ").alias("groups"))


@query(_BRIDGE + "SELECT series_uid, group_name FROM b JOIN g USING (rule_set) WHERE group_name = 'G0'")
def bridge_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter through the relation keeps its repeats: one row for each rule set of the group."""
    return _bridge(spark, sf_dir).filter("group_name = 'G0'").select("series_uid", "group_name")


@query("SELECT user_id AS ae, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k <= 3")
def tail_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.tail(T.transactions(spark, sf_dir), "ae", "event_id", 3).select("ae", "event_id")


@query(cte("instance") + "SELECT series_uid, path, (row_number() OVER (PARTITION BY series_uid ORDER BY coalesce(CASE WHEN part % 3 > 0 THEN instance_number END, 0), coalesce(slice_thickness, 0), coalesce(size, 0), path) - 1)::BIGINT AS slice_index FROM instance")
def slice_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = T.instances(spark, sf_dir).select("series_uid", "path", F.when(F.col("part") % 3 > 0, F.col("instance_number")).alias("instance_number"), F.col("slice_thickness").alias("slice_location"), F.col("size").alias("z"))
    return R.slice_order(i).select("series_uid", "path", F.col("slice_index").cast("long").alias("slice_index"))


@query("""SELECT source, count(*) AS n_files, sum(strlen(text))::BIGINT AS n_bytes FROM documents GROUP BY 1""")
def file_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and bytes of each folder."""
    return T.table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n_files"), F.sum(F.octet_length("text")).alias("n_bytes"))


@query("SELECT p_partkey FROM part WHERE (contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'ring') OR contains(lower(p_type), 'ring')) AND lower(p_type) = 'promo'")
def catalog_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text in any of several fields, and categories that are equal without case."""
    found = L.search(T.table(spark, sf_dir, "part"), ["p_name", "p_brand", "p_type"], "RING")
    return found.filter(F.lower("p_type") == "PROMO".lower()).select("p_partkey")
