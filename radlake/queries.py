"""Queries over the driver's tables for every operator family, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalar as S
from .functions import vr as VR
from .operators import catalog as C
from .operators import cfind as Q
from .operators import deid as D
from .operators import kernels as K
from .operators import lines as LI
from .operators import lists as L
from .operators import reports as R
from .operators import rules as RU
from .operators import voxels as V
from .plans import masks as P
from .registry import ORACLE_SQL, QUERIES, query  # noqa: F401
from .sources import tables as T
from .sources.tables import cte

# --- rule engine ----------------------------------------------------------------------

#: Rules of the queries: set, order, id, tag name, tag id, operator, value, combinator.
RULES = [
    (1, 1, 1, "Modality", "(0008,0060)", "CASE_SENSITIVE_STRING_EXACT_MATCH", "A", "AND"),
    (1, 2, 2, "Study Description", "(0008,1030)", "CASE_INSENSITIVE_STRING_CONTAINS", "urgent", "AND"),
    (2, 1, 3, "Modality", "(0008,0060)", "EQUALS", "R", "AND"),
    (2, 2, 4, "Protocol Name", "(0018,1030)", "CASE_INSENSITIVE_STRING_CONTAINS", "promo", "OR"),
    (3, 1, 5, "Slice Thickness", "(0018,0050)", "GREATER_THAN", "25", "AND"),
    (3, 2, 6, "Slice Thickness", "(0018,0050)", "LESS_THAN_OR_EQUAL_TO", "40", "OR"),
    (3, 3, 7, "Modality", "(0008,0060)", "NOT_EQUALS", "N", "AND"),
    (4, 1, 8, "Body Part Examined", "(0018,0015)", "NOT_EQUALS", "HEAD", "AND"),
]
#: Groups: group, template, set, order of the set, combinator.
GROUPS = [(1, "T1", 1, 1, "OR"), (1, "T1", 2, 2, "OR"), (2, "T2", 3, 1, "AND"), (3, "T3", 4, 1, "AND")]


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "set_id int, rule_order int, rule_id int, tag_name string, tag_id string, operator string, value string, combine string")


def group_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GROUPS, "group_id int, template_id string, set_id int, set_order int, combine string")


def series_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_uid, tags): the tags of the first instance of each series. By study, so that finding the first needs no shuffle of its own."""
    parts = T.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), "p_type")
    studies = T.studies(spark, sf_dir).select("study_uid", "study_description")
    i = T.instances(spark, sf_dir).select("series_uid", "study_uid", "instance_number", "part", "size", "path", "modality", "slice_thickness")
    rows = C.first_wins(i.join(parts, "part").join(studies, "study_uid"), ["study_uid", "series_uid"], ["instance_number", "part", "size", "path"])
    tags = F.create_map(F.lit("Modality"), "modality", F.lit("Slice Thickness"), F.col("slice_thickness").cast("string"), F.lit("Study Description"), "study_description", F.lit("(0018,1030)"), "p_type")
    return rows.select("series_uid", tags.alias("tags"))


FIRST = cte("study", "instance") + """, f AS (SELECT i.series_uid, i.modality, i.slice_thickness, s.study_description, p.p_type,
  row_number() OVER (PARTITION BY i.series_uid ORDER BY instance_number, part, size, path) AS k
  FROM instance i JOIN study s USING (study_uid) JOIN part p ON p.p_partkey = i.part),
t AS (SELECT series_uid, modality = 'A' AND contains(lower(study_description), 'urgent') AS s1, modality = 'R' AND contains(lower(p_type), 'promo') AS s2,
  (slice_thickness > 25 AND slice_thickness <= 40) OR modality <> 'N' AS s3 FROM f WHERE k = 1) """


@query(FIRST + """SELECT series_uid, (s1 OR s2)::INT + s3::INT AS matched_groups,
CASE (s1 OR s2)::INT + s3::INT WHEN 0 THEN 'RULE_NOT_MATCHED' WHEN 1 THEN 'RULE_MATCHED' ELSE 'MULTIPLE_RULES_MATCHED' END AS status FROM t""")
def rule_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched = RU.match(series_tags(spark, sf_dir), rule_table(spark), group_table(spark))
    return RU.assign(matched).withColumn("matched_groups", F.col("matched_groups").cast("int"))


@query(FIRST + "SELECT series_uid, 'T1' AS template_id, s1::BIGINT + s2::BIGINT AS matched_sets FROM t WHERE s1 OR s2 UNION ALL SELECT series_uid, 'T2', 1 FROM t WHERE s3")
def rule_group_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched = RU.match(series_tags(spark, sf_dir), rule_table(spark), group_table(spark))
    return RU.evaluate_groups(matched).filter("result").select("series_uid", "template_id", "matched_sets")


@query(FIRST + "SELECT series_uid, unnest([1, 2, 3, 4]) AS set_id, unnest([s1, s2, s3, false]) AS result FROM t")
def rule_ruleset_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RU.evaluate_sets(series_tags(spark, sf_dir), rule_table(spark))


def _satisfied(spark: SparkSession, sf_dir: str, column: str, cases: list[tuple[str, str]]) -> DataFrame:
    df = T.table(spark, sf_dir, "part").select("p_partkey", F.col(column).cast("string").alias("tag"))
    table = spark.createDataFrame(cases, "operator string, value string")
    return df.join(table, F.lit(True)).select("p_partkey", "operator", "value", RU.satisfied(F.col("operator"), F.col("tag"), F.col("value")).alias("result"))


@query("""SELECT p_partkey, o AS operator, v AS value, CASE o WHEN 'GREATER_THAN' THEN p_size > 25 WHEN 'LESS_THAN' THEN p_size < 10 WHEN 'GREATER_THAN_OR_EQUAL_TO' THEN p_size >= 30
ELSE CASE v WHEN 'abc' THEN false ELSE p_size <= 7.5 END END AS result FROM part, (VALUES ('GREATER_THAN', '25'), ('LESS_THAN', '10'), ('GREATER_THAN_OR_EQUAL_TO', ' 3e1 '), ('LESS_THAN_OR_EQUAL_TO', '7.5'), ('LESS_THAN_OR_EQUAL_TO', 'abc')) t(o, v)""")
def rule_numeric_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _satisfied(spark, sf_dir, "p_size", [("GREATER_THAN", "25"), ("LESS_THAN", "10"), ("GREATER_THAN_OR_EQUAL_TO", " 3e1 "), ("LESS_THAN_OR_EQUAL_TO", "7.5"), ("LESS_THAN_OR_EQUAL_TO", "abc")])


@query("""SELECT p_partkey, o AS operator, v AS value, CASE o WHEN 'EQUALS' THEN p_name = v WHEN 'NOT_EQUALS' THEN p_name <> v WHEN 'CASE_SENSITIVE_STRING_CONTAINS' THEN contains(p_name, v)
WHEN 'CASE_INSENSITIVE_STRING_CONTAINS' THEN contains(lower(p_name), lower(v)) WHEN 'CASE_SENSITIVE_STRING_DOES_NOT_CONTAIN' THEN NOT contains(p_name, v)
WHEN 'CASE_INSENSITIVE_STRING_DOES_NOT_CONTAIN' THEN NOT contains(lower(p_name), lower(v)) WHEN 'CASE_INSENSITIVE_STRING_EXACT_MATCH' THEN lower(p_name) = lower(v) ELSE false END AS result
FROM part, (VALUES ('EQUALS', 'red widget'), ('NOT_EQUALS', 'red widget'), ('CASE_SENSITIVE_STRING_CONTAINS', 'Red'), ('CASE_INSENSITIVE_STRING_CONTAINS', 'RED'), ('CASE_SENSITIVE_STRING_DOES_NOT_CONTAIN', 'bolt'),
('CASE_INSENSITIVE_STRING_DOES_NOT_CONTAIN', 'BOLT'), ('CASE_INSENSITIVE_STRING_EXACT_MATCH', 'Red Widget'), ('NO_SUCH_OPERATOR', 'x')) t(o, v)""")
def rule_string_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [f"CASE_{c}_STRING_{k}" for k in ("CONTAINS", "DOES_NOT_CONTAIN") for c in ("SENSITIVE", "INSENSITIVE")]
    cases = [("EQUALS", "red widget"), ("NOT_EQUALS", "red widget"), *zip(names, ("Red", "RED", "bolt", "BOLT")), ("CASE_INSENSITIVE_STRING_EXACT_MATCH", "Red Widget"), ("NO_SUCH_OPERATOR", "x")]
    return _satisfied(spark, sf_dir, "p_name", cases)


@query(f"""SELECT o AS operator, count(*) AS n, count(*) FILTER (p_size % 2 = 0 AND o NOT IN ('NOT_EQUALS', 'CASE_SENSITIVE_STRING_DOES_NOT_CONTAIN', 'CASE_INSENSITIVE_STRING_DOES_NOT_CONTAIN', 'GREATER_THAN', 'LESS_THAN')) AS n_true
FROM part, (SELECT unnest({sorted(set(VR.NUMERIC_OPERATORS) | set(VR.STRING_OPERATORS))}) AS o) GROUP BY 1""")
def rule_missing_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every operator on tags equal to the rule's value, half of which are missing: a missing tag never meets a rule."""
    size = F.col("p_size").cast("string")
    each = T.table(spark, sf_dir, "part").select(F.explode(F.array(*map(F.lit, sorted(set(VR.NUMERIC_OPERATORS) | set(VR.STRING_OPERATORS))))).alias("operator"), F.when(F.col("p_size") % 2 == 0, size).alias("tag"), size.alias("value"))
    return each.groupBy("operator").agg(F.count("*").alias("n"), F.count_if(RU.satisfied(F.col("operator"), F.col("tag"), F.col("value"))).alias("n_true"))


# --- hierarchical queries -------------------------------------------------------------


@query(cte("patient") + "SELECT patient_id AS \"PatientID\", patient_name AS \"PatientName\" FROM patient WHERE regexp_matches(lower(patient_name), '^customer#0000001.*$') ORDER BY patient_id LIMIT 10000")
def cfind_patient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.find(T.patients(spark, sf_dir), {"patient_name": "customer#0000001*"}, {"patient_id": "PatientID", "patient_name": "PatientName"}, ["patient_id"])


def _study_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = T.series(spark, sf_dir).groupBy("study_uid").agg(F.sum("instance_count").alias("n_instances"))
    return T.studies(spark, sf_dir).join(T.patients(spark, sf_dir), "patient_id").join(counts, "study_uid", "left").withColumn("n_instances", F.coalesce("n_instances", F.lit(0)))


STUDY_FIELDS = {"study_uid": "StudyInstanceUID", "patient_id": "PatientID", "patient_name": "PatientName", "study_date": "StudyDate", "study_description": "StudyDescription", "n_instances": "NumberOfStudyRelatedInstances"}
STUDY_SQL = cte("patient", "study", "series") + """, c AS (SELECT study_uid, sum(instance_count) AS n FROM series GROUP BY study_uid), l AS (SELECT s.*, p.patient_name, coalesce(c.n, 0)::BIGINT AS n FROM study s JOIN patient p USING (patient_id) LEFT JOIN c USING (study_uid))
SELECT study_uid AS "StudyInstanceUID", patient_id AS "PatientID", patient_name AS "PatientName", strftime(study_date, '%Y%m%d') AS "StudyDate", study_description AS "StudyDescription", n::VARCHAR AS "NumberOfStudyRelatedInstances" FROM l """


@query(STUDY_SQL + "WHERE lower(study_description) = '1-urgent' ORDER BY study_uid LIMIT 10000")
def cfind_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.find(_study_level(spark, sf_dir), {"study_description": "1-urgent"}, STUDY_FIELDS, ["study_uid"])


@query(STUDY_SQL + "WHERE study_date BETWEEN DATE '1996-01-01' AND DATE '1996-03-31' ORDER BY study_uid LIMIT 10000")
def cfind_date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.find(_study_level(spark, sf_dir), {"study_date": "19960101-19960331"}, STUDY_FIELDS, ["study_uid"])


@query(STUDY_SQL + "ORDER BY study_uid LIMIT 10000")
def cfind_open_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.find(_study_level(spark, sf_dir), {"study_date": "19960101-"}, STUDY_FIELDS, ["study_uid"])


@query(STUDY_SQL + "WHERE study_date >= DATE '2001-01-01' ORDER BY study_uid LIMIT 10000")
def cfind_open_range_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.find(_study_level(spark, sf_dir), {"study_date": "20010101-"}, STUDY_FIELDS, ["study_uid"], strict=True)


@query(STUDY_SQL + "WHERE regexp_matches(study_uid, '^1.3.*$') AND regexp_matches(lower(study_description), '^.-.*i.*$') ORDER BY study_uid LIMIT 10000")
def cfind_wildcard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.find(_study_level(spark, sf_dir), {"study_uid": "1?3*", "study_description": "?-*I*"}, STUDY_FIELDS, ["study_uid"])


def _rt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structure sets: series of the first five suppliers' returned items."""
    i = T.instances(spark, sf_dir).filter("modality = 'R' AND line_status = 'F'")
    return i.select(F.concat(F.lit("RT."), "series_uid").alias("series_uid"), "study_uid", F.lit("RTSTRUCT").alias("modality")).distinct()


@query(cte("study", "instance", "series") + """, img AS (SELECT series_uid, study_uid, series_description, '' AS modality FROM series ORDER BY series_uid LIMIT 10000),
rt AS (SELECT DISTINCT 'RT.' || series_uid AS series_uid, study_uid, 'RTSTRUCT' AS modality FROM instance WHERE modality = 'R' AND line_status = 'F' ORDER BY series_uid LIMIT 10000)
SELECT series_uid, study_uid, series_description, modality FROM img UNION ALL SELECT series_uid, study_uid, NULL, modality FROM rt""")
def cfind_series_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = T.series(spark, sf_dir).select("series_uid", "study_uid", "series_description", F.lit("").alias("modality"))
    return Q.with_rt(images, _rt(spark, sf_dir), "*")


@query(cte("instance") + "SELECT DISTINCT 'RT.' || series_uid AS series_uid, study_uid, 'RTSTRUCT' AS modality FROM instance WHERE modality = 'R' AND line_status = 'F' ORDER BY series_uid LIMIT 10000")
def cfind_rt_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = T.series(spark, sf_dir).select("series_uid", "study_uid", "series_description", F.lit("").alias("modality"))
    return Q.with_rt(images, _rt(spark, sf_dir), "RTSTRUCT")


@query(cte("instance") + """SELECT sop_uid AS "SOPInstanceUID", series_uid AS "SeriesInstanceUID", path AS "Path" FROM instance WHERE regexp_matches(sop_uid, '^12..*$') ORDER BY sop_uid, path, size LIMIT 10000""")
def cfind_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.find(T.instances(spark, sf_dir), {"sop_uid": "12?*"}, {"sop_uid": "SOPInstanceUID", "series_uid": "SeriesInstanceUID", "path": "Path"}, ["sop_uid", "path", "size"])


@query(cte("patient", "study") + "SELECT s.study_uid, p.patient_id FROM study s JOIN patient p USING (patient_id) WHERE lower(p.patient_name) = 'customer#000000007'")
def retrieve_iexact(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = T.studies(spark, sf_dir).join(T.patients(spark, sf_dir), "patient_id")
    return Q.retrieve(joined, {"patient_name": "CUSTOMER#000000007"}).select("study_uid", "patient_id")


# --- catalog --------------------------------------------------------------------------

INGEST_SQL = cte("study", "instance") + """, f AS (SELECT i.*, strftime(s.study_date, '%Y%m%d') AS day, CASE WHEN part % 10 = 0 THEN 'CT SCOUT ' || part ELSE 'Axial' END AS descr, CASE WHEN part % 50 = 7 THEN '' ELSE sop_uid END AS sop FROM instance i JOIN study s USING (study_uid)),
r AS (SELECT *, CASE WHEN mtime > TIMESTAMP '2001-06-01' - INTERVAL 10 MINUTE THEN 'recently_modified' WHEN mtime < TIMESTAMP '1995-06-01' THEN 'before_date_filter' WHEN modality NOT IN ('A', 'R') THEN 'modality'
WHEN sop = '' THEN 'missing_sop_uid' WHEN part % 10 = 0 THEN 'localizer_series' WHEN strptime(day, '%Y%m%d') < TIMESTAMP '1996-01-01' THEN 'study_date_before_filter' END AS reason FROM f) """


def _ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = T.studies(spark, sf_dir).select("study_uid", F.date_format("study_date", "yyyyMMdd").alias("study_date"))
    files = T.instances(spark, sf_dir).join(day, "study_uid")
    files = files.withColumn("series_description", F.when(F.col("part") % 10 == 0, F.concat(F.lit("CT SCOUT "), F.col("part").cast("string"))).otherwise("Axial"))
    files = files.withColumn("sop_uid", F.when(F.col("part") % 50 == 7, "").otherwise(F.col("sop_uid")))
    stamp = lambda s: F.lit(s).cast("timestamp_ntz")
    return C.skip_reason(files, stamp("2001-06-01"), stamp("1995-06-01"), stamp("1996-01-01"), ("A", "R"))


@query(INGEST_SQL + "SELECT reason, count(*) AS n FROM r GROUP BY reason")
def ingest_skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.breakdown(_ingest(spark, sf_dir), "reason")


@query(cte("instance") + ", k AS (SELECT DISTINCT path FROM instance WHERE mtime < TIMESTAMP '1998-01-01') SELECT DISTINCT path FROM instance WHERE path NOT IN (SELECT path FROM k)")
def ingest_new_files_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = T.instances(spark, sf_dir)
    return C.new_rows(files.select("path").distinct(), files.filter(F.col("mtime") < F.lit("1998-01-01").cast("timestamp_ntz")), ["path"])


@query(cte("instance") + "SELECT sop_uid, path, size FROM (SELECT *, row_number() OVER (PARTITION BY sop_uid ORDER BY path, size, slice_thickness, mtime) AS k FROM instance) WHERE k = 1")
def dedupe_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.first_wins(T.instances(spark, sf_dir), ["sop_uid"], ["path", "size", "slice_thickness", "mtime"]).select("sop_uid", "path", "size")


@query(cte("instance") + "SELECT series_uid, sop_uid, part FROM (SELECT *, row_number() OVER (PARTITION BY series_uid ORDER BY instance_number, part, size, path) AS k FROM instance) WHERE k = 1")
def first_instance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.first_wins(T.instances(spark, sf_dir), ["series_uid"], ["instance_number", "part", "size", "path"]).select("series_uid", "sop_uid", "part")


@query(cte("study", "instance") + "SELECT s.patient_id, i.study_uid, i.series_uid, count(*) AS n, min(i.sop_uid) AS first_sop FROM instance i JOIN study s USING (study_uid) GROUP BY ALL")
def catalog_hierarchy_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = T.instances(spark, sf_dir).join(T.studies(spark, sf_dir).select("study_uid", "patient_id"), "study_uid")
    return i.groupBy("patient_id", "study_uid", "series_uid").agg(F.count("*").alias("n"), F.min("sop_uid").alias("first_sop"))


UPSERT_SQL = cte("patient") + ", old AS (SELECT * FROM patient WHERE gender <> 'BUILDING'), new AS (SELECT patient_id, upper(patient_name) AS patient_name, gender FROM patient WHERE gender IN ('BUILDING', 'MACHINERY')) "


def _upsert(spark: SparkSession, sf_dir: str, update: bool) -> DataFrame:
    p = T.patients(spark, sf_dir)
    incoming = p.filter(F.col("gender").isin("BUILDING", "MACHINERY")).withColumn("patient_name", F.upper("patient_name"))
    return C.upsert(p.filter("gender <> 'BUILDING'"), incoming, ["patient_id"], update)


@query(UPSERT_SQL + "SELECT * FROM old UNION ALL SELECT * FROM new WHERE patient_id NOT IN (SELECT patient_id FROM old)")
def upsert_get_or_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _upsert(spark, sf_dir, False)


@query(UPSERT_SQL + "SELECT * FROM old WHERE patient_id NOT IN (SELECT patient_id FROM new) UNION ALL SELECT * FROM new")
def upsert_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _upsert(spark, sf_dir, True)


@query("""SELECT ae, kind AS series_uid, run, count(*) AS n, min(ts) AS first, max(ts) AS last FROM (SELECT *, sum(c) OVER (PARTITION BY ae ORDER BY ts, event_id) AS run FROM (SELECT event_id, ts, user_id AS ae, event_type AS kind,
coalesce((lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) <> event_type)::INT, 1) AS c FROM events)) GROUP BY ae, kind, run""")
def series_completion_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.change_runs(T.transactions(spark, sf_dir).withColumnRenamed("kind", "series_uid"), "ae", "series_uid", ["ts", "event_id"])


@query("""SELECT event_id, ae, freed FROM (SELECT event_id, user_id AS ae, value, sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS freed, CAST(round(value * 100) AS BIGINT) AS size FROM events) WHERE freed - size < 5000""")
def cleanup_running_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = T.transactions(spark, sf_dir).withColumn("size", F.round(F.col("bytes") * 100).cast("long"))
    return C.until_freed(files, "size", ["ts", "event_id"], 5000, "ae").select("event_id", "ae", "freed")


@query("""SELECT event_id, freed FROM (SELECT event_id, sum(CAST(round(value * 100) AS BIGINT)) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS freed, CAST(round(value * 100) AS BIGINT) AS size FROM events
WHERE ts < (SELECT max(ts) - INTERVAL 7 DAY FROM events)) WHERE freed - size < 2000000""")
def cleanup_store_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One target for the whole store; files of the last 7 days stay."""
    files = T.transactions(spark, sf_dir).withColumn("size", F.round(F.col("bytes") * 100).cast("long"))
    cutoff = F.lit(files.agg(F.max("ts")).first()[0]) - F.expr("INTERVAL 7 DAYS")
    return C.until_freed(files, "size", ["ts", "event_id"], 2000000, cutoff=cutoff).select("event_id", "freed")


@query("SELECT DISTINCT least(l_partkey, l_suppkey) AS low, greatest(l_partkey, l_suppkey) AS high FROM lineitem WHERE l_partkey <> l_suppkey")
def pairs_symmetric_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.symmetric_pairs(T.table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey")


#: Template names of the fuzzy match.
TEMPLATES = ["RED WIDGET", "blue_bolt", "small-ring", "gear", "steel", "Blue Bolt", "Gear"]


@query("""WITH n AS (SELECT DISTINCT p_name AS name FROM part), t AS (SELECT * FROM (VALUES ('RED WIDGET', 1), ('blue_bolt', 2), ('small-ring', 3), ('gear', 4), ('steel', 5), ('Blue Bolt', 6), ('Gear', 7)) t(template, position)),
m AS (SELECT name, template, position, CASE WHEN lower(name) = lower(template) THEN 1 WHEN replace(lower(name), ' ', '_') = replace(lower(template), ' ', '_') THEN 2
WHEN regexp_replace(lower(name), '[ _-]', '', 'g') = regexp_replace(lower(template), '[ _-]', '', 'g') THEN 3 END AS tier FROM n, t
UNION ALL SELECT name, template, position, CASE WHEN contains(lower(name), f) OR contains(f, lower(name)) THEN 4 END FROM n, (SELECT lower(template) AS f, arg_max(template, position) AS template, min(position) AS position FROM t GROUP BY 1))
SELECT name, template, tier FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY tier, CASE WHEN tier < 4 THEN -position ELSE position END) AS k FROM m WHERE tier IS NOT NULL) WHERE k = 1""")
def fuzzy_name_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = T.table(spark, sf_dir, "part").select(F.col("p_name").alias("name"))
    return C.tiered_match(names, spark.createDataFrame(list(zip(TEMPLATES, range(1, 8))), "name string, position int"))


@query(cte("study") + "SELECT * FROM (SELECT study_uid, strftime(study_date, '%Y-%m-%d') AS study_date FROM study ORDER BY study_date DESC, study_uid LIMIT 25 OFFSET 50)")
def page_of_studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.page(T.studies(spark, sf_dir), [F.col("study_date").desc(), "study_uid"], 3, 25).select("study_uid", F.col("study_date").cast("string").alias("study_date"))


@query(cte("study", "series") + "SELECT study_uid, patient_id FROM study WHERE study_uid IN (SELECT study_uid FROM series WHERE instance_count > 1)")
def semi_join_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.studies(spark, sf_dir).join(T.series(spark, sf_dir).filter("instance_count > 1"), "study_uid", "left_semi").select("study_uid", "patient_id")


@query(cte("study") + "SELECT patient_id, max_by(study_uid, (study_date, study_uid)) AS study_uid, strftime(max(study_date), '%Y-%m-%d') AS study_date FROM study GROUP BY patient_id")
def latest_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.latest(T.studies(spark, sf_dir), "patient_id", ["study_date", "study_uid"], ["study_uid", "study_date"]).withColumn("study_date", F.col("study_date").cast("string"))


# --- reports --------------------------------------------------------------------------


@query("""WITH m AS (SELECT max(ts) AS t FROM events) SELECT count(*) AS total, count(*) FILTER (event_type <> 'error') AS success, count(*) FILTER (event_type = 'error') AS failure, count(*) FILTER (event_type = 'view') AS stores
FROM events, m WHERE ts > t - INTERVAL 24 HOUR""")
def txn_stats_24h(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.transactions(spark, sf_dir)
    recent = e.join(e.agg(F.max("ts").alias("as_of")), F.lit(True)).filter(F.col("ts") > F.col("as_of") - F.expr("INTERVAL 24 HOURS"))
    kind = F.col("kind")
    return R.counts_since(recent, {"total": F.lit(True), "success": kind != "error", "failure": kind == "error", "stores": kind == "view"})


@query("SELECT o_orderstatus AS modality, count(*) AS n FROM orders GROUP BY 1")
def status_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.breakdown(T.studies(spark, sf_dir), "modality")


@query(cte("patient", "study") + "SELECT p.patient_id, count(DISTINCT s.study_uid) AS n_studies FROM patient p LEFT JOIN study s USING (patient_id) GROUP BY 1")
def patient_study_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.counts_per(T.patients(spark, sf_dir).select("patient_id"), T.studies(spark, sf_dir), "patient_id", "study_uid", "n_studies")


@query("""WITH a AS (SELECT count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (value > 10) AS large FROM events WHERE ts > TIMESTAMP '2024-01-15')
SELECT 'views' AS parameter_name, views::VARCHAR AS parameter_value FROM a UNION ALL SELECT 'errors', errors::VARCHAR FROM a UNION ALL SELECT 'large', large::VARCHAR FROM a""")
def stats_since_last_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.transactions(spark, sf_dir).filter(F.col("ts") > F.lit("2024-01-15").cast("timestamp_ntz"))
    wide = R.counts_since(e, {"views": F.col("kind") == "view", "errors": F.col("kind") == "error", "large": F.col("bytes") > 10})
    return R.to_long(wide, wide.columns)


@query("""WITH a AS (SELECT o_orderkey, min(l_shipdate) AS first, max(l_shipdate) AS last, count(l_shipdate) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_returnflag = 'A' GROUP BY 1)
SELECT coalesce(sum(epoch(last) - epoch(first)), 0)::DOUBLE AS total_seconds, count(*) AS cases, coalesce(sum(epoch(last) - epoch(first)), 0)::DOUBLE / count(*) AS mean_seconds FROM a""")
def avg_processing_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = T.instances(spark, sf_dir).filter("modality = 'A'").groupBy("study_uid").agg(F.min("mtime").alias("first"), F.max("mtime").alias("last"))
    cases = T.studies(spark, sf_dir).select("study_uid").join(used, "study_uid", "left")
    return R.mean_over_all(cases, (F.unix_micros(F.col("last").cast("timestamp")) - F.unix_micros(F.col("first").cast("timestamp"))) / 1e6)


@query("""SELECT event_type AS kind, coalesce(sum(v) FILTER (ts >= TIMESTAMP '2024-01-30'), 0)::BIGINT AS today, coalesce(sum(v) FILTER (ts >= date_trunc('week', TIMESTAMP '2024-01-30')), 0)::BIGINT AS this_week,
coalesce(sum(v) FILTER (ts >= date_trunc('week', TIMESTAMP '2024-01-30') - INTERVAL 7 DAY AND ts <= date_trunc('week', TIMESTAMP '2024-01-30') - INTERVAL 1 SECOND), 0)::BIGINT AS past_week
FROM (SELECT event_type, ts, json_extract_string(props, '$.k')::BIGINT AS v FROM events) GROUP BY 1""")
def dashboard_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.lit("2024-01-30").cast("timestamp_ntz")
    week = F.date_trunc("week", day).cast("timestamp_ntz")
    stats = T.transactions(spark, sf_dir).withColumn("v", F.get_json_object("props", "$.k"))
    ts = F.col("ts")
    windows = {"today": ts >= day, "this_week": ts >= week, "past_week": (ts >= week - F.expr("INTERVAL 7 DAYS")) & (ts <= week - F.expr("INTERVAL 1 SECOND"))}
    return R.digit_sums(stats, "v", windows, "kind")


@query("SELECT event_type AS kind, median(value) FILTER (value > 0) / 60 AS minutes FROM events GROUP BY 1")
def dashboard_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.transactions(spark, sf_dir).select("kind", F.when(F.col("bytes") > 0, F.col("bytes")).alias("bytes"))
    return R.medians(rows, ["kind"], "bytes").select("kind", (F.col("median") / 60).alias("minutes"))


@query(cte("study", "series") + """SELECT patient_id, study_uid, count(*) AS n_series, sum(instance_count)::BIGINT AS n_instances, grouping(patient_id, study_uid)::BIGINT AS level FROM series JOIN study USING (study_uid) GROUP BY ROLLUP (patient_id, study_uid)""")
def run_summary_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.summary_rollup(T.series(spark, sf_dir).join(T.studies(spark, sf_dir), "study_uid"))


@query("SELECT source, count(*) AS n_rt, count(quality) AS n_rated, count(*) FILTER (quality = 1 OR toxic = 1) AS n_flagged FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def rt_rating_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.table(spark, sf_dir, "documents").join(T.table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.groupBy("source").agg(F.count("*").alias("n_rt"), F.count("quality").alias("n_rated"), F.count_if((F.col("quality") == 1) | (F.col("toxic") == 1)).alias("n_flagged"))


@query("SELECT doc_id, source, coalesce(quality::VARCHAR, 'N/A') AS quality, coalesce(toxic::VARCHAR, 'N/A') AS toxic, coalesce(nullif(lang, ''), 'Unknown') AS lang FROM documents LEFT JOIN labels USING (doc_id)")
def ratings_long_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.table(spark, sf_dir, "documents").join(T.table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.select("doc_id", "source", S.or_default(F.col("quality").cast("string"), "N/A").alias("quality"), S.or_default(F.col("toxic").cast("string"), "N/A").alias("toxic"), S.or_default(F.col("lang"), "Unknown").alias("lang"))


@query(cte("patient", "study", "series") + """, s AS (SELECT study_uid, string_agg(series_uid || '*' || instance_count, ',' ORDER BY series_uid) AS series FROM series GROUP BY 1),
t AS (SELECT patient_id, string_agg(study_uid || '@' || strftime(study_date, '%Y-%m-%d') || '[' || coalesce(s.series, '') || ']', ';' ORDER BY study_uid) AS studies FROM study LEFT JOIN s USING (study_uid) GROUP BY 1)
SELECT patient_id, patient_name, coalesce(studies, '') AS studies FROM patient LEFT JOIN t USING (patient_id)""")
def nested_patient_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents read again and shown level by level, in their order."""
    doc = R.nested(T.patients(spark, sf_dir), T.studies(spark, sf_dir), T.series(spark, sf_dir))
    schema = "patient_id string, patient_name string, studies array<struct<study_uid:string,study_date:string,series:array<struct<series_uid:string,instance_count:long>>>>"
    d = doc.select(F.from_json("document", schema).alias("d"))
    series = lambda x: F.array_join(F.transform(x["series"], lambda s: F.concat_ws("*", s["series_uid"], s["instance_count"].cast("string"))), ",")
    studies = F.transform("d.studies", lambda x: F.concat(x["study_uid"], F.lit("@"), x["study_date"], F.lit("["), F.coalesce(series(x), F.lit("")), F.lit("]")))
    return d.select("d.patient_id", "d.patient_name", F.coalesce(F.array_join(studies, ";"), F.lit("")).alias("studies"))


@query("SELECT count(*) AS n_files, sum(CAST(round(l_extendedprice * 100) AS BIGINT))::DOUBLE AS used, greatest(0, 1e12 - sum(CAST(round(l_extendedprice * 100) AS BIGINT))::DOUBLE) AS available FROM lineitem")
def storage_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = T.instances(spark, sf_dir).select(F.round(F.col("size") * 100).cast("long").alias("bytes"))
    return R.storage_usage(files, "bytes", 1e12).select("n_files", F.col("used").cast("double").alias("used"), F.col("available").cast("double").alias("available"))


@query("SELECT lang, string_agg(source, ', ' ORDER BY source) AS sources FROM (SELECT DISTINCT lang, source FROM documents) GROUP BY 1")
def joined_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "documents").groupBy("lang").agg(F.array_join(F.array_sort(F.collect_set("source")), ", ").alias("sources"))


@query("SELECT user_id AS ae, date_trunc('hour', ts) + INTERVAL 30 MINUTE * (minute(ts) // 30) AS period, count(*) AS n FROM events GROUP BY ALL")
def snapshots_30min(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.transactions(spark, sf_dir)
    return e.groupBy("ae", F.window("ts", "30 minutes")).agg(F.count("*").alias("n")).select("ae", F.col("window.start").alias("period"), "n")


# --- values ---------------------------------------------------------------------------


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of many shapes, from the lines."""
    line = T.table(spark, sf_dir, "lineitem")
    day = F.date_format("l_shipdate", "yyyyMMdd")
    v = F.when(F.col("l_partkey") % 7 == 0, F.concat(F.lit("x"), day)).when(F.col("l_partkey") % 7 == 1, F.concat(F.substring(day, 1, 6), F.lit("31"))).when(F.col("l_partkey") % 7 == 2, F.col("l_suppkey").cast("string"))
    v = v.when(F.col("l_partkey") % 7 == 3, F.concat(F.lit("1.2."), F.col("l_orderkey").cast("string"))).when(F.col("l_partkey") % 7 == 4, F.concat(F.col("l_orderkey").cast("string"), F.lit("e5"))).when(F.col("l_partkey") % 7 == 5, F.concat(F.lit("A_b "), "l_returnflag"))
    return line.select(v.otherwise(day).alias("v")).distinct()


VALUES_SQL = """WITH t AS (SELECT DISTINCT CASE l_partkey % 7 WHEN 0 THEN 'x' || d WHEN 1 THEN d[1:6] || '31' WHEN 2 THEN l_suppkey::VARCHAR WHEN 3 THEN '1.2.' || l_orderkey WHEN 4 THEN l_orderkey || 'e5' WHEN 5 THEN 'A_b ' || l_returnflag ELSE d END AS v
FROM (SELECT *, strftime(l_shipdate, '%Y%m%d') AS d FROM lineitem)) """
_VR_SQL = {
    "da": "regexp_full_match(v, '\\d{8}') AND try_strptime(v, '%Y%m%d') IS NOT NULL",
    "ds": "length(v) <= 16 AND regexp_full_match(trim(v), '[+-]?(\\d+(\\.\\d*)?|\\.\\d+)([eE][+-]?\\d+)?')",
    "is": "length(v) <= 12 AND regexp_full_match(trim(v), '[+-]?\\d+') AND coalesce(try_cast(v AS BIGINT) BETWEEN -2147483648 AND 2147483647, false)",
    "ui": "length(v) <= 64 AND regexp_full_match(v, '\\d+(\\.\\d+)*')",
    "cs": "length(v) <= 16 AND regexp_full_match(v, '[A-Za-z0-9 _]*')",
    "tm": "length(v) <= 16 AND regexp_full_match(v, '\\d{2}(\\d{2}(\\d{2}(\\.\\d{1,6})?)?)?')",
    "pn": "length(v) <= 64 AND NOT contains(v, chr(92))",
    "us": "regexp_full_match(trim(v), '[+-]?\\d+') AND coalesce(try_cast(v AS BIGINT) BETWEEN 0 AND 65535, false)",
    "fd": "regexp_full_match(v, '[+-]?(\\d+(\\.\\d*)?|\\.\\d+)([eE][+-]?\\d+)?')",
    "lo": "length(v) <= 64 AND NOT contains(v, chr(92))",
    "as": "regexp_full_match(v, '\\d{3}[DWMY]')",
    "sq": "length(v) <= 1024",
}


def _vr(code: str):
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _values(spark, sf_dir).select("v", VR.valid(F.col("v"), F.lit(code.upper())).alias("ok"))

    f.__name__ = f"vr_validate_{code}"
    query(VALUES_SQL + f"SELECT v, {_VR_SQL[code]} AS ok FROM t")(f)


for _code in _VR_SQL:
    _vr(_code)


_CODES = ["FL", "DS", "US", "LO", "PN", "DA", "SQ", "AT"]


@query(f"""SELECT p_partkey, vr, o AS operator, vr IN ('FL', 'DS', 'US') AND (o IN ({str(VR.NUMERIC_OPERATORS)[1:-1]})) OR vr IN ('LO', 'PN') AND (o IN ({str(VR.STRING_OPERATORS)[1:-1]})) OR vr = 'DA' AND (o IN ({str(VR.NUMERIC_OPERATORS + VR.STRING_OPERATORS)[1:-1]}))
OR o IN ('EQUALS', 'NOT_EQUALS') AND vr IN ('SQ', 'AT') AS ok FROM (SELECT p_partkey, ({_CODES})[p_partkey % 8 + 1] AS vr, ({sorted(set(VR.NUMERIC_OPERATORS) | set(VR.STRING_OPERATORS))})[p_size % 12 + 1] AS o FROM part)""")
def vr_operator_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of a table, each with a representation and an operator: whether they go together."""
    every = sorted(set(VR.NUMERIC_OPERATORS) | set(VR.STRING_OPERATORS))
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))
    rules = T.table(spark, sf_dir, "part").select("p_partkey", pick(_CODES, F.col("p_partkey") % 8).alias("vr"), pick(every, F.col("p_size") % 12).alias("operator"))
    return rules.withColumn("ok", F.array_contains(VR.operators(F.col("vr")), F.col("operator")))


@query(r"""SELECT doc_id, CASE WHEN text IS NULL OR text IN ('', '#') THEN '#' ELSE regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b', '[EMAIL]', 'g'),
'https?://\S+', '[URL]', 'g'), '\b(?:\d{1,3}\.){3}\d{1,3}\b', '[IP]', 'g'), '\b\d{3}-\d{2}-\d{4}\b', '[SSN]', 'g'), '\b\d{9}\b', '[ID]', 'g'), '\b\d{3}[-.]?\d{3}[-.]?\d{4}\b', '[PHONE]', 'g') END AS text FROM documents""")
def phi_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "documents").select("doc_id", S.scrub(F.col("text")).alias("text"))


@query("""WITH t AS (SELECT c_custkey, c_name AS v FROM customer) SELECT c_custkey, '***FIELD_MASKED***' AS name, v[1:4] || '...' || right(v, 4) AS uid, '***FIELD_MASKED***' AS uid_id_first, regexp_extract('/a/b/' || v, '[^/]*$') AS path, '***EMPTY***' AS empty, v AS other FROM t""")
def mask_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("c_name")
    return T.table(spark, sf_dir, "customer").select(
        "c_custkey", S.mask(F.lit("patient_name"), v).alias("name"), S.mask(F.lit("series_uid"), v, "uid_first").alias("uid"), S.mask(F.lit("series_uid"), v).alias("uid_id_first"),
        S.mask(F.lit("root_path"), F.concat(F.lit("/a/b/"), v)).alias("path"), S.mask(F.lit("modality"), F.lit("")).alias("empty"), S.mask(F.lit("modality"), v).alias("other"),
    )


@query("SELECT p_partkey, CASE WHEN s = '' THEN 'UNKNOWN' ELSE s END AS name FROM (SELECT p_partkey, trim(regexp_replace(regexp_replace('#' || p_name || '/' || p_brand || '.', '[^A-Za-z0-9_-]', '_', 'g'), '_+', '_', 'g'), '_') AS s FROM part)")
def sanitize_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("#"), "p_name", F.lit("/"), "p_brand", F.lit("."))
    return T.table(spark, sf_dir, "part").select("p_partkey", S.safe_name(raw).alias("name"))


#: Labels with a side, labels without, and what looks like a side but is none.
_LABEL_SQL = """CASE WHEN length(l) <= 16 THEN l WHEN regexp_matches(l, '(?i)_(right|left|r|l|rt|lt)$') THEN l[1 : 16 - length(regexp_extract(l, '(?i)_(right|left|r|l|rt|lt)$'))] || regexp_extract(l, '(?i)_(right|left|r|l|rt|lt)$') ELSE l[1:16] END"""


@query(f"""SELECT p_partkey, {_LABEL_SQL} AS label FROM (SELECT p_partkey, 'ROI ' || p_name || ' ' || p_size || (CASE p_partkey % 8 WHEN 0 THEN '_L' WHEN 1 THEN '_Right' WHEN 2 THEN ' R' WHEN 3 THEN '-LEFT' WHEN 4 THEN '_Rt' WHEN 5 THEN '_LT' WHEN 6 THEN '_LEFT' ELSE '' END) AS l FROM part)""")
def truncate_roi_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = F.array(*map(F.lit, ("_L", "_Right", " R", "-LEFT", "_Rt", "_LT", "_LEFT", "")))
    label = F.concat(F.lit("ROI "), "p_name", F.lit(" "), F.col("p_size").cast("string"), F.element_at(ends, (F.col("p_partkey") % 8 + 1).cast("int")))
    return T.table(spark, sf_dir, "part").select("p_partkey", S.short_label(label).alias("label"))


@query(r"""SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN p_size || '\' || (p_size * 5 % 256) || '\0' WHEN 1 THEN (CASE split_part(p_name, ' ', 1) WHEN 'red' THEN '255\0\0' WHEN 'blue' THEN '0\0\255' WHEN 'green' THEN '0\255\0' END)
WHEN 2 THEN '16\' || p_size || '\255' WHEN 3 THEN (n // 65536 % 256) || '\' || (n // 256 % 256) || '\' || (n % 256) WHEN 4 THEN '18\52\' || ('0x' || lpad((p_partkey % 100)::VARCHAR, 2, '0'))::INT WHEN 5 THEN '4\' || ((300000 + p_size % 10 * 100) // 256 % 256) || '\' || ((300000 + p_size % 10 * 100) % 256)
ELSE '255\192\203' END AS color FROM (SELECT *, 16711680 + p_partkey AS n FROM part)""")
def parse_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RGB, names behind a word, hex with and without #, packed integers, RGB out of range (its digits are packed), names in odd case."""
    k, size = F.col("p_partkey") % 7, F.col("p_size").cast("int")
    raw = F.when(k == 0, F.format_string("RGB %d %d 0", size % 256, size * 5 % 256)).when(k == 1, F.concat(F.lit("Segment - "), F.split_part("p_name", F.lit(" "), F.lit(1))))
    raw = raw.when(k == 2, F.concat(F.lit("#10"), F.lpad(F.hex(size), 2, "0"), F.lit("FF"))).when(k == 3, (F.lit(16711680) + F.col("p_partkey")).cast("string"))
    raw = raw.when(k == 4, F.concat(F.lit("1234"), F.lpad((F.col("p_partkey") % 100).cast("string"), 2, "0"))).when(k == 5, F.format_string("rgb 300 %d 00", size % 10)).otherwise(" opaque-PinK ")
    return T.table(spark, sf_dir, "part").select("p_partkey", S.color(raw).alias("color"))


@query(cte("patient", "study", "instance") + """SELECT layout, i.sop_uid, i.path AS file, CASE layout WHEN 'patient' THEN p || '/' || f WHEN 'study' THEN p || '/' || s || '/' || f WHEN 'series' THEN p || '/' || s || '/' || e || '/' || f
WHEN 'date' THEN strftime(d, '%Y/%m/%d') || '/' || f ELSE f END AS path FROM (SELECT i.sop_uid, i.path, t.study_date AS d, i.sop_uid || '.dcm' AS f, regexp_replace(pt.patient_name, '[^A-Za-z0-9_-]', '_', 'g') AS p, t.study_uid AS s, replace(i.series_uid, '.', '_') AS e
FROM instance i JOIN study t USING (study_uid) JOIN patient pt USING (patient_id)) i, (VALUES ('flat'), ('patient'), ('study'), ('series'), ('date')) l(layout)""")
def storage_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    patients = T.patients(spark, sf_dir).select("patient_id", "patient_name")
    studies = T.studies(spark, sf_dir).select("study_uid", "patient_id", "study_date").join(patients, "patient_id")
    folders = S.storage_folders(F.col("patient_name"), F.col("study_uid"), F.col("study_date"))
    rows = T.instances(spark, sf_dir).select("sop_uid", "series_uid", "study_uid", F.col("path").alias("file")).join(studies.select("study_uid", folders.alias("folders")), "study_uid")
    return rows.select("sop_uid", "file", F.explode(S.storage_paths(F.col("folders"), F.col("series_uid"), F.concat("sop_uid", F.lit(".dcm")))).alias("layout", "path")).select("layout", "sop_uid", "file", "path")


# --- de-identification -----------------------------------------------------------------


#: Of the test tables only.
SECRET = b"secret of the test tables"
_PADS = [bytes(b ^ pad for b in SECRET.ljust(64, b"\0")).hex() for pad in (0x36, 0x5C)]


def keyed_sql(text: str) -> str:
    return f"sha256(unhex('{_PADS[1]}') || unhex(sha256(unhex('{_PADS[0]}') || encode({text}))))"


def digits_sql(key: str, low: int, high: int, salt: str) -> str:
    return f"(('0x' || substr({keyed_sql(f"{key} || '{salt}'")}, 1, 12))::BIGINT % {high - low + 1} + {low})"


#: Studies that draw the same digits are numbered behind them.
UIDS_SQL = f"""drawn AS (SELECT DISTINCT study_uid, '{D.UID_PREFIX}.' || {digits_sql('study_uid', 100, 999, 'study0')} || '.' || {digits_sql('study_uid', 10, 99, 'study1')} || '.' || {digits_sql('study_uid', 100, 999, 'study2')} AS uid FROM study),
u AS (SELECT study_uid, uid || CASE WHEN n > 1 THEN (n - 1)::VARCHAR ELSE '' END AS deid_study_uid FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY study_uid) AS n FROM drawn))"""


@query(cte("study", "series") + f", {UIDS_SQL} SELECT series_uid, deid_study_uid || '.' || row_number() OVER (PARTITION BY study_uid ORDER BY series_uid) AS deid_series_uid FROM (SELECT DISTINCT series_uid, study_uid FROM series) JOIN u USING (study_uid)")
def deid_uid_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.series_uids(T.series(spark, sf_dir), D.study_uids(T.studies(spark, sf_dir), SECRET))


@query(cte("study") + f"SELECT study_uid, strftime(DATE '2000-01-01' + {digits_sql('study_uid', 0, 7668, 'date')}::INT, '%Y-%m-%d') AS deid_date FROM study")
def deid_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.studies(spark, sf_dir).select("study_uid", D.study_date(F.col("study_uid"), SECRET).cast("string").alias("deid_date"))


_MASKED_JSON = ",".join(f'"{t}":"#"' for t in D.MASKED + D.FREE_TEXT)


@query(cte("series") + f"""SELECT series_uid, '{{{_MASKED_JSON},"SeriesInstanceUID":"' || series_uid || '","StudyInstanceUID":"' || study_uid || '"}}' AS tags FROM series""")
def deid_masked_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tag map of every series, with a value for each listed tag, before it leaves."""
    named = F.map_from_arrays(F.array(*map(F.lit, D.MASKED + D.FREE_TEXT)), F.array(*[F.concat(F.lit(f"{t} of "), "series_uid") for t in D.MASKED + D.FREE_TEXT]))
    others = F.create_map(F.lit("SeriesInstanceUID"), "series_uid", F.lit("StudyInstanceUID"), "study_uid", F.lit("(0009,0010)"), F.lit("private"))
    rows = T.series(spark, sf_dir).select("series_uid", F.map_concat(named, others).alias("tags"))
    return rows.select("series_uid", F.to_json(D.masked_tags(F.col("tags"))).alias("tags"))


@query(cte("patient") + f"SELECT patient_id, 'P' || substr({keyed_sql('patient_id')}, 1, 16) AS pseudonym FROM patient")
def deid_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.patients(spark, sf_dir).select("patient_id", D.pseudonym(F.col("patient_id"), SECRET).alias("pseudonym"))


@query(cte("study", "series") + f", {UIDS_SQL} SELECT series_uid, CASE WHEN length(study_uid) % 2 = 0 THEN deid_study_uid ELSE study_uid END AS study_uid FROM series JOIN u USING (study_uid)")
def reid_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = D.study_uids(T.studies(spark, sf_dir), SECRET).filter(F.length("study_uid") % 2 == 0).select(F.col("study_uid").alias("uid_from"), F.col("deid_study_uid").alias("uid_to"))
    return C.remap(T.series(spark, sf_dir).select("series_uid", "study_uid"), mapping, ["study_uid"])


@query("SELECT p_name, CASE WHEN count(*) = 1 THEN min(p_brand) END AS p_brand, count(*) > 1 AS ambiguous FROM (SELECT p_name || p_size AS p_name, p_brand FROM part) GROUP BY 1")
def roi_property_ambiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.table(spark, sf_dir, "part").select(F.concat("p_name", F.col("p_size").cast("string")).alias("p_name"), "p_brand")
    return C.unique_properties(p, "p_name", ["p_brand"])


# --- voxels ---------------------------------------------------------------------------

SIZE = (8, 8, 7)


def _marked(spark: SparkSession, sf_dir: str, flag: str) -> DataFrame:
    """A voxel for each line of a flag, in any number of copies."""
    line = T.table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == flag)
    return line.select(F.col("l_suppkey").alias("comparison_id"), (F.col("l_partkey") % 8).cast("int").alias("i"), (F.col("l_orderkey") % 8).cast("int").alias("j"), (F.col("l_linenumber") - 1).cast("int").alias("k"))


def _mask(spark: SparkSession, sf_dir: str, flag: str) -> DataFrame:
    return _marked(spark, sf_dir, flag).distinct()


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.membership(_marked(spark, sf_dir, "A"), _marked(spark, sf_dir, "R"))


_M = "SELECT DISTINCT l_suppkey AS comparison_id, (l_partkey % 8)::INT AS i, (l_orderkey % 8)::INT AS j, (l_linenumber - 1)::INT AS k FROM lineitem WHERE l_returnflag = "
VOXELS_SQL = f"WITH a AS ({_M}'A'), b AS ({_M}'R'), c AS (SELECT comparison_id, i, j, k, a.comparison_id IS NOT NULL AS in_a, b.comparison_id IS NOT NULL AS in_b FROM a FULL JOIN b USING (comparison_id, i, j, k)), c2 AS (SELECT comparison_id, i, j, k, (comparison_id, i, j, k) IN (SELECT (comparison_id, i, j, k) FROM a) AS in_a, (comparison_id, i, j, k) IN (SELECT (comparison_id, i, j, k) FROM b) AS in_b FROM (SELECT * FROM a UNION SELECT * FROM b)) "
_N = ", n AS (SELECT comparison_id, count(*) FILTER (in_a) AS na, count(*) FILTER (in_b) AS nb, count(*) FILTER (in_a AND in_b) AS nab, count(*) AS nu FROM c2 GROUP BY 1) "


@query(VOXELS_SQL + _N + "SELECT comparison_id, 2 * nab / (na + nb) AS dsc, nab / nu AS jsc, 1 - nab / nu AS voe, nab / sqrt(na::DOUBLE * nb) AS cs FROM n")
def voxel_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.overlap(_cells(spark, sf_dir), 448).select("comparison_id", "dsc", "jsc", "voe", "cs")


_H = lambda x: f"(CASE WHEN {x} > 0 THEN -({x} / 448.0::DOUBLE) * ln({x} / 448.0::DOUBLE) ELSE 0 END)"


@query(VOXELS_SQL + _N + f"SELECT comparison_id, round(2 * ({_H('nab')} + {_H('(na - nab)')} + {_H('(nb - nab)')} + {_H('(448 - nu)')}) - ({_H('na')} + {_H('(448 - na)')}) - ({_H('nb')} + {_H('(448 - nb)')}), 9) AS vi FROM n")
def voxel_vi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.overlap(_cells(spark, sf_dir), 448).select("comparison_id", F.round("vi", 9).alias("vi"))


_TESTS = {"union": "true", "intersection": "in_a AND in_b", "subtraction": "in_a AND NOT in_b", "xor": "in_a <> in_b"}


def _set_operation(name: str):
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return V.combine(_cells(spark, sf_dir), name)

    f.__name__ = f"voxel_{name}"
    query(VOXELS_SQL + f"SELECT comparison_id, i, j, k FROM c2 WHERE {_TESTS[name]}")(f)


for _name in _TESTS:
    _set_operation(_name)

_OFFSETS = ", ".join(map(str, V.ball(1.0)))


@query(VOXELS_SQL + f"SELECT DISTINCT comparison_id, i + x AS i, j + y AS j, k + z AS k FROM a, (VALUES {_OFFSETS}) o(x, y, z) WHERE i + x BETWEEN 0 AND 7 AND j + y BETWEEN 0 AND 7 AND k + z BETWEEN 0 AND 6")
def voxel_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.margin(_marked(spark, sf_dir, "A"), 1.0, SIZE)


@query(VOXELS_SQL + f", m AS (SELECT comparison_id, i, j, k FROM c2) SELECT comparison_id, i + x AS i, j + y AS j, k + z AS k FROM m, (VALUES {_OFFSETS}) o(x, y, z) GROUP BY ALL HAVING count(*) = {len(V.ball(1.0))}")
def voxel_erode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.margin(V.combine(_cells(spark, sf_dir), "union"), -1.0, SIZE)


@query(VOXELS_SQL + "SELECT comparison_id, count(*) AS n, count(*) * 2.5 AS volume, min(i) AS min_i, max(i) AS max_i, min(j) AS min_j, max(j) AS max_j, min(k) AS min_k, max(k) AS max_k FROM a GROUP BY 1")
def voxel_volume_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.extent(_mask(spark, sf_dir, "A"), (1.0, 1.0, 2.5))


_NEAR = "SELECT {0}.comparison_id, {0}.i, {0}.j, {0}.k, sqrt(min(({0}.i - {1}.i) ** 2 + ({0}.j - {1}.j) ** 2 + ({0}.k - {1}.k) ** 2)) AS d FROM {0} JOIN {1} USING (comparison_id) GROUP BY ALL"
DISTANCE_SQL = VOXELS_SQL + f""", x AS ({_NEAR.format('a', 'b')}), y AS ({_NEAR.format('b', 'a')}), p AS (SELECT comparison_id, avg(d) AS m, quantile_cont(d, 0.95) AS h FROM x GROUP BY 1), q AS (SELECT comparison_id, avg(d) AS m, quantile_cont(d, 0.95) AS h FROM y GROUP BY 1)
SELECT comparison_id, round((p.m + q.m) / 2, 9) AS msd, round(greatest(p.h, q.h), 9) AS hd95 FROM p JOIN q USING (comparison_id)"""


@query(DISTANCE_SQL)
def voxel_msd_hd95(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = V.voxel_distances(_marked(spark, sf_dir, "A"), _marked(spark, sf_dir, "R"))
    return d.select("comparison_id", F.round("msd", 9).alias("msd"), F.round("hd95", 9).alias("hd95"))


@query(DISTANCE_SQL)
def voxel_distance_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = K.metrics(_cells(spark, sf_dir), SIZE, names=["msd", "hd95"]).groupBy("comparison_id").pivot("metric", ["msd", "hd95"]).agg(F.first("value"))
    return m.select("comparison_id", F.round("msd", 9).alias("msd"), F.round("hd95", 9).alias("hd95"))


def _axis_rows(source: str, target: str, step: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> str:
    """Voxels of the source and not the target, with the distance to the nearest of the target along an axis, if there is one."""
    lines = " UNION ALL ".join(
        f"SELECT s.comparison_id, s.i, s.j, s.k, abs(s.{x} - t.{x}) * {w} AS d FROM {source} s JOIN {target} t ON s.comparison_id = t.comparison_id AND " + " AND ".join(f"s.{n} = t.{n}" for n in "ijk" if n != x) for x, w in zip("ijk", step)
    )
    return f"SELECT comparison_id, i, j, k, min(d) AS d FROM ({lines}) WHERE (comparison_id, i, j, k) NOT IN (SELECT (comparison_id, i, j, k) FROM {target}) GROUP BY ALL"


def _axis(source: str, target: str, step: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> str:
    return f"SELECT comparison_id, avg(d) AS d FROM ({_axis_rows(source, target, step)}) GROUP BY 1"


@query(VOXELS_SQL + f", u AS ({_axis('a', 'b')}), o AS ({_axis('b', 'a')}), e AS (SELECT DISTINCT comparison_id FROM c2) SELECT comparison_id, round(coalesce(u.d, 0), 9) AS umdc, round(coalesce(o.d, 0), 9) AS omdc, round((coalesce(u.d, 0) + coalesce(o.d, 0)) / 2, 9) AS mdc FROM e LEFT JOIN u USING (comparison_id) LEFT JOIN o USING (comparison_id)")
def voxel_mdc(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = V.mean_distances(_cells(spark, sf_dir))
    return d.select("comparison_id", *[F.round(c, 9).alias(c) for c in ("umdc", "omdc", "mdc")])


@query(VOXELS_SQL + "SELECT comparison_id, k, count(*) FILTER (in_a AND NOT in_b) AS under, count(*) FILTER (in_b AND NOT in_a) AS over, count(*) FILTER (in_a AND in_b) AS common FROM c2 GROUP BY 1, 2")
def voxel_slice_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.slice_counts(_cells(spark, sf_dir))


@query()
def voxel_surface_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.metrics(_cells(spark, sf_dir), SIZE, names=["surface_dsc", "apl"]).drop("error")


@query()
def voxel_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return LI.voxels(K.largest_parts(LI.lines(_marked(spark, sf_dir, "A"))))


@query()
def voxel_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.run([{"type": "smooth", "structures": ["a"]}], {"a": _marked(spark, sf_dir, "A")}, SIZE)


# mask pipelines: mask_queries.py


# --- lists and states -------------------------------------------------------------------


@query(cte("patient") + "SELECT patient_id FROM patient WHERE contains(lower(patient_name), '12') OR contains(lower(gender), '12')")
def search_any_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.search(T.patients(spark, sf_dir), ["patient_name", "gender"], "12").select("patient_id")


@query(cte("study") + "SELECT study_uid FROM study WHERE modality = 'F' AND study_date >= DATE '1997-01-01' AND study_date <= DATE '1997-06-30'")
def optional_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.optional(T.studies(spark, sf_dir), {"modality": "F", "study_description": ""}, {"study_date": ("1997-01-01", "1997-06-30"), "accession": (None, None)}).select("study_uid")


@query("""SELECT event_id FROM (SELECT event_id, ts, CASE WHEN user_id % 3 = 0 THEN NULL WHEN user_id % 3 = 1 THEN 'TASK_NOT_FOUND' ELSE 'RTSTRUCT_READY' END AS s FROM events WHERE event_type <> 'error')
WHERE (s IS NULL OR s <> 'RTSTRUCT_READY') AND NOT (coalesce(s, '') = 'TASK_NOT_FOUND' AND ts < TIMESTAMP '2024-01-30' - INTERVAL 7 DAY)""")
def polling_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.transactions(spark, sf_dir)
    status = F.when(F.col("ae") % 3 == 0, None).when(F.col("ae") % 3 == 1, "TASK_NOT_FOUND").otherwise("RTSTRUCT_READY")
    exports = e.select("event_id", F.col("ts").alias("transfer_time"), status.alias("server_status"), F.when(F.col("kind") == "error", "FAILED").otherwise("COMPLETED").alias("transfer_status"))
    return L.to_poll(exports, F.lit("2024-01-30").cast("timestamp_ntz"), ["RTSTRUCT_READY"]).select("event_id")


@query("SELECT event_id FROM events WHERE user_id % 2 = 0 AND ('10.0.' || (user_id % 4) || '.1' LIKE '10.0.2%' OR contains('10.0.' || (user_id % 4) || '.1', '0.0.1'))")
def allow_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.transactions(spark, sf_dir).withColumn("ae_title", F.col("ae").cast("string")).withColumn("ip", F.concat(F.lit("10.0."), (F.col("ae") % 4).cast("string"), F.lit(".1")))
    titles = e.select("ae_title", (F.col("ae") % 2 == 0).alias("is_active")).distinct()
    return L.allowed(e, titles, ["10.0.2/24", " 0.0.1"]).select("event_id")


@query("SELECT p_partkey FROM part")
def batch_gate_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.gate(T.table(spark, sf_dir, "part"), {"size": F.col("p_size") > 0, "name": F.col("p_name") != ""}).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE (SELECT min(p_size) FROM part) > 5")
def batch_gate_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.gate(T.table(spark, sf_dir, "part"), {"size": F.col("p_size") > 5}).select("p_partkey")


@query("""SELECT l_orderkey, destination, attempt FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY attempt) AS k FROM (SELECT l_orderkey, destination, ok,
row_number() OVER (PARTITION BY l_orderkey ORDER BY is_primary DESC, priority, destination) AS attempt FROM (SELECT DISTINCT l_orderkey, l_suppkey AS destination, l_suppkey % 5 = 0 AS is_primary, l_suppkey % 7 AS priority, l_suppkey % 3 > 0 AS ok FROM lineitem)) WHERE ok) WHERE k = 1""")
def export_destination(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("l_suppkey")
    attempts = T.table(spark, sf_dir, "lineitem").select("l_orderkey", s.alias("destination"), (s % 5 == 0).alias("is_primary"), (s % 7).alias("priority"), (s % 3 > 0).alias("success")).distinct()
    return L.first_success(attempts, "l_orderkey")


#: The states, first to last, and each step that is allowed by their numbers.
STATES = [
    "UNPROCESSED", "RULE_NOT_MATCHED", "RULE_MATCHED", "MULTIPLE_RULES_MATCHED", "DEIDENTIFIED_SUCCESSFULLY", "DEIDENTIFICATION_FAILED", "PENDING_TRANSFER_TO_DRAW_SERVER",
    "SENT_TO_DRAW_SERVER", "FAILED_TRANSFER_TO_DRAW_SERVER", "RTSTRUCTURE_RECEIVED", "INVALID_RTSTRUCTURE_RECEIVED", "RTSTRUCTURE_EXPORTED", "RTSTRUCTURE_EXPORT_FAILED",
]
STEPS = [(1, 2), (1, 3), (1, 4), (3, 5), (3, 6), (4, 5), (4, 6), (5, 7), (7, 8), (7, 9), (8, 10), (8, 11), (10, 12), (10, 13)]


@query(f"""WITH s AS (SELECT {STATES} AS s), p AS (SELECT * FROM (VALUES {str(STEPS)[1:-1]}) p(a, b)), o AS (SELECT o_orderkey, o_orderkey % 13 + 1 AS x, o_orderkey // 13 % 13 + 1 AS y FROM orders)
SELECT o_orderkey, s[CASE WHEN b IS NULL THEN x ELSE y END] AS status FROM o CROSS JOIN s LEFT JOIN p ON a = x AND b = y""")
def status_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of states is tried."""
    of = lambda k: F.element_at(F.array(*map(F.lit, STATES)), (k % 13 + 1).cast("int"))
    key = F.col("o_orderkey")
    return T.table(spark, sf_dir, "orders").select("o_orderkey", L.next_status(of(key), of(F.floor(key / 13))).alias("status"))


@query("""SELECT o_orderkey, CASE WHEN f > 0 AND d < t THEN 'partial' ELSE 'completed' END AS status FROM (SELECT l_orderkey AS o_orderkey, count(*) AS t, count(*) FILTER (l_returnflag <> 'N' OR l_linenumber = 1) AS d, count(*) FILTER (l_returnflag = 'R') AS f FROM lineitem GROUP BY 1)""")
def retrieve_job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = T.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("t"), F.count_if((F.col("l_returnflag") != "N") | (F.col("l_linenumber") == 1)).alias("d"), F.count_if(F.col("l_returnflag") == "R").alias("f"))
    return n.select("o_orderkey", L.job_status(F.col("t"), F.col("d"), F.col("f")).alias("status"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN (CASE WHEN p_size > 30 THEN 'value' END) WHEN 1 THEN 'operator' ELSE (CASE WHEN p_size > 30 THEN 'value' END) END AS error FROM part""")
def rule_write_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    value = F.when(F.col("p_size") > 30, F.lit("x y")).otherwise(F.col("p_size").cast("string"))
    vr = F.when(k == 0, "DS").when(k == 1, "LO").otherwise("")
    operator = F.when(k == 1, "GREATER_THAN").otherwise("LESS_THAN")
    return T.table(spark, sf_dir, "part").select("p_partkey", L.rule_error(vr, operator, value).alias("error"))


@query("""SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey, CASE WHEN a.p_partkey IS NULL THEN 'created' WHEN b.p_partkey IS NULL THEN 'removed' WHEN a.v = b.v THEN 'same' ELSE 'updated' END AS change
FROM (SELECT p_partkey, p_brand AS v FROM part WHERE p_size < 30) a FULL JOIN (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_name END AS v FROM part WHERE p_size > 10) b USING (p_partkey)""")
def mapping_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.table(spark, sf_dir, "part")
    wanted = p.filter("p_size > 10").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise(F.col("p_name")).alias("v"))
    return L.mapping_changes(p.filter("p_size < 30").select("p_partkey", F.col("p_brand").alias("v")), wanted, "p_partkey", "v")


@query("""WITH n AS (SELECT s_suppkey AS node, s_suppkey % 4 = 0 AS p, s_suppkey % 3 = 0 AS f, s_suppkey % 10 AS priority FROM supplier) SELECT 'primary_and_fallback' AS rule, node FROM n WHERE p AND f
UNION ALL SELECT 'priority', node FROM (SELECT *, count(*) OVER (PARTITION BY priority) AS c FROM n WHERE f) WHERE c > 1""")
def node_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    nodes = T.table(spark, sf_dir, "supplier").select(s.alias("node"), (s % 4 == 0).alias("is_primary"), (s % 3 == 0).alias("is_fallback"), (s % 10).alias("priority"))
    return L.violations(nodes)


@query("""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN l_linestatus = 'F' AND l_linenumber = 3 THEN 'checksum' WHEN l_quantity > 45 THEN 'unreadable' WHEN l_returnflag = 'N' THEN 'modality' WHEN l_linenumber = 2 THEN 'series' END AS reason FROM lineitem) GROUP BY 1""")
def rtstruct_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    files = T.table(spark, sf_dir, "lineitem").select(
        (F.col("l_quantity") <= 45).alias("readable"), F.when(F.col("l_returnflag") == "N", "CT").otherwise("RTSTRUCT").alias("modality"), F.when(n != 1, n).alias("referenced_series"),
        F.when(n == 2, 0).otherwise(n).alias("expected_series"), F.when(F.col("l_linestatus") == "F", F.when(n == 3, "x").otherwise("y")).alias("header_checksum"), F.lit("y").alias("checksum"),
    )
    return R.breakdown(L.accepted(files), "reason")


@query("""SELECT l_orderkey, l_suppkey, top + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey) AS roi_number FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_returnflag = 'N') JOIN (SELECT l_orderkey, max(l_linenumber) AS top FROM lineitem GROUP BY 1) USING (l_orderkey)""")
def append_rois(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = T.table(spark, sf_dir, "lineitem")
    rows = line.select("l_orderkey", F.col("l_linenumber").alias("roi_number"))
    added = line.filter("l_returnflag = 'N'").select("l_orderkey", "l_suppkey").distinct()
    return L.append_numbered(rows, added, "l_orderkey", "roi_number", "l_suppkey").select("l_orderkey", "l_suppkey", F.col("roi_number").cast("long").alias("roi_number"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, least(255.0, greatest(0.0, (l_quantity * 10.0 - 100.0 - 0.0) / 200.0 * 255)) AS shade FROM lineitem")
def windowed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", L.windowed(F.col("l_quantity"), 100.0, 200.0, 10.0, -100.0).alias("shade"))


@query("""SELECT template, count(DISTINCT model) AS n_models, count(*) AS n_structures FROM (SELECT DISTINCT p_type AS template, p_brand AS model, p_name AS structure FROM part) GROUP BY 1""")
def template_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.table(spark, sf_dir, "part").select(F.col("p_type").alias("template"), F.col("p_brand").alias("model"), F.col("p_name").alias("structure")).distinct()
    per_model = p.groupBy("template", "model").agg(F.count("*").alias("n"))
    return per_model.groupBy("template").agg(F.count("*").alias("n_models"), F.sum("n").alias("n_structures"))


from . import catalog_queries, list_queries, mask_queries, stream_queries  # noqa: E402, F401
