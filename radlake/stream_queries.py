"""Queries that write files or run streams over the tables: header scans, structure sets, series completion, file formats."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.tags import NUMBERS
from .operators import catalog as C
from .registry import query
from .sources import dicom, files
from .sources import tables as T
from .sources.tables import cte
from .streaming import completion, ingest

# --- files -------------------------------------------------------------------------------


def _image(key: int, name: str) -> bytes:
    """A header made of a patient: explicit little-endian, with a sequence, a private tag and pixels."""
    modality = "CT MR PT US".split()[key % 4]
    tags = {
        "SOPInstanceUID": ("UI", "" if key % 11 == 0 else f"1.2.{key}"), "StudyDate": ("DA", f"{1990 + key % 20}0102"), "Modality": ("CS", modality), "StudyDescription": ("LO", f"Study {key % 7}"),
        "SeriesDescription": ("LO", "CT Scout view" if key % 5 == 0 else "Axial"), "PatientName": ("PN", name), "PatientID": ("LO", str(key)), "StudyInstanceUID": ("UI", f"9.{key}"), "SeriesInstanceUID": ("UI", f"9.{key}.1"),
    }
    parts = [(NUMBERS[k], dicom.element(NUMBERS[k], vr, v.encode())) for k, (vr, v) in tags.items() if v]
    parts += [(0x00081032, dicom.sequence(0x00081032, [dicom.element(0x00080100, "SH", b"x")], undefined=bool(key % 2))), (0x00090010, dicom.element(0x00090010, "LO", b"private"))]
    body = b"".join(b for _, b in sorted(parts)) + dicom.element(dicom.PIXELS, "OW", b"\0" * 4000)
    return b"\0" * 128 + b"DICM" + dicom.element(0x00020010, "UI", b"1.2.840.10008.1.2.1") + body


def _structures(key: int, name: str) -> bytes:
    """A structure set of a supplier: three ROIs with a contour each, and the series they refer to."""
    e, n = dicom.element, NUMBERS
    image = e(n["ReferencedSOPInstanceUID"], "UI", f"1.2.{key}".encode())
    series = e(n["SeriesInstanceUID"], "UI", f"S.{key}".encode()) + dicom.sequence(n["ContourImageSequence"], [image, image])
    frame = e(n["FrameOfReferenceUID"], "UI", b"F.1") + dicom.sequence(n["RTReferencedStudySequence"], [dicom.sequence(n["RTReferencedSeriesSequence"], [series], undefined=True)])
    number = lambda k, tag: e(n[tag], "IS", str(k).encode())
    rois = [number(k, "ROINumber") + e(n["ROIName"], "LO", f"{name} {k}".encode()) for k in (1, 2, 3)]
    contours = [e(n["ROIDisplayColor"], "IS", b"255\\0\\" + str(k).encode()) + dicom.sequence(n["ContourSequence"], [e(n["ContourData"], "DS", f"{k}\\1\\2\\3\\4\\5.5".encode())]) + number(k, "ReferencedROINumber") for k in (1, 2, 3)]
    seen = [number(k, "ReferencedROINumber") + e(n["RTROIInterpretedType"], "CS", b"ORGAN") for k in (1, 2)]
    body = e(n["SOPInstanceUID"], "UI", f"R.{key}".encode()) + e(n["Modality"], "CS", b"RTSTRUCT")
    body += dicom.sequence(n["ReferencedFrameOfReferenceSequence"], [frame], undefined=bool(key % 2)) + dicom.sequence(n["StructureSetROISequence"], rois)
    body += dicom.sequence(n["ROIContourSequence"], contours, undefined=True) + dicom.sequence(n["RTROIObservationsSequence"], seen)
    return b"\0" * 128 + b"DICM" + e(0x00020010, "UI", b"1.2.840.10008.1.2.1") + body


def _written(rows: DataFrame, make, folder: str) -> str:
    """Writes a file for each (key, name); tasks write to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [make(k, n) for k, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([f"p{k % 10}/{k}.dcm" for k in batch.column(0).to_pylist()]), pa.array(made, pa.binary())], ["name", "content"])

    files.write_files(rows.mapInArrow(run, "name string, content binary"), folder)
    return folder


@query("""SELECT c_custkey::VARCHAR || '.dcm' AS file, CASE WHEN c_custkey % 4 = 3 THEN 'skipped' WHEN c_custkey % 11 = 0 THEN 'error' WHEN c_custkey % 5 = 0 OR 1990 + c_custkey % 20 < 1995 THEN 'skipped' ELSE 'success' END AS status,
CASE WHEN c_custkey % 4 = 3 THEN 'unsupported_modality' WHEN c_custkey % 11 = 0 THEN 'missing_sop_uid' WHEN c_custkey % 5 = 0 THEN 'localizer_series' WHEN 1990 + c_custkey % 20 < 1995 THEN 'study_date_before_filter' END AS reason,
CASE WHEN NOT (c_custkey % 4 = 3 OR c_custkey % 11 = 0 OR c_custkey % 5 = 0 OR 1990 + c_custkey % 20 < 1995) THEN c_name END AS patient_name, CASE WHEN NOT (c_custkey % 4 = 3 OR c_custkey % 11 = 0 OR c_custkey % 5 = 0 OR 1990 + c_custkey % 20 < 1995) THEN (1990 + c_custkey % 20)::VARCHAR || '0102' END AS study_date FROM customer""")
def dicom_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each patient is written and scanned with all filters."""
    rows = T.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    folder = _written(rows, _image, files.shared_folder(spark, "dicom"))
    found = dicom.scan_images(spark, folder, dt.datetime(2100, 1, 1), dt.datetime(1995, 1, 1), by_study_date=True, exclude_localizers=True)
    return found.select(F.element_at(F.split("file_path", "/"), -1).alias("file"), "status", "reason", "patient_name", "study_date")


@query("""SELECT c_custkey::VARCHAR AS id, c_name AS name, CASE c_custkey % 4 WHEN 0 THEN 'CT' WHEN 1 THEN 'MR' WHEN 2 THEN 'PT' ELSE 'US' END AS modality, 'Study ' || (c_custkey % 7) AS description, 'private' AS private, NULL::VARCHAR AS sequence FROM customer""")
def dicom_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tag maps by name and number; sequences are left out, private tags stand by number."""
    rows = T.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    folder = _written(rows, _image, files.shared_folder(spark, "dicom"))
    get = lambda k: F.try_element_at("tags", F.lit(k))
    return dicom.scan(spark, folder).select(get("Patient ID").alias("id"), get("Patient's Name").alias("name"), get("(0008,0060)").alias("modality"), get("Study Description").alias("description"), get("(0009,0010)").alias("private"), get("(0008,1032)").alias("sequence"))


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, name, dataset): the structure sets of the suppliers, written as files and read as JSON."""
    rows = T.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    folder = _written(rows, _structures, files.shared_folder(spark, "rtstruct"))
    found = dicom.headers(spark, folder, "json").filter("modality = 'RTSTRUCT'")
    return found.select(F.regexp_extract("path", r"([0-9]+)\.dcm$", 1).cast("long").alias("key"), "dataset").join(rows, "key")


@query("""SELECT s_suppkey AS key, s_name || 'é' AS patient, CASE WHEN s_suppkey % 3 = 0 THEN 'ORIG.S.' ELSE 'S.' END || s_suppkey AS series_uid, CASE WHEN s_suppkey % 3 = 0 THEN 'ORIG.' ELSE '1.2.' END || s_suppkey AS image,
CASE WHEN s_suppkey % 2 = 0 THEN 'FX.' || s_suppkey ELSE 'F.1' END AS frame, 3::BIGINT AS n_rois, (1 + 2 + 3) * 1.0::DOUBLE AS first_points FROM supplier""")
def reid_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structure sets are given their patients, frames and references back, written as files by the data source, and read again."""
    key = F.col("key").cast("string")
    uids = F.when(F.col("key") % 3 == 0, F.create_map(F.concat(F.lit("S."), key), F.concat(F.lit("ORIG.S."), key), F.concat(F.lit("1.2."), key), F.concat(F.lit("ORIG."), key)))
    rows = _sets(spark, sf_dir).select("key", "dataset", F.create_map(F.lit("PatientName"), F.concat("name", F.lit("é")), F.lit("PatientID"), key, F.lit("StudyID"), F.lit("")).alias("fields"), F.when(F.col("key") % 2 == 0, F.concat(F.lit("FX."), key)).alias("frame"), uids.alias("uids"))
    folder = files.shared_folder(spark, "back")
    dicom.write(dicom.reidentified_json(rows).select(F.concat(F.lit("p"), (F.col("key") % 7).cast("string"), F.lit("/"), key, F.lit(".dcm")).alias("name"), "dataset"), folder, implicit=True)
    sets = dicom.scan_structure_sets(spark, folder)
    names = dicom.scan(spark, folder).select("path", F.try_element_at("tags", F.lit("Patient's Name")).alias("patient"))
    out = sets.join(names, "path")
    points = F.aggregate(F.transform("contours", lambda c: c["points"][0]), F.lit(0.0), lambda a, x: a + x)
    return out.select(F.col("patient_id").cast("long").alias("key"), "patient", F.col("referenced_series_uid").alias("series_uid"), F.col("referenced_sop_uids")[0].alias("image"), F.col("frame_uids")[0].alias("frame"), F.size("rois").cast("long").alias("n_rois"), points.alias("first_points"))


@query("""SELECT s_suppkey AS key, k AS number, s_name || ' ' || k AS name, '255\\0\\' || k AS color, k + 15.5::DOUBLE AS total, CASE WHEN k < 3 THEN 'ORGAN' END AS type FROM supplier, (VALUES (1), (2), (3)) t(k)""")
def structure_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table function over structure sets, in SQL with lateral joins."""
    dicom.register_functions(spark)
    _sets(spark, sf_dir).createOrReplaceTempView("structure_sets")
    return spark.sql(
        """SELECT s.key, r.number, r.name, c.color, aggregate(c.points, 0D, (a, x) -> a + x) AS total, o.type
        FROM structure_sets s, LATERAL structure_parts(dataset, 'rois') r
        JOIN (SELECT key, c.* FROM structure_sets, LATERAL structure_parts(dataset, 'contours') c) c ON c.key = s.key AND c.roi_number = r.number
        LEFT JOIN (SELECT key, o.* FROM structure_sets, LATERAL structure_parts(dataset, 'observations') o) o ON o.key = s.key AND o.roi_number = r.number"""
    )


#: Character set, codec and a name in it, by the patient's number.
_NAMES = [("ISO_IR 100", "latin-1", "Müller"), ("ISO_IR 144", "iso8859-5", "Пётр"), ("ISO_IR 192", "utf-8", "王小东"), ("GB18030", "gb18030", "王小东"), ("\\ISO 2022 IR 87", "iso2022_jp", "山田"), ("", "ascii", "Smith")]


def _named(key: int, name: str) -> bytes:
    charset, codec, own = _NAMES[key % len(_NAMES)]
    e = dicom.element
    body = (e(0x00080005, "CS", charset.encode()) if charset else b"") + e(NUMBERS["Modality"], "CS", b"CT") + e(NUMBERS["Manufacturer"], "LO", f"{own} {key % 3}".encode(codec)) + e(NUMBERS["PatientName"], "PN", f"{own}^{name}".encode(codec)) + e(NUMBERS["KVP"], "DS", b"120")
    return b"\0" * 128 + b"DICM" + e(0x00020010, "UI", b"1.2.840.10008.1.2.1") + body


@query(f"""SELECT c_custkey AS id, n || '^' || c_name AS name, n || ' ' || (c_custkey % 3) AS manufacturer, '120' AS kvp FROM customer JOIN (VALUES {', '.join(f"({k}, '{n}')" for k, (_, _, n) in enumerate(_NAMES))}) t(k, n) ON c_custkey % {len(_NAMES)} = k""")
def dicom_character_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in six character sets, read through the data source, with tags that rules name."""
    rows = T.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    folder = _written(rows, _named, files.shared_folder(spark, "dicom"))
    found = dicom.headers(spark, folder, "tags").filter("modality = 'CT' AND size > 132")
    key = F.regexp_extract("path", r"([0-9]+)\.dcm$", 1).cast("long")
    get = lambda k: F.try_element_at("tags", F.lit(k))
    return found.select(key.alias("id"), get("Patient's Name").alias("name"), get("Manufacturer").alias("manufacturer"), get("KVP").alias("kvp"))


@query(r"""SELECT 'R.' || s_suppkey AS sop_uid, 'S.' || s_suppkey AS referenced_series_uid, 2::BIGINT AS n_images, k AS number, s_name || ' ' || k AS name, '255\0\' || k AS color, (k + 15.5)::DOUBLE AS total, CASE WHEN k < 3 THEN 'ORGAN' END AS type FROM supplier, (VALUES (1), (2), (3)) t(k)""")
def structure_set_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A structure set for each supplier is written and read: ROIs, contours, observations and what they refer to."""
    rows = T.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    folder = _written(rows, _structures, files.shared_folder(spark, "rtstruct"))
    sets = dicom.scan_structure_sets(spark, folder)
    one = lambda array, field: F.filter(array, lambda x: x["roi_number"] == F.col("r.number"))[0][field]
    each = sets.select("sop_uid", "referenced_series_uid", F.size("referenced_sop_uids").cast("long").alias("n_images"), F.explode("rois").alias("r"), "contours", "observations")
    got = lambda a, f: F.get(F.transform(F.filter(a, lambda x: x["roi_number"] == F.col("r.number")), lambda x: x[f]), 0)
    return each.select("sop_uid", "referenced_series_uid", "n_images", "r.number", "r.name", got("contours", "color").alias("color"), F.aggregate(got("contours", "points"), F.lit(0.0), lambda a, x: a + x).alias("total"), got("observations", "type").alias("type"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A template document for each part: two kinds that have parsers and one that has none, behind comments; elements lie at several depths."""
    root = F.element_at(F.array(*map(F.lit, ("StructureTemplate", "Protocol", "Other"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    p = F.col("p_name")
    preview = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit('<Preview ID="T'), F.col("p_partkey").cast("string"), F.lit('" Diagnosis="C61" TreatmentSite="'), "p_brand", F.lit('" Type="Protocol"/>'))).otherwise("")
    parts = [
        F.concat(F.lit('<Structure Name="'), p, F.lit('"><Identification><VolumeType>ptv</VolumeType></Identification><ColorAndStyle>Red</ColorAndStyle></Structure>')),
        F.concat(F.lit('<Structure ID="'), p, F.lit(' 1" Name="other"><Identification><Volume><VolumeType>Body</VolumeType></Volume></Identification><Look><ColorAndStyle>Segment - Cyan</ColorAndStyle></Look></Structure>')),
        F.lit('<!-- <Structure ID="no"/> --><Group><Structure ID="" Name="in a group"><VolumeType>none</VolumeType></Structure></Group>'),
    ]
    xml = F.concat(F.lit("<?xml version='1.0'?>\n<!-- <Other> -->"), F.lit("<"), root, F.lit(">"), preview, F.lit("<Structures>"), *parts, F.lit("</Structures></"), root, F.lit(">"))
    return T.table(spark, sf_dir, "part").select("p_partkey", xml.alias("xml"))


@query("""SELECT p_partkey, k AS position, CASE WHEN k = 1 THEN p_name || ' 1' END AS id, CASE k WHEN 0 THEN p_name WHEN 1 THEN p_name || ' 1' ELSE 'in a group' END AS name, CASE k WHEN 0 THEN 'ptv' WHEN 1 THEN 'Body' ELSE 'none' END AS volume_type,
CASE WHEN k = 0 THEN 'PTV' WHEN k = 1 THEN 'EXTERNAL' END AS type, CASE WHEN k = 0 THEN '255\\0\\0' WHEN k = 1 THEN '0\\255\\255' END AS color FROM part, (VALUES (0), (1), (2)) t(k) WHERE p_partkey % 3 <> 2""")
def xml_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Template documents of two kinds through their registered parsers; a third kind has none, and is left out."""
    got = files.parse_templates(_documents(spark, sf_dir))
    return got.select("p_partkey", F.col("position").cast("int").alias("position"), "id", "name", "volume_type", "type", "color")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'T' || p_partkey ELSE '' END AS template_id, CASE WHEN p_partkey % 2 = 0 THEN 'C61' ELSE '' END AS diagnosis, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '' END AS treatment_site,
'' AS description, CASE WHEN p_partkey % 2 = 0 THEN 'Protocol' ELSE 'StructureTemplate' END AS type, 'Varian Eclipse' AS vendor, 3 AS total_structures FROM part""")
def xml_template_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the preview element of each document says."""
    return files.template_info(_documents(spark, sf_dir))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'unknown' WHEN 1 THEN 'no_structures' ELSE 'invalid' END AS error FROM part WHERE p_partkey % 5 < 3")
def xml_template_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of an unknown kind, without structures or not well-formed."""
    kinds = [F.concat(F.lit('<Other><Structure Name="'), "p_name", F.lit('"/></Other>')), F.concat(F.lit("<Protocol><!--"), "p_name", F.lit("--></Protocol>")), F.concat(F.lit("<Protocol><Structure>"), "p_name")]
    good = F.concat(F.lit('<!-- x --><Protocol><Structure Name="'), "p_name", F.lit('"/></Protocol>'))
    k = F.col("p_partkey") % 5
    xml = F.when(k == 0, kinds[0]).when(k == 1, kinds[1]).when(k == 2, kinds[2]).otherwise(good)
    return files.template_errors(T.table(spark, sf_dir, "part").select("p_partkey", xml.alias("xml"))).select("p_partkey", "error")


@query("SELECT DISTINCT p_type AS model_name, p_brand AS model_id, 'c' AS model_config, p_partkey::VARCHAR AS map_id, p_name AS map_tg263_primary_name FROM part")
def model_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a catalog, one for each type, with a model for each brand and its structures."""
    p = T.table(spark, sf_dir, "part")
    structure = F.struct(F.col("p_partkey").cast("string").alias("map_id"), F.col("p_name").alias("map_tg263_primary_name"))
    models = p.groupBy("p_type", "p_brand").agg(F.collect_list(structure).alias("modelmap"))
    model = F.struct(F.col("p_brand").alias("id"), F.col("p_type").alias("name"), F.lit("c").alias("config"), "modelmap")
    answers = models.groupBy("p_type").agg(F.to_json(F.collect_list(model)).alias("body"))
    return files.model_catalog(answers).select("model_name", "model_id", "model_config", "map_id", "map_tg263_primary_name")


@query("SELECT 'day' || (event_id % 7) || '.log' AS file, event_id || ' ' || upper(event_type) || ' by ' || user_id AS value FROM events WHERE event_type = 'error' OR contains(user_id::VARCHAR, 'error')")
def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs of seven days are written and searched without regard to case."""
    folder = files.shared_folder(spark, "logs")
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    line = F.concat(F.col("event_id").cast("string"), F.lit(" "), F.upper("event_type"), F.lit(" by "), F.col("user_id").cast("string"))
    logs = e.select(F.concat(F.lit("day"), (F.col("event_id") % 7).cast("string"), F.lit(".log")).alias("name"), line.alias("line"))
    files.write_files(logs.groupBy("name").agg(F.encode(F.array_join(F.collect_list("line"), "\n"), "UTF-8").alias("content")), folder)
    return files.log_search(spark, folder, "Error")


@query("SELECT p_partkey AS row, p_name AS modification_type FROM part")
def seed_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seed list goes to CSV and comes back."""
    folder = files.shared_folder(spark, "csv")
    p = T.table(spark, sf_dir, "part")
    files.export_csv(p.select("p_partkey", F.col("p_name").alias("modification_type")), folder)
    return files.seed_csv(spark, folder, "row long, modification_type string")


@query("SELECT count(*) AS n, count(DISTINCT l_orderkey) AS n_orders, 0::BIGINT AS n_again FROM lineitem")
def bulk_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows are appended by batches; a batch that is written again adds nothing."""
    folder = files.shared_folder(spark, "store")
    line = T.table(spark, sf_dir, "lineitem").withColumn("batch", (F.col("l_orderkey") % 2).cast("int"))
    for batch in (0, 1, 1):
        files.append_batch(line.filter(F.col("batch") == batch), folder, "batch")
    back = spark.read.parquet(folder)
    again = back.groupBy(*line.columns).agg(F.count("*").alias("a")).join(line.groupBy(*line.columns).agg(F.count("*").alias("b")), line.columns, "left").filter("a > b")
    return back.agg(F.count("*").alias("n"), F.count_distinct("l_orderkey").alias("n_orders")).crossJoin(again.agg(F.count("*").alias("n_again")))  # one row each


# --- streams -------------------------------------------------------------------------------


@query("""SELECT ae, series_uid, count(*) AS n, min(ts)::VARCHAR AS first, count(DISTINCT event_id) AS n_sops FROM (SELECT *, sum(c) OVER (PARTITION BY ae ORDER BY ts, event_id) AS run FROM (SELECT event_id, ts, user_id AS ae, event_type AS series_uid,
coalesce((lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) <> event_type)::INT, 1) AS c FROM events)) GROUP BY ae, series_uid, run""")
def stream_series_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The receive stream: a sender that goes on to another series, or releases its association, completes the one before."""
    folder = files.shared_folder(spark, "stream")
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("ae"), F.col("event_type").alias("series_uid"))
    e = e.withColumns({"sop_uid": F.col("event_id").cast("string"), "path": F.concat(F.lit("/in/"), F.col("event_id").cast("string")), "released": F.lit(False)})
    last = e.groupBy("ae").agg(F.max("ts").alias("ts"), F.max("event_id").alias("event_id"))
    ends = last.select((F.col("event_id") + 10**9).alias("event_id"), (F.col("ts") + F.expr("INTERVAL 1 SECOND")).alias("ts"), "ae", *[F.lit(None).cast("string").alias(c) for c in ("series_uid", "sop_uid", "path")], F.lit(True).alias("released"))
    rows = e.unionByName(ends)
    rows.repartitionByRange(4, "ts").sortWithinPartitions("ts", "event_id").write.mode("overwrite").parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 10).parquet(f"{folder}/in")
    run = completion.completed_series(stream).writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/out").outputMode("append")
    completion.run_to_end(spark, run)
    done = spark.read.schema(completion.OUT).parquet(f"{folder}/out")
    return done.select("ae", "series_uid", "n", F.date_format("first", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("first"), F.size(F.array_distinct("sop_uids")).cast("long").alias("n_sops")).withColumn("first", F.regexp_replace("first", r"\.?0+$", ""))


@query("""WITH f AS (SELECT user_id AS ae, event_type AS series_uid, min(struct_pack(ts := ts, e := event_id)) AS f FROM events GROUP BY ALL), r AS (SELECT *, lead(f) OVER (PARTITION BY ae ORDER BY f) AS n FROM f)
SELECT r.ae, r.series_uid, count(*) FILTER (n IS NULL OR struct_pack(ts := ts, e := event_id) < n) AS files, count(DISTINCT event_id % 5) FILTER (n IS NULL OR struct_pack(ts := ts, e := event_id) < n) AS images, count(*) FILTER (n IS NOT NULL AND struct_pack(ts := ts, e := event_id) > n) AS late
FROM events JOIN r ON user_id = r.ae AND event_type = r.series_uid GROUP BY ALL""")
def stream_late_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a series that is complete are dropped and counted; images that come twice count twice, as files."""
    folder = files.shared_folder(spark, "late")
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("ae"), F.col("event_type").alias("series_uid"))
    e = e.withColumns({"sop_uid": (F.col("event_id") % 5).cast("string"), "path": F.concat(F.lit("/in/"), F.col("event_id").cast("string")), "released": F.lit(False)})
    last = e.groupBy("ae").agg(F.max("ts").alias("ts"), F.max("event_id").alias("event_id"))
    ends = last.select((F.col("event_id") + 10**9).alias("event_id"), (F.col("ts") + F.expr("INTERVAL 1 SECOND")).alias("ts"), "ae", *[F.lit(None).cast("string").alias(c) for c in ("series_uid", "sop_uid", "path")], F.lit(True).alias("released"))
    rows = e.unionByName(ends)
    rows.repartitionByRange(4, "ts").sortWithinPartitions("ts", "event_id").write.mode("overwrite").parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
    out = completion.series_stream(stream, drop_late=True).writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/out").outputMode("append")
    completion.run_to_end(spark, out)
    done = spark.read.schema(completion.ALL).parquet(f"{folder}/out")
    total = lambda c, test: F.coalesce(F.sum(F.when(test, c)), F.lit(0)).cast("long")
    late = F.col("late")
    return done.groupBy("ae", "series_uid").agg(total(F.size("paths"), ~late).alias("files"), total(F.size("sop_uids"), ~late).alias("images"), total(F.col("n"), late).alias("late"))


#: Rows of a file that is ingested, about.
INGESTED = 1_000_000


class _Stopped(Exception):
    """A run that is killed after a batch is written and before it is noted as done."""


@query(cte("instance") + "SELECT sop_uid, series_uid, path FROM (SELECT *, row_number() OVER (PARTITION BY sop_uid ORDER BY path, size) AS k FROM instance) WHERE k = 1")
def stream_ingest_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ingest is stopped in its second batch of five and started again: the catalog is that of one pass."""
    folder = files.shared_folder(spark, "ingest")
    rows = T.instances(spark, sf_dir).select("sop_uid", "series_uid", "path", "size")
    batch = -(-rows.count() // (5 * INGESTED)) or 1  # files of a batch, so that a task's share does not grow with the input
    rows.repartition(5 * batch, "path").write.mode("overwrite").parquet(f"{folder}/in")

    def stop(number: int) -> None:
        if number == 1:
            raise _Stopped

    where = (f"{folder}/in", rows.schema, f"{folder}/out", f"{folder}/checkpoint", batch)
    try:
        ingest.ingest(spark, *where, seen=stop).awaitTermination()
    except StreamingQueryException:
        pass
    ingest.ingest(spark, *where).awaitTermination()
    return ingest.catalog(spark, rows.schema, f"{folder}/out", ["sop_uid"], ["path", "size"]).select("sop_uid", "series_uid", "path")


@query("""WITH d AS (SELECT l_orderkey, l_suppkey, l_linenumber, l_shipdate, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_suppkey, l_partkey, l_linenumber) AS k, l_suppkey AS dir FROM lineitem), f AS (SELECT l_orderkey, dir AS first_dir FROM d WHERE k = 1)
SELECT l_orderkey AS series_uid, first_dir AS directory, count(*) FILTER (dir = first_dir) AS n, count(*) FILTER (dir <> first_dir) AS n_dropped FROM d JOIN f USING (l_orderkey) GROUP BY ALL""")
def series_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series belongs to the directory in which it is met first; files of it elsewhere are reported, not taken."""
    line = T.table(spark, sf_dir, "lineitem")
    files_ = line.select(F.col("l_orderkey").alias("series_uid"), F.col("l_suppkey").alias("directory"), F.struct("l_shipdate", "l_suppkey", "l_partkey", "l_linenumber").alias("place"))
    return C.finalised(files_)


@query("SELECT (max(ts) - INTERVAL 7 DAY)::VARCHAR AS start, max(ts)::VARCHAR AS old FROM events")
def low_water_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that succeeds moves the start to seven days before it; one that fails leaves it."""
    e = T.transactions(spark, sf_dir).agg(F.max("ts").alias("t"))
    shown = lambda ok: C.next_start(F.col("t"), F.col("t"), F.lit(ok)).cast("string")
    return e.select(shown(True).alias("start"), shown(False).alias("old"))


def _events(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """A stream of the events, each of them twice."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("ae"), F.round(F.col("value") * 100).cast("long").alias("size"))
    e.union(e).repartitionByRange(4, "ts").sortWithinPartitions("ts").write.mode("overwrite").parquet(f"{folder}/in")
    return spark.readStream.schema(e.schema).parquet(f"{folder}/in")


@query("SELECT event_id, user_id AS ae FROM events")
def stream_without_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images that come twice are taken once; the log is appended to a sink."""
    folder = files.shared_folder(spark, "repeats")
    once = completion.without_repeats(_events(spark, sf_dir, folder), "event_id", "ts")
    writer = once.select("event_id", "ae").writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append")
    completion.run_to_end(spark, writer)
    return spark.read.schema("event_id long, ae long").parquet(f"{folder}/out")


@query("SELECT user_id AS ae, 2 * count(*) AS files, (2 * sum(CAST(round(value * 100) AS BIGINT)))::BIGINT AS bytes FROM events GROUP BY 1")
def stream_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running totals of each sender; the last ones are the result."""
    folder = files.shared_folder(spark, "counters")
    totals = completion.counters(_events(spark, sf_dir, folder), "ae", "size")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out")

    completion.run_to_end(spark, totals.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").outputMode("complete"))
    return spark.read.parquet(f"{folder}/out")


@query("SELECT count(*) AS n, count(DISTINCT event_id) AS n_events FROM (SELECT * FROM events UNION ALL SELECT * FROM events)")
def stream_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transaction log; a second run over the same checkpoint appends nothing."""
    folder = files.shared_folder(spark, "log")
    log = _events(spark, sf_dir, folder)
    for _ in range(2):
        completion.run_to_end(spark, completion.append_log(log, f"{folder}/out", f"{folder}/checkpoint"))
    return spark.read.schema(log.schema).parquet(f"{folder}/out").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("n_events"))


@query("SELECT count(*) AS n, sum(c_custkey)::BIGINT AS keys FROM customer")
def archive_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths, sizes and checksums of the files of an archive; they agree with the contents."""
    rows = T.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    folder = files.shared_folder(spark, "archive")
    contents = rows.select(F.concat(F.col("key").cast("string"), F.lit(".bin")).alias("name"), F.col("name").cast("binary").alias("content"))
    files.write_files(contents, folder)
    manifest = files.archive_manifest(spark, folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "size", "sha256")
    want = rows.select("key", F.concat(F.col("key").cast("string"), F.lit(".bin")).alias("file"), F.octet_length("name").cast("long").alias("size"), F.sha2("name", 256).alias("sha256"))
    return want.join(manifest, ["file", "size", "sha256"]).agg(F.count("*").alias("n"), F.sum("key").alias("keys"))
