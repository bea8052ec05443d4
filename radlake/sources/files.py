"""Other sources and sinks: file listings, templates in XML, model catalogs in JSON, logs, CSV exports."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.scalar import color, interpreted_type
from ..registry import PARSERS, register_parser
from ..scratch import shared_folder as shared_folder


def listing(spark: SparkSession, path: str) -> DataFrame:
    """path, mtime, size of every file below a folder; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.sha2("content", 256).alias("sha256"))


def model_catalog(responses: DataFrame) -> DataFrame:
    """A catalog response in ``body`` to one row per structure; the model's other fields get the prefix model_."""
    schema = "array<struct<id:string,name:string,config:string,trainer_name:string,postprocess:string,modelmap:array<struct<map_id:string,mapid:string,map_tg263_primary_name:string,major_category:string,anatomic_group:string>>>>"
    models = responses.select(F.explode(F.from_json("body", schema)).alias("m"))
    rows = models.select("m", F.explode("m.modelmap").alias("s"))
    return rows.select("s.*", *[F.col(f"m.{c}").alias(f"model_{c}") for c in ("id", "name", "config", "trainer_name", "postprocess")])


def log_search(spark: SparkSession, path: str, needle: str) -> DataFrame:
    """Lines that contain a text, without regard to case, with their file."""
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), "value")
    return lines.filter(F.lower("value").contains(needle.lower()))


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_files(rows: DataFrame, folder: str) -> int:
    """Writes (name, content) as files below a shared folder, in tasks; the number of files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = fs.FileSystem.from_uri(folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder)
        made = set()
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parent = f"{at}/{name}".rsplit("/", 1)[0]
                if parent not in made:
                    system.create_dir(parent)
                    made.add(parent)
                with system.open_output_stream(f"{at}/{name}") as out:
                    out.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return rows.select("name", "content").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


# --- template documents -------------------------------------------------------------------


#: What may stand before the first element: declarations, comments, a document type.
_PROLOG = r"(?s)^\uFEFF?(?:\s+|<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>\[]*(?:\[.*?\]\s*)?>)*<([A-Za-z_][\w.:-]*)"
STRUCTURES = "array<struct<id:string,name:string,volume_type:string,color_string:string>>"
TEMPLATE = f"struct<error:string,template_id:string,diagnosis:string,treatment_site:string,description:string,type:string,structures:{STRUCTURES}>"
#: Attributes of the preview element and what stands for a missing one (fixed values).
PREVIEW = {"template_id": ("ID", ""), "diagnosis": ("Diagnosis", ""), "treatment_site": ("TreatmentSite", ""), "description": ("Description", ""), "type": ("Type", "StructureTemplate")}


def _root(xml: Column) -> Column:
    """The name of the first element of a document; empty if there is none."""
    return F.regexp_extract(xml, _PROLOG, 1)


def template_of(xml: str | None) -> dict:
    """Metadata and structures of one document; elements may lie at any depth."""
    try:
        root = ElementTree.fromstring((xml or "").lstrip("\ufeff").strip())
    except ElementTree.ParseError:
        return {"error": "invalid", "structures": []}
    preview = root.find(".//Preview")
    found = {k: preview.get(name, missing) if preview is not None else missing for k, (name, missing) in PREVIEW.items()}
    text = lambda e: None if e is None else e.text
    structures = [
        {"id": e.get("ID", ""), "name": e.get("ID", "") or e.get("Name", ""), "volume_type": text(e.find(".//VolumeType")), "color_string": text(e.find(".//ColorAndStyle"))} for e in root.iterfind(".//Structure")
    ]
    return found | {"error": None if structures else "no_structures", "structures": structures}


def templates(documents: DataFrame) -> DataFrame:
    """Documents with ``template`` (TEMPLATE) in place of ``xml``."""
    others = [c for c in documents.columns if c != "xml"]
    schema = documents.select(*others).withColumn("template", F.lit(None).cast(TEMPLATE)).schema
    kind = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([template_of(x) for x in batch.column(len(others)).to_pylist()], kind.field("template").type)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], found], [*others, "template"])

    return documents.select(*others, F.col("xml").cast("string").alias("xml")).mapInArrow(run, schema)


def structures(documents: DataFrame) -> DataFrame:
    """Structures of template documents as they are stored: position from 0, id, name, volume_type, color_string. The name is the ID; without one, the Name."""
    rows = templates(documents)
    return rows.select(*[c for c in rows.columns if c != "template"], F.posexplode("template.structures").alias("position", "s")).select("*", "s.*").drop("s")


def template_info(documents: DataFrame) -> DataFrame:
    """Documents with their metadata, the vendor and the number of structures; documents without structures are none."""
    rows = templates(documents).filter("template.error IS NULL")
    others = [c for c in rows.columns if c != "template"]
    return rows.select(*others, *[F.col(f"template.{k}").alias(k) for k in PREVIEW], F.lit("Varian Eclipse").alias("vendor"), F.size("template.structures").alias("total_structures"))


def structures_of(documents: DataFrame) -> DataFrame:
    """Structures with their type and colour by DICOM; those that are none are null."""
    s = structures(documents).withColumns({"type": interpreted_type(F.col("volume_type")), "color": color(F.nullif("color_string", F.lit("")))})
    return s.withColumn("id", F.nullif("id", F.lit("")))


register_parser("StructureTemplate")(structures_of)
register_parser("Protocol")(structures_of)


def parse_templates(documents: DataFrame) -> DataFrame:
    """The structures of all documents (``xml``) whose root element has a parser."""
    parts = [parser(documents.filter(_root(F.col("xml")) == root)) for root, parser in PARSERS.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def template_errors(documents: DataFrame) -> DataFrame:
    """Documents with an error: not well-formed (invalid), of an unknown kind, or without structures."""
    known = documents.withColumn("_known", F.coalesce(_root(F.col("xml")).isin(list(PARSERS)), F.lit(False)))
    rows = templates(known)
    error = F.when(F.col("template.error") == "invalid", "invalid").when(~F.col("_known"), "unknown").otherwise(F.col("template.error"))
    return rows.withColumn("error", error).filter("error IS NOT NULL").drop("_known", "template")



def seed_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A seed list with a header."""
    return spark.read.option("header", True).schema(schema).csv(path)


def append_batch(rows: DataFrame, path: str, batch: str) -> None:
    """Adds rows to a store by batches; a batch that was written before is replaced, so that a run can be repeated."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(batch).parquet(path)


def archive_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, sha256) of the files that go into an archive."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
