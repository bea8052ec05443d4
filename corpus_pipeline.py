"""The corpus pipeline: quality rules, near-dedup, substring dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs. All but the last return the
columns of documents, and others that docs had.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from radlake.llm import minhash, mixing, packing, quality, suffix
from radlake.llm.common import Scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without their frequent lines; the others go.

    Rows are told apart by doc_id, source and text; repeated rows all stay. Null
    and empty texts are rejected; an empty table gives no row.
    """
    kept = quality.quality(docs).filter("kept").select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("content").alias("_c"), F.col("frequent_lines").alias("_lines"))
    kept = kept.dropDuplicates(["_d", "_s", "_c"])
    held = docs.select(F.struct(*docs.columns).alias("held"))
    same = F.col("held.doc_id").eqNullSafe(F.col("_d")) & F.col("held.source").eqNullSafe(F.col("_s")) & (quality.content_of(F.col("held.text")) == F.col("_c"))
    out = held.join(kept, same).select("held", quality.without_lines(F.col("held.text"), F.col("_lines")).alias("text"))
    made = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[made.get(c, F.col(f"held.{c}")).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similarity 0.8: the one with the smallest doc_id.

    Of rows that repeat a doc_id and its text one stays, the first by its columns
    as JSON; a doc_id with different texts keeps those that nothing with a
    smaller id is like. Null and empty texts are in no group; rows without an id
    stay if nothing with an id is like them. An empty table gives no row.
    """
    groups = minhash.near_duplicates(docs).select("doc_id", "content", "kept")
    groups = Scratch(spark, "groups").save(groups, "groups")
    ids = groups.filter("kept").select(F.col("doc_id").alias("_d"), F.col("content").alias("_c"))
    held = docs.select(F.struct(*docs.columns).alias("row"), minhash.content_of(F.col("text")).alias("content"))
    left = held.join(ids, held["row.doc_id"].eqNullSafe(ids["_d"]) & (held["content"] == ids["_c"]), "left_semi")
    if groups.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").isEmpty():
        return left.select("row.*")
    first = F.row_number().over(W.partitionBy("row.doc_id", "content").orderBy(F.to_json("row")))
    single = left.filter("row.doc_id IS NOT NULL").withColumn("_k", first).filter("_k = 1").select("row")
    return single.union(left.filter("row.doc_id IS NULL").select("row")).select("row.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that an earlier one has; a cut inside a character drops its rest."""
    lost = suffix.spans(docs, Scratch(spark, "suffix"))
    out = suffix.cut_texts(docs, lost, texts_too=True)
    others = [F.col(f"held.{c}").alias(c) for c in docs.columns if c not in ("doc_id", "text")]
    out = out.select("doc_id", "text", *others)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Null texts have no words and are taken as their source's share says; a null
    source is a source of its own; an empty table gives no row.
    """
    scratch = Scratch(spark, "mix")
    rows = docs.select(F.struct(*docs.columns).alias("row"), "source", mixing.hash_of(F.col("doc_id"), F.col("text")).alias("h"))
    sized = scratch.save(docs.select("source", mixing.hash_of(F.col("doc_id"), F.col("text")).alias("h"), mixing.size_of(F.col("text")).alias("size")), "sized")
    taken = mixing.take(rows, mixing.plan(sized, scratch)).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the token sequences: of null and empty texts just the end; of an empty table none."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality", quality_rules),
    ("near_dedup", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("mixing", mixed_sources),
    ("packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
