"""The queries opN_<name> over the driver's tables, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, contamination, divergence, extract, licenses, lm, minhash, mining, mixing, packing, quality, suffix, tokens


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op2_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(_table(spark, sf_dir, "pages"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents")).drop("blocks")


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), minhash.QUERY_PERCENT).select("doc_id", "n_shingles", "component_id", "kept")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_files(_table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", *quality.COUNTS, "base_failed", "kept")


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(_table(spark, sf_dir, "embeddings"))


def op8_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.deduplicate(_table(spark, sf_dir, "documents"))


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(_table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.hard_negatives(_table(spark, sf_dir, "embeddings"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("spans")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_packing, op2_extraction, op3_licenses, op4_minhash, op5_token_files,
        op6_quality, op7_neighbours, op8_suffix, op9_lm, op10_mixing,
        op11_negatives, op12_decontamination, op13_divergence,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op4_minhash": minhash.ORACLE, "op6_quality": quality.ORACLE, "op10_mixing": mixing.ORACLE,
    "op11_negatives": mining.ORACLE, "op12_decontamination": contamination.ORACLE, "op13_divergence": divergence.ORACLE,
}
