"""Ingest as a stream of files: batches into the catalog, so that a run that was stopped goes on where it was."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.catalog import first_wins


def ingest(spark: SparkSession, source: str, schema: StructType | str, target: str, checkpoint: str, files: int = 100, seen: Callable[[int], None] | None = None):
    """A started query that brings all files of ``source`` that are there into ``target``, some files a batch.

    A batch is a partition of its own, which it overwrites: one that was stopped
    after its write, and is done again, adds nothing twice. The checkpoint knows
    the files of each batch. seen: called with the number of a batch after its
    write.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(target)
        if seen is not None:
            seen(number)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true").parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def catalog(spark: SparkSession, schema: StructType | str, target: str, keys: list[str], order: list[str]) -> DataFrame:
    """The ingested rows, one for each key: the first by order, whatever batch it came in."""
    rows = spark.read.schema(schema).parquet(target)
    return first_wins(rows, keys, order)
