"""Folders and tables that all executors share, for steps between."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def _root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; on one machine, where that is unset, a temporary folder that goes with the driver."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="radlake-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return _LOCAL[0]


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is not None:
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, as a URI; it goes when the driver ends."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(f"{_root(spark)}/{name}-{uuid.uuid4().hex}")
    path = p.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(p).toUri().toString()
    atexit.register(_delete, spark, path)
    return path


def saved(df: DataFrame, name: str) -> DataFrame:
    """A table written to the shared folder and read again: it cuts the lineage, a lost executor costs its running tasks only."""
    at = shared_folder(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
