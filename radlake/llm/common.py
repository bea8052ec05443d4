"""What the training-data operators share: scratch tables, words, batches."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: ASCII upper case to lower case; all other bytes stay.
LOWER = bytes.maketrans(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)))
#: Words each Python worker remembers before it starts anew.
MEMO_LIMIT = 300_000


def checkpoint_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.

    Where it is unset (tests on one machine) a temporary folder is made; on a
    cluster that would be wrong, so it is refused there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="radlake-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Scratch:
    """Intermediate tables as Parquet in the shared folder.

    A saved table cuts the lineage: a lost executor costs its running tasks
    only. Tables go when dropped, the rest when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{checkpoint_root(spark)}/radlake-{name}-{uuid.uuid4().hex}"
        spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
        atexit.register(self._delete, self.path)

    def _delete(self, path: str) -> None:
        sc = self.spark.sparkContext
        if sc._jsc is not None:
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)

    def uri(self, name: str) -> str:
        """A place in the folder as a full URI, whatever form the setting has."""
        sc = self.spark.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(p).toUri().toString()

    def save(self, df: DataFrame, name: str) -> DataFrame:
        at = f"{self.path}/{name}"
        df.write.option("compression", "zstd").mode("overwrite").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.path}/{name}")


def texts(column) -> Iterator[bytes]:
    """UTF-8 of an Arrow string column; null is empty."""
    for value in column:
        buffer = value.as_buffer() if value.is_valid else None
        yield buffer.to_pybytes() if buffer is not None else b""


class HashMemo(dict):
    """word -> its 64-bit hash, the same in every process."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every run of n consecutive word hashes."""
    if len(hashes) < n:
        return hashes[:0]
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[k : k + len(out)]
    return mix64(out)
