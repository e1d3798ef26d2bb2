"""Intermediate tables in the folder that all executors share, and size-checked broadcasts."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when it is counted to have at most this many rows of a few longs each (about 16 MB).
BROADCAST_ROWS = 400_000


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only where that is unset and Spark is a single process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-treeledger-")
        atexit.register(shutil.rmtree, found, True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Bytes of rows that go to a Python process at once: both ends hold a batch several times over.
BATCH_BYTES = 4 << 20
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}


@contextlib.contextmanager
def _writing(spark: SparkSession):
    """Within this, an ended write gives back the disk of its shuffles, as what it made is in the written table, and a batch
    of rows for Python has a limit in bytes."""
    before = {key: spark.conf.get(key, None) for key in _WRITING}
    for key, value in _WRITING.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends here, and a lost executor costs nothing.

    The table goes when the application ends, or with drop().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}/{name}"
    with _writing(spark):
        df.write.option("compression", "zstd").parquet(path)
    at, files = _located(spark, path)
    files.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def _located(spark: SparkSession, path: str):
    """The folder of a staged table and its file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getParent()
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def drop(*tables: DataFrame) -> None:
    """Remove staged tables. Only for tables that nothing reads any more: whatever came of them must be staged itself."""
    for df in tables:
        at, files = _located(df.sparkSession, df._staged_at)
        files.delete(at, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a staged table for broadcast if it is counted to be small; beyond that Spark shuffles both sides.

    The result of the join is the same either way.
    """
    return F.broadcast(df) if df.count() <= rows else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
