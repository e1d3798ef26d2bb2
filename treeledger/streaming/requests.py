"""An extension over the append-only request log: totals of requests as they come in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeledger.sources.requests import SCHEMA


def read_log(spark: SparkSession, path: str, files_a_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_a_batch).json(path)


def bytes_by_window(log: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Requests, bytes and failures by kind and window; state older than the watermark goes."""
    failed = (F.col("status") >= 400).cast("int")
    return log.withWatermark("ts", late).groupBy(F.window("ts", window), "kind").agg(F.count("*").alias("requests"), F.sum("bytes_in").alias("bytes_in"), F.sum(failed).alias("failed"))
