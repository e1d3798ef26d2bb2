"""Rows as text or JSON records in a fixed order of keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeledger.functions.paths import percent_encode


def as_json(event: str, *columns: str) -> Column:
    """{"event": ..., ...}; a null column is left out, which is how conditional keys are said."""
    return F.to_json(F.struct(F.lit(event).alias("event"), *columns), {"ignoreNullFields": "true"})


def as_line(label: str, *columns: str) -> Column:
    """LABEL key=value ...; nulls are left out, values are encoded where they would break the line."""
    return F.concat_ws(" ", F.lit(label), *[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}="), percent_encode(F.col(c).cast("string")))) for c in columns])


def ordered(frames: list[tuple[str, DataFrame]], *order: str) -> DataFrame:
    """Action frames one after the other: stage, stage_rank and the columns of the frames."""
    out = None
    for rank, (name, frame) in enumerate(frames):
        part = frame.select(F.lit(rank).alias("stage_rank"), F.lit(name).alias("stage"), "*")
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out.orderBy("stage_rank", *order)


def diff_rows(scores: DataFrame) -> DataFrame:
    """The nine columns of a diff's table, as they are written: a one-sided path has blank sizes and zeros."""
    both = F.col("state").isin("identical", "changed")
    size = lambda c: F.when(both, F.col(c).cast("string")).otherwise("").alias(c)
    number = lambda c: F.when(both, F.coalesce(F.col(c), F.lit(0))).otherwise(0).cast("long").alias(c)
    return scores.select("field", F.col("file").alias("path"), "state", size("old_size"), size("new_size"), *map(number, ("reused", "moved", "patch_bytes", "total_cost")))


def write_diff(scores: DataFrame, path: str) -> None:
    """The diff's table with its header, by field and path."""
    diff_rows(scores).repartitionByRange("field", "path").sortWithinPartitions("field", "path").write.csv(path, sep="\t", header=True, emptyValue="")
