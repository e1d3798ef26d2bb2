"""Declarative checks: each is a frame of id, assertion, subject, expected, actual, ok."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check(rows: DataFrame, id_: str, text: str, subject: Column, expected: Column, actual: Column) -> DataFrame:
    e, a = expected.cast("string"), actual.cast("string")
    return rows.select(F.lit(id_).alias("id"), F.lit(text).alias("assertion"), subject.cast("string").alias("subject"), e.alias("expected"), a.alias("actual"), e.eqNullSafe(a).alias("ok"))


def every(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def retcodes(bodies: DataFrame) -> DataFrame:
    return check(bodies, "A1", "an answer's return code is 0", F.col("name"), F.lit(0), F.col("retcode"))


def tags(builds: DataFrame) -> DataFrame:
    return check(builds, "A2", "a build has the tag that was asked for", F.col("requested"), F.col("requested"), F.col("tag"))


def checksums(manifests: DataFrame) -> DataFrame:
    """manifests (name, checksum, content)."""
    return check(manifests, "A3", "a manifest's digest is its checksum", F.col("name"), F.lower("checksum"), F.md5("content"))


def id_suffixes(manifests: DataFrame) -> DataFrame:
    return check(manifests, "A4", "a manifest id ends in its checksum", F.col("name"), F.lower("checksum"), F.lower(F.split_part(F.col("id"), F.lit("_"), F.lit(2))))


def sizes_cover(chunks: DataFrame) -> DataFrame:
    """chunks (field, file, size, offset, uncompressed_size): they end where the file does, without holes."""
    total = chunks.groupBy("field", "file", "size").agg(F.sum("uncompressed_size").alias("total"), F.max(F.col("offset") + F.col("uncompressed_size")).alias("end"))
    return check(total, "A11", "chunks cover their file once", F.concat_ws(":", "field", "file"), F.concat_ws("/", "size", "size"), F.concat_ws("/", "total", "end"))


def fetch_subsets(retained: DataFrame) -> DataFrame:
    """retained (role, field, file, id): what is fetched belongs to the new file and is not reused."""
    roles = retained.groupBy("field", "file", "id").agg(F.collect_set("role").alias("r")).where(F.array_contains("r", "patch_fetch"))
    right = F.array_contains("r", "materialize_new") & ~F.array_contains("r", "reuse")
    return check(roles, "A12", "fetched chunks are new and not reused", F.concat_ws(":", "field", "file", "id"), F.lit(True), right)


def counts_agree(summary: DataFrame, rows: DataFrame) -> DataFrame:
    """summary (state, n) against rows (state)."""
    actual = rows.groupBy("state").agg(F.count("*").alias("found"))
    return check(summary.join(actual, "state", "full_outer"), "A15", "counts are those of the rows", F.col("state"), F.coalesce("n", F.lit(0)), F.coalesce("found", F.lit(0)))


def inventory(listed: DataFrame, disk: DataFrame) -> DataFrame:
    """listed (path, md5) against disk (path, content)."""
    both = listed.select("path", F.lower("md5").alias("e")).join(disk.select("path", F.md5("content").alias("a")), "path", "full_outer")
    return check(both, "A16", "the inventory lists each file with its digest", F.col("path"), F.col("e"), F.col("a"))


def differs_unless_identical(captures: DataFrame) -> DataFrame:
    """captures (name, class, old_md5, new_md5) that have both sides."""
    return check(captures, "A19", "both sides differ unless the class is identical", F.col("name"), F.col("class") != "identical", F.col("old_md5") != F.col("new_md5"))


def boundaries_seen(rows: DataFrame, id_: str, text: str, flag: Column) -> DataFrame:
    """Both sides of a boundary occur in the sample."""
    seen = rows.agg(F.bool_or(flag).alias("yes"), F.bool_or(~flag).alias("no"))
    return check(seen, id_, text, F.lit("sample"), F.lit("true/true"), F.concat_ws("/", F.coalesce("yes", F.lit(False)).cast("string"), F.coalesce("no", F.lit(False)).cast("string")))


def summary(assertions: DataFrame) -> DataFrame:
    return assertions.groupBy("id").agg(F.count("*").alias("total"), F.count_if("ok").alias("passed"), F.count_if(~F.col("ok")).alias("failed"))


def result(assertions: DataFrame, complete: bool = True) -> DataFrame:
    """One row: fail before incomplete before pass."""
    failed = F.coalesce(F.count_if(~F.col("ok")), F.lit(0))
    return assertions.agg(F.when(failed > 0, "fail").when(~F.lit(complete), "incomplete").otherwise("pass").alias("result"))


def agreement(recorded: DataFrame, derived: DataFrame) -> DataFrame:
    """Whether ids recorded as ok hold in what was derived again; an id that was not derived agrees."""
    again = derived.groupBy("id").agg(F.bool_and("ok").alias("again"))
    return recorded.where("ok").select("id").distinct().join(again, "id", "left").select("id", F.coalesce("again", F.lit(True)).alias("agrees"))


def first_rejections(rejected: DataFrame, most: int) -> DataFrame:
    """Distinct (source, value, rule): the first `most` by order of `pos`, and how many were left out."""
    distinct = rejected.groupBy("source", "value", "rule").agg(F.min("pos").alias("pos"))
    kept = distinct.orderBy("pos").limit(most)
    n = distinct.agg(F.greatest(F.count("*") - most, F.lit(0)).alias("omitted"))
    return kept.crossJoin(n)
