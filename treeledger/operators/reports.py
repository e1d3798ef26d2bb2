"""Summaries, gates and small decisions over plans, scans, captures and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeledger.functions.totals import at_least_0, overlaps, saturating_sum
from treeledger.operators.trees import diff_summary

#: The order in which a comparison is told.
VERDICTS = ["missing", "extra", "changed", "type-conflict", "case-mismatch", "identical"]


def plan_line(files: DataFrame, estimates: DataFrame, purged: DataFrame, scoped: bool) -> DataFrame:
    """One row: files (size), estimates (est_download), purged (bytes), the largest chunk of all."""
    plan = files.agg(F.count("*").alias("files"), saturating_sum(F.col("size")).cast("long").alias("est_write"))
    down = estimates.agg(saturating_sum(F.col("est_download")).cast("long").alias("est_download"), F.coalesce(F.max("max_chunk"), F.lit(0)).alias("max_chunk_bytes"))
    gone = purged.agg(F.count("*").alias("purge_files"), saturating_sum(F.col("bytes")).cast("long").alias("purge_bytes"))
    return plan.crossJoin(down).crossJoin(gone).withColumn("scoped", F.lit(scoped))  # three frames of one row each


def verdict_stream(diff: DataFrame, show_identical: bool = False) -> DataFrame:
    """Rows of a tree diff in the order in which they are told: by bucket, then by path, and the counts last. A pair in two
    spellings is told in its bucket and as a case mismatch, with the other spelling as its tag."""
    rank = F.array_position(F.array(*map(F.lit, VERDICTS)), F.col("bucket"))
    told = diff if show_identical else diff.where("bucket <> 'identical'")
    rows = told.select(rank.alias("rank"), F.upper("bucket").alias("label"), F.coalesce("src_rel", "dst_rel").alias("rel"), "tag")
    spelled = diff.where("case_mismatch").select(F.lit(VERDICTS.index("case-mismatch") + 1).cast("long").alias("rank"), F.lit("CASE-MISMATCH").alias("label"), F.col("src_rel").alias("rel"), F.col("dst_rel").alias("tag"))
    counts = diff_summary(diff)
    keys = [c for c in counts.columns if c != "in_step"]
    last = counts.select(F.lit(len(VERDICTS) + 1).cast("long").alias("rank"), F.lit("SUMMARY").alias("label"), F.lit(None).cast("string").alias("rel"), F.concat_ws(" ", *[F.concat(F.lit(f"{k}="), F.col(k).cast("string")) for k in keys]).alias("tag"))
    return rows.unionAll(spelled).unionAll(last).orderBy("rank", "rel")


def examples(paths: DataFrame, most: int = 5) -> DataFrame:
    """The first paths and how many more there are."""
    more = paths.agg(F.greatest(F.count("*") - most, F.lit(0)).alias("more"))
    return paths.select("rel").orderBy("rel").limit(most).crossJoin(more)


def tag_probe_summary(probes: DataFrame, diff_tags: list[str]) -> DataFrame:
    served = F.col("status") == 200
    return probes.agg(F.count("*").alias("requested"), F.count_if(served).alias("served"), F.count_if(served & ~F.col("tag").isin(diff_tags)).alias("served_outside"))


def run_summary(events: DataFrame) -> DataFrame:
    """events (outcome, bytes): counters of a run; done is what has an outcome."""
    count = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    row = events.agg(*map(count, ("skipped", "repaired", "failed")), saturating_sum(F.when(F.col("outcome") == "repaired", F.col("bytes"))).cast("long").alias("bytes"))
    return row.withColumn("done", F.col("skipped") + F.col("repaired") + F.col("failed"))


def exit_status(summary: DataFrame, *keys: str) -> DataFrame:
    """The first hard stop that each run met (columns usage_error, metadata_error, limit_hits, write_error, failed), or ok."""
    status = F.when(F.col("usage_error"), "usage").when(F.col("metadata_error"), "metadata").when(F.col("limit_hits") > 0, "limit").when(F.col("write_error"), "write").when(F.col("failed") > 0, "damaged").otherwise("ok")
    return summary.select(*keys, status.alias("status"))


def stored_bodies(bodies: DataFrame, budget: int) -> DataFrame:
    """bodies (grp, seq, bytes): how much of each is stored when a group's budget is spent in order; the rest is cut."""
    before = F.coalesce(F.sum("bytes").over(Window.partitionBy("grp").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = F.least(F.col("bytes"), F.greatest(F.lit(budget) - before, F.lit(0)))
    return bodies.withColumn("stored", kept).withColumn("truncated", kept < F.col("bytes"))


def newest(copies: DataFrame, keep: int) -> DataFrame:
    """The newest copies (grp, ts, attempt) of each group."""
    rank = F.row_number().over(Window.partitionBy("grp").orderBy(F.col("ts").desc(), F.col("attempt").desc()))
    return copies.withColumn("nth", rank).where(F.col("nth") <= keep).drop("nth")


def tiering(payloads: DataFrame, ceiling: int | None) -> DataFrame:
    """payloads (file, payload: bytes of bad chunks that move): how each file can be written in place.

    A file reserves its payload while it is written and gives it back when it is done, and a refused reservation is
    not charged. So one file at a time is staged whenever its own payload fits; with several in work, those that
    overlap share the ceiling, which a plan can't foresee. ceiling: None for no limit; 0 stages nothing at all.
    """
    if ceiling is None:
        return payloads.withColumn("tier", F.lit("staged"))
    tier = F.when(F.lit(ceiling) == 0, "ordered").when(at_least_0(F.col("payload")) <= ceiling, "staged").otherwise("ordered")
    return payloads.withColumn("tier", tier)


def first_new_id(new_chunks: DataFrame, old_chunks: DataFrame) -> DataFrame:
    """The first chunk id of the new list that the old one lacks."""
    return new_chunks.join(old_chunks.select("id").distinct(), "id", "left_anti").orderBy("manifest_pos", "pos", "cpos").limit(1).select("id")


def index_mismatches(plan: DataFrame, index: DataFrame) -> DataFrame:
    """Entries of a plan and of a reference index (id, offset) that the other lacks."""
    both = plan.select("id", "offset", F.lit(True).alias("p")).distinct().join(index.select("id", "offset", F.lit(True).alias("x")).distinct(), ["id", "offset"], "full_outer")
    return both.where("p is null or x is null").select("id", "offset", F.when(F.col("p").isNull(), "not planned").otherwise("not indexed").alias("why"))


def set_checks(sets: DataFrame) -> DataFrame:
    """sets (name, fetch, new, reuse: arrays of ids): whether fetch is within new and apart from reuse."""
    return sets.select("name", (F.size(F.array_except("fetch", "new")) == 0).alias("subset"), (~F.coalesce(F.arrays_overlap("fetch", "reuse"), F.lit(False))).alias("disjoint"))


def declared_mismatch(declared: Column, requested: Column) -> Column:
    """A declared value that differs; one that is absent doesn't."""
    return declared.isNotNull() & (declared != requested)


def container_refusal(download_mode: Column, compression: Column, encryption: Column) -> Column:
    """Why a build's container can't be handled, or null."""
    return F.when(F.lower(download_mode) != "chunk", "download mode").when(compression != 1, "compression").when(encryption != 0, "encryption")


def write_mode(requested: Column, exists: Column, is_regular: Column) -> Column:
    return F.when(~exists, "in_place").when((requested == "temp") | ~is_regular, "temp").otherwise("in_place")


def verdict_reusable(chunks_then: Column, chunks_now: Column, length_then: Column, length_now: Column, mtime_then: Column, mtime_now: Column, scanned_ns: Column) -> Column:
    """Whether a verdict of plan time still holds: nothing has changed, and the file was two seconds old when scanned."""
    return (chunks_then == chunks_now) & (length_then == length_now) & mtime_then.eqNullSafe(mtime_now) & mtime_now.isNotNull() & (scanned_ns - mtime_now > 2_000_000_000)


def blob_problems(blob: Column) -> Column:
    """Reasons why a measured blob can't be used; empty: it can."""
    checks = ["compressed_size", "compressed_md5", "uncompressed_size", "uncompressed_md5"]
    return F.array_compact(F.array(*[F.when(~F.coalesce(blob["verified"][c], F.lit(False)), f"{c} differs") for c in checks], F.when(blob["error"].isNotNull(), blob["error"]), F.when(blob["partial"], "partial")))


def trim_is_free(chunks: DataFrame) -> DataFrame:
    """chunks (file, source, uncompressed_size, live, target_size): files of which no live source lies past the target's end."""
    past = F.col("live") & (F.col("source") + F.col("uncompressed_size") > F.col("target_size"))
    return chunks.groupBy("file").agg((~F.coalesce(F.bool_or(past), F.lit(False))).alias("free"))


def redo_terminal(ranges: DataFrame) -> DataFrame:
    """ranges (file, start, end): files with ranges that lie over each other, whose mismatch writing again can't mend."""
    last = F.lag("end").over(Window.partitionBy("file").orderBy("start", "end"))
    first = F.lag("start").over(Window.partitionBy("file").orderBy("start", "end"))
    return ranges.withColumn("over", F.coalesce(overlaps(first, last, F.col("start"), F.col("end")), F.lit(False))).groupBy("file").agg(F.bool_or("over").alias("terminal"))


def file_actions(chunks: DataFrame) -> DataFrame:
    """Per chunk of a file to be mended (dest_ok, source, live, staged): what would be done with it, and with holes."""
    action = F.when(F.col("dest_ok"), "kept").when(F.col("source").isNotNull() & F.col("live"), F.when(F.col("staged"), "staged").otherwise("copied")).otherwise("download")
    return chunks.withColumn("action", action)


def resumed(chunks: DataFrame) -> DataFrame:
    """Temp files: a chunk within the prefix that is there already is resumed, one whose slice matches is copied."""
    end = F.col("offset") + F.col("uncompressed_size")
    return chunks.withColumn("action", F.when(F.col("prefix_len") >= end, "resumed").when(F.col("slice_ok"), "copied").otherwise("download"))
