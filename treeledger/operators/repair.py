"""What bringing an install to a build would read, fetch, write and delete; nothing is done here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeledger.functions.paths import ancestors, bad_rel, clean_rel, depth, path_key
from treeledger.functions.totals import at_least_0, saturating_sum


def _fold(name: str) -> str:
    """What path_key() makes of a name."""
    return name.translate({c: c + 32 for c in range(65, 91)})


def plan_files(files: DataFrame, blocked: list[str] | None = None) -> DataFrame:
    """The files of a plan: cleaned paths, the first of those that fold alike, in path order.

    A path that is refused makes the plan worthless, so it raises.
    """
    why = bad_rel(F.col("file"))
    checked = files.where(~F.coalesce("is_folder", F.lit(False)) & (F.col("file") != ""))
    checked = checked.withColumn("rel", F.when(why.isNotNull(), F.raise_error(F.concat(F.lit("bad path "), "file", F.lit(": "), why))).otherwise(clean_rel(F.col("file"))))
    if blocked:
        checked = checked.where(~path_key(F.col("rel")).isin([_fold(b) for b in blocked]))
    first = F.row_number().over(Window.partitionBy(path_key(F.col("rel"))).orderBy("manifest_pos", "pos"))
    return checked.withColumn("nth", first).where("nth = 1").drop("nth").orderBy("rel")


def download_estimate(chunks: DataFrame) -> DataFrame:
    """Bytes to fetch for each file, from chunks with `source` (null: fetched)."""
    return chunks.groupBy("field", "file").agg(saturating_sum(F.when(F.col("source").isNull(), F.col("compressed_size"))).cast("long").alias("est_download"))


def salvage_order(chunks: DataFrame, usable: str = "usable_len") -> DataFrame:
    """Per file the direction of writing in which more sources survive until they are read (a tie: ascending)."""
    fits = F.col("source").isNotNull() & (F.try_add("source", "uncompressed_size") <= F.col(usable))
    ascending, descending = fits & (F.col("source") >= F.col("offset")), fits & (F.col("source") <= F.col("offset"))
    counted = chunks.groupBy("field", "file").agg(F.count_if(ascending).alias("kept_ascending"), F.count_if(descending).alias("kept_descending"))
    return counted.withColumn("ascending", F.col("kept_descending") <= F.col("kept_ascending"))


def scanned_estimate(chunks: DataFrame, orders: DataFrame, usable: str = "usable_len") -> DataFrame:
    """Bytes to fetch after a scan: bad chunks that the chosen order does not salvage. chunks has dest_ok."""
    joined = chunks.join(orders.select("field", "file", "ascending"), ["field", "file"], "left")
    fits = F.col("source").isNotNull() & (F.try_add("source", "uncompressed_size") <= F.col(usable))
    live = fits & F.when(F.col("ascending"), F.col("source") >= F.col("offset")).otherwise(F.col("source") <= F.col("offset"))
    return joined.groupBy("field", "file").agg(F.count_if(~F.col("dest_ok")).alias("damaged"), saturating_sum(F.when(~F.col("dest_ok") & ~F.coalesce(live, F.lit(False)), F.col("compressed_size"))).cast("long").alias("est_download"))


def disk_plan(files: DataFrame, jobs: int, in_place: bool) -> DataFrame:
    """est_write and est_extra: what is written, and what the files in work take beside that."""
    extra = F.greatest(F.lit(0).cast("long"), F.col("size") - F.coalesce("on_disk", F.lit(0))) if in_place else at_least_0(F.col("size"))
    return files.agg(F.count("*").alias("files"), saturating_sum(F.col("size")).cast("long").alias("est_write"), (jobs * F.coalesce(F.max(extra), F.lit(0))).alias("est_extra"))


def limit_hits(actual: DataFrame, limits: dict[str, int]) -> DataFrame:
    """what, actual, limit of the figures (one row, a column each) that are over their limit; equal passes."""
    names = list(limits)
    long = actual.select([F.col(n).cast("long").alias(n) for n in names]).unpivot([], names, "what", "actual")
    limit = F.create_map(*[x for n in names for x in (F.lit(n), F.lit(limits[n]).cast("long"))])
    return long.withColumn("limit", limit[F.col("what")]).where(F.col("actual") > F.col("limit"))


def is_audio_version(rel: Column) -> Column:
    """Whether a path names a record of which voice packs are installed."""
    name = path_key(F.element_at(F.split(rel, "/", -1), -1))
    return name.startswith("audio_lang_") | (name.startswith("audio_") & name.endswith("_pkg_version"))


def purge(disk: DataFrame, expected: DataFrame, keep: list[str], visible: Column | None = None, blocked: list[str] | None = None) -> DataFrame:
    """disk (rel, bytes) with the verdict for each path, by the first rule that holds: out-of-scope, expected, kept (the
    tool's own), blocked, audio-version, purge."""
    known = expected.select(path_key(F.col("rel")).alias("key"), F.lit(True).alias("expected")).distinct()
    keyed = disk.withColumn("key", path_key(F.col("rel"))).join(known, "key", "left")
    among = lambda names: F.col("key").isin([_fold(n) for n in names]) if names else F.lit(False)
    verdict = F.when(~(visible if visible is not None else F.lit(True)), "out-of-scope").when(F.col("expected"), "expected").when(among(keep), "kept").when(among(blocked), "blocked").when(is_audio_version(F.col("rel")), "audio-version").otherwise("purge")
    return keyed.select("rel", "bytes", verdict.alias("verdict"))


def purge_totals(verdicts: DataFrame) -> DataFrame:
    gone = F.col("verdict") == "purge"
    return verdicts.agg(F.count_if(gone).alias("files"), saturating_sum(F.when(gone, F.col("bytes"))).cast("long").alias("bytes"), F.count_if(F.col("verdict") == "out-of-scope").alias("hidden"))


def empty_dirs(verdicts: DataFrame) -> DataFrame:
    """Directories without a kept descendant, deepest first."""
    below = verdicts.select("verdict", F.explode(ancestors(F.col("rel"))).alias("dir"))
    return below.groupBy("dir").agg(F.bool_and(F.col("verdict") == "purge").alias("empty")).where("empty").select("dir").orderBy(depth(F.col("dir")).desc(), "dir")


def integrity(plan: DataFrame, disk: DataFrame) -> DataFrame:
    """plan (rel, size, md5) against disk (rel, content): one verdict a file. scan.integrity_of() has it from a scan."""
    return file_verdicts(plan.join(disk.select("rel", F.octet_length("content").alias("length"), F.md5("content").alias("found")), "rel", "left"))


def file_verdicts(found: DataFrame) -> DataFrame:
    """rel, verdict of files (rel, size, md5) and what was found of them (length, found; null: nothing)."""
    verdict = F.when(F.col("length").isNull(), "missing").when(F.col("length") != F.col("size"), "size").when(F.col("found") != F.lower("md5"), "md5").otherwise("ok")
    return found.select("rel", verdict.alias("verdict"))


def deprecated(disk: DataFrame, listed: DataFrame, visible: Column | None = None) -> DataFrame:
    """Files on disk that a list of retired paths names."""
    seen = disk.where(visible) if visible is not None else disk
    return seen.join(listed.select(path_key(F.col("rel")).alias("k")).distinct(), path_key(F.col("rel")) == F.col("k"), "left_semi")
