"""Two builds of a file tree compared through their manifests of content-addressed chunks.

manifest_file: field, manifest_pos, pos, file, is_folder, size, md5, chunks array<struct<id, uncompressed_md5, offset,
compressed_size, uncompressed_size, ...>>. flat chunk: field, file, manifest_pos, pos, cpos and the chunk's columns.
"First" always is list order, that is (manifest_pos, pos, cpos), never row order.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeledger.functions.totals import at_least_0, saturating_sum

#: The classes in their order.
CLASSES = ["identical", "no_reuse", "reuse_in_place", "reuse_moved", "added", "removed"]
_IDENTITY = ["field", "file", "uncompressed_md5", "uncompressed_size"]


def flatten(files: DataFrame) -> DataFrame:
    """One row per chunk, folders and nameless entries dropped."""
    named = files.where(~F.coalesce("is_folder", F.lit(False)) & (F.col("file") != ""))
    # the outer form, as the plain one makes Spark evaluate the list once more in a filter on its size
    listed = named.select("field", "manifest_pos", "pos", "file", F.posexplode_outer("chunks").alias("cpos", "c"))
    return listed.where("c is not null").select("field", "manifest_pos", "pos", "file", "cpos", "c.*")


def select_manifests(files: DataFrame, ignored: list[str], audio: list[str]) -> DataFrame:
    """Fields that are not ignored, nor of an ignored category (if there is such a column), and are no audio field (5 or 10
    bytes long with a hyphen), then those of the audio selected; a field that both steps take comes twice."""
    audio_name = F.octet_length("field").isin(5, 10) & F.col("field").contains("-")
    passed_over = F.col("field").isin(ignored)
    if "category" in files.columns:
        passed_over = passed_over | F.coalesce(F.col("category").isin(ignored), F.lit(False))
    return files.where(~passed_over & ~audio_name).unionAll(files.where(F.col("field").isin(audio)))


def first_sources(old_chunks: DataFrame) -> DataFrame:
    """Offset of the first old chunk of each identity (digest and size) in each file."""
    order = F.struct("manifest_pos", "pos", "cpos")
    return old_chunks.groupBy(*_IDENTITY).agg(F.min_by("offset", order).alias("source"))


def chunk_reuse(new_chunks: DataFrame, old_chunks: DataFrame) -> DataFrame:
    """New chunks with the offset of the same bytes in the old file, null where they must be fetched."""
    return new_chunks.join(first_sources(old_chunks), _IDENTITY, "left")


def path_diff(old_files: DataFrame, new_files: DataFrame) -> DataFrame:
    """field, file, state (added, removed, identical, changed), sizes of both sides."""
    side = lambda df, p: df.select("field", "file", F.col("size").alias(f"{p}_size"), F.lower("md5").alias(f"{p}_md5"), F.lit(True).alias(f"in_{p}"))
    both = side(old_files, "old").join(side(new_files, "new"), ["field", "file"], "full_outer")
    same = (F.col("old_md5") == F.col("new_md5")) & (F.col("old_size") == F.col("new_size"))
    state = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(same, "identical").otherwise("changed")
    return both.select("field", "file", state.alias("state"), "old_size", "new_size")


def path_scores(new_chunks: DataFrame, old_chunks: DataFrame) -> DataFrame:
    """Per file: chunks, reused and moved ones, how far into the old file the reused bytes reach, compressed bytes of both
    sides and of what is fetched. total_cost, the ranking key, is both sides together: the old file must be had whole."""
    moved = F.col("source").isNotNull() & (F.col("source") != F.col("offset"))
    fetched = F.when(F.col("source").isNull(), at_least_0(F.col("compressed_size"))).otherwise(0)
    reach = F.max(F.when(F.col("source").isNotNull(), at_least_0(F.try_add("source", "uncompressed_size"))))
    old = old_chunks.groupBy("field", "file").agg(F.sum(at_least_0(F.col("compressed_size"))).alias("old_bytes"))
    new = chunk_reuse(new_chunks, old_chunks).groupBy("field", "file").agg(
        F.count("*").alias("nchunks"), F.count("source").alias("reused"), F.count_if(moved).alias("moved"),
        F.count_if(moved & (F.col("source") < F.col("offset"))).alias("moved_later"), F.count_if(moved & (F.col("source") > F.col("offset"))).alias("moved_earlier"),
        F.coalesce(reach, F.lit(0)).cast("long").alias("old_max_end"), F.sum(at_least_0(F.col("compressed_size"))).alias("new_bytes"), F.sum(fetched).alias("patch_bytes"),
    )
    both = new.join(old, ["field", "file"], "left").withColumn("old_bytes", F.coalesce("old_bytes", F.lit(0)))
    return both.withColumn("total_cost", F.col("old_bytes") + F.col("new_bytes"))


def class_of(state: Column, nchunks: Column, reused: Column, moved: Column) -> Column:
    """The class a file belongs to; null for a changed file that fits none (a single chunk that is new or kept)."""
    return (
        F.when(state.isin("added", "removed", "identical"), state)
        .when(moved > 0, "reuse_moved")
        .when((reused == 0) & (nchunks > 1), "no_reuse")
        .when((reused > 0) & (reused < nchunks), "reuse_in_place")
    )


def scored(old_files: DataFrame, new_files: DataFrame, old_chunks: DataFrame, new_chunks: DataFrame) -> DataFrame:
    """path_diff() with the scores of new files and the class."""
    out = path_diff(old_files, new_files).join(path_scores(new_chunks, old_chunks), ["field", "file"], "left")
    return out.withColumn("class", class_of(F.col("state"), F.coalesce("nchunks", F.lit(0)), F.coalesce("reused", F.lit(0)), F.coalesce("moved", F.lit(0))))


def diff_rollup(scores: DataFrame) -> DataFrame:
    """Counts and bytes by field and over all fields (field null), in one pass; diff_paths() has the lists behind them."""
    state = lambda s: F.count_if(F.col("state") == s).alias(s)
    return scores.groupingSets([["field"], []], "field").agg(*map(state, ("added", "removed", "identical", "changed")), saturating_sum(F.col("patch_bytes")).cast("long").alias("patch_bytes"), saturating_sum(F.col("new_size")).cast("long").alias("new_bytes"))


def diff_paths(scores: DataFrame) -> DataFrame:
    """state, path (field:file) of every path that is not identical."""
    return scores.where("state <> 'identical'").select("state", F.concat_ws(":", "field", "file").alias("path"))


def reuse_pool(new_chunks: DataFrame, old_chunks: DataFrame) -> DataFrame:
    """How many new chunks have their bytes anywhere in the old build (by digest alone) against in the same file."""
    anywhere = old_chunks.select(F.col("uncompressed_md5").alias("m")).distinct()
    flagged = chunk_reuse(new_chunks, old_chunks).join(anywhere, F.col("uncompressed_md5") == F.col("m"), "left")
    across = F.col("m").isNotNull() & F.col("source").isNull()
    return flagged.agg(F.count("*").alias("chunks"), F.count("source").alias("in_file"), F.count("m").alias("anywhere"), F.count_if(across).alias("across_only"), F.count_distinct(F.when(across, F.struct("field", "file"))).alias("files_across_only"))


def structure_counts(files: DataFrame) -> DataFrame:
    """One row: oddities of a manifest's entries and of their chunk lists."""
    chunk_end = lambda c: c["offset"] + c["uncompressed_size"]
    chunks = F.coalesce("chunks", F.array().cast(files.schema["chunks"].dataType))
    pairs = F.when(F.size(chunks) > 1, F.arrays_zip(F.slice(chunks, 1, F.size(chunks) - 1).alias("a"), F.slice(chunks, 2, F.size(chunks) - 1).alias("b"))).otherwise(F.array())
    total = F.aggregate(chunks, F.lit(0).cast("long"), lambda s, c: s + c["uncompressed_size"])
    row = files.select(
        "file", (F.size(chunks) == 0).alias("empty"), F.col("file").contains("\\").alias("backslash"), F.col("file").rlike(r"[^\x00-\x7F]").alias("non_ascii"),
        F.exists(pairs, lambda p: p["b"]["offset"] <= p["a"]["offset"]).alias("unsorted"), F.exists(pairs, lambda p: p["b"]["offset"] != chunk_end(p["a"])).alias("gapped"),
        (~F.coalesce("is_folder", F.lit(False)) & (total != F.col("size"))).alias("wrong_size"), F.array_max(F.transform(chunks, lambda c: c["uncompressed_size"])).alias("largest"),
    )
    counts = row.agg(*[F.count_if(c).alias(c) for c in ("empty", "backslash", "non_ascii", "unsorted", "gapped", "wrong_size")], F.max("largest").alias("max_chunk"))
    return counts.crossJoin(files.groupBy("file").agg((F.count("*") - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("duplicates")))


def reconcile(declared: DataFrame, decoded: DataFrame) -> DataFrame:
    """Declared against decoded counts of the same names, only where they are declared: name, expected, actual, ok."""
    names = [c for c in declared.columns if c in decoded.columns]
    long = lambda df, v: df.select([F.col(c).cast("long").alias(c) for c in names]).unpivot([], names, "name", v)
    return long(declared, "expected").where("expected is not null").join(long(decoded, "actual"), "name").withColumn("ok", F.col("expected").eqNullSafe(F.col("actual")))


def tiling(ranges: DataFrame, key: str) -> DataFrame:
    """Ranges (key, offset, length) in order, each with the hole before it or the overlap with what came before.

    prev_offset is that of the earlier range that reaches farthest, the first such one on a tie.
    """
    order = Window.partitionBy(key).orderBy("offset", "length")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("offset") + F.col("length")
    reach = F.coalesce(F.max(end).over(before), F.lit(0))
    farthest = F.max(F.struct(end.alias("end"), (-F.col("offset")).alias("back"))).over(before)
    return ranges.select("*", F.greatest(F.col("offset") - reach, F.lit(0)).alias("gap"), F.when(reach > F.col("offset"), -farthest["back"]).alias("prev_offset"))


def range_violations(chunks: DataFrame) -> DataFrame:
    """What is wrong with each chunk's range in list order: negative, overflow, past the end, not where the last ended."""
    return _ranged(chunks).where("rule is not null").select("field", "file", "cpos", "rule")


def layout_violations(chunks: DataFrame) -> DataFrame:
    """field, file, cpos, rule: range_violations(), and for each file whose sizes do not add up to its own (total: the sum
    of sizes that are no longs is one too) a row without a chunk. Both come from one pass over the file's chunks."""
    order = Window.partitionBy("field", "file")
    total = F.sum(F.col("uncompressed_size").cast("decimal(38,0)")).over(order)
    last = F.row_number().over(order.orderBy(F.desc("manifest_pos"), F.desc("pos"), F.desc("cpos"))) == 1
    found = _ranged(chunks).withColumns({"total": total, "last": last})
    of_file = F.when(F.col("last") & (F.col("total") != F.col("size")), F.struct(F.lit(None).cast("long").alias("cpos"), F.lit("total").alias("rule")))
    of_chunk = F.when(F.col("rule").isNotNull(), F.struct(F.col("cpos").cast("long").alias("cpos"), "rule"))
    return found.select("field", "file", F.explode(F.array_compact(F.array(of_chunk, of_file))).alias("v")).select("field", "file", "v.*")


def _ranged(chunks: DataFrame) -> DataFrame:
    """chunks with the rule that each one's range breaks."""
    order = Window.partitionBy("field", "file").orderBy("manifest_pos", "pos", "cpos")
    end = F.try_add("offset", "uncompressed_size")
    last = F.coalesce(F.lag(end).over(order), F.lit(0))
    rule = (
        F.when((F.col("offset") < 0) | (F.col("uncompressed_size") < 0), "negative").when(end.isNull(), "overflow").when(end > F.col("size"), "past-end")
        .when(F.col("uncompressed_size") == 0, "empty").when(F.col("offset") > last, "gap").when(F.col("offset") < last, "overlap")
    )
    return chunks.withColumn("rule", rule)


def wants(chunks: DataFrame) -> DataFrame:
    """Each distinct chunk id once: how often and by how many files it is asked for, its identity by list order, and
    how many rows disagree with that."""
    # by file first, then by identity, then by id: each step is summed up before it is shuffled, so no id is one task's list
    order = F.min(F.struct("manifest_pos", "pos", "cpos")).alias("first")
    identity = ["id", "uncompressed_md5", "uncompressed_size"]
    by_file = chunks.groupBy(*identity, "field", "file").agg(F.count("*").alias("n"), order, F.max("compressed_size").alias("c"))
    kinds = by_file.groupBy(*identity).agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("c").alias("c"))
    named = kinds.groupBy("id").agg(F.sum("n").alias("references"), F.min_by(F.struct("uncompressed_md5", "uncompressed_size", "n"), "first").alias("kind"), F.max("c").alias("compressed_size"))
    files = by_file.select("id", "field", "file").distinct().groupBy("id").agg(F.count("*").alias("files"))
    return named.join(files, "id").select("id", "references", "files", F.col("kind.uncompressed_size").alias("bytes"), (F.col("references") - F.col("kind.n")).alias("conflicts"), "compressed_size")


def projected_download(wanted: DataFrame) -> DataFrame:
    """One row: the bytes that fetching every wanted chunk once would move."""
    return wanted.agg(saturating_sum(F.col("compressed_size")).cast("string").alias("projected"))


def retention(new_chunks: DataFrame, old_chunks: DataFrame) -> DataFrame:
    """role, field, file, id of the chunks that each use of a capture needs."""
    reuse = chunk_reuse(new_chunks, old_chunks)
    role = lambda df, name: df.select(F.lit(name).alias("role"), "field", "file", "id").distinct()
    return role(old_chunks, "materialize_old").unionAll(role(new_chunks, "materialize_new")).unionAll(role(reuse.where("source is null"), "patch_fetch")).unionAll(role(reuse.where("source is not null"), "reuse"))


def patch_plan(new_chunks: DataFrame, old_chunks: DataFrame) -> DataFrame:
    """Each new chunk as REUSE from an offset of the old file or FETCH."""
    decision = F.when(F.col("source").isNull(), "FETCH").otherwise("REUSE")
    return chunk_reuse(new_chunks, old_chunks).select("field", "file", "cpos", "id", "offset", "uncompressed_size", "compressed_size", decision.alias("decision"), "source", (F.coalesce(F.col("source") != F.col("offset"), F.lit(False))).alias("moved"))


def patch_totals(plan: DataFrame) -> DataFrame:
    """Per field; a negative cost is an error, as it makes the whole plan worthless."""
    cost = F.when(F.col("decision") == "FETCH", F.when(F.col("compressed_size") < 0, F.raise_error(F.lit("negative download size"))).otherwise(F.col("compressed_size"))).otherwise(0)
    return plan.groupBy("field").agg(F.count("*").alias("chunks"), F.count_if(F.col("decision") == "REUSE").alias("reuse"), F.count_if(F.col("decision") == "FETCH").alias("fetch"), F.count_if("moved").alias("moved"), F.sum(cost.cast("long")).alias("download_bytes"))


def rebuild(parts: DataFrame, root: str | None = None) -> DataFrame:
    """field, file, size, md5, tiled of files put together from (field, file, offset, bytes); with root they are also
    written below it, a folder that all executors share.

    A file's parts pass one task in order and one at a time, so a file may be of any size. tiled: they begin at 0 and
    leave no hole and no overlap.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, out = None, None
        for batch in batches:
            for field, file, offset, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (field, file) != key:
                    if out:
                        yield out.done(*key)
                    key, out = (field, file), _Whole(root, field, file)
                out.add(offset, data)
        if out:
            yield out.done(*key)

    ordered = parts.select("field", "file", F.col("offset").cast("long").alias("offset"), F.col("bytes").cast("binary").alias("bytes")).repartition("field", "file").sortWithinPartitions("field", "file", "offset")
    return ordered.mapInArrow(run, "field string, file string, size long, md5 string, tiled boolean")


class _Whole:
    """One file as its parts come in; its bytes go through a temporary name until it is whole."""

    def __init__(self, root: str | None, field: str, file: str) -> None:
        self.md5, self.size, self.tiled = hashlib.md5(), 0, True
        self.path = f"{root}/{field}/{file}" if root else None
        if self.path:
            os.makedirs(os.path.dirname(self.path), exist_ok=True)
            self.temporary = f"{self.path}.{uuid.uuid4().hex}"
            self.handle = open(self.temporary, "wb")

    def add(self, offset: int, data: bytes) -> None:
        self.tiled &= offset == self.size
        self.md5.update(data)
        self.size += len(data)
        if self.path:
            self.handle.write(data)

    def done(self, field: str, file: str) -> pa.RecordBatch:
        if self.path:
            self.handle.close()
            os.replace(self.temporary, self.path)
        return pa.RecordBatch.from_pydict({"field": [field], "file": [file], "size": [self.size], "md5": [self.md5.hexdigest()], "tiled": [self.tiled]})
