"""The plans that the other operators' steps make up: what a repair would do, as rows and as a document, and which chunks a
capture would store."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeledger.functions.globs import in_scope
from treeledger.functions.paths import chunk_id_rule, path_rule
from treeledger.functions.records import as_line
from treeledger.functions.totals import at_least_0, saturating_sum, slice_matches
from treeledger.operators.manifest import chunk_reuse, projected_download, retention, wants
from treeledger.operators.repair import empty_dirs, plan_files, purge, purge_totals


def bad_ranges(size: Column, chunk: Column) -> Column:
    """Why a chunk's range is refused, or null. An empty chunk is allowed."""
    end = F.try_add(chunk["offset"], chunk["uncompressed_size"])
    return F.when((chunk["offset"] < 0) | (chunk["uncompressed_size"] < 0), "negative").when(end.isNull(), "overflow").when(end > size, "past-end")


def repair_plan(files: DataFrame, blocked: list[str] | None = None, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """rel, size, md5, chunks, tiled of the files that a repair deals with, in the order of their paths.

    Folders and nameless entries go; paths are cleaned; what is blocked or out of scope goes; of paths that fold alike the
    first stays. Then chunks are put in order of their offsets and empty ones go. A bad path or range makes the whole
    plan worthless and raises. tiled: the chunks cover the file without hole or overlap.
    """
    # what is out of scope must not refuse the rest for its chunks, so ranges are judged last
    seen = plan_files(files, blocked)
    if include or exclude:
        seen = seen.where(in_scope(F.col("rel"), include or [], exclude or []))
    chunks = F.coalesce("chunks", F.array().cast(files.schema["chunks"].dataType))
    first_bad = F.element_at(F.filter(F.transform(chunks, lambda c: bad_ranges(F.col("size"), c)), lambda why: why.isNotNull()), 1)
    why = F.when(F.exists(chunks, lambda c: bad_ranges(F.col("size"), c).isNotNull()), first_bad)
    checked = F.when(why.isNotNull(), F.raise_error(F.concat(F.lit("bad range in "), "rel", F.lit(": "), why))).otherwise(chunks)
    placed = F.transform(checked, lambda c, i: F.struct(c["offset"].alias("o"), i.alias("i"), c.alias("c")))
    kept = F.filter(F.transform(F.array_sort(placed), lambda p: p["c"]), lambda c: c["uncompressed_size"] > 0)
    tidy = seen.select("rel", "size", "md5", kept.alias("chunks"))
    # the cursor is the end of what came before, -1 once it is off
    cursor = F.aggregate("chunks", F.lit(0).cast("long"), lambda at, c: F.when((at >= 0) & (c["offset"] == at), at + c["uncompressed_size"]).otherwise(F.lit(-1)))
    return tidy.withColumn("tiled", cursor == F.col("size")).orderBy("rel")


def plan_chunks(plan: DataFrame) -> DataFrame:
    """rel, cpos and the columns of each chunk."""
    return plan.select("rel", F.posexplode_outer("chunks").alias("cpos", "c")).where("c is not null").select("rel", "cpos", "c.*")


def disk_figures(plan: DataFrame, disk: DataFrame, mode: str) -> DataFrame:
    """rel, mode, extra_bytes: how each file would be written and what that takes beside it. disk: rel, length, is_regular.

    Temp if asked for, or if what is there is no regular file; then the whole file is extra, in place only its growth.
    """
    found = plan.select("rel", "size").join(disk.select("rel", "length", "is_regular"), "rel", "left")
    how = F.when((F.lit(mode) == "temp") | ~F.coalesce("is_regular", F.lit(True)), "temp").otherwise("in_place")
    grown = F.greatest(at_least_0(F.col("size")) - F.coalesce("length", F.lit(0)), F.lit(0))
    return found.withColumn("mode", how).select("rel", "mode", F.when(F.col("mode") == "temp", at_least_0(F.col("size"))).otherwise(grown).cast("long").alias("extra_bytes"))


def repair_document(plan: DataFrame, estimates: DataFrame, figures: DataFrame, purged: DataFrame | None = None) -> DataFrame:
    """kind, rel, size, chunks_total, est_download_bytes, mode, extra_bytes: a row for each file to repair, then for each
    to purge. A file without an estimate counts with all its chunks."""
    all_ = F.aggregate("chunks", F.lit(0).cast("decimal(38,0)"), lambda s, c: (s + F.greatest(c["compressed_size"], F.lit(0))).cast("decimal(38,0)")).cast("long")
    rows = plan.join(estimates.select("rel", "est_download"), "rel", "left").join(figures, "rel", "left")
    repair = rows.select(F.lit("repair").alias("kind"), "rel", "size", F.size("chunks").cast("long").alias("chunks_total"), F.coalesce("est_download", all_).alias("est_download_bytes"), "mode", "extra_bytes")
    if purged is None:
        return repair.orderBy("rel")
    nothing = F.lit(None)
    gone = purged.where("verdict = 'purge'").select(F.lit("purge").alias("kind"), "rel", F.col("bytes").alias("size"), nothing.cast("long").alias("chunks_total"), nothing.cast("long").alias("est_download_bytes"), nothing.cast("string").alias("mode"), nothing.cast("long").alias("extra_bytes"))
    return repair.unionAll(gone).orderBy(F.col("kind").desc(), "rel")


def document_totals(document: DataFrame, jobs: int) -> DataFrame:
    """One row: the plan's line, summed from the rows of its document."""
    repair, gone = F.col("kind") == "repair", F.col("kind") == "purge"
    total = lambda when, c: saturating_sum(F.when(when, F.col(c))).cast("long")
    return document.agg(F.count_if(repair).alias("files"), total(repair, "est_download_bytes").alias("est_download"), total(repair, "size").alias("est_write"), (jobs * F.coalesce(F.max("extra_bytes"), F.lit(0))).alias("est_extra"), F.count_if(gone).alias("purge_files"), total(gone, "size").alias("purge_bytes"))


def scope_selected(plan: DataFrame, purged: DataFrame | None, include: list[str]) -> None:
    """Raise if includes select nothing at all, neither to repair nor to purge."""
    if include and plan.isEmpty() and (purged is None or purged.where("verdict <> 'out-of-scope'").isEmpty()):
        raise ValueError(f"include {', '.join(include)} selects nothing")


def purge_plan(disk: DataFrame, expected: DataFrame, keep: list[str], include: list[str] | None = None, exclude: list[str] | None = None, blocked: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(verdicts, directories that empty, deepest first, totals) of a cleanup. disk: rel, bytes (null: can't be read)."""
    readable = disk.where("bytes is not null")
    visible = in_scope(F.col("rel"), include or [], exclude or []) if include or exclude else None
    verdicts = purge(readable, expected, keep, visible, blocked)
    errors = disk.where("bytes is null").agg(F.count("*").alias("errors"))
    # the frames of totals have one row each
    return verdicts, empty_dirs(verdicts), purge_totals(verdicts).crossJoin(errors)


def entry_problems(files: DataFrame, context: str) -> DataFrame:
    """source, value, rule, pos of every path and chunk id of a manifest that can't be joined onto a bundle."""
    place = F.concat(F.lit(f"manifest {context} entry "), F.col("pos").cast("string"))
    paths = files.select(F.concat(place, F.lit(" file")).alias("source"), F.col("file").alias("value"), path_rule(F.col("file"), allow_device=True).alias("rule"), F.struct("pos", F.lit(-1).alias("cpos")).alias("pos"))
    ids = files.select("pos", F.posexplode("chunks").alias("cpos", "c")).select(F.concat(place, F.lit(" chunk "), F.col("cpos").cast("string"), F.lit(" id")).alias("source"), F.col("c.id").alias("value"), chunk_id_rule(F.col("c.id")).alias("rule"), F.struct("pos", "cpos").alias("pos"))
    return paths.unionAll(ids).where("rule is not null")


def sides_of(admitted: DataFrame, old_files: DataFrame, new_files: DataFrame) -> DataFrame:
    """Admitted captures (capture_id, field, file) with the entry of their own field in either build, null where it has none."""
    entry = lambda df, name: df.select("field", "file", F.struct("size", "md5", "chunks").alias(name))
    return admitted.join(entry(old_files, "old"), ["field", "file"], "left").join(entry(new_files, "new"), ["field", "file"], "left")


def manifest_wants(fields: DataFrame, tags: list[str], manifests: DataFrame) -> DataFrame:
    """Every field of both builds with its manifest (field, tag, id), id null where a build has none."""
    asked = fields.select("field").distinct().select("field", F.explode(F.array(*map(F.lit, tags))).alias("tag"))
    return asked.join(manifests.select("field", "tag", "id"), ["field", "tag"], "left")


def chunk_plan(admitted: DataFrame, old_chunks: DataFrame, new_chunks: DataFrame, ceiling: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(retention, wants, projected bytes) of a capture's store, for the admitted files (field, file) alone.

    A fetched chunk that is not of the new file or is reused as well raises, and so do projected bytes over the ceiling
    (equal passes; None: no ceiling, as for a run that fetches nothing).
    """
    chosen = admitted.select("field", "file").distinct()
    old, new = (df.join(chosen, ["field", "file"], "left_semi") for df in (old_chunks, new_chunks))
    kept = retention(new, old)
    roles = kept.groupBy("field", "file", "id").agg(F.collect_set("role").alias("r"))
    wrong = roles.where(F.array_contains("r", "patch_fetch") & (~F.array_contains("r", "materialize_new") | F.array_contains("r", "reuse")))
    broken = wrong.limit(1).collect()
    if broken:
        raise ValueError(f"fetched chunks of {broken[0].file} are not those that are new")
    wanted = wants(old.select(*new.columns).unionAll(new))
    projected = projected_download(wanted)
    if ceiling is not None and int(projected.first()[0]) > ceiling:
        raise ValueError(f"more than {ceiling} bytes to fetch")
    return kept, wanted, projected


def chunk_settlement(chunks: DataFrame) -> DataFrame:
    """Per file of chunks with an action (kept, copied, staged, resumed, download): what is kept, reused and fetched."""
    size = F.col("uncompressed_size")
    total = lambda *names: F.coalesce(F.sum(F.when(F.col("action").isin(*names), size)), F.lit(0)).alias
    return chunks.groupBy("rel").agg(total("kept", "resumed")("kept_bytes"), total("copied", "staged")("reused_bytes"), total("download")("fetched_bytes"), total("copied", "staged", "download")("written_bytes"))


def patch_rows(new_chunks: DataFrame, old_chunks: DataFrame, old_files: DataFrame, contents: DataFrame) -> DataFrame:
    """Each new chunk as REUSE of a verified slice of the old file or FETCH, and why. contents: field, file, content (old). A
    file's content meets the list of its chunks once."""
    chunk = ["cpos", "id", "source", "uncompressed_size", "uncompressed_md5", "compressed_size"]
    files = chunk_reuse(new_chunks, old_chunks).groupBy("field", "file").agg(F.collect_list(F.struct(*chunk)).alias("chunks"))
    met = files.join(old_files.select("field", "file", F.lit(True).alias("had")).distinct(), ["field", "file"], "left").join(contents.select("field", "file", "content"), ["field", "file"], "left")

    def judged(c: Column) -> Column:
        slice_ = F.when(c["source"].isNotNull(), F.struct(c["source"].alias("offset"), c["uncompressed_size"].alias("length"), c["uncompressed_md5"].alias("md5")))
        note = F.when(F.col("had").isNull(), "added").when(c["source"].isNull(), "new bytes").when(~slice_matches(F.col("content"), slice_), "slice differs")
        return F.struct(*[c[n].alias(n) for n in ("cpos", "id", "source", "compressed_size")], note.alias("note"))

    rows = met.select("field", "file", F.explode(F.transform("chunks", judged)).alias("c")).select("field", "file", "c.*")
    reused = F.col("note").isNull()
    return rows.select("field", "file", "cpos", "id", F.when(reused, "REUSE").otherwise("FETCH").alias("decision"), F.when(reused, F.col("source")).alias("source"), "note", "compressed_size")


def first_error(errors: DataFrame) -> DataFrame:
    """Of errors (idx, error) of parallel work that of the first item, null without one."""
    return errors.agg(F.min_by("error", "idx").alias("error"))


def capture_summary(frames: dict[str, DataFrame]) -> DataFrame:
    """One row that holds the counters of all phases, each a frame of one row, prefixed by its phase's name."""
    named = [df.select(*[F.col(c).alias(f"{phase}_{c}") for c in df.columns]) for phase, df in frames.items()]
    return reduce(DataFrame.crossJoin, named)  # one row each


def run_record(facts: dict[str, Column | None]) -> Column:
    """A SUMMARY record of keys in the order given; a key whose value is null is left out."""
    return F.to_json(F.struct(F.lit("summary").alias("event"), *[v.alias(k) for k, v in facts.items() if v is not None]), {"ignoreNullFields": "true"})


def report_record(facts: DataFrame) -> DataFrame:
    """facts with `record`, the REPORT line that comes before anything is done: version facts in a fixed order.

    facts: local_version (null: none), latest_version, biz, exe, download_mode, branch, package_id, build_id (null: left
    out), audio_langs and diff_tags (arrays; languages are sorted, tags stay as they are served).
    """
    joined = lambda c, sort: F.array_join(F.array_sort(c) if sort else F.col(c), ",")
    told = facts.withColumns({"local_version": F.coalesce("local_version", F.lit("none")), "audio_langs": joined("audio_langs", True), "diff_tags": joined("diff_tags", False)})
    line = as_line("REPORT", "local_version", "latest_version", "biz", "exe", "download_mode", "branch", "package_id", "build_id", "audio_langs", "diff_tags")
    return told.withColumn("record", line)


def moves(files: DataFrame, cache: str, target: str, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """rel, target_rel, bytes of the files below a voice cache that belong below the install, within the scope of their targets."""
    inside = files.where(F.col("rel").startswith(f"{cache.rstrip('/')}/"))
    to = F.concat(F.lit(f"{target.rstrip('/')}/"), F.substring("rel", F.lit(len(cache.rstrip("/")) + 2), F.length("rel")))
    out = inside.select("rel", to.alias("target_rel"), "bytes")
    return out.where(in_scope(F.col("target_rel"), include or [], exclude or [])) if include or exclude else out
