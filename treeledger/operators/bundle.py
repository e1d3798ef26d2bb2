"""Stored captures: their documents, what they hold, and what can be derived again from the bytes that they keep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeledger.functions.paths import path_rule
from treeledger.operators.assertions import boundaries_seen, check, every
from treeledger.operators.manifest import CLASSES

#: States of a class that a capture may be left with.
ACCEPTABLE = ["captured", "covered", "unavailable", "over_budget"]


def open_bundle(spark: SparkSession, root: str, versions: list[int]) -> DataFrame:
    """path (below root), schema_version, body (variant) of a bundle's JSON documents.

    A document that isn't JSON, has another version or an unsafe path makes the bundle unreadable and raises.
    """
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(root, wholetext=True).select(F.input_file_name().alias("at"), "value")
    plain = F.regexp_replace("at", "^[a-z]+:(//[^/]*)?(?=/)", "")
    base = f"{root.rstrip('/')}/"
    docs = found.select(F.substring(plain, F.lit(len(base) + 1), F.length(plain)).alias("path"), F.try_parse_json("value").alias("body"))
    version = F.try_variant_get("body", "$.schema_version", "int")
    why = F.when(path_rule(F.col("path")).isNotNull(), path_rule(F.col("path"))).when(F.col("body").isNull(), "not JSON").when(version.isNull(), "no version").when(~version.isin(versions), "unknown version")
    checked = docs.select("path", version.alias("schema_version"), "body", why.alias("why"))
    return checked.select("path", F.when(F.col("why").isNotNull(), F.raise_error(F.concat("path", F.lit(": "), "why"))).otherwise(F.col("schema_version")).alias("schema_version"), "body")


def bundle_manifest(matrix: DataFrame, files: DataFrame, sets: DataFrame) -> DataFrame:
    """One row, document: the classes of a capture, its files and their totals, and the chunks of each role, as JSON.

    matrix: class, status, file. files: path, bytes, md5, sha256, encoding. sets: role, chunks. The document is an index
    of one capture; whoever has more files than a document should hold keeps the inventory as a table.
    """
    totals = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    listed = files.agg(F.array_sort(F.collect_list(F.struct("path", "bytes", "md5", "sha256", "encoding"))).alias("files"))
    rank = F.array_position(F.array(*map(F.lit, CLASSES)), F.col("class"))
    rows = matrix.agg(F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "class", "status", "file"))), lambda r: F.struct(r["class"].alias("class"), r["status"].alias("status"), r["file"].alias("file"))).alias("matrix"))
    by_set = sets.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("role", "chunks")))).alias("totals_by_set"))
    one = totals.select(F.struct("files", "bytes").alias("totals")).crossJoin(rows).crossJoin(listed).crossJoin(by_set)  # one row each
    return one.select(F.to_json(F.struct(F.lit(1).alias("schema_version"), "totals", "matrix", "files", "totals_by_set")).alias("document"))


def references(index: DataFrame, tag: str, role: str) -> DataFrame:
    """capture_id, path, offset, chunk_id of an index (chunk_id, referenced_by: structs of tag, capture_id, path, role,
    offset), the references of each file in the order of their offsets."""
    rows = index.select("chunk_id", F.explode("referenced_by").alias("r")).where((F.col("r.tag") == tag) & (F.col("r.role") == role))
    return rows.select("r.capture_id", "r.path", "r.offset", "chunk_id").orderBy("capture_id", "path", "offset")


# --- assertions that are derived again


def reconciled(declared: DataFrame, decoded: DataFrame) -> DataFrame:
    """declared and decoded (name, files, chunks, bytes); what isn't declared isn't compared."""
    both = declared.alias("e").join(decoded.alias("a"), "name", "left")
    rows = both.select("name", F.explode(F.array(*[F.struct(F.lit(c).alias("what"), F.col(f"e.{c}").cast("long").alias("e"), F.col(f"a.{c}").cast("long").alias("a")) for c in ("files", "chunks", "bytes")])).alias("x")).where("x.e is not null")
    return check(rows, "A5", "decoded counts are those declared", F.concat_ws(" ", "name", "x.what"), F.col("x.e"), F.col("x.a"))


def blobs(stored: DataFrame, measured: DataFrame) -> DataFrame:
    """stored and measured (id, compressed_size, compressed_md5, uncompressed_size, uncompressed_md5)."""
    described = lambda df, name: df.select("id", F.concat_ws(" ", "compressed_size", F.lower("compressed_md5"), "uncompressed_size", F.lower("uncompressed_md5")).alias(name))
    return check(described(stored, "e").join(described(measured, "a"), "id", "left"), "A6", "a stored blob is what the index says", F.col("id"), F.col("e"), F.col("a"))


def assembled(declared: DataFrame, rebuilt: DataFrame, old: bool) -> DataFrame:
    """declared (path, size, md5) against files put together again (path, size, md5)."""
    both = declared.alias("e").join(rebuilt.alias("a"), "path", "left")
    id_, side = ("A7", "old") if old else ("A8", "new")
    said = lambda of: F.concat_ws(" ", F.col(f"{of}.size").cast("string"), F.lower(f"{of}.md5"))
    return check(both, id_, f"the {side} file put together has its digest", F.col("path"), said("e"), said("a"))


def patched(direct: DataFrame, by_patch: DataFrame) -> DataFrame:
    """Files from new chunks alone against files from the old one and the patch (path, md5)."""
    both = direct.select("path", F.col("md5").alias("e")).join(by_patch.select("path", F.col("md5").alias("a")), "path", "left")
    return check(both, "A9", "patched bytes are the direct ones", F.col("path"), F.col("e"), F.col("a"))


def reused_slices(slices: DataFrame) -> DataFrame:
    """slices (path, cpos, md5, content: the old file's bytes there)."""
    return check(slices, "A10", "a reused slice has its chunk's digest", F.concat_ws(" ", "path", "cpos"), F.lower("md5"), F.md5("content"))


def config_tags(configs: DataFrame) -> DataFrame:
    """configs (name, old_tag, version: read again from the written settings)."""
    return check(configs, "A13", "the settings name the old tag", F.col("name"), F.col("old_tag"), F.col("version"))


def strays(disk: DataFrame, allowed: DataFrame) -> DataFrame:
    """Every path of a bundle (path) is one that a document names."""
    known = disk.join(allowed.select("path", F.lit("named").alias("a")).distinct(), "path", "left")
    return check(known, "A14", "no path is stray", F.col("path"), F.lit("named"), F.coalesce("a", F.lit("stray")))


def class_states(matrix: DataFrame) -> DataFrame:
    """Every class has a row whose state is acceptable. matrix: class, status."""
    names = matrix.sparkSession.createDataFrame([(c,) for c in CLASSES], "class string")
    state = F.coalesce("status", F.lit("absent"))
    return check(names.join(matrix, "class", "left"), "A17", "every class has an acceptable state", F.col("class"), F.lit(True), state.isin(ACCEPTABLE))


def shipped(rebuilt: DataFrame, on_disk: DataFrame) -> DataFrame:
    """Files put together from blobs against those that the bundle ships (path, size, md5)."""
    both = rebuilt.alias("e").join(on_disk.alias("a"), "path", "left")
    said = lambda of: F.when(F.col(f"{of}.md5").isNull(), "absent").otherwise(F.concat_ws(" ", F.col(f"{of}.size").cast("string"), F.lower(f"{of}.md5")))
    return check(both, "A18", "rebuilt bytes are the shipped ones", F.col("path"), said("e"), said("a"))


def totals_are_sums(totals: DataFrame, plan: DataFrame) -> DataFrame:
    """totals (name, reuse, fetch, moved, download_bytes) against the rows of their plans (name, decision, moved, compressed_size)."""
    fetch = F.col("decision") == "FETCH"
    sums = plan.groupBy("name").agg(F.count_if(~fetch).alias("reuse"), F.count_if(fetch).alias("fetch"), F.count_if("moved").alias("moved"), F.sum(F.when(fetch, F.col("compressed_size")).otherwise(0).cast("long")).alias("download_bytes"))
    said = lambda of: F.concat_ws("/", *[F.col(f"{of}.{c}").cast("string") for c in ("reuse", "fetch", "moved", "download_bytes")])
    return check(totals.alias("e").join(sums.alias("a"), "name", "full_outer"), "A20", "totals are sums of the plan", F.col("name"), said("e"), said("a"))


def boundaries(chunks: DataFrame, scores: DataFrame) -> DataFrame:
    """Both sides of reuse, of moving and of size occur. chunks: source, offset; scores: old_size, new_size."""
    return every(
        boundaries_seen(chunks, "A21", "reused and new chunks occur", F.col("source").isNotNull()),
        boundaries_seen(chunks.where("source is not null"), "A22", "moved and unmoved chunks occur", F.col("source") != F.col("offset")),
        boundaries_seen(scores.where("old_size is not null and new_size is not null"), "A23", "grown and other files occur", F.col("new_size") > F.col("old_size")),
    )


def assembly(outcomes: DataFrame) -> DataFrame:
    """outcomes (capture_id, old_md5, old_found, new_md5, new_found, patched_md5) -> a row for each assertion that a
    capture's sides allow (A7, A8, A9)."""
    rows = outcomes.select(
        "capture_id",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.col("old_md5").isNotNull(), F.struct(F.lit("A7").alias("id"), F.lit("the old file put together has its digest").alias("text"), F.col("old_md5").alias("e"), F.col("old_found").alias("a"))),
                    F.when(F.col("new_md5").isNotNull(), F.struct(F.lit("A8").alias("id"), F.lit("the new file put together has its digest").alias("text"), F.col("new_md5").alias("e"), F.col("new_found").alias("a"))),
                    F.when(F.col("new_md5").isNotNull() & F.col("old_md5").isNotNull(), F.struct(F.lit("A9").alias("id"), F.lit("patched bytes are the direct ones").alias("text"), F.col("new_found").alias("e"), F.col("patched_md5").alias("a"))),
                )
            )
        ).alias("x"),
    )
    return rows.select("x.id", F.col("x.text").alias("assertion"), F.col("capture_id").alias("subject"), F.col("x.e").alias("expected"), F.col("x.a").alias("actual"), F.col("x.e").eqNullSafe(F.col("x.a")).alias("ok"))
