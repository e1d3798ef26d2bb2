"""A stored bundle held against its own documents, from its folder alone.

Its JSON documents are read once as variants and become relations by what they are; its other files are read by Spark's binary
reader. Blobs are found by what the index says of them, decoded once and sent to every file that uses them; files are put
together in sorted partitions, a chunk at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeledger.functions.cut import written
from treeledger.functions.paths import escape_devices
from treeledger.operators import assertions, bundle
from treeledger.operators.assertions import check, every
from treeledger.operators.manifest import rebuild, tiling
from treeledger.sources.files import contents, inventory
from treeledger.sources.manifests import unpack

#: Documents of a bundle, and fields of theirs.
MANIFEST, INDEX, CHECKSUMS, SELFCHECK = "MANIFEST.json", "chunks/index.json", "verify/checksums.json", "verify/selfcheck.json"
_FILE = "struct<path:string,bytes:bigint,md5:string,sha256:string,encoding:string>"
_BLOB = (
    "struct<chunk_id:string,stored_path:string,bytes:bigint,md5_compressed:string,md5_decompressed:string,sha256_compressed:string,uncompressed_size:bigint,partial:boolean,"
    "decode_error:variant,fetch_error:variant,measurement_error:variant,referenced_by:array<struct<tag:string,capture_id:string,path:string,role:string,offset:bigint>>>"
)
_SIDE = "struct<tag:string,size:bigint,md5:string,nchunks:bigint>"
_RANGE = "struct<start:bigint,end:bigint>"
_STEP = f"struct<i:bigint,decision:string,target_range:{_RANGE},source_range:{_RANGE},chunk_id:string,compressed_size:bigint,uncompressed_size:bigint>"
_TOTALS = "struct<chunks:bigint,reuse:bigint,fetch:bigint,moved:bigint,download_bytes:bigint>"
#: Documents that the list of digests can't hold, as they are written after it or are it.
UNLISTED = [MANIFEST, CHECKSUMS, SELFCHECK]


@dataclass(frozen=True)
class Bundle:
    """The relations of a bundle.

    matrix: class, status. listed: path, bytes, md5, sha256, encoding. blobs: chunk_id, stored_path, bytes, md5_compressed,
    md5_decompressed, sha256_compressed, uncompressed_size, why (it can't be used). references: chunk_id, tag, capture_id,
    path, role, offset. maps: capture_id, path, old, new, totals, download_bytes. steps: capture_id, i, decision, target_range,
    source_range, chunk_id, compressed_size, uncompressed_size. recorded: id, ok. versions: old_tag. files: rel, length,
    content.
    """

    matrix: DataFrame
    listed: DataFrame
    blobs: DataFrame
    references: DataFrame
    maps: DataFrame
    steps: DataFrame
    recorded: DataFrame
    versions: DataFrame
    files: DataFrame


def _rows(docs: DataFrame, path: str, field: str, kind: str) -> DataFrame:
    """The structs of a list in one document."""
    return docs.where(F.col("path") == path).select(F.explode(F.variant_get("body", f"$.{field}", f"array<{kind}>")).alias("r")).select("r.*")


def opened(spark: SparkSession, root: str, versions: list[int]) -> Bundle:
    """The bundle below root. A document that is missing, isn't JSON, has another version or an unsafe path raises."""
    docs = written(bundle.open_bundle(spark, root, versions).withColumn("body", F.to_json("body"))).withColumn("body", F.parse_json("body"))
    absent = [d for d in (MANIFEST, INDEX, CHECKSUMS, SELFCHECK) if d not in {r.path for r in docs.where(F.col("path").isin(MANIFEST, INDEX, CHECKSUMS, SELFCHECK)).select("path").collect()}]
    if absent:
        raise ValueError(f"{absent[0]} is missing")
    index = _rows(docs, INDEX, "blobs", _BLOB)
    given = lambda c: ~F.is_variant_null(c) & F.col(c).isNotNull()
    why = F.concat_ws(", ", *[F.when(given(c), c) for c in ("decode_error", "fetch_error", "measurement_error")], F.when(F.col("partial"), "partial"), F.when(F.col("stored_path").isNull(), "nothing was stored"))
    maps = docs.where("path like 'patchmaps/%'").select(
        F.variant_get("body", "$.capture_id", "string").alias("capture_id"), F.variant_get("body", "$.path", "string").alias("path"), F.variant_get("body", "$.old", _SIDE).alias("old"), F.variant_get("body", "$.new", _SIDE).alias("new"),
        F.variant_get("body", "$.totals", _TOTALS).alias("totals"), F.variant_get("body", "$.expectations.download_bytes", "bigint").alias("download_bytes"), F.variant_get("body", "$.plan", f"array<{_STEP}>").alias("plan"),
    )
    return Bundle(
        matrix=_rows(docs, MANIFEST, "matrix", "struct<class:string,status:string>"),
        listed=_rows(docs, CHECKSUMS, "entries", _FILE),
        blobs=index.withColumn("why", F.nullif(why, F.lit(""))).drop("decode_error", "fetch_error", "measurement_error", "partial", "referenced_by"),
        references=index.select("chunk_id", F.explode("referenced_by").alias("r")).select("chunk_id", "r.*"),
        maps=maps.drop("plan"),
        steps=maps.select("capture_id", F.explode("plan").alias("s")).select("capture_id", "s.*"),
        recorded=_rows(docs, SELFCHECK, "assertions", "struct<id:string,ok:boolean>"),
        versions=docs.where(F.col("path") == MANIFEST).select(F.variant_get("body", "$.versions.old.tag", "string").alias("old_tag")),
        files=contents(spark, root),
    )


def decoded(blobs: DataFrame, limit: int) -> DataFrame:
    """blobs (chunk_id, content: a zstd frame) -> chunk_id, data, error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for id_, frame in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = error = None
                try:
                    data = unpack(frame, limit) if frame is not None else None
                    error = "absent" if frame is None else None
                except Exception as e:  # a damaged blob is what is looked for
                    error = f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_arrays([pa.array([id_]), pa.array([data], pa.binary()), pa.array([error], pa.string())], names=["chunk_id", "data", "error"])

    return blobs.select("chunk_id", "content").mapInArrow(run, "chunk_id string, data binary, error string")


def _described(size: Column, md5: Column, sha256: Column, inner: Column, inner_md5: Column) -> Column:
    return F.concat_ws(" ", size.cast("string"), F.lower(md5), F.lower(sha256), inner.cast("string"), F.lower(inner_md5))


def stored_blobs(b: Bundle, chunks: DataFrame) -> DataFrame:
    """A6: the file of each blob is what the index says, inside and out. chunks: decoded()."""
    said = F.coalesce(F.col("why"), _described(F.col("bytes"), F.col("md5_compressed"), F.col("sha256_compressed"), F.col("uncompressed_size"), F.col("md5_decompressed")))
    on_disk = b.blobs.join(b.files.withColumnRenamed("rel", "stored_path"), "stored_path", "left").join(chunks, "chunk_id", "left")
    found = F.when(F.col("why").isNotNull(), "can't be used").when(F.col("content").isNull(), "absent").when(F.col("error").isNotNull(), F.col("error")).otherwise(_described(F.length("content"), F.md5("content"), F.sha2("content", 256), F.length("data"), F.md5("data")))
    return check(on_disk, "A6", "a stored blob is what the index says", F.coalesce("stored_path", "chunk_id"), said, found)


def _sides(b: Bundle) -> DataFrame:
    """capture_id, side, path, size, md5, nchunks that the patch maps declare."""
    one = lambda side: b.maps.where(F.col(side).isNotNull()).select("capture_id", F.lit(side).alias("side"), "path", f"{side}.size", f"{side}.md5", f"{side}.nchunks")
    return one("old").unionAll(one("new"))


def _used(b: Bundle) -> DataFrame:
    """capture_id, side, offset, chunk_id, length of the chunks that each side is put together from."""
    side = F.when(F.col("role") == "materialize_old", "old").when(F.col("role") == "materialize_new", "new")
    return b.references.select("capture_id", side.alias("side"), "offset", "chunk_id").where("side is not null").join(b.blobs.select("chunk_id", F.col("uncompressed_size").alias("length")), "chunk_id", "left")


def layouts(b: Bundle) -> DataFrame:
    """A11: the chunks of each side begin at 0, leave no hole and no overlap, and end at its size."""
    laid = tiling(_used(b).withColumn("key", F.concat_ws(" ", "capture_id", "side")), "key")
    found = laid.groupBy("capture_id", "side").agg(F.count("*").alias("n"), F.sum("gap").alias("gaps"), F.count("prev_offset").alias("over"), F.max(F.col("offset") + F.col("length")).alias("end"))
    both = _sides(b).join(found, ["capture_id", "side"], "left")
    return check(both, "A11", "chunks cover their file once", F.concat_ws(" ", "capture_id", "side"), F.concat_ws("/", "nchunks", "size", F.lit("0"), F.lit("0")), F.concat_ws("/", "n", "end", "gaps", "over"))


def closure(b: Bundle, chunks: DataFrame) -> DataFrame:
    """capture_id, side, chunk_id, error: the first chunk of each side that can't be had."""
    lost = _used(b).join(chunks.select("chunk_id", "error", F.col("data").isNotNull().alias("has")), "chunk_id", "left").where("has is null or not has")
    return lost.groupBy("capture_id", "side").agg(F.min_by(F.struct("chunk_id", F.coalesce("error", F.lit("not in the index")).alias("error")), "offset").alias("first")).select("capture_id", "side", "first.*")


def rebuilt(b: Bundle, chunks: DataFrame, lost: DataFrame) -> DataFrame:
    """A7, A8 and A18: each side whose chunks can be had, put together, has its digest and is the file that the bundle ships; a
    side whose chunks can't be had fails by name, and says nothing else."""
    parts = _used(b).join(lost.select("capture_id", "side"), ["capture_id", "side"], "left_anti").join(chunks.select("chunk_id", F.col("data").alias("bytes")), "chunk_id")
    made = rebuild(parts.select(F.col("capture_id").alias("field"), F.col("side").alias("file"), "offset", "bytes")).select(F.col("field").alias("capture_id"), F.col("file").alias("side"), F.col("size").alias("made_size"), F.col("md5").alias("made_md5"))
    made = written(_sides(b).join(made, ["capture_id", "side"]))
    old = F.col("side") == "old"
    shipped_at = F.concat(F.when(old, "game/").otherwise("expected/"), "path")
    said = lambda size, md5: F.concat_ws(" ", F.col(size).cast("string"), F.lower(md5))
    digests = [check(made.where(F.col("side") == side), id_, f"the {side} file put together has its digest", F.concat_ws(" ", "capture_id", "path"), said("size", "md5"), said("made_size", "made_md5")) for side, id_ in (("old", "A7"), ("new", "A8"))]
    on_disk = made.withColumn("rel", escape_devices(shipped_at)).join(b.files.select("rel", "length", F.md5("content").alias("disk_md5")), "rel", "left")
    same = check(on_disk, "A18", "rebuilt bytes are the shipped ones", F.col("rel"), said("made_size", "made_md5"), F.when(F.col("length").isNull(), "absent").otherwise(said("length", "disk_md5")))
    gone = check(lost, "A18", "rebuilt bytes are the shipped ones", F.concat_ws(" ", "capture_id", "side"), F.lit("all chunks"), F.concat_ws(": ", "chunk_id", "error"))
    return every(*digests, same, gone)


def arithmetic(b: Bundle) -> DataFrame:
    """A20: the totals of a patch map are sums over its plan, and a capture with a new side has totals."""
    fetch = F.col("decision") == "FETCH"
    moved = ~fetch & (F.col("source_range.start") != F.col("target_range.start"))
    sums = b.steps.groupBy("capture_id").agg(F.count("*").alias("chunks"), F.count_if(~fetch).alias("reuse"), F.count_if(fetch).alias("fetch"), F.count_if(moved).alias("moved"), F.sum(F.when(fetch, F.col("compressed_size")).otherwise(0)).alias("bytes"))
    both = b.maps.join(sums, "capture_id", "left")
    names = ["chunks", "reuse", "fetch", "moved", "bytes", "bytes"]
    zero = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("0"))
    declared = F.concat_ws("/", *[F.col(f"totals.{c}").cast("string") for c in ("chunks", "reuse", "fetch", "moved", "download_bytes")], F.col("download_bytes").cast("string"))
    expected = F.when(F.col("new").isNull(), zero("download_bytes")).otherwise(declared)
    return check(both, "A20", "totals are sums of the plan", F.concat(F.lit("patchmaps/"), "capture_id"), expected, F.when(F.col("new").isNull(), F.lit("0")).otherwise(F.concat_ws("/", *map(zero, names))))


def plan_in_index(b: Bundle) -> DataFrame:
    """A12: each fetched chunk of a plan is one that the index keeps for the patch of that capture, at its place."""
    fetched = b.steps.where("decision = 'FETCH'").select("capture_id", "i", "chunk_id", F.col("target_range.start").alias("offset"))
    kept = b.references.where("role = 'patch_fetch'").select("capture_id", "chunk_id", "offset", F.lit(True).alias("kept")).distinct()
    both = fetched.join(kept, ["capture_id", "chunk_id", "offset"], "left")
    return check(both, "A12", "fetched chunks are new and not reused", F.concat_ws(" ", "capture_id", "i"), F.lit(True), F.coalesce("kept", F.lit(False)))


def listed_files(b: Bundle) -> DataFrame:
    """A16: each listed file has the size and the digests that the list says."""
    said = lambda of: F.concat_ws(" ", F.col(f"{of}.bytes").cast("string"), F.lower(f"{of}.md5"), F.lower(f"{of}.sha256"))
    disk = inventory(b.files.where(~F.col("rel").isin(UNLISTED)).join(b.listed.select(F.col("path").alias("rel")), "rel", "left_semi"))
    return check(b.listed.alias("e").join(disk.alias("a"), "path", "left"), "A16", "the inventory lists each file with its digest", F.col("path"), said("e"), F.when(F.col("a.bytes").isNull(), "absent").otherwise(said("a")))


def settings_tag(b: Bundle) -> DataFrame:
    """A13: the settings that the bundle ships name the old tag."""
    version = F.regexp_extract(F.col("content").cast("string"), r"(?m)^\s*game_version\s*=\s*(\S+)\s*$", 1)
    found = b.files.where("rel = 'game/config.ini'").agg(F.max(version).alias("version"))
    return check(b.versions.crossJoin(found), "A13", "the settings name the old tag", F.lit("game/config.ini"), F.col("old_tag"), F.col("version"))  # one row each


def verified(b: Bundle, limit: int = 1 << 28) -> DataFrame:
    """id, assertion, subject, expected, actual, ok of everything that the bundle's own bytes can support."""
    usable = b.blobs.where("why is null").join(b.files.select(F.col("rel").alias("stored_path"), "content"), "stored_path", "left")
    chunks = written(decoded(usable, limit))
    lost = written(closure(b, chunks))
    named = b.listed.select("path").unionAll(b.listed.sparkSession.createDataFrame([(p,) for p in UNLISTED], "path string"))
    return every(
        listed_files(b), stored_blobs(b, chunks), layouts(b), rebuilt(b, chunks, lost), arithmetic(b), plan_in_index(b), settings_tag(b),
        bundle.class_states(b.matrix), bundle.strays(b.files.select(F.col("rel").alias("path")), named),
    )


def headline(rows: DataFrame) -> DataFrame:
    """One row, line: what is wrong at the root; null if nothing is.

    A file that can't be put together comes before a damaged blob, which comes before all else, as the others follow from
    them: a list whose digest no longer fits is a symptom of a blob that doesn't decode.
    """
    rank = F.when((F.col("id") == "A18") & (F.col("expected") == "all chunks"), 0).when(F.col("id") == "A6", 1).otherwise(2)
    line = F.concat_ws("", "id", F.lit(" "), "subject", F.lit(": "), "actual")
    return rows.where(~F.col("ok")).agg(F.min_by(line, F.struct(rank, "id", "subject")).alias("line"))


def report(b: Bundle, rows: DataFrame) -> DataFrame:
    """One row: result, total, passed, failed, line (see headline()), agrees (what the bundle recorded as right is right)."""
    counts = rows.agg(F.count("*").alias("total"), F.count_if("ok").alias("passed"), F.count_if(~F.col("ok")).alias("failed"))
    agreed = assertions.agreement(b.recorded, rows).agg(F.coalesce(F.bool_and("agrees"), F.lit(True)).alias("agrees"))
    one = assertions.result(rows).crossJoin(counts).crossJoin(headline(rows)).crossJoin(agreed)  # one row each
    return one.select("result", "total", "passed", "failed", "line", "agrees")
