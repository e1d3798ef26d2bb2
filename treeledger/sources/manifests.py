"""Manifests as they are served: a zstd frame around a protobuf message. Spark has a reader for neither."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeledger.functions.paths import field_rule, tag_rule

CHUNK = "struct<id:string,uncompressed_md5:string,offset:bigint,compressed_size:bigint,uncompressed_size:bigint,unknown_field6:bigint,compressed_md5:string>"
ENTRIES = f"array<struct<file:string,chunks:array<{CHUNK}>,is_folder:boolean,size:bigint,md5:string>>"
_SCHEMA = f"build_tag string, field string, manifest_pos int, error string, entries {ENTRIES}"

# field numbers on the wire; every number is a varint, every other field has a length before it
_FILE = {1: "file", 2: "chunks", 3: "is_folder", 4: "size", 5: "md5"}
_CHUNK = {1: "id", 2: "uncompressed_md5", 3: "offset", 4: "compressed_size", 5: "uncompressed_size", 6: "unknown_field6", 7: "compressed_md5"}
MAGIC = b"\x28\xb5\x2f\xfd"


def _varint(data: memoryview, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at
        if shift > 63:
            raise ValueError("a number is too long")


def _fields(data: memoryview) -> Iterator[tuple[int, int | memoryview]]:
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
            yield key >> 3, value - (1 << 64) if value >> 63 else value
        elif kind == 2:
            n, at = _varint(data, at)
            if at + n > len(data):
                raise ValueError("a field reaches past the end")
            yield key >> 3, data[at : at + n]
            at += n
        else:
            at += {1: 8, 5: 4}[kind]


def _record(data: memoryview, names: dict[int, str]) -> dict:
    out = {n: [] if n == "chunks" else 0 if n in ("offset", "size", "compressed_size", "uncompressed_size", "unknown_field6") else False if n == "is_folder" else "" for n in names.values()}
    for number, value in _fields(data):
        name = names.get(number)
        if name == "chunks":
            out[name].append(_record(value, _CHUNK))
        elif name:
            out[name] = bool(value) if name == "is_folder" else value if isinstance(value, int) else bytes(value).decode()
    return out


def decode(message: bytes) -> list[dict]:
    """Entries of a manifest message."""
    return [_record(value, _FILE) for number, value in _fields(memoryview(message)) if number == 1]


def unpack(frame: bytes, limit: int, size: int | None = None, md5: str | None = None) -> bytes:
    """The message in a frame, when frame, size and digest are what was declared."""
    import zstandard

    if frame[:4] != MAGIC:
        raise ValueError("not a zstd frame")
    reader = zstandard.ZstdDecompressor().decompressobj()
    message = reader.decompress(frame) if zstandard.frame_content_size(frame) <= limit else None
    if message is None or len(message) > limit:
        raise ValueError(f"more than {limit} bytes")
    if not reader.eof:
        raise ValueError("the frame is cut short")
    if size is not None and size != len(message):
        raise ValueError(f"{len(message)} bytes instead of {size}")
    if md5 and hashlib.md5(message).hexdigest() != md5.lower():
        raise ValueError("the digest is not the checksum")
    return message


def read_manifests(served: DataFrame, limit: int = 1 << 28) -> DataFrame:
    """served (build_tag, field, manifest_pos, content, size, checksum) -> the manifest_file relation, one row an entry,
    and a row with `error` for each manifest that can't be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None
        for batch in batches:
            for row in batch.to_pylist():
                error, entries = None, None
                try:
                    entries = decode(unpack(row["content"], limit, row["size"], row["checksum"]))
                    for e in entries:
                        e["md5"] = e["md5"].lower()
                except Exception as e:  # what a server sends is data: the reason is the result
                    error = f"{type(e).__name__}: {e}"
                kind = kind or _arrow()
                yield pa.RecordBatch.from_arrays([pa.array([row["build_tag"]]), pa.array([row["field"]]), pa.array([row["manifest_pos"]], pa.int32()), pa.array([error], pa.string()), pa.array([entries], kind)], names=["build_tag", "field", "manifest_pos", "error", "entries"])

    decoded = served.select("build_tag", "field", F.col("manifest_pos").cast("int").alias("manifest_pos"), "content", "size", "checksum").mapInArrow(run, _SCHEMA)
    return decoded.select("build_tag", "field", "manifest_pos", "error", F.posexplode_outer("entries").alias("pos", "e")).select("build_tag", "field", "manifest_pos", "pos", "error", "e.*")


def _arrow() -> pa.DataType:
    chunk = pa.struct([(n, pa.int64() if n in ("offset", "compressed_size", "uncompressed_size", "unknown_field6") else pa.string()) for n in _CHUNK.values()])
    return pa.list_(pa.struct([("file", pa.string()), ("chunks", pa.list_(chunk)), ("is_folder", pa.bool_()), ("size", pa.int64()), ("md5", pa.string())]))


def blob_sizes(blobs: DataFrame, limit: int) -> DataFrame:
    """blobs (id, content: a zstd frame) -> id, size, md5 of what is in it, error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for id_, frame in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    data = unpack(frame, limit)
                    rows.append((id_, len(data), hashlib.md5(data).hexdigest(), None))
                except Exception as e:
                    rows.append((id_, None, None, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["id", "size", "md5", "error"])

    return blobs.select(F.col("id").cast("string").alias("id"), "content").mapInArrow(run, "id string, size long, md5 string, error string")


_PATHS = "build_tag string, field string, manifest_pos int, pos int, file string, is_folder boolean, size bigint, md5 string, chunks int"


def _named(entries: DataFrame) -> DataFrame:
    """Entries whose tag and field may name a folder; another tag or field raises."""
    why = F.coalesce(tag_rule(F.col("build_tag"), allow_device=True), field_rule(F.col("field")))
    return entries.withColumn("field", F.when(why.isNotNull(), F.raise_error(F.concat(F.lit("a dump can't be named: "), why))).otherwise(F.col("field")))


def write_dump(entries: DataFrame, path: str) -> None:
    """All of the manifest_file relation as gzipped JSON lines, a folder for each build and field."""
    _named(entries).write.option("compression", "gzip").partitionBy("build_tag", "field").json(path)


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    kind = "build_tag string, field string, manifest_pos int, pos int, file string, is_folder boolean, size bigint, md5 string, " + f"chunks array<{CHUNK}>"
    return spark.read.schema(kind).json(path)


def write_paths(entries: DataFrame, path: str) -> None:
    """The short form, a tab between columns: paths with sizes, digests and numbers of chunks."""
    short = _named(entries).withColumn("chunks", F.coalesce(F.size("chunks"), F.lit(0)))
    short.select(*[c.split()[0] for c in _PATHS.split(", ")]).write.csv(path, sep="\t", header=True)


def read_paths(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, schema=_PATHS)
