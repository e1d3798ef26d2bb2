"""JSON documents of any length, written by all tasks in order.

A document is rows of text: what comes before its list, an element a row, and what comes after. Rows are sorted by range, so each
task writes a run of them, and the runs one after the other are the document, the same bytes for any number of tasks. No
list of all elements is ever held.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeledger.operators.manifest import CLASSES

#: Fixed value: the version that documents name.
VERSION = 1


def pieces(head: DataFrame, elements: DataFrame, tail: str = "]}") -> DataFrame:
    """part, place, piece of a document. head: one row, piece (up to and with the `[`). elements: place (a struct or a column
    that orders them, different for each), element (a struct)."""
    first = elements.agg(F.min("place").alias("first"))
    body = elements.crossJoin(first).select(F.lit(1).alias("part"), "place", F.concat(F.when(F.col("place") == F.col("first"), "").otherwise(","), F.to_json("element", {"ignoreNullFields": "false"})).alias("piece"))
    none = F.lit(None).cast(elements.schema["place"].dataType)
    end = elements.sparkSession.range(1).select(F.lit(2).alias("part"), none.alias("place"), F.lit(tail).alias("piece"))
    return head.select(F.lit(0).alias("part"), none.alias("place"), "piece").unionAll(body).unionAll(end)


def text_of(document: DataFrame) -> str:
    """A short document as one string, such as one of a test."""
    return "\n".join(r.piece for r in document.orderBy("part", "place").select("piece").collect())


def write(document: DataFrame, path: str, parts: int) -> None:
    """pieces() as one file at `path`. Tasks write runs of rows; the runs are joined by streams of the file system, so the driver
    holds no more than a buffer."""
    spark = document.sparkSession
    runs = f"{path}.runs"
    document.repartitionByRange(parts, "part", "place").sortWithinPartitions("part", "place").select("piece").write.mode("overwrite").text(runs)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(runs)
    files = at.getFileSystem(conf)
    out = files.create(jvm.org.apache.hadoop.fs.Path(path), True)
    try:
        for status in sorted((s for s in files.listStatus(at) if s.getPath().getName().startswith("part-")), key=lambda s: s.getPath().getName()):
            part = files.open(status.getPath())
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
            finally:
                part.close()
    finally:
        out.close()
    files.delete(at, True)


def _headed(facts: DataFrame, name: str) -> DataFrame:
    """The head of a document: the columns of one row, and the name of the list that follows."""
    rows = F.to_json(F.struct(F.lit(VERSION).alias("schema_version"), *facts.columns), {"ignoreNullFields": "false"})
    return facts.select(F.concat(F.substring(rows, F.lit(1), F.length(rows) - 1), F.lit(f',"{name}":[')).alias("piece"))


def manifest_document(matrix: DataFrame, files: DataFrame, sets: DataFrame) -> DataFrame:
    """pieces() of the document that bundle_manifest() makes, for any number of files. matrix: class, status, file. files: path
    (each once), bytes, md5, sha256, encoding. sets: role, chunks."""
    totals = files.agg(F.struct(F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).alias("totals"))
    rank = F.array_position(F.array(*map(F.lit, CLASSES)), F.col("class"))
    # a row a class and a row a role
    rows = matrix.agg(F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "class", "status", "file"))), lambda r: F.struct(r["class"].alias("class"), r["status"].alias("status"), r["file"].alias("file"))).alias("matrix"))
    by_set = sets.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("role", "chunks")))).alias("totals_by_set"))
    head = _headed(totals.crossJoin(rows).crossJoin(by_set), "files")  # one row each
    return pieces(head, files.select(F.col("path").alias("place"), F.struct("path", "bytes", "md5", "sha256", "encoding").alias("element")))


def error_document(bodies: DataFrame, budget: int) -> DataFrame:
    """pieces() of the index of answers that were errors, in the order of their requests. bodies: seq (each once), url, status,
    attempts, content_type, bytes, stored, truncated, as reports.stored_bodies() gives them; an answer of which nothing was
    stored has no path."""
    path = F.when(F.col("stored") > 0, F.concat(F.lit("api/error_bodies/"), F.lpad(F.col("seq").cast("string"), 6, "0"), F.lit(".body")))
    element = F.struct("seq", "url", "status", "attempts", "content_type", F.col("bytes").alias("bytes_received"), F.col("stored").alias("retained_bytes"), "truncated", path.alias("stored_path"))
    totals = bodies.agg(F.lit(budget).alias("budget"), F.count("*").alias("count"), F.coalesce(F.sum("stored"), F.lit(0)).alias("retained_bytes"))
    return pieces(_headed(totals, "responses"), bodies.select(F.col("seq").alias("place"), element.alias("element")))


def api_document(bodies: DataFrame, stored: Column) -> DataFrame:
    """pieces() of the index of answers that a capture keeps byte by byte: seq (each once), file, bytes, sha256. stored: whether
    the body was written; else its path is null."""
    element = F.struct("seq", F.when(stored, F.concat(F.lit("api/"), "file")).alias("stored_as"), "bytes", "sha256")
    head = _headed(bodies.agg(F.count("*").alias("count"), F.count_if(stored).alias("stored")), "bodies")
    return pieces(head, bodies.select(F.col("seq").alias("place"), element.alias("element")))
