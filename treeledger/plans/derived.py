"""Manifests, trees and logs derived from the driver's tables by rules that both Spark and DuckDB can follow.

BLOCK characters of a document's text are a chunk; builds differ by residues of doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bodies(spark: SparkSession, sf_dir: str, build: str) -> DataFrame:
    """field, file, doc_id, body of the old or the new build."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("field"), F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("file"))
    if build == "old":
        return d.where("doc_id % 13 <> 0").select("field", "file", "doc_id", F.col("text").alias("body"))
    t, n = F.col("text"), F.col("doc_id")
    swapped = F.concat(F.substring(t, F.lit(BLOCK + 1), F.lit(BLOCK)), F.substring(t, F.lit(1), F.lit(BLOCK)), F.substring(t, F.lit(2 * BLOCK + 1), F.length(t)))
    body = F.when(n % 3 == 0, F.concat(F.lit("v2 "), t)).when(n % 5 == 0, F.concat(t, F.lit("tail"))).when(n % 7 == 1, swapped).otherwise(t)
    return d.where("doc_id % 11 <> 0").select("field", "file", "doc_id", body.alias("body"))


def manifest(spark: SparkSession, sf_dir: str, build: str) -> DataFrame:
    """The manifest_file relation of a build: one pass over each body cuts it, and each block is digested once."""
    cut = F.regexp_extract_all("body", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    read = F.transform(cut, lambda part, i: F.struct(F.md5(part).alias("id"), (i * BLOCK).cast("long").alias("offset"), F.length(part).cast("long").alias("n")))
    chunks = F.transform(read, lambda c: F.struct(c["id"].alias("id"), c["id"].alias("uncompressed_md5"), c["offset"].alias("offset"), c["n"].alias("compressed_size"), c["n"].alias("uncompressed_size")))
    return bodies(spark, sf_dir, build).where(F.length("body") > 0).select("field", F.lit(0).alias("manifest_pos"), F.col("doc_id").alias("pos"), "file", F.lit(False).alias("is_folder"), F.length("body").cast("long").alias("size"), F.md5("body").alias("md5"), chunks.alias("chunks"))


def side(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    """One of two trees: each lacks and changes other documents than the other; dst spells some paths in capitals; some
    paths are a folder on one side, and there are folders of either and of both, and links of dst with a file below."""
    d = table(spark, sf_dir, "documents")
    n, dst = F.col("doc_id"), which == "dst"
    source = F.when((n % 17 == 0) & F.lit(dst), F.upper("source")).otherwise(F.col("source"))
    folder = n % (37 if dst else 43) == 0
    size = F.when(folder, 0).otherwise(F.col("n_chars") + F.when((n % 19 == 0) & F.lit(dst), 1).otherwise(0))
    mtime = F.when(folder, 0).otherwise(n * 1000 + F.when((n % 23 == 0) & F.lit(dst), 7).otherwise(0))
    digest = F.md5(F.when((n % 29 == 0) & F.lit(dst), F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    none = F.create_map().cast("map<string,binary>")
    hashes = F.when(folder, none).otherwise(F.create_map(F.lit("md5"), F.unhex(digest)))
    here = d.where(n % (11 if dst else 13) != 0)
    row = lambda rel, kind, size, mtime, hashes, link=False: [rel.alias("rel"), kind.alias("kind"), size.cast("long").alias("size"), mtime.cast("long").alias("mtime_ns"), hashes.alias("hashes"), F.lit(link).alias("is_link")]
    at = lambda head, tail="": F.concat(F.lit(head), n.cast("string"), F.lit(tail))
    zero, a_dir = F.lit(0), F.lit("dir")
    files = here.select(*row(F.concat_ws("/", source, F.col("lang"), n.cast("string")), F.when(folder, "dir").otherwise("file"), size, mtime, hashes))
    dirs = here.where(n % 10 == 0).select(*row(at("dirs/"), a_dir, zero, zero, none))
    shared = d.where(n % (50 if dst else 100) == 7).select(*row(at("links/"), a_dir, zero, zero, none, dst))
    out = files.unionAll(dirs).unionAll(shared)
    return out.unionAll(d.where(n % 50 == 7).select(*row(at("links/", "/x"), F.lit("file"), F.lit(1), F.lit(1), none))) if dst else out


def odd_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest with folders, nameless and repeated entries, other separators and letters, chunk lists that are empty,
    out of order or gapped, empty chunks, sizes that are wrong and ids that stand for two contents."""
    n = F.col("doc_id")
    name = (
        F.when(n % 14 == 5, "").when(n % 9 == 1, F.concat(F.lit("odd\\"), n.cast("string"))).when(n % 8 == 2, F.concat_ws("/", F.lit("twice"), (n % 40).cast("string")))
        .when(n % 12 == 6, F.concat(F.lit("\u00e9/"), n.cast("string"))).otherwise(F.concat(F.lit("plain/"), n.cast("string")))
    )
    first, second = 100 + n % 7, F.when(n % 7 == 3, 0).otherwise(50)
    chunk = lambda id_, offset, size: F.struct(id_.alias("id"), F.md5(F.concat_ws("-", id_, (n % 2).cast("string"))).alias("uncompressed_md5"), offset.cast("long").alias("offset"), size.cast("long").alias("compressed_size"), size.cast("long").alias("uncompressed_size"))
    a = chunk(F.concat(F.lit("a"), (n % 20).cast("string")), F.lit(0), first)
    b = chunk(F.concat(F.lit("b"), n.cast("string")), first + F.when(n % 6 == 2, 5).otherwise(0), second)
    none = F.array().cast("array<struct<id:string,uncompressed_md5:string,offset:bigint,compressed_size:bigint,uncompressed_size:bigint>>")
    chunks = F.when((n % 10 == 3) | (n % 6 == 4), none).when(n % 6 == 1, F.array(b, a)).otherwise(F.array(a, b))
    size = F.when((n % 10 == 3) | (n % 6 == 4), 0).otherwise(first + second + F.when(n % 6 == 2, 5).otherwise(0)) + F.when(n % 5 == 0, 1).otherwise(0)
    return table(spark, sf_dir, "documents").select(F.lit("game").alias("field"), F.lit(0).alias("manifest_pos"), n.alias("pos"), name.alias("file"), (n % 10 == 3).alias("is_folder"), size.cast("long").alias("size"), F.md5(n.cast("string")).alias("md5"), chunks.alias("chunks"))


#: The same relations for DuckDB, as common table expressions.
SQL = {
    "bodies": """docs AS (SELECT doc_id, text, lang AS field, source || '/' || lang || '/' || doc_id AS file FROM documents),
old_body AS (SELECT field, file, doc_id, text AS body FROM docs WHERE doc_id % 13 <> 0),
new_body AS (SELECT field, file, doc_id, CASE WHEN doc_id % 3 = 0 THEN 'v2 ' || text WHEN doc_id % 5 = 0 THEN text || 'tail'
  WHEN doc_id % 7 = 1 THEN substr(text, 257, 256) || substr(text, 1, 256) || substr(text, 513) ELSE text END AS body FROM docs WHERE doc_id % 11 <> 0)""",
    "files": """old_file AS (SELECT field, file, length(body) AS size, md5(body) AS md5 FROM old_body WHERE length(body) > 0),
new_file AS (SELECT field, file, length(body) AS size, md5(body) AS md5 FROM new_body WHERE length(body) > 0)""",
    "chunks": """old_chunk AS (SELECT field, file, doc_id, i AS cpos, i * 256 AS off, md5(substr(body, i * 256 + 1, 256)) AS m, length(substr(body, i * 256 + 1, 256)) AS n
  FROM (SELECT *, unnest(range((length(body) + 255) // 256)) AS i FROM old_body)),
new_chunk AS (SELECT field, file, doc_id, i AS cpos, i * 256 AS off, md5(substr(body, i * 256 + 1, 256)) AS m, length(substr(body, i * 256 + 1, 256)) AS n
  FROM (SELECT *, unnest(range((length(body) + 255) // 256)) AS i FROM new_body))""",
    "reuse": """first_old AS (SELECT field, file, m, n, arg_min(off, cpos) AS source FROM old_chunk GROUP BY ALL),
reuse AS (SELECT c.*, f.source FROM new_chunk c LEFT JOIN first_old f USING (field, file, m, n))""",
    "score": """old_sum AS (SELECT field, file, sum(n) AS old_bytes FROM old_chunk GROUP BY ALL),
score AS (SELECT field, file, count(*) AS nchunks, count(source) AS reused, count(*) FILTER (source <> off) AS moved, count(*) FILTER (source < off) AS moved_later,
  count(*) FILTER (source > off) AS moved_earlier, coalesce(max(source + n), 0) AS old_max_end, sum(n)::BIGINT AS new_bytes, sum(CASE WHEN source IS NULL THEN n ELSE 0 END)::BIGINT AS patch_bytes,
  coalesce(any_value(old_bytes), 0)::BIGINT AS old_bytes, (sum(n) + coalesce(any_value(old_bytes), 0))::BIGINT AS total_cost FROM reuse LEFT JOIN old_sum USING (field, file) GROUP BY ALL)""",
    "diff": """diff AS (SELECT field, file, CASE WHEN o.md5 IS NULL THEN 'added' WHEN w.md5 IS NULL THEN 'removed' WHEN o.md5 = w.md5 AND o.size = w.size THEN 'identical' ELSE 'changed' END AS state,
  o.size AS old_size, w.size AS new_size FROM old_file o FULL JOIN new_file w USING (field, file))""",
    "scored": """scored AS (SELECT d.*, s.* EXCLUDE (field, file), CASE WHEN state <> 'changed' THEN state WHEN moved > 0 THEN 'reuse_moved' WHEN reused = 0 AND nchunks > 1 THEN 'no_reuse'
  WHEN reused > 0 AND reused < nchunks THEN 'reuse_in_place' END AS class FROM diff d LEFT JOIN score s USING (field, file))""",
    "sides": """src AS (SELECT source || '/' || lang || '/' || doc_id AS rel, CASE WHEN doc_id % 43 = 0 THEN 'dir' ELSE 'file' END AS kind, CASE WHEN doc_id % 43 = 0 THEN 0 ELSE n_chars END AS size,
  CASE WHEN doc_id % 43 = 0 THEN 0 ELSE doc_id * 1000 END AS mtime_ns, CASE WHEN doc_id % 43 <> 0 THEN md5(text) END AS h, false AS is_link FROM documents WHERE doc_id % 13 <> 0
  UNION ALL SELECT 'dirs/' || doc_id, 'dir', 0, 0, NULL, false FROM documents WHERE doc_id % 10 = 0 AND doc_id % 13 <> 0 UNION ALL SELECT 'links/' || doc_id, 'dir', 0, 0, NULL, false FROM documents WHERE doc_id % 100 = 7),
dst AS (SELECT CASE WHEN doc_id % 17 = 0 THEN upper(source) ELSE source END || '/' || lang || '/' || doc_id AS rel, CASE WHEN doc_id % 37 = 0 THEN 'dir' ELSE 'file' END AS kind,
  CASE WHEN doc_id % 37 = 0 THEN 0 ELSE n_chars + CASE WHEN doc_id % 19 = 0 THEN 1 ELSE 0 END END AS size, CASE WHEN doc_id % 37 = 0 THEN 0 ELSE doc_id * 1000 + CASE WHEN doc_id % 23 = 0 THEN 7 ELSE 0 END END AS mtime_ns,
  CASE WHEN doc_id % 37 <> 0 THEN md5(CASE WHEN doc_id % 29 = 0 THEN text || '!' ELSE text END) END AS h, false AS is_link FROM documents WHERE doc_id % 11 <> 0
  UNION ALL SELECT 'dirs/' || doc_id, 'dir', 0, 0, NULL, false FROM documents WHERE doc_id % 10 = 0 AND doc_id % 11 <> 0 UNION ALL SELECT 'links/' || doc_id, 'dir', 0, 0, NULL, true FROM documents WHERE doc_id % 50 = 7
  UNION ALL SELECT 'links/' || doc_id || '/x', 'file', 1, 1, NULL, false FROM documents WHERE doc_id % 50 = 7)""",
    "odd": """odd_file AS (SELECT doc_id, CASE WHEN doc_id % 14 = 5 THEN '' WHEN doc_id % 9 = 1 THEN 'odd' || chr(92) || doc_id WHEN doc_id % 8 = 2 THEN 'twice/' || (doc_id % 40) WHEN doc_id % 12 = 6 THEN 'é/' || doc_id ELSE 'plain/' || doc_id END AS file,
  doc_id % 10 = 3 AS is_folder, doc_id % 10 = 3 OR doc_id % 6 = 4 AS bare, 100 + doc_id % 7 AS a, CASE WHEN doc_id % 7 = 3 THEN 0 ELSE 50 END AS b, CASE WHEN doc_id % 6 = 2 THEN 5 ELSE 0 END AS gap, md5(doc_id::VARCHAR) AS md5,
  CASE WHEN bare THEN 0 ELSE a + b + gap END + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS size FROM documents),
odd_chunk AS (SELECT doc_id, file, is_folder, CASE WHEN doc_id % 6 = 1 THEN 1 ELSE 0 END AS cpos, 'a' || (doc_id % 20) AS id, md5('a' || (doc_id % 20) || '-' || (doc_id % 2)) AS m, 0 AS off, a AS n FROM odd_file WHERE NOT bare
  UNION ALL SELECT doc_id, file, is_folder, CASE WHEN doc_id % 6 = 1 THEN 0 ELSE 1 END, 'b' || doc_id, md5('b' || doc_id || '-' || (doc_id % 2)), a + gap, b FROM odd_file WHERE NOT bare)""",
}


def with_(*names: str) -> str:
    """WITH clause of these relations and of what they stand on."""
    order = ["bodies", "files", "chunks", "reuse", "score", "diff", "scored", "sides", "odd"]
    needs = {"files": ["bodies"], "chunks": ["bodies"], "reuse": ["chunks"], "score": ["reuse"], "diff": ["files"], "scored": ["diff", "score"]}
    wanted = set()

    def add(n: str) -> None:
        for m in needs.get(n, []):
            add(m)
        wanted.add(n)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(SQL[n] for n in order if n in wanted) + "\n"
