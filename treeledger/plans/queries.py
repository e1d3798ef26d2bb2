"""Registered queries over the driver's tables, each beside the DuckDB SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeledger.functions import globs, paths, records, totals
from treeledger.functions.cut import written
from treeledger.operators import assertions, manifest, repair, reports, selection, sync, trees
from treeledger.plans.derived import manifest as build
from treeledger.plans.derived import BLOCK, bodies, odd_manifest, side, table, with_
from treeledger.plans.registry import query
from treeledger.sources import requests

def _chunks(spark: SparkSession, d: str, which: str) -> DataFrame:
    return manifest.flatten(build(spark, d, which))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    old, new = build(spark, d, "old"), build(spark, d, "new")
    return manifest.scored(old, new, manifest.flatten(old), manifest.flatten(new))


def _reuse(spark: SparkSession, d: str) -> DataFrame:
    return manifest.chunk_reuse(_chunks(spark, d, "new"), _chunks(spark, d, "old"))


@query(with_("chunks") + "SELECT field, file, cpos, off AS \"offset\", m AS id, n AS uncompressed_size FROM new_chunk")
def manifest_flatten(spark, d):
    return _chunks(spark, d, "new").select("field", "file", F.col("cpos").cast("long").alias("cpos"), "offset", "id", "uncompressed_size")


@query(with_("diff") + "SELECT * FROM diff")
def manifest_diff_state(spark, d):
    return manifest.path_diff(build(spark, d, "old"), build(spark, d, "new"))


@query(with_("score") + "SELECT * FROM score")
def path_score(spark, d):
    return manifest.path_scores(_chunks(spark, d, "new"), _chunks(spark, d, "old"))


@query(with_("scored") + "SELECT coalesce(class, 'none') AS class, count(*) AS files, sum(coalesce(patch_bytes, 0))::BIGINT AS patch_bytes FROM scored GROUP BY 1")
def class_population(spark, d):
    return _scored(spark, d).groupBy(F.coalesce("class", F.lit("none")).alias("class")).agg(F.count("*").alias("files"), F.sum(F.coalesce("patch_bytes", F.lit(0))).alias("patch_bytes"))


@query(with_("scored") + """SELECT field, count(*) FILTER (state = 'added') AS added, count(*) FILTER (state = 'removed') AS removed, count(*) FILTER (state = 'identical') AS identical,
count(*) FILTER (state = 'changed') AS changed, coalesce(sum(patch_bytes), 0)::BIGINT AS patch_bytes, coalesce(sum(new_size), 0)::BIGINT AS new_bytes FROM scored GROUP BY GROUPING SETS ((field), ())""")
def diff_rollup(spark, d):
    return manifest.diff_rollup(_scored(spark, d))


@query(with_("reuse") + """SELECT count(*) AS chunks, count(source) AS in_file, count(*) FILTER (m IN (SELECT m FROM old_chunk)) AS anywhere,
count(*) FILTER (m IN (SELECT m FROM old_chunk) AND source IS NULL) AS across_only,
count(DISTINCT CASE WHEN m IN (SELECT m FROM old_chunk) AND source IS NULL THEN field || ':' || file END) AS files_across_only FROM reuse""")
def reuse_pool(spark, d):
    return manifest.reuse_pool(_chunks(spark, d, "new"), _chunks(spark, d, "old"))


@query(with_("reuse") + "SELECT field, file, sum(CASE WHEN source IS NULL THEN n ELSE 0 END)::BIGINT AS est_download FROM reuse GROUP BY ALL")
def download_estimate(spark, d):
    return repair.download_estimate(_reuse(spark, d))


@query(with_("reuse") + """, usable AS (SELECT r.*, o.size AS usable FROM reuse r LEFT JOIN (SELECT field, file, length(body) AS size FROM old_body) o USING (field, file)),
k AS (SELECT field, file, count(*) FILTER (source + n <= usable AND source >= off) AS kept_ascending, count(*) FILTER (source + n <= usable AND source <= off) AS kept_descending FROM usable GROUP BY ALL)
SELECT *, kept_descending <= kept_ascending AS ascending FROM k""")
def salvage_order(spark, d):
    return repair.salvage_order(_usable(spark, d))


def _usable(spark: SparkSession, d: str) -> DataFrame:
    old = build(spark, d, "old").select("field", "file", F.col("size").alias("usable_len"))
    return _reuse(spark, d).join(old, ["field", "file"], "left")


@query(with_("reuse") + """, usable AS (SELECT r.*, o.size AS usable, r.cpos % 4 <> 1 AS dest_ok FROM reuse r LEFT JOIN (SELECT field, file, length(body) AS size FROM old_body) o USING (field, file)),
k AS (SELECT field, file, count(*) FILTER (source + n <= usable AND source <= off) <= count(*) FILTER (source + n <= usable AND source >= off) AS up FROM usable GROUP BY ALL)
SELECT field, file, count(*) FILTER (NOT dest_ok) AS damaged, sum(CASE WHEN NOT dest_ok AND NOT coalesce(source + n <= usable AND CASE WHEN up THEN source >= off ELSE source <= off END, false) THEN n ELSE 0 END)::BIGINT AS est_download
FROM usable JOIN k USING (field, file) GROUP BY ALL""")
def scanned_estimate(spark, d):
    chunks = _usable(spark, d).withColumn("dest_ok", F.col("cpos") % 4 != 1)
    return repair.scanned_estimate(chunks, repair.salvage_order(chunks))


@query(with_("files") + """SELECT count(*) AS files, sum(w.size)::BIGINT AS est_write, (4 * max(greatest(0, w.size - coalesce(o.size, 0))))::BIGINT AS est_extra
FROM new_file w LEFT JOIN old_file o USING (field, file)""")
def disk_plan(spark, d):
    old = build(spark, d, "old").select("field", "file", F.col("size").alias("on_disk"))
    return repair.disk_plan(build(spark, d, "new").join(old, ["field", "file"], "left"), jobs=4, in_place=True)


@query(with_("files") + """, t AS (SELECT count(*) AS files, sum(size)::BIGINT AS bytes, max(size)::BIGINT AS largest FROM new_file)
SELECT what, actual, lim AS "limit" FROM (SELECT 'files' AS what, files AS actual, 10::BIGINT AS lim FROM t UNION ALL SELECT 'bytes', bytes, 1000000000000 FROM t UNION ALL SELECT 'largest', largest, 100 FROM t) WHERE actual > lim""")
def limit_hits(spark, d):
    row = build(spark, d, "new").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.max("size").alias("largest"))
    return repair.limit_hits(row, {"files": 10, "bytes": 10**12, "largest": 100})


@query("""WITH r AS (SELECT l_orderkey, row_number() OVER o AS i, cast(l_quantity AS BIGINT) AS len, coalesce(sum(cast(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base
 FROM lineitem WINDOW o AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)),
p AS (SELECT l_orderkey, base + CASE WHEN i % 3 = 0 THEN 5 WHEN i % 5 = 0 THEN -2 ELSE 0 END AS off, len FROM r),
c AS (SELECT *, coalesce(max(off + len) OVER (PARTITION BY l_orderkey ORDER BY off, len ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reach FROM p)
SELECT count(*) FILTER (off > reach) AS gaps, sum(greatest(off - reach, 0))::BIGINT AS gap_bytes, count(*) FILTER (reach > off) AS overlaps FROM c""")
def layout_tiling(spark, d):
    t = manifest.tiling(_layout(spark, d), "l_orderkey")
    return t.agg(F.count_if(F.col("gap") > 0).alias("gaps"), F.sum("gap").alias("gap_bytes"), F.count("prev_offset").alias("overlaps"))


def _layout(spark: SparkSession, d: str) -> DataFrame:
    o = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    length = F.col("l_quantity").cast("long")
    base = F.coalesce(F.sum(length).over(o.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    i = F.row_number().over(o)
    rows = table(spark, d, "lineitem").select("l_orderkey", length.alias("length"), base.alias("base"), i.alias("i"))
    return rows.select("l_orderkey", (F.col("base") + F.when(F.col("i") % 3 == 0, 5).when(F.col("i") % 5 == 0, -2).otherwise(0)).alias("offset"), "length")


@query(with_("chunks") + """, v AS (SELECT field, file, cpos, CASE WHEN cpos % 5 = 2 THEN off + 3 WHEN cpos % 7 = 3 THEN -1 ELSE off END AS off, n, (SELECT 0) AS z FROM new_chunk),
s AS (SELECT v.*, w.size FROM v JOIN (SELECT field, file, length(body) AS size FROM new_body) w USING (field, file)),
l AS (SELECT *, coalesce(lag(off + n) OVER (PARTITION BY field, file ORDER BY cpos), 0) AS prev FROM s),
r AS (SELECT field, file, cpos, CASE WHEN off < 0 OR n < 0 THEN 'negative' WHEN off + n > size THEN 'past-end' WHEN n = 0 THEN 'empty' WHEN off > prev THEN 'gap' WHEN off < prev THEN 'overlap' END AS rule FROM l)
SELECT * FROM r WHERE rule IS NOT NULL""")
def range_violations(spark, d):
    files = build(spark, d, "new")
    c = manifest.flatten(files).join(files.select("field", "file", "size"), ["field", "file"])
    c = c.withColumn("offset", F.when(F.col("cpos") % 5 == 2, F.col("offset") + 3).when(F.col("cpos") % 7 == 3, -1).otherwise(F.col("offset")))
    return manifest.range_violations(c).withColumn("cpos", F.col("cpos").cast("long"))


@query(with_("odd") + """, c AS (SELECT f.doc_id, f.doc_id % 3 AS moved, c.cpos, off + CASE WHEN f.doc_id % 11 = 3 AND off > 0 THEN -2 ELSE 0 END AS off, n, f.size FROM odd_chunk c JOIN odd_file f USING (doc_id)),
l AS (SELECT *, coalesce(lag(off + n) OVER w, 0) AS prev FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY cpos)),
r AS (SELECT doc_id, cpos, CASE WHEN off + n > size THEN 'past-end' WHEN n = 0 THEN 'empty' WHEN off > prev THEN 'gap' WHEN off < prev THEN 'overlap' END AS rule FROM l)
SELECT 'game' AS field, doc_id::VARCHAR AS file, cpos::BIGINT AS cpos, rule FROM r WHERE rule IS NOT NULL UNION ALL SELECT 'game', doc_id::VARCHAR, NULL, 'total' FROM c GROUP BY doc_id HAVING sum(n) <> any_value(size)""")
def layout_violations(spark, d):
    """Ranges of a manifest whose sizes may be wrong, chunk by chunk and as a whole."""
    rows = odd_manifest(spark, d).withColumn("file", F.col("pos").cast("string"))
    chunks = rows.select("field", "file", "manifest_pos", "pos", "size", F.posexplode("chunks").alias("cpos", "c")).select("field", "file", "manifest_pos", "pos", "size", "cpos", "c.*")
    offset = F.col("offset") + F.when((F.col("pos") % 11 == 3) & (F.col("offset") > 0), -2).otherwise(0)
    return manifest.layout_violations(chunks.withColumn("offset", offset))


@query(with_("odd") + """, t AS (SELECT doc_id, sum(n) AS total, max(n) AS mx, bool_or(off <= prev) AS unsorted, bool_or(off <> prev_end) AS gapped FROM (SELECT *, lag(off) OVER w AS prev, lag(off + n) OVER w AS prev_end FROM odd_chunk WINDOW w AS (PARTITION BY doc_id ORDER BY cpos)) GROUP BY 1),
f AS (SELECT * FROM odd_file LEFT JOIN t USING (doc_id))
SELECT count(*) FILTER (bare) AS empty, count(*) FILTER (contains(file, chr(92))) AS backslash, count(*) FILTER (regexp_matches(file, '[^\\x00-\\x7F]')) AS non_ascii, count(*) FILTER (unsorted) AS unsorted, count(*) FILTER (gapped) AS gapped,
count(*) FILTER (NOT is_folder AND coalesce(total, 0) <> size) AS wrong_size, max(mx)::BIGINT AS max_chunk, (count(*) - count(DISTINCT file))::BIGINT AS duplicates FROM f""")
def structure_counts(spark, d):
    return manifest.structure_counts(odd_manifest(spark, d))


@query(with_("odd") + "SELECT doc_id, file, cpos, id, off AS \"offset\", n AS uncompressed_size FROM odd_chunk WHERE NOT is_folder AND file <> ''")
def manifest_flatten_odd(spark, d):
    return manifest.flatten(odd_manifest(spark, d)).select(F.col("pos").alias("doc_id"), "file", F.col("cpos").cast("long").alias("cpos"), "id", "offset", "uncompressed_size")


@query("""WITH p AS (SELECT doc_id, lower(source) || '/' || lang || '/' || (doc_id // 2) AS rel, row_number() OVER (PARTITION BY source, lang, doc_id // 2 ORDER BY doc_id) AS nth FROM documents)
SELECT doc_id, rel FROM p WHERE nth = 1""")
def first_wins_dedupe(spark, d):
    doc = F.col("doc_id")
    odd = F.when(doc % 2 == 0, F.col("source")).otherwise(F.upper("source"))
    files = table(spark, d, "documents").select("doc_id", F.lit(0).alias("manifest_pos"), doc.alias("pos"), F.concat_ws("/", odd, "lang", F.floor(doc / 2).cast("string")).alias("file"), F.lit(False).alias("is_folder"))
    return repair.plan_files(files).select("doc_id", paths.path_key(F.col("rel")).alias("rel"))


@query("""SELECT source || '/' || lang || '/' || doc_id AS rel FROM documents WHERE regexp_matches(source || '/' || lang || '/' || doc_id, '^src1.*/(en|fr)/.*$') AND NOT regexp_matches(source || '/' || lang || '/' || doc_id, '^.*7$')""")
def scope_filter(spark, d):
    rel = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    return table(spark, d, "documents").select(rel.alias("rel")).where(globs.in_scope(F.col("rel"), ["SRC1*/en/*", "src1*\\fr\\*"], ["*7"]))


@query("""SELECT source || '/' || lang || '/' || doc_id AS rel FROM documents WHERE lang <> 'fr' AND source <> 'src3' AND NOT regexp_matches(doc_id::VARCHAR, '^.?5$')""")
def ancestor_exclude(spark, d):
    rel = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    return table(spark, d, "documents").select(rel.alias("rel")).where(globs.kept_by_filter(F.col("rel"), [], ["src?/fr", "src??/fr", "SRC3", "src*/??/5", "src*/??/?5"]))


#: Installed files: those of the old build, records of voice packs among them, and two folders of which nothing is expected.
_DISK = with_("files") + """, disk AS (SELECT CASE WHEN doc_id % 31 = 0 THEN regexp_replace(file, '[^/]*$', '') || CASE WHEN doc_id % 2 = 0 THEN 'Audio_' || doc_id || '_pkg_version' ELSE 'AUDIO_LANG_' || doc_id END
  WHEN doc_id % 11 = 0 THEN 'gone/' || (doc_id % 3) || '/' || doc_id ELSE file END AS rel, length(body) AS bytes FROM old_body WHERE length(body) > 0),
v AS (SELECT rel, bytes, CASE WHEN rel IN (SELECT file FROM new_file) THEN 'expected' WHEN lower(rel) = 'gone/1/22' THEN 'kept' WHEN lower(rel) = 'gone/0/33' THEN 'blocked'
  WHEN lower(split_part(rel, '/', -1)) LIKE 'audio\\_lang\\_%' ESCAPE '\\' OR lower(split_part(rel, '/', -1)) LIKE 'audio\\_%\\_pkg\\_version' ESCAPE '\\' THEN 'audio-version' ELSE 'purge' END AS verdict FROM disk)
"""


def _installed(spark: SparkSession, d: str) -> DataFrame:
    n, old = F.col("pos"), build(spark, d, "old")
    record = F.concat(F.regexp_replace("file", "[^/]*$", ""), F.when(n % 2 == 0, F.concat(F.lit("Audio_"), n.cast("string"), F.lit("_pkg_version"))).otherwise(F.concat(F.lit("AUDIO_LANG_"), n.cast("string"))))
    gone = F.concat_ws("/", F.lit("gone"), (n % 3).cast("string"), n.cast("string"))
    return old.select(F.when(n % 31 == 0, record).when(n % 11 == 0, gone).otherwise(F.col("file")).alias("rel"), F.col("size").alias("bytes"))


@query(_DISK + "SELECT * FROM v")
def purge_keepset_anti(spark, d):
    return repair.purge(_installed(spark, d), build(spark, d, "new").select(F.col("file").alias("rel")), keep=["GONE/1/22"], blocked=["gone/0/33"])


@query(_DISK + """, u AS (SELECT split_part(rel, '/', 1) AS dir, verdict FROM v UNION ALL SELECT split_part(rel, '/', 1) || '/' || split_part(rel, '/', 2), verdict FROM v)
SELECT dir FROM u GROUP BY dir HAVING bool_and(verdict = 'purge')""")
def purge_empty_dirs(spark, d):
    return repair.empty_dirs(purge_keepset_anti(spark, d))


@query(_DISK + "SELECT count(*) FILTER (verdict = 'purge') AS files, coalesce(sum(bytes) FILTER (verdict = 'purge'), 0)::BIGINT AS bytes, 0::BIGINT AS hidden FROM v")
def purge_totals(spark, d):
    return repair.purge_totals(purge_keepset_anti(spark, d))


_TAG = """CASE WHEN s.rel IS NULL OR d.rel IS NULL OR s.kind <> d.kind THEN NULL WHEN s.kind = 'dir' THEN 'dir-present' WHEN s.size <> d.size AND s.mtime_ns <> d.mtime_ns THEN 'stat-size+stat-mtime' WHEN s.size <> d.size THEN 'stat-size'
WHEN s.mtime_ns <> d.mtime_ns THEN 'stat-mtime' WHEN s.h <> d.h THEN 'digest-differs:md5' ELSE 'digest-matches:md5' END"""
_FOLDED = "translate(s.rel, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') = translate(d.rel, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _tree_sql(on: str, name: str = "") -> str:
    """A pair in two spellings is a case mismatch and has the bucket of its contents besides. name: as a relation, not a query."""
    pairs, rows = _tree_parts(on)
    return with_("sides") + pairs + (f", {name} AS ({rows})" if name else f"\n{rows}")


def _tree_parts(on: str) -> tuple[str, str]:
    return f""", j AS (SELECT s.rel AS src_rel, d.rel AS dst_rel, s.kind AS src_kind, d.kind AS dst_kind, {_TAG} AS tag FROM src s FULL JOIN dst d ON {on})""", """SELECT CASE WHEN dst_rel IS NULL THEN 'missing' WHEN src_rel IS NULL THEN 'extra' WHEN src_kind <> dst_kind THEN 'type-conflict' WHEN tag NOT IN ('digest-matches:md5', 'dir-present') THEN 'changed' ELSE 'identical' END AS bucket,
coalesce(src_rel <> dst_rel, false) AS case_mismatch, * FROM j"""


def _diff(spark: SparkSession, d: str, fold: bool) -> DataFrame:
    return trees.tree_diff(side(spark, d, "src"), side(spark, d, "dst"), trees.Trust(), ["md5"], fold)


@query(_tree_sql("s.rel = d.rel"))
def tree_diff_exact(spark, d):
    return _diff(spark, d, False)


@query(_tree_sql(_FOLDED))
def tree_diff_folded(spark, d):
    return _diff(spark, d, True)


def _summary_sql(on: str) -> str:
    return f"""WITH t AS ({_tree_sql(on)}), c AS (SELECT count(*) FILTER (bucket = 'missing') AS missing, count(*) FILTER (bucket = 'extra') AS extra, count(*) FILTER (bucket = 'changed') AS changed, count(*) FILTER (bucket = 'type-conflict') AS type_conflict,
count(*) FILTER (case_mismatch) AS case_mismatch, count(*) FILTER (bucket = 'identical') AS identical, count(*) FILTER (bucket <> 'identical') AS total FROM t) SELECT *, total + case_mismatch = 0 AS in_step FROM c"""


@query(_summary_sql("s.rel = d.rel"))
def tree_diff_summary(spark, d):
    return trees.diff_summary(_diff(spark, d, False))


@query(_summary_sql(_FOLDED))
def tree_diff_folded_summary(spark, d):
    return trees.diff_summary(_diff(spark, d, True))


@query(with_("sides") + "SELECT s.rel AS src_rel, d.rel AS dst_rel FROM src s JOIN dst d ON lower(s.rel) = lower(d.rel) WHERE s.rel <> d.rel")
def case_renames(spark, d):
    return trees.case_renames(side(spark, d, "src"), side(spark, d, "dst"))


@query(with_("sides") + """, t AS (SELECT CASE WHEN s.kind = 'dir' THEN 'dir-present' WHEN s.h <> d.h THEN 'digest-differs:md5' ELSE 'digest-matches:md5' END AS tag FROM src s JOIN dst d USING (rel) WHERE s.kind = d.kind) SELECT tag, count(*) AS pairs FROM t GROUP BY tag""")
def verdict_tags(spark, d):
    diff = trees.tree_diff(side(spark, d, "src"), side(spark, d, "dst"), trees.Trust(size=False, mtime=False), ["md5"])
    return diff.where("tag is not null").groupBy("tag").agg(F.count("*").alias("pairs"))


@query(with_("sides") + """, t AS (SELECT CASE WHEN s.kind = 'dir' THEN 'dir-present' WHEN s.size <> d.size AND s.mtime_ns <> d.mtime_ns THEN 'unverifiable:size+mtime' WHEN s.size <> d.size THEN 'unverifiable:size' WHEN s.mtime_ns <> d.mtime_ns THEN 'unverifiable:mtime' ELSE 'stat-match' END AS tag FROM src s JOIN dst d USING (rel) WHERE s.kind = d.kind) SELECT tag, count(*) AS pairs FROM t GROUP BY tag""")
def verdict_unverifiable(spark, d):
    diff = trees.tree_diff(side(spark, d, "src"), side(spark, d, "dst"), trees.Trust(size=False, mtime=False), [])
    return diff.where("tag is not null").groupBy("tag").agg(F.count("*").alias("pairs"))


def _effective(spark: SparkSession, d: str) -> DataFrame:
    return trees.with_cache(side(spark, d, "src").drop("hashes"), side(spark, d, "dst"))


_FRESH = with_("sides") + ", e AS (SELECT s.rel, s.kind, d.h, coalesce(s.kind = 'file' AND d.kind = 'file' AND s.size = d.size AND s.mtime_ns = d.mtime_ns, false) AS fresh, s.h AS now FROM src s LEFT JOIN dst d USING (rel))\n"


@query(_FRESH + "SELECT 'src' AS side, 'md5' AS algo, count(*) FILTER (fresh) AS have, count(*) FILTER (NOT fresh) AS undecided FROM e WHERE kind = 'file' UNION ALL SELECT 'src', 'sha256', 0, count(*) FROM e WHERE kind = 'file'")
def coverage_tally(spark, d):
    return trees.coverage(_effective(spark, d).withColumn("side", F.lit("src")), ["md5", "sha256"])


@query(_FRESH + """SELECT count(*) AS live, count(*) FILTER (kind = 'file') AS files, count(*) FILTER (kind = 'dir') AS dirs, count(*) FILTER (fresh) AS cache_hit, count(*) FILTER (kind = 'file' AND NOT fresh) AS undecided,
count(*) FILTER (kind = 'file' AND NOT fresh AND length(rel) % 2 = 0) AS hashed, count(*) FILTER (kind = 'file' AND NOT fresh AND length(rel) % 2 = 1) AS stat_only, (SELECT count(*) FROM dst WHERE rel NOT IN (SELECT rel FROM src)) AS pruned FROM e""")
def scan_stats(spark, d):
    src, dst = side(spark, d, "src"), side(spark, d, "dst")
    read = src.where("kind = 'file' and length(rel) % 2 = 0").select("rel", F.col("hashes").alias("computed"))
    e = _effective(spark, d).join(read, "rel", "left").withColumn("computed", F.when(~F.col("fresh"), F.col("computed")))
    return trees.scan_stats(e, trees.stale(dst, src))


@query(_FRESH + "SELECT rel, CASE WHEN fresh THEN h ELSE now END AS md5 FROM e")
def cache_merge(spark, d):
    now = side(spark, d, "src").select("rel", F.col("hashes").alias("computed"))
    e = _effective(spark, d).join(now, "rel").withColumn("computed", F.when(~F.col("fresh"), F.col("computed")))
    return trees.merged(e).select("rel", F.lower(F.hex(F.col("hashes")["md5"])).alias("md5"))


@query(with_("sides") + "SELECT rel, size FROM dst WHERE rel NOT IN (SELECT rel FROM src)")
def stale_prune(spark, d):
    return trees.stale(side(spark, d, "dst"), side(spark, d, "src")).select("rel", "size")


_ACTIONS = _tree_sql("s.rel = d.rel", "t") + """, lk AS (SELECT rel AS link, rel IN (SELECT rel FROM src) AS shared FROM dst WHERE is_link),
x AS (SELECT dst_rel AS rel, dst_kind AS kind, link, shared FROM t LEFT JOIN lk ON dst_rel = link OR starts_with(dst_rel, link || '/') WHERE bucket = 'extra'),
a AS (SELECT 0 AS stage_rank, 'FIX-DIR' AS stage, src_rel AS rel, NULL AS because FROM t WHERE bucket = 'type-conflict' AND src_kind = 'dir'
UNION ALL SELECT 1, 'MKDIR', src_rel, NULL FROM t WHERE bucket = 'missing' AND src_kind = 'dir'
UNION ALL SELECT DISTINCT 2, 'DELETE', link, NULL FROM x WHERE link IS NOT NULL AND NOT shared UNION ALL SELECT 2, 'DELETE', rel, NULL FROM x WHERE link IS NULL AND kind = 'file'
UNION ALL SELECT 3, 'COPY', src_rel, bucket FROM t WHERE bucket IN ('missing', 'changed', 'type-conflict') AND src_kind = 'file'
UNION ALL SELECT 4, 'RMDIR', rel, NULL FROM x WHERE link IS NULL AND kind = 'dir')
"""


def _links(spark: SparkSession, d: str) -> DataFrame:
    return side(spark, d, "dst").where("is_link").select("rel", "kind", F.lit(None).cast("string").alias("target"))


@query(_ACTIONS + "SELECT * FROM a")
def sync_plan_actions(spark, d):
    return sync.sync_plan(_diff(spark, d, False), _links(spark, d))


@query(_ACTIONS + "SELECT 0 AS renamed, count(*) FILTER (stage = 'MKDIR') AS mkdir, count(*) FILTER (stage = 'COPY') AS copied, count(*) FILTER (stage = 'DELETE') AS deleted, count(*) FILTER (stage = 'RMDIR') AS rmdir, false AS missing_only, false AS keep_extra FROM a")
def sync_plan_summary(spark, d):
    return sync.plan_summary(sync_plan_actions(spark, d))


@query(_ACTIONS + "SELECT 'shared-link' AS rule, min(rel) AS rel, link AS at FROM x WHERE shared GROUP BY link")
def sync_plan_guards(spark, d):
    diff, dst, links = _diff(spark, d, False), side(spark, d, "dst"), _links(spark, d)
    return sync.guards(sync.sync_plan(diff, links), dst, links, sync.shared_link_extras(diff, links))


@query(with_("sides") + ", p AS (SELECT s.rel FROM src s JOIN dst d USING (rel) WHERE s.kind = 'file' AND d.kind = 'file' AND s.size = d.size AND s.mtime_ns = d.mtime_ns) SELECT unnest(['src', 'dst']) AS side, rel, 'sha256' AS missing FROM p")
def hash_plan(spark, d):
    plan = sync.hash_plan(side(spark, d, "src"), side(spark, d, "dst"), trees.Trust(), ["md5", "sha256"])
    return plan.select("side", "rel", F.array_join("missing", "+").alias("missing"))


@query(with_("sides") + """, t AS (SELECT n.rel, n.kind, n.size, n.mtime_ns, CASE WHEN n.kind = 'file' THEN n.h END AS md5 FROM src n) SELECT rel, kind, size, mtime_ns, md5 FROM t""")
def record_update(spark, d):
    src = side(spark, d, "src")
    rel = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    contents = table(spark, d, "documents").where("doc_id % 43 <> 0").select(rel.alias("rel"), F.col("text").alias("content"))
    out = sync.updated(src.drop("hashes"), side(spark, d, "dst"), contents, ["md5"])
    return out.select("rel", "kind", "size", "mtime_ns", F.lower(F.hex(F.col("hashes")["md5"])).alias("md5"))


# dst as the record, src as the disk: a pair of one size and time is decided by reading the disk alone
@query(with_("sides") + """, j AS (SELECT r.rel AS src_rel, n.rel AS dst_rel, CASE WHEN r.rel IS NULL OR n.rel IS NULL OR r.kind <> n.kind THEN NULL WHEN r.kind = 'dir' THEN 'dir-present' WHEN r.size <> n.size AND r.mtime_ns <> n.mtime_ns THEN 'stat-size+stat-mtime' WHEN r.size <> n.size THEN 'stat-size'
WHEN r.mtime_ns <> n.mtime_ns THEN 'stat-mtime' WHEN r.h <> n.h THEN 'digest-differs:md5' WHEN r.rel IS NOT NULL AND n.rel IS NOT NULL THEN 'digest-matches:md5' END AS tag, r.kind AS rk, n.kind AS nk FROM dst r FULL JOIN src n ON r.rel = n.rel)
SELECT CASE WHEN dst_rel IS NULL THEN 'missing' WHEN src_rel IS NULL THEN 'extra' WHEN rk <> nk THEN 'type-conflict' WHEN tag NOT IN ('digest-matches:md5', 'dir-present') THEN 'changed' ELSE 'identical' END AS bucket, coalesce(src_rel, dst_rel) AS rel, tag FROM j""")
def record_compare_self(spark, d):
    rel = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    contents = table(spark, d, "documents").where("doc_id % 43 <> 0").select(rel.alias("rel"), F.col("text").alias("content"))
    diff = sync.compare_self(side(spark, d, "dst"), side(spark, d, "src").drop("hashes"), contents, trees.Trust(), ["md5"])
    return diff.select("bucket", F.coalesce("src_rel", "dst_rel").alias("rel"), "tag")


@query(with_("sides") + """, r AS (SELECT * FROM dst WHERE rel NOT LIKE 'dirs/%' AND rel NOT LIKE 'links/%' AND rel NOT LIKE 'src2/%' AND rel NOT LIKE '%/fr/%7'), n AS (SELECT * FROM src WHERE rel NOT LIKE 'dirs/%' AND rel NOT LIKE 'links/%' AND rel NOT LIKE 'src2/%' AND rel NOT LIKE '%/fr/%7')
SELECT CASE WHEN n.rel IS NULL THEN 'missing' WHEN r.rel IS NULL THEN 'extra' WHEN r.kind <> n.kind THEN 'type-conflict' WHEN r.kind = 'dir' THEN 'identical' WHEN r.size <> n.size OR r.mtime_ns <> n.mtime_ns THEN 'changed' ELSE 'identical' END AS bucket, count(*) AS n FROM r FULL JOIN n ON r.rel = n.rel GROUP BY 1""")
def record_compare_filtered(spark, d):
    """A stored record against the disk by stat, without what a filter hides on either side."""
    hidden = ["dirs/**", "links/*", "src2/**", "*/fr/*7"]
    stored = written(side(spark, d, "dst").select("rel", "kind", "size", "mtime_ns", "hashes"))
    record = sync.record_side(stored, exclude=hidden, fold=False)
    live = sync.record_side(side(spark, d, "src"), exclude=hidden, fold=False)
    return trees.tree_diff(record, live).groupBy("bucket").agg(F.count("*").alias("n"))


@query("""SELECT p_partkey, CASE WHEN (p_partkey % 2)::INT + (p_partkey % 3 = 0)::INT >= (p_partkey % 5 = 0)::INT + (p_partkey % 7 = 0)::INT THEN 'md5' ELSE 'sha256' END AS algo FROM part""")
def any_of_pick(spark, d):
    k = F.col("p_partkey")
    has = lambda a, b: F.array_compact(F.array(F.when(a, "md5"), F.when(b, "sha256")))
    return table(spark, d, "part").select("p_partkey", trees.any_of(has(k % 2 == 1, k % 5 == 0), has(k % 3 == 0, k % 7 == 0), ["md5", "sha256"]).alias("algo"))


_CHANGED = with_("scored") + ", c AS (SELECT field, file, total_cost::BIGINT AS total_cost, moved, reused FROM scored WHERE state = 'changed')\n"


@query(_CHANGED + "SELECT field, file, row_number() OVER (ORDER BY total_cost, field <> 'game', field, moved DESC, reused DESC, file) AS rank FROM c")
def scoring_rank(spark, d):
    return selection.ranked(_scored(spark, d).where("state = 'changed'").select("field", "file", "total_cost", "moved", "reused")).select("field", "file", "rank")


@query(_CHANGED + "SELECT field, file, row_number() OVER (ORDER BY total_cost, field <> 'game', field, file) AS admission_rank FROM c")
def admission_rank(spark, d):
    return selection.admission_ranked(_scored(spark, d).where("state = 'changed'").select("field", "file", F.col("total_cost").alias("budget_cost"))).select("field", "file", "admission_rank")


@query("""WITH c AS (SELECT p_partkey, cast(round(p_retailprice * 100) AS BIGINT) AS cost FROM part), s AS (SELECT *, sum(cost) OVER (ORDER BY cost, p_partkey ROWS UNBOUNDED PRECEDING)::BIGINT AS spent FROM c)
SELECT * FROM s WHERE spent <= 20000000""")
def greedy_budget(spark, d):
    items = table(spark, d, "part").select("p_partkey", F.round(F.col("p_retailprice") * 100).cast("long").alias("cost"))
    return selection.admitted_prefix(items, 20_000_000, "p_partkey")


@query("""WITH RECURSIVE i AS (SELECT p_partkey, cast(round(p_retailprice * 100) AS BIGINT) AS cost, row_number() OVER (ORDER BY p_partkey) AS nth FROM part),
w AS (SELECT 0::BIGINT AS nth, NULL::BIGINT AS k, 0::BIGINT AS spent, false AS ok UNION ALL SELECT i.nth, i.p_partkey, CASE WHEN w.spent + i.cost <= 2000000 THEN w.spent + i.cost ELSE w.spent END, w.spent + i.cost <= 2000000 FROM w JOIN i ON i.nth = w.nth + 1)
SELECT k AS p_partkey, ok AS admitted FROM w WHERE k IS NOT NULL""")
def greedy_fold(spark, d):
    items = table(spark, d, "part").select("p_partkey", F.round(F.col("p_retailprice") * 100).cast("long").alias("cost"))
    return selection.greedy(items, 2_000_000, "p_partkey", key="p_partkey").select("p_partkey", "admitted")


@query(with_("scored") + """, k AS (SELECT unnest(['identical', 'no_reuse', 'reuse_in_place', 'reuse_moved', 'added', 'removed']) AS class),
m AS (SELECT class, coalesce(CASE state WHEN 'removed' THEN old_size WHEN 'added' THEN new_bytes ELSE total_cost END, 0)::BIGINT AS c, field, file FROM scored)
SELECT class, arg_min(field, (c, field <> 'game', field, file)) AS field, arg_min(file, (c, field <> 'game', field, file)) AS file, CASE WHEN count(file) = 0 THEN 'unavailable' ELSE 'captured' END AS status FROM k LEFT JOIN m USING (class) GROUP BY class""")
def class_matrix(spark, d):
    found = selection.candidates(_scored(spark, d).fillna(0, ["reused", "moved", "nchunks", "total_cost"]))
    _, status = selection.select_by_class(found, per_class=1, budget=10**15)
    return spark.createDataFrame([(s["class"], s["field"], s["file"], s["status"]) for s in status], "class string, field string, file string, status string")


@query(with_("chunks") + "SELECT m AS id, count(*) AS \"references\", count(DISTINCT field || ':' || file) AS files, max(n) AS bytes, 0::BIGINT AS conflicts, max(n) AS compressed_size FROM new_chunk GROUP BY m")
def wants_by_chunk(spark, d):
    return manifest.wants(_chunks(spark, d, "new"))


@query(with_("odd") + """, k AS (SELECT * FROM odd_chunk WHERE NOT is_folder AND file <> ''), f AS (SELECT id, arg_min(m, (doc_id, cpos)) AS m, arg_min(n, (doc_id, cpos)) AS n FROM k GROUP BY 1)
SELECT k.id, count(*) AS "references", count(DISTINCT file) AS files, any_value(f.n)::BIGINT AS bytes, count(*) FILTER (k.m <> f.m OR k.n <> f.n) AS conflicts, max(k.n)::BIGINT AS compressed_size FROM k JOIN f USING (id) GROUP BY k.id""")
def wants_with_conflicts(spark, d):
    return manifest.wants(manifest.flatten(odd_manifest(spark, d)))


@query(with_("reuse") + """SELECT 'materialize_old' AS role, count(DISTINCT field || ':' || file || ':' || m) AS chunks FROM old_chunk UNION ALL SELECT 'materialize_new', count(DISTINCT field || ':' || file || ':' || m) FROM new_chunk
UNION ALL SELECT CASE WHEN source IS NULL THEN 'patch_fetch' ELSE 'reuse' END, count(DISTINCT field || ':' || file || ':' || m) FROM reuse GROUP BY source IS NULL""")
def retention_sets(spark, d):
    return manifest.retention(_chunks(spark, d, "new"), _chunks(spark, d, "old")).groupBy("role").agg(F.count("*").alias("chunks"))


@query(with_("reuse") + """SELECT field, count(*) AS chunks, count(source) AS reuse, count(*) - count(source) AS fetch, count(*) FILTER (source <> off) AS moved, sum(CASE WHEN source IS NULL THEN n ELSE 0 END)::BIGINT AS download_bytes FROM reuse GROUP BY field""")
def patch_totals(spark, d):
    return manifest.patch_totals(manifest.patch_plan(_chunks(spark, d, "new"), _chunks(spark, d, "old")))


@query(with_("bodies") + "SELECT file AS rel, md5(body) AS md5, true AS tiled FROM new_body WHERE length(body) > 0")
def rebuild_files(spark, d):
    cut = F.regexp_extract_all("body", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    parts = bodies(spark, d, "new").where(F.length("body") > 0).select("field", "file", F.posexplode_outer(cut).alias("i", "part"))
    # offsets are in bytes here
    start = F.sum(F.octet_length("part")).over(Window.partitionBy("field", "file").orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("field", "file", F.coalesce(start, F.lit(0)).alias("offset"), F.encode("part", "utf-8").alias("bytes"))
    return manifest.rebuild(parts).select(F.col("file").alias("rel"), "md5", "tiled")


@query("SELECT event_type AS kind, count(*) AS requests, sum(cast(round(value * 100) AS BIGINT))::BIGINT AS bytes_in, max(event_id) AS last_seq FROM events GROUP BY 1")
def request_bytes_by_kind(spark, d):
    e = table(spark, d, "events")
    return requests.by_kind(e.select(F.col("event_type").alias("kind"), F.round(F.col("value") * 100).cast("long").alias("bytes_in"), F.col("event_id").alias("seq")))


@query("""WITH b AS (SELECT DISTINCT event_type AS endpoint FROM events), m AS (SELECT b.endpoint, max(e.event_id) AS seq FROM b LEFT JOIN events e ON contains('https://host/' || e.event_type || '/' || e.user_id, b.endpoint) AND e.user_id % 3 = 0 GROUP BY 1) SELECT endpoint, coalesce(seq, 0) AS seq FROM m""")
def body_request_match(spark, d):
    e = table(spark, d, "events")
    log = e.select(F.col("event_id").alias("seq"), F.concat(F.lit("https://host/"), "event_type", F.lit("/"), F.col("user_id").cast("string")).alias("url"), F.when(F.col("user_id") % 3 == 0, 200).otherwise(404).alias("status"))
    return requests.match_bodies(e.select(F.col("event_type").alias("endpoint")).distinct(), log)


@query("SELECT page_id, replace(replace(replace(replace(replace(url || ' %', '%', '%25'), ' ', '%20'), chr(9), '%09'), chr(13), '%0D'), chr(10), '%0A') AS encoded, replace(replace(url_encode(url || ' *~'), '%2A', '%2A'), '+', '%20') AS component FROM pages")
def percent_encode(spark, d):
    url = F.col("url")
    return table(spark, d, "pages").select("page_id", paths.percent_encode(F.concat(url, F.lit(" %"))).alias("encoded"), paths.encode_component(F.concat(url, F.lit(" *~"))).alias("component"))


_ODD_PATH = "CASE doc_id % 12 WHEN 0 THEN '' WHEN 1 THEN 'a/' || chr(9) WHEN 2 THEN 'a\\b' WHEN 3 THEN '/' || source WHEN 4 THEN 'c:' || source WHEN 5 THEN source || '/../x' WHEN 6 THEN './' || source WHEN 7 THEN source || '/x.' WHEN 8 THEN source || '/con.txt' WHEN 9 THEN source || '//x' WHEN 10 THEN source || '/COM7' ELSE source || '/' || lang END"


@query(f"""WITH p AS (SELECT doc_id, {_ODD_PATH} AS path FROM documents) SELECT doc_id, CASE doc_id % 12 WHEN 0 THEN 'path.empty' WHEN 1 THEN 'path.control' WHEN 2 THEN 'path.backslash' WHEN 3 THEN 'path.absolute' WHEN 4 THEN 'path.drive' WHEN 5 THEN 'path.parent'
WHEN 6 THEN 'path.dot-component' WHEN 7 THEN 'path.windows-fold' WHEN 8 THEN 'path.device' WHEN 9 THEN 'path.empty-component' WHEN 10 THEN 'path.device' END AS rule FROM p""")
def path_rule(spark, d):
    odd = F.expr(_ODD_PATH.replace("'a\\b'", "'a\\\\b'"))
    return table(spark, d, "documents").select("doc_id", paths.path_rule(odd).alias("rule"))


@query("""SELECT 'A11' AS id, count(*) AS total, count(*) AS passed, 0::BIGINT AS failed FROM documents WHERE doc_id % 11 <> 0 AND length(text) > 0
UNION ALL SELECT 'A16', count(*), count(*) FILTER (doc_id % 13 <> 0 AND doc_id % 11 <> 0 AND doc_id % 6 <> 0), count(*) FILTER (NOT (doc_id % 13 <> 0 AND doc_id % 11 <> 0 AND doc_id % 6 <> 0)) FROM documents WHERE doc_id % 13 <> 0 OR doc_id % 11 <> 0""")
def assertion_counts(spark, d):
    files = build(spark, d, "new")
    chunks = manifest.flatten(files).join(files.select("field", "file", "size"), ["field", "file"])
    docs = table(spark, d, "documents")
    path = F.col("doc_id").cast("string").alias("path")
    listed = docs.where("doc_id % 13 <> 0").select(path, F.md5("text").alias("md5"))
    disk = docs.where("doc_id % 11 <> 0").select(path, F.encode(F.when(F.col("doc_id") % 6 == 0, F.concat("text", F.lit("~"))).otherwise(F.col("text")), "utf-8").alias("content"))
    return assertions.summary(assertions.every(assertions.sizes_cover(chunks), assertions.inventory(listed, disk)))


@query(with_("sides") + """, p AS (SELECT rel, split_part(rel, '/', 1) AS a, split_part(rel, '/', 1) || '/' || split_part(rel, '/', 2) AS b FROM src), l AS (SELECT 'src1/en' AS x UNION ALL SELECT 'src2' UNION ALL SELECT 'src2/en')
SELECT rel, CASE WHEN a IN (SELECT x FROM l) THEN a ELSE b END AS link FROM p WHERE a IN (SELECT x FROM l) OR b IN (SELECT x FROM l)""")
def link_ancestor(spark, d):
    links = spark.createDataFrame([("src1/en",), ("src2",), ("src2/en",)], "rel string")
    return trees.link_above(side(spark, d, "src").select("rel"), links)


@query("""SELECT o_orderkey, '{"event":"plan","files":' || o_custkey || CASE WHEN o_orderkey % 2 = 0 THEN ',"status":"' || o_orderstatus || '"' ELSE '' END || '}' AS json, 'PLAN files=' || o_custkey || CASE WHEN o_orderkey % 2 = 0 THEN ' status=' || o_orderstatus ELSE '' END AS line FROM orders""")
def record_rendering(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("files"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).alias("status"))
    return rows.select("o_orderkey", records.as_json("plan", "files", "status").alias("json"), records.as_line("PLAN", "files", "status").alias("line"))


@query("""SELECT o_custkey, least(sum(greatest(cast(round(o_totalprice) AS HUGEINT) * CASE WHEN o_orderkey % 5 = 0 THEN -1 ELSE 10000000000000 END, 0)), 18446744073709551615)::DECIMAL(20, 0)::VARCHAR AS total FROM orders GROUP BY 1""")
def saturating_totals(spark, d):
    x = F.round("o_totalprice").cast("long") * F.when(F.col("o_orderkey") % 5 == 0, -1).otherwise(10**13)
    return table(spark, d, "orders").groupBy("o_custkey").agg(totals.saturating_sum(F.when(F.col("o_orderkey") % 5 == 0, -1).otherwise(x)).cast("string").alias("total"))


@query(f"""WITH s AS ({_summary_sql(_FOLDED)}), t AS ({_tree_sql(_FOLDED)}) SELECT list_position(['missing', 'extra', 'changed', 'type-conflict', 'case-mismatch', 'identical'], bucket)::BIGINT AS rank, upper(bucket) AS label, coalesce(src_rel, dst_rel) AS rel, tag FROM t WHERE bucket <> 'identical'
UNION ALL SELECT 5, 'CASE-MISMATCH', src_rel, dst_rel FROM t WHERE case_mismatch
UNION ALL SELECT 7, 'SUMMARY', NULL, 'missing=' || missing || ' extra=' || extra || ' changed=' || changed || ' type_conflict=' || type_conflict || ' case_mismatch=' || case_mismatch || ' identical=' || identical || ' total=' || total FROM s""")
def verdict_stream(spark, d):
    return reports.verdict_stream(_diff(spark, d, True))


@query("""WITH b AS (SELECT event_type AS grp, event_id AS seq, cast(round(value * 100) AS BIGINT) AS bytes FROM events),
r AS (SELECT *, coalesce(sum(bytes) OVER (PARTITION BY grp ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS prev FROM b)
SELECT grp, sum(least(bytes, greatest(100000 - prev, 0)))::BIGINT AS stored, count(*) FILTER (least(bytes, greatest(100000 - prev, 0)) < bytes) AS truncated FROM r GROUP BY 1""")
def error_body_budget(spark, d):
    b = table(spark, d, "events").select(F.col("event_type").alias("grp"), F.col("event_id").alias("seq"), F.round(F.col("value") * 100).cast("long").alias("bytes"))
    return reports.stored_bodies(b, 100_000).groupBy("grp").agg(F.sum("stored").alias("stored"), F.count_if("truncated").alias("truncated"))


@query("SELECT o_custkey AS grp, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 3")
def newest_copies(spark, d):
    c = table(spark, d, "orders").select(F.col("o_custkey").alias("grp"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("attempt"), "o_orderkey")
    return reports.newest(c, 3).select("grp", "o_orderkey")


@query(with_("chunks") + "SELECT arg_min(m, (doc_id, cpos)) AS id FROM new_chunk WHERE m NOT IN (SELECT m FROM old_chunk)")
def first_new_id(spark, d):
    return reports.first_new_id(_chunks(spark, d, "new"), _chunks(spark, d, "old"))


@query(with_("sides") + """, s AS (SELECT rel FROM dst WHERE rel NOT IN (SELECT rel FROM src)) SELECT rel, (SELECT greatest(count(*) - 5, 0) FROM s) AS more FROM s ORDER BY rel LIMIT 5""")
def uncovered_examples(spark, d):
    return reports.examples(trees.stale(side(spark, d, "dst"), side(spark, d, "src")))


@query("""WITH e AS (SELECT CASE WHEN event_id % 3 = 0 THEN 'skipped' WHEN event_id % 7 = 0 THEN 'failed' ELSE 'repaired' END AS outcome, cast(round(value) AS BIGINT) AS bytes FROM events)
SELECT count(*) FILTER (outcome = 'skipped') AS skipped, count(*) FILTER (outcome = 'repaired') AS repaired, count(*) FILTER (outcome = 'failed') AS failed, sum(CASE WHEN outcome = 'repaired' THEN greatest(bytes, 0) ELSE 0 END)::BIGINT AS bytes, count(*) AS done FROM e""")
def run_summary(spark, d):
    k = F.col("event_id")
    e = table(spark, d, "events").select(F.when(k % 3 == 0, "skipped").when(k % 7 == 0, "failed").otherwise("repaired").alias("outcome"), F.round("value").cast("long").alias("bytes"))
    return reports.run_summary(e)


@query(with_("reuse") + """, u AS (SELECT field, file, sum(CASE WHEN source <> off THEN n ELSE 0 END) AS payload FROM reuse GROUP BY ALL)
SELECT field, file, CASE WHEN payload <= 1024 THEN 'staged' ELSE 'ordered' END AS tier FROM u""")
def in_place_tiers(spark, d):
    moved = F.coalesce(F.col("source") != F.col("offset"), F.lit(False))
    p = _reuse(spark, d).groupBy("field", "file").agg(F.sum(F.when(moved, F.col("uncompressed_size")).otherwise(0)).alias("payload"))
    return reports.tiering(p, 1024).select("field", "file", "tier")
