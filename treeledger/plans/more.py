"""Registered queries of plans, scans, captures and single functions, each beside the DuckDB SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeledger.functions import cut as cut_
from treeledger.functions import paths, records, totals
from treeledger.operators import assertions, bundle, capture, documents, manifest, plan, repair, reports, scan, selection, sync, trees
from treeledger.plans.derived import bodies, odd_manifest, table, with_
from treeledger.operators.phases import Phases
from treeledger.plans.derived import manifest as build
from treeledger.plans.registry import query
from treeledger.sources import files, requests, settings


def _text(value: str | None) -> str:
    """A value as a SQL literal that both engines read alike."""
    return "NULL" if value is None else " || ".join(f"chr({ord(c)})" if c in "\\'\n\t" else f"'{c}'" for c in value) or "''"


def _cases(values: list) -> str:
    """The value for doc_id modulo their number."""
    return "CASE doc_id % " + str(len(values)) + "".join(f" WHEN {i} THEN {_text(v)}" for i, v in enumerate(values)) + " END"


def _given(spark: SparkSession, d: str, values: list) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.expr(_cases(values)).alias("x"))


# --- paths, ids and tags: fixed values of the rules that they break

_PATHS = {"a\\b": ("a/b", None), "./a/./b": ("a/b", None), "a//b": ("a/b", None), "": (None, "empty"), "a/": (None, "trailing separator"), "C:x": (None, "drive prefix"), "/a": (None, "absolute"), "a/../b": (None, "parent"), "a./b": (None, "trailing dot or space"), "ab:c": (None, "stream"), "x/COM1.txt": (None, "device name"), ".": (None, "names nothing")}


@query(f"SELECT doc_id, {_cases([c for c, _ in _PATHS.values()])} AS clean, {_cases([w for _, w in _PATHS.values()])} AS why FROM documents")
def clean_paths(spark, d):
    return _given(spark, d, list(_PATHS)).select("doc_id", paths.clean_rel(F.col("x")).alias("clean"), paths.bad_rel(F.col("x")).alias("why"))


_HEX = "0123456789abcdefABCDEF"
_IDS = {"": "chunk-id.empty", "0123456789abcdef_" + "0" * 32: None, "0123456789ABCDEF_" + "A" * 32: None, "0123456789abcdef" + "0" * 32: "chunk-id.shape", "0123456789abcdeg_" + "0" * 32: "chunk-id.shape", "a/b": "chunk-id.shape", "0123456789abcdef_" + "0" * 31: "chunk-id.shape", "0123456789abcdef_" + "0" * 32 + "\n": "chunk-id.shape"}
_TAGS = {"7.1.0": None, "7.1.0-beta": None, "1": None, "": "tag.empty", "x" * 33: "tag.too-long", "1\t2": "tag.control", "1/2": "tag.separator", "1 2": "tag.separator", "1:2": "tag.drive", "1*": "tag.windows-character", ".1": "tag.edge-dot", "1.": "tag.edge-dot", "con": "tag.device", "COM1.2": "tag.device", "COM0": None}
_FIELDS = {"game": None, "zh-cn": None, "a/b": "field.multi-component", "/abs": "path.absolute", "a\\b": "path.backslash", "..": "path.parent", "": "path.empty", "con": "path.device", "a.": "path.windows-fold"}


@query(f"SELECT doc_id, {_cases(list(_IDS.values()))} AS chunk_id, {_cases(list(_TAGS.values()))} AS tag, {_cases(list(_FIELDS.values()))} AS field FROM documents")
def id_rules(spark, d):
    given = lambda values: F.expr(_cases(list(values)))
    return table(spark, d, "documents").select("doc_id", paths.chunk_id_rule(given(_IDS)).alias("chunk_id"), paths.tag_rule(given(_TAGS)).alias("tag"), paths.field_rule(given(_FIELDS)).alias("field"))


_PAGE = """WITH p AS (SELECT page_id, CASE page_id % 8 WHEN 0 THEN url WHEN 1 THEN regexp_replace(url, '^[a-z]+://', '') WHEN 2 THEN regexp_replace(url, '^[a-z]+:/', '') WHEN 3 THEN replace(regexp_replace(url, '^[a-z]+://', ''), '/', '\\')
  WHEN 4 THEN replace(regexp_replace(url, '^[a-z]+://', ''), '/', '/./') WHEN 5 THEN regexp_replace(url, '^[a-z]+://[^/]*', 'aux.d') WHEN 6 THEN regexp_replace(url, '^[a-z]+://[^/]*', '..') ELSE regexp_replace(url, '^[a-z]+://', '') || ' ' END AS x FROM pages),
q AS (SELECT *, replace(x, '\\', '/') AS y FROM p), c AS (SELECT *, string_split(y, '/') AS parts FROM q),
w AS (SELECT *, CASE WHEN y = '' THEN 'empty' WHEN y LIKE '%/' THEN 'trailing separator' WHEN regexp_matches(y, '^[A-Za-z]:') THEN 'drive prefix' WHEN y LIKE '/%' THEN 'absolute' WHEN list_contains(parts, '..') THEN 'parent'
  WHEN len(list_filter(parts, lambda p: p <> '.' AND regexp_matches(p, '[. ]$'))) > 0 THEN 'trailing dot or space' WHEN y LIKE '%:%' THEN 'stream' WHEN len(list_filter(parts, lambda p: upper(rtrim(split_part(p, '.', 1))) IN ('CON', 'PRN', 'AUX', 'NUL', 'CONIN$', 'CONOUT$')
  OR regexp_matches(rtrim(split_part(p, '.', 1)), '^(?i)(COM|LPT)[1-9]$'))) > 0 THEN 'device name' WHEN len(list_filter(parts, lambda p: p NOT IN ('', '.'))) = 0 THEN 'names nothing' END AS why FROM c)
"""


@query(_PAGE + "SELECT page_id, CASE WHEN why IS NULL THEN array_to_string(list_filter(parts, lambda p: p NOT IN ('', '.')), '/') END AS clean, why FROM w")
def page_paths(spark, d):
    """Addresses of pages as relative paths, cut and bent in eight ways."""
    k, url = F.col("page_id") % 8, F.col("url")
    cut = F.regexp_replace(url, "^[a-z]+://", "")
    forms = [url, cut, F.regexp_replace(url, "^[a-z]+:/", ""), F.replace(cut, F.lit("/"), F.lit("\\")), F.replace(cut, F.lit("/"), F.lit("/./")), F.regexp_replace(url, "^[a-z]+://[^/]*", "aux.d"), F.regexp_replace(url, "^[a-z]+://[^/]*", ".."), F.concat(cut, F.lit(" "))]
    x = F.element_at(F.array(*forms), (k + 1).cast("int"))
    return table(spark, d, "pages").select("page_id", paths.clean_rel(x).alias("clean"), paths.bad_rel(x).alias("why"))


@query(r"""WITH i AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN '' WHEN doc_id % 11 = 0 THEN substr(md5(text), 1, 16) || md5(text) WHEN doc_id % 7 = 0 THEN substr(md5(text), 1, 15) || 'g_' || md5(text) WHEN doc_id % 5 = 0 THEN substr(md5(text), 1, 16) || '_' || substr(md5(text), 2)
  WHEN doc_id % 3 = 0 THEN upper(substr(md5(text), 1, 16) || '_' || md5(text)) ELSE substr(md5(text), 1, 16) || '_' || md5(text) END AS x FROM documents), t AS (SELECT doc_id, substr(text, 1 + (doc_id % 40)::INT, (doc_id % 20)::INT) AS g FROM documents)
SELECT doc_id, CASE WHEN x = '' THEN 'chunk-id.empty' WHEN NOT regexp_full_match(x, '[0-9A-Fa-f]{16}_[0-9A-Fa-f]{32}') THEN 'chunk-id.shape' END AS chunk_id,
CASE WHEN g = '' THEN 'path.empty' WHEN regexp_matches(g, '[\x00-\x1f\x7f\x{80}-\x{9f}]') THEN 'path.control' WHEN contains(g, '\') THEN 'path.backslash' WHEN g LIKE '/%' THEN 'path.absolute' WHEN contains(g, ':') THEN 'path.drive' WHEN list_contains(string_split(g, '/'), '..') THEN 'path.parent'
  WHEN list_contains(string_split(g, '/'), '.') THEN 'path.dot-component' WHEN len(list_filter(string_split(g, '/'), lambda p: regexp_matches(p, '[. ]$'))) > 0 THEN 'path.windows-fold'
  WHEN len(list_filter(string_split(g, '/'), lambda p: upper(split_part(p, '.', 1)) IN ('CON', 'PRN', 'AUX', 'NUL', 'CONIN$', 'CONOUT$') OR regexp_matches(split_part(p, '.', 1), '^(?i)(COM|LPT)[1-9]$'))) > 0 THEN 'path.device'
  WHEN list_contains(string_split(g, '/'), '') THEN 'path.empty-component' WHEN contains(g, '/') THEN 'field.multi-component' END AS field FROM i JOIN t USING (doc_id)""")
def damaged_ids(spark, d):
    """Chunk ids made of digests, some of them damaged, and pieces of texts as names of fields."""
    n, m = F.col("doc_id"), F.md5("text")
    head = F.substring(m, 1, 16)
    good = F.concat(head, F.lit("_"), m)
    x = F.when(n % 13 == 0, "").when(n % 11 == 0, F.concat(head, m)).when(n % 7 == 0, F.concat(F.substring(m, 1, 15), F.lit("g_"), m)).when(n % 5 == 0, F.concat(head, F.lit("_"), F.substring(m, 2, 31))).when(n % 3 == 0, F.upper(good)).otherwise(good)
    piece = F.substring("text", (1 + n % 40).cast("int"), (n % 20).cast("int"))
    return table(spark, d, "documents").select("doc_id", paths.chunk_id_rule(x).alias("chunk_id"), paths.field_rule(piece).alias("field"))


@query(r"""WITH s AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN ['CON', 'nul', 'com1', 'lpt9', 'prn', 'Aux'][(doc_id // 3 % 6)::INT + 1] || CASE WHEN doc_id % 2 = 0 THEN '.' ELSE '-' END || lang WHEN 1 THEN replace(substr(text, 1, 30), ' ', '%') ELSE source || '/%' || lang || '/con' END AS x FROM documents)
SELECT doc_id, array_to_string([CASE WHEN regexp_matches(split_part(p, '.', 1), '^(?i)(CON|PRN|AUX|NUL|CONIN\$|CONOUT\$|(COM|LPT)[1-9])$') THEN '%' || p ELSE replace(p, '%', '%%') END FOR p IN string_split(x, '/')], '/') AS escaped, x AS back FROM s""")
def escaped_names(spark, d):
    """Names of devices and pieces of texts, spelled so that no device opens, and spelled back."""
    n = F.col("doc_id")
    device = F.element_at(F.array(*map(F.lit, ["CON", "nul", "com1", "lpt9", "prn", "Aux"])), (F.floor(n / 3) % 6 + 1).cast("int"))
    x = F.when(n % 3 == 0, F.concat(device, F.when(n % 2 == 0, ".").otherwise("-"), "lang")).when(n % 3 == 1, F.replace(F.substring("text", 1, 30), F.lit(" "), F.lit("%"))).otherwise(F.concat("source", F.lit("/%"), "lang", F.lit("/con")))
    out = table(spark, d, "documents").select("doc_id", paths.escape_devices(x).alias("escaped"))
    return out.select("doc_id", "escaped", paths.unescape_devices(F.col("escaped")).alias("back"))


_SPELLED = {"a/con.txt": "a/%con.txt", "%con": "%%con", "plain": "plain", "COM1/x": "%COM1/x", "%plain": "%%plain", "%%nul.z": "%%%%nul.z", "con .txt": "con .txt", "a%b/NUL": "a%%b/%NUL"}


@query(f"SELECT doc_id, {_cases(list(_SPELLED.values()))} AS escaped, {_cases(list(_SPELLED))} AS back FROM documents")
def device_spellings(spark, d):
    out = _given(spark, d, list(_SPELLED)).select("doc_id", paths.escape_devices(F.col("x")).alias("escaped"))
    return out.select("doc_id", "escaped", paths.unescape_devices(F.col("escaped")).alias("back"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL WHEN (doc_id % 9)::INT - (doc_id % 4)::INT >= 0 THEN (doc_id % 9) - (doc_id % 4) END AS stale,
CASE WHEN doc_id % 5 <> 0 THEN lower(substr(md5(text), 1, 16)) END AS prefix, CASE WHEN doc_id % 5 <> 0 THEN md5(text) END AS checksum, CASE WHEN doc_id % 7 <> 0 THEN upper(md5(text)) END AS digest, replace(lower(lang || '_' || source), '_', '-') AS audio FROM documents""")
def version_and_id_facts(spark, d):
    n, sum_ = F.col("doc_id"), F.md5("text")
    branch = F.when(n % 3 == 0, "x.1").otherwise(F.concat((n % 9).cast("string"), F.lit(".2")))
    id_ = F.when(n % 5 == 0, sum_).otherwise(F.concat(F.upper(F.substring(sum_, 1, 16)), F.lit("_"), sum_))
    split = paths.split_manifest_id(id_)
    digest = paths.hex_digest(F.when(n % 7 == 0, "not hex").otherwise(sum_))
    return table(spark, d, "documents").select("doc_id", paths.staleness(branch, (n % 4).cast("string")).alias("stale"), split["prefix"].alias("prefix"), split["checksum"].alias("checksum"), F.hex(digest).alias("digest"), paths.audio_token(F.concat(F.lit(" "), "lang", F.lit("_"), "source")).alias("audio"))


@query("""SELECT doc_id, substr(text, 1, list_max(list_filter(range(0, 101), lambda k: octet_length(encode(substr(text, 1, k::INT))) <= 100))::INT) AS capped, octet_length(encode(text)) > 2000 AS gzipped, text = text AS back,
'https://h/x/' || doc_id AS address FROM documents""")
def text_facts(spark, d):
    odd = F.concat("text", F.lit(" %20\t\n"))
    address = paths.join_address(F.when(F.col("doc_id") % 2 == 0, "https://h/x/").otherwise("https://h/x"), F.col("doc_id").cast("string"))
    return table(spark, d, "documents").select("doc_id", totals.capped(F.col("text"), 100).alias("capped"), totals.gzipped(F.octet_length("text"), 2000).alias("gzipped"), (paths.percent_decode(paths.percent_encode(odd)) == odd).alias("back"), address.alias("address"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey % 50 AS a, l_partkey % 50 + l_suppkey % 20 - 3 AS b, l_suppkey % 60 AS c, l_suppkey % 60 + l_partkey % 10 AS e FROM lineitem)
SELECT l_orderkey, l_linenumber, a < e AND c < b AS overlaps, a <= c AND e <= b AS holds, CASE WHEN c > b THEN c - b END AS gap, b < a AS inverted, b <= a AS empty FROM r""")
def range_facts(spark, d):
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    r = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (p % 50).alias("a"), (p % 50 + s % 20 - 3).alias("b"), (s % 60).alias("c"), (s % 60 + p % 10).alias("e"))
    a, b, c, e = map(F.col, "abce")
    return r.select("l_orderkey", "l_linenumber", totals.overlaps(a, b, c, e).alias("overlaps"), totals.contains(a, b, c, e).alias("holds"), totals.gap_between(b, c).alias("gap"), totals.is_inverted(a, b).alias("inverted"), totals.is_empty(a, b).alias("empty"))


@query("""SELECT event_id, event_id % 5 = 1 AND event_id % 3 <> 0 AS mismatch, CASE WHEN event_id % 4 = 1 THEN 'download mode' WHEN event_id % 5 = 1 THEN 'compression' WHEN event_id % 6 = 1 THEN 'encryption' END AS refusal,
CASE WHEN event_id % 3 = 0 THEN 'in_place' WHEN event_id % 4 = 0 OR event_id % 5 = 0 THEN 'temp' ELSE 'in_place' END AS mode, event_id % 2 = 0 AND event_id % 7 <> 0 AND 3000000000 - (event_id % 4) * 1000000000 > 2000000000 AS reusable,
(event_id % 600) IN (408, 429) OR (event_id % 600) BETWEEN 500 AND 599 AS again, event_id % 2 = 0 AS inside,
CASE WHEN event_id % 3 = 0 THEN 'compressed_md5 differs' ELSE '' END || CASE WHEN event_id % 5 = 0 THEN CASE WHEN event_id % 3 = 0 THEN '|' ELSE '' END || 'partial' ELSE '' END AS problems FROM events""")
def gates(spark, d):
    n = F.col("event_id")
    when = lambda k, r=0: n % k == r
    yes = F.lit(True)
    blob = F.struct(F.struct(yes.alias("compressed_size"), (~when(3)).alias("compressed_md5"), yes.alias("uncompressed_size"), yes.alias("uncompressed_md5")).alias("verified"), F.lit(None).cast("string").alias("error"), when(5).alias("partial"))
    mtime = F.when(~when(7), (n % 4) * 1_000_000_000)
    return table(spark, d, "events").select(
        "event_id", reports.declared_mismatch(F.when(~when(3), F.when(when(5, 1), "x").otherwise("y")), F.lit("y")).alias("mismatch"),
        reports.container_refusal(F.when(when(4, 1), "file").otherwise("CHUNK"), F.when(when(5, 1), 2).otherwise(1), F.when(when(6, 1), 1).otherwise(0)).alias("refusal"),
        reports.write_mode(F.when(when(4), "temp").otherwise("in_place"), ~when(3), ~when(5)).alias("mode"), reports.verdict_reusable(F.lit(1), F.lit(1), F.lit(2), F.when(when(2), 2).otherwise(3), mtime, mtime, F.lit(3_000_000_000)).alias("reusable"),
        requests.retryable(n % 600).alias("again"), paths.within(F.when(when(2), "a/b").otherwise("ab"), F.lit("a")).alias("inside"), F.array_join(reports.blob_problems(blob), "|").alias("problems"),
    )


@query("""SELECT c_custkey, 'https://l.host/api/getGames?launcher_id=' || c_nationkey || '&language=' || replace(url_encode(c_mktsegment || ' x'), '+', '%20') || '&game_ids[]=' || c_custkey || '&channel=1&sub_channel=0' AS service,
'https://s.host/getBuild?branch=main&package_id=' || c_custkey || '&password=p%26q' || CASE WHEN c_custkey % 2 = 0 THEN '&tag=7.1.0' ELSE '' END AS build FROM customer""")
def service_addresses(spark, d):
    key = F.col("c_custkey").cast("string")
    service = requests.service_url(F.lit("https://l.host/api/"), F.lit("getGames"), F.col("c_nationkey").cast("string"), F.concat("c_mktsegment", F.lit(" x")), key, F.lit("1"), F.lit("0"))
    url = requests.build_url(F.lit("https://s.host"), F.lit("main"), key, F.lit("p&q"), F.when(F.col("c_custkey") % 2 == 0, "7.1.0"))
    return table(spark, d, "customer").select("c_custkey", service.alias("service"), url.alias("build"))


# --- what sources give, over rows of the tables


@query("""WITH f AS (SELECT doc_id, ['game', 'en-us', 'zh-cn', 'ja-jp', 'extra-pack', 'en-usx'][(doc_id % 6)::INT + 1] AS field, CASE WHEN doc_id % 4 = 0 THEN 'beta' WHEN doc_id % 4 = 1 THEN 'main' END AS category FROM documents)
SELECT doc_id, field, category FROM f WHERE field NOT IN ('beta', 'ja-jp') AND coalesce(category, '') NOT IN ('beta', 'ja-jp') AND NOT (octet_length(encode(field)) IN (5, 10) AND contains(field, '-')) UNION ALL SELECT doc_id, field, category FROM f WHERE field IN ('en-us', 'en-usx')""")
def manifest_selection(spark, d):
    n = F.col("doc_id")
    field = F.element_at(F.array(*map(F.lit, ["game", "en-us", "zh-cn", "ja-jp", "extra-pack", "en-usx"])), (n % 6 + 1).cast("int"))
    rows = table(spark, d, "documents").select("doc_id", field.alias("field"), F.when(n % 4 == 0, "beta").when(n % 4 == 1, "main").alias("category"))
    return manifest.select_manifests(rows, ["beta", "ja-jp"], ["en-us", "en-usx"])


@query("""WITH f AS (SELECT source || '/' || lang || '/' || doc_id || '.bin' AS path, encode(text) AS b FROM documents) SELECT path, octet_length(b) AS bytes, md5(b) AS md5, sha256(b) AS sha256, 'identity' AS encoding FROM f""")
def checksum_inventory(spark, d):
    rel = F.concat(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")), F.lit(".bin"))
    return files.inventory(table(spark, d, "documents").select(rel.alias("rel"), F.encode("text", "utf-8").alias("content")))


@query("""SELECT count(*) FILTER (doc_id % 5 > 0) AS files, count(*) FILTER (doc_id % 5 = 0) AS dirs, (count(*) + count(*) FILTER (doc_id % 3 = 0))::BIGINT AS hashes FROM documents""")
def older_record_counts(spark, d):
    n = F.col("doc_id")
    hashes = F.when(n % 3 == 0, F.create_map(F.lit("md5"), F.md5("text"), F.lit("sha256"), F.sha2("text", 256))).otherwise(F.create_map(F.lit("md5"), F.md5("text")))
    rows = table(spark, d, "documents").select("doc_id", F.when(n % 5 == 0, "dir").otherwise("file").alias("kind"), hashes.alias("hashes"))
    return settings.import_counts(settings.import_cache(rows))


def _list_lines(spark: SparkSession, d: str, number: Column) -> DataFrame:
    """Lines of a list: objects that name a path, other text, other objects, blank lines."""
    n, k = number.cast("string"), F.col("doc_id") % 4
    line = F.when(k == 0, F.concat(F.lit('{"remoteName": "a/'), n, F.lit('"}'))).when(k == 1, F.concat(F.lit("not json "), n)).when(k == 2, F.concat(F.lit('{"other": '), n, F.lit("}"))).otherwise(" ")
    return table(spark, d, "documents").select(F.col("doc_id").alias("line_no"), line.alias("line"))


@query("""SELECT doc_id AS line_no, CASE WHEN doc_id % 4 = 1 THEN 'not json ' || doc_id ELSE '{"other": ' || doc_id || '}' END AS line FROM documents WHERE doc_id % 4 IN (1, 2)""")
def unusable_list_lines(spark, d):
    return settings.bad_lines(_list_lines(spark, d, F.col("doc_id")))


@query("SELECT DISTINCT 'a/' || (doc_id // 8) AS rel FROM documents WHERE doc_id % 4 = 0")
def kept_list_paths(spark, d):
    return settings.path_list(_list_lines(spark, d, F.floor(F.col("doc_id") / 8)))


# --- scans of an install against a plan


def _planned(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of the new build with their sources in the old one, by path."""
    reuse = manifest.chunk_reuse(manifest.flatten(build(spark, d, "new")), manifest.flatten(build(spark, d, "old")))
    return reuse.select(F.col("file").alias("rel"), F.col("cpos").cast("long").alias("cpos"), "id", "uncompressed_md5", "offset", "compressed_size", "uncompressed_size", "source")


def _disk(spark: SparkSession, d: str) -> DataFrame:
    """What is installed: the old build, some files with another first letter."""
    spoilt = F.concat(F.lit("~"), F.substring("body", F.lit(2), F.length("body")))
    return bodies(spark, d, "old").where(F.length("body") > 0).select(F.col("file").alias("rel"), F.when(F.col("doc_id") % 6 == 0, spoilt).otherwise(F.col("body")).alias("content"))


def _scanned(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The planned chunks as a table, as more than the scan reads them, and the verdicts of the scan."""
    chunks = cut_.written(_planned(spark, d))
    return chunks, scan.deep_scan(chunks, _disk(spark, d))


_SCAN = with_("reuse") + """, disk AS (SELECT file, CASE WHEN doc_id % 6 = 0 THEN '~' || substr(body, 2) ELSE body END AS c FROM old_body WHERE length(body) > 0),
v AS (SELECT r.file AS rel, r.cpos, r.off, r.n, r.source, coalesce(off + n <= length(c) AND md5(substr(c, off + 1, n)) = m, false) AS dest_ok, coalesce(source + n <= length(c) AND md5(substr(c, (source + 1)::INT, n)) = m, false) AS source_ok,
length(r.file) % 3 AS mode FROM reuse r LEFT JOIN disk USING (file))
"""


@query(_SCAN + "SELECT rel, cpos, dest_ok, source_ok FROM v")
def deep_scan(spark, d):
    return scan.deep_scan(_planned(spark, d), _disk(spark, d))


@query(_SCAN + "SELECT rel, count(*) AS chunks, count(*) FILTER (NOT dest_ok) AS damaged, count(*) FILTER (source_ok) AS sources FROM v GROUP BY 1")
def deep_scan_damage(spark, d):
    return scan.damage(deep_scan(spark, d))


@query(_SCAN + """, f AS (SELECT *, NOT dest_ok AND source_ok AND source >= off AS up, NOT dest_ok AND source_ok AND source <= off AS down FROM v WHERE rel NOT LIKE '%7'),
g AS (SELECT rel, any_value(mode) AS mode, sum(n) AS all_, sum(CASE WHEN NOT source_ok THEN n ELSE 0 END) AS temp, count(*) FILTER (up) AS nu, count(*) FILTER (down) AS nd, sum(CASE WHEN NOT dest_ok AND NOT coalesce(up, false) THEN n ELSE 0 END) AS u,
sum(CASE WHEN NOT dest_ok AND NOT coalesce(down, false) THEN n ELSE 0 END) AS w FROM f GROUP BY 1)
SELECT rel, (CASE WHEN mode = 0 THEN all_ WHEN mode = 1 THEN temp WHEN nd > nu THEN w ELSE u END)::BIGINT AS est_download FROM g UNION ALL SELECT rel, sum(n)::BIGINT FROM v WHERE rel LIKE '%7' GROUP BY 1""")
def deep_scan_estimate(spark, d):
    chunks, verdicts = _scanned(spark, d)
    # of some files the scan brought nothing
    verdicts = verdicts.where("rel not like '%7'")
    mode = F.when(F.length("rel") % 3 == 0, "discard").when(F.length("rel") % 3 == 1, "temp").otherwise("in_place")
    return scan.download_after_scan(chunks, verdicts, chunks.select("rel").distinct().withColumn("mode", mode))


@query(_SCAN + "SELECT (SELECT count(*) FROM v) AS same, 0::BIGINT AS other")
def scan_of_this_plan(spark, d):
    chunks, verdicts = _scanned(spark, d)
    verdicts = cut_.written(verdicts)  # each count reads them, and the plan's number
    here, changed = cut_.written(scan.fingerprint(chunks)), scan.fingerprint(chunks.withColumn("compressed_size", F.col("compressed_size") + 1))
    count = lambda scanned, name: scan.same_plan(verdicts, scanned, here).agg(F.count("*").alias(name))
    return count(here, "same").crossJoin(count(changed, "other"))  # one row each


@query(with_("files") + """, disk AS (SELECT file, doc_id, CASE WHEN doc_id % 6 = 0 THEN '~' || substr(body, 2) ELSE body END AS c FROM old_body)
SELECT w.file AS rel, CASE WHEN c IS NULL THEN 'missing' WHEN octet_length(encode(c)) <> octet_length(encode(b.body)) THEN 'size' WHEN md5(c) <> w.md5 THEN 'md5' ELSE 'ok' END AS verdict FROM new_file w JOIN new_body b USING (file) LEFT JOIN disk USING (file)""")
def integrity(spark, d):
    expected = bodies(spark, d, "new").where(F.length("body") > 0).select(F.col("file").alias("rel"), F.octet_length("body").alias("size"), F.upper(F.md5("body")).alias("md5"))
    return repair.integrity(expected, _disk(spark, d).select("rel", F.encode("content", "utf-8").alias("content")))


@query(with_("reuse", "files") + """, disk AS (SELECT file, CASE WHEN doc_id % 6 = 0 THEN '~' || substr(body, 2) ELSE body END AS c FROM old_body WHERE length(body) > 0),
p AS (SELECT file, encode(c) AS c, i * 700 AS at, octet_length(encode(c)) AS n FROM (SELECT *, unnest(range((octet_length(encode(c)) + 699) // 700)) AS i FROM disk))
SELECT w.file AS rel, count(*) AS chunks, count(*) FILTER (coalesce(off + r.n <= octet_length(encode(c)) AND md5(substr(hex(encode(c)), 2 * off + 1, 2 * r.n)) = md5(substr(hex(encode(b.body)), 2 * off + 1, 2 * r.n)), false)) AS intact,
CASE WHEN any_value(c) IS NULL THEN 'missing' WHEN octet_length(encode(any_value(c))) <> octet_length(encode(any_value(b.body))) THEN 'size' WHEN md5(any_value(c)) <> any_value(w.md5) THEN 'md5' ELSE 'ok' END AS verdict
FROM new_file w JOIN new_body b USING (field, file) JOIN (SELECT field, file, i * 256 AS off, least(256, octet_length(encode(body)) - i * 256) AS n FROM (SELECT *, unnest(range((octet_length(encode(body)) + 255) // 256)) AS i FROM new_body)) r USING (field, file)
LEFT JOIN disk ON disk.file = w.file GROUP BY 1""")
def scan_in_pieces(spark, d):
    """Ranges and whole files judged in one read of files that are stored in pieces of 700 bytes."""
    hexed = F.hex(F.encode("body", "utf-8"))
    new = bodies(spark, d, "new").where(F.length("body") > 0).select(F.col("file").alias("rel"), "body", hexed.alias("h"), F.octet_length("body").alias("size"))
    part = lambda h, n, i: F.unhex(F.substring(h, 2 * n * i + 1, F.lit(2 * n)))
    cut = lambda size, n: F.sequence(F.lit(0), F.ceil(size / n).cast("int") - 1)
    chunks = new.select("rel", "h", F.explode(cut(F.col("size"), 256)).alias("i")).select("rel", F.col("i").cast("long").alias("cpos"), part(F.col("h"), 256, F.col("i")).alias("c"), (F.col("i") * 256).alias("offset"))
    chunks = chunks.select("rel", "cpos", "offset", F.octet_length("c").cast("long").alias("uncompressed_size"), F.md5("c").alias("uncompressed_md5"), F.lit(None).cast("long").alias("source"))
    disk = _disk(spark, d).select("rel", F.hex(F.encode("content", "utf-8")).alias("h"))
    pieces = disk.select("rel", "h", F.explode(cut(F.length("h") / 2, 700)).alias("i")).select("rel", (F.col("i") * 700).alias("offset"), part(F.col("h"), 700, F.col("i")).alias("content"))
    seen = cut_.written(scan.scan_pieces(chunks, pieces, whole=True))
    counted = seen.groupBy("rel").agg(F.count("*").alias("chunks"), F.count_if("dest_ok").alias("intact"))
    return counted.join(scan.integrity_of(seen, new.select("rel", "size", F.md5("body").alias("md5"))), "rel")


# --- repair and purge plans

_REPAIR = with_("odd") + """, p AS (SELECT *, replace(file, chr(92), '/') AS rel, row_number() OVER (PARTITION BY lower(replace(file, chr(92), '/')) ORDER BY doc_id) AS nth FROM odd_file WHERE NOT is_folder AND file <> ''),
q AS (SELECT rel, size, CASE WHEN bare THEN 0 WHEN b = 0 THEN 1 ELSE 2 END AS chunks, CASE WHEN bare THEN size = 0 WHEN b = 0 THEN a = size ELSE gap = 0 AND a + b = size END AS tiled, CASE WHEN bare THEN 0 ELSE a + b END AS cost, doc_id
FROM p WHERE nth = 1 AND lower(rel) <> 'plain/4' AND NOT rel LIKE '%77' AND (rel LIKE 'plain/%' OR rel LIKE 'odd/%' OR rel LIKE 'twice/%'))
"""


def _repair(spark: SparkSession, d: str) -> DataFrame:
    return plan.repair_plan(odd_manifest(spark, d), blocked=["Plain/4"], include=["PLAIN/*", "odd\\*", "twice/*"], exclude=["*77"])


@query(_REPAIR + "SELECT rel, size, chunks, tiled FROM q")
def repair_plan(spark, d):
    return _repair(spark, d).select("rel", "size", F.size("chunks").alias("chunks"), "tiled")


def _document(spark: SparkSession, d: str) -> DataFrame:
    wanted = _repair(spark, d)
    n = F.regexp_extract("rel", "([0-9]+)$", 1).cast("long")
    known = wanted.where(n % 3 != 0).select("rel", (n % 50).alias("est_download"))
    on_disk = wanted.where(n % 2 == 0).select("rel", F.lit(120).cast("long").alias("length"), (n % 4 == 0).alias("is_regular"))
    gone = table(spark, d, "documents").where("doc_id % 9 = 4").select(F.concat(F.lit("old/"), F.col("doc_id").cast("string")).alias("rel"), F.col("n_chars").cast("long").alias("bytes"))
    return plan.repair_document(wanted, known, plan.disk_figures(wanted, on_disk, "in_place"), repair.purge(gone, wanted.select("rel"), []))


_DOCUMENT = _REPAIR + """, r AS (SELECT 'repair' AS kind, rel, size, chunks::BIGINT AS chunks_total, (CASE WHEN k % 3 <> 0 THEN k % 50 ELSE cost END)::BIGINT AS est_download_bytes, CASE WHEN k % 2 = 0 AND k % 4 <> 0 THEN 'temp' ELSE 'in_place' END AS mode,
(CASE WHEN k % 2 = 0 AND k % 4 <> 0 THEN size WHEN k % 2 = 0 THEN greatest(size - 120, 0) ELSE size END)::BIGINT AS extra_bytes FROM (SELECT *, regexp_extract(rel, '([0-9]+)$', 1)::BIGINT AS k FROM q)
UNION ALL SELECT 'purge', 'old/' || doc_id, n_chars, NULL, NULL, NULL, NULL FROM documents WHERE doc_id % 9 = 4)
"""


@query(_DOCUMENT + "SELECT * FROM r")
def repair_document(spark, d):
    return _document(spark, d)


@query(_DOCUMENT + """SELECT count(*) FILTER (kind = 'repair') AS files, (sum(est_download_bytes) FILTER (kind = 'repair'))::BIGINT AS est_download, (sum(size) FILTER (kind = 'repair'))::BIGINT AS est_write, (4 * max(extra_bytes))::BIGINT AS est_extra,
count(*) FILTER (kind = 'purge') AS purge_files, coalesce(sum(size) FILTER (kind = 'purge'), 0)::BIGINT AS purge_bytes FROM r""")
def plan_line(spark, d):
    return plan.document_totals(_document(spark, d), jobs=4)


@query("""WITH t AS (SELECT source || '/' || lang || '/' || doc_id AS rel, n_chars AS bytes, doc_id FROM documents), v AS (SELECT *, CASE WHEN NOT (rel LIKE 'src1%' OR rel LIKE 'src2%') THEN 'out-of-scope' WHEN doc_id % 4 <> 0 THEN 'expected' ELSE 'purge' END AS verdict FROM t WHERE doc_id % 15 <> 0)
SELECT count(*) FILTER (verdict = 'purge') AS files, coalesce(sum(bytes) FILTER (verdict = 'purge'), 0)::BIGINT AS bytes, count(*) FILTER (verdict = 'out-of-scope') AS hidden, (SELECT count(*) FROM t WHERE doc_id % 15 = 0) AS errors FROM v""")
def purge_plan_totals(spark, d):
    rel = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("rel")
    docs = table(spark, d, "documents")
    disk = docs.select(rel, F.when(F.col("doc_id") % 15 != 0, F.col("n_chars")).cast("long").alias("bytes"))
    return plan.purge_plan(disk, docs.where("doc_id % 4 <> 0").select(rel), [], include=["src1*", "SRC2*"])[2]


@query(with_("odd") + """, x AS (SELECT doc_id, 'manifest t/game entry ' || doc_id || ' file' AS source, file AS value, CASE WHEN file = '' THEN 'path.empty' WHEN contains(file, chr(92)) THEN 'path.backslash' END AS rule FROM odd_file
UNION ALL SELECT doc_id, 'manifest t/game entry ' || doc_id || ' chunk ' || cpos || ' id', id, 'chunk-id.shape' FROM odd_chunk) SELECT source, value, rule FROM x WHERE rule IS NOT NULL""")
def entry_problems(spark, d):
    return plan.entry_problems(odd_manifest(spark, d), "t/game").select("source", "value", "rule")


@query(with_("odd") + """, x AS (SELECT doc_id, -1 AS c, file AS value, CASE WHEN file = '' THEN 'path.empty' WHEN contains(file, chr(92)) THEN 'path.backslash' END AS rule FROM odd_file), y AS (SELECT value, rule, min(doc_id) AS pos FROM x WHERE rule IS NOT NULL GROUP BY ALL)
SELECT value, rule, pos, (SELECT greatest(count(*) - 7, 0) FROM y) AS omitted FROM y ORDER BY pos LIMIT 7""")
def first_rejections(spark, d):
    found = plan.entry_problems(odd_manifest(spark, d), "t/game").where("rule like 'path%'").select(F.lit("paths").alias("source"), "value", "rule", F.col("pos.pos").alias("pos"))
    return assertions.first_rejections(found, 7).select("value", "rule", "pos", "omitted")


# --- captures


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    old, new = build(spark, d, "old"), build(spark, d, "new")
    return old, new, manifest.flatten(old), manifest.flatten(new)


_ADMITTED = with_("reuse", "diff") + ", adm AS (SELECT field, file FROM docs WHERE doc_id % 5 = 0), oc AS (SELECT * FROM old_chunk JOIN adm USING (field, file)), nc AS (SELECT * FROM reuse JOIN adm USING (field, file))\n"


def _admitted(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("doc_id % 5 = 0")
    return docs.select(F.col("lang").alias("field"), F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("file"), F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("capture_id"))


@query(_ADMITTED + ", w AS (SELECT m, max(n) AS n FROM (SELECT m, n FROM oc UNION ALL SELECT m, n FROM nc) GROUP BY m) SELECT sum(n)::BIGINT::VARCHAR AS projected FROM w")
def chunk_plan_projected(spark, d):
    _, _, old, new = _sides(spark, d)
    return plan.chunk_plan(_admitted(spark, d), old, new, ceiling=10**12)[2]


@query(_ADMITTED + "SELECT 'materialize_old' AS role, count(DISTINCT file || ':' || m) AS chunks FROM oc UNION ALL SELECT 'materialize_new', count(DISTINCT file || ':' || m) FROM nc UNION ALL SELECT CASE WHEN source IS NULL THEN 'patch_fetch' ELSE 'reuse' END, count(DISTINCT file || ':' || m) FROM nc GROUP BY source IS NULL")
def chunk_plan_roles(spark, d):
    _, _, old, new = _sides(spark, d)
    return plan.chunk_plan(_admitted(spark, d), old, new)[0].groupBy("role").agg(F.count("*").alias("chunks"))


@query(_ADMITTED + "SELECT field, file, 'c' || split_part(file, '/', 3) AS capture_id, o.size AS old_size, w.size AS new_size FROM adm LEFT JOIN old_file o USING (field, file) LEFT JOIN new_file w USING (field, file)")
def captured_sides(spark, d):
    old, new, _, _ = _sides(spark, d)
    return plan.sides_of(_admitted(spark, d), old, new).select("field", "file", "capture_id", F.col("old.size").alias("old_size"), F.col("new.size").alias("new_size"))


@query("WITH m AS (SELECT lang AS field, tag, min(doc_id) AS id FROM documents, (SELECT unnest(['old', 'new']) AS tag) GROUP BY ALL), f AS (SELECT DISTINCT lang AS field FROM documents) SELECT f.field, t.tag, m.id FROM f CROSS JOIN (SELECT unnest(['old', 'new']) AS tag) t LEFT JOIN m ON m.field = f.field AND m.tag = t.tag AND NOT (m.tag = 'old' AND m.field = 'fr')")
def manifest_wants(spark, d):
    docs = table(spark, d, "documents").select(F.col("lang").alias("field"), "doc_id")
    held = docs.groupBy("field").agg(F.min("doc_id").alias("id")).select("field", F.explode(F.array(F.lit("old"), F.lit("new"))).alias("tag"), "id").where("not (tag = 'old' and field = 'fr')")
    return plan.manifest_wants(docs, ["old", "new"], held)


@query(_ADMITTED + "SELECT 'c' || split_part(file, '/', 3) AS capture_id, file AS path, off AS \"offset\", m AS chunk_id FROM nc WHERE source IS NULL")
def index_references(spark, d):
    _, _, old, new = _sides(spark, d)
    rows = manifest.chunk_reuse(new, old).join(_admitted(spark, d), ["field", "file"])
    ref = F.struct(F.lit("new").alias("tag"), "capture_id", F.col("file").alias("path"), F.when(F.col("source").isNull(), "patch_fetch").otherwise("reuse").alias("role"), "offset")
    index = rows.groupBy(F.col("id").alias("chunk_id")).agg(F.collect_list(ref).alias("referenced_by"))
    return bundle.references(index, "new", "patch_fetch")


@query(with_("reuse") + """, p AS (SELECT DISTINCT m AS id, off FROM reuse WHERE cpos % 4 <> 3), x AS (SELECT DISTINCT m AS id, off FROM reuse WHERE cpos % 5 <> 2)
SELECT coalesce(p.id, x.id) AS id, coalesce(p.off, x.off) AS "offset", CASE WHEN p.id IS NULL THEN 'not planned' ELSE 'not indexed' END AS why FROM p FULL JOIN x ON p.id = x.id AND p.off = x.off WHERE p.id IS NULL OR x.id IS NULL""")
def index_check(spark, d):
    chunks = manifest.flatten(build(spark, d, "new"))
    return reports.index_mismatches(chunks.where("cpos % 4 <> 3"), chunks.where("cpos % 5 <> 2"))


@query(with_("reuse") + """, disk AS (SELECT field, file, CASE WHEN doc_id % 6 = 0 THEN '~' || substr(body, 2) ELSE body END AS c FROM old_body WHERE length(body) > 0),
x AS (SELECT r.field, r.file, r.cpos, r.m AS id, r.n AS compressed_size, r.source, CASE WHEN c IS NULL THEN 'added' WHEN source IS NULL THEN 'new bytes' WHEN md5(substr(c, (source + 1)::INT, n)) <> m THEN 'slice differs' END AS note FROM reuse r LEFT JOIN disk USING (field, file))
SELECT field, file, cpos, id, compressed_size, CASE WHEN note IS NULL THEN 'REUSE' ELSE 'FETCH' END AS decision, CASE WHEN note IS NULL THEN source END AS source, note FROM x""")
def patch_rows(spark, d):
    old, _, o, n = _sides(spark, d)
    disk = old.select("field", "file").join(_disk(spark, d).withColumnRenamed("rel", "file"), "file")
    return plan.patch_rows(n, o, old, disk).withColumn("cpos", F.col("cpos").cast("long"))


@query(_SCAN + ", a AS (SELECT rel, n, CASE WHEN dest_ok THEN 'kept' WHEN source IS NOT NULL AND source_ok THEN CASE WHEN length(rel) % 2 = 0 THEN 'staged' ELSE 'copied' END ELSE 'download' END AS action FROM v) SELECT rel, (sum(CASE WHEN action = 'kept' THEN n ELSE 0 END))::BIGINT AS kept_bytes, (sum(CASE WHEN action IN ('copied', 'staged') THEN n ELSE 0 END))::BIGINT AS reused_bytes, (sum(CASE WHEN action = 'download' THEN n ELSE 0 END))::BIGINT AS fetched_bytes, (sum(CASE WHEN action <> 'kept' THEN n ELSE 0 END))::BIGINT AS written_bytes FROM a GROUP BY rel")
def chunk_settlement(spark, d):
    chunks, verdicts = _scanned(spark, d)
    seen = chunks.join(verdicts, ["rel", "cpos"]).withColumns({"live": F.col("source_ok"), "staged": F.length("rel") % 2 == 0})
    return plan.chunk_settlement(reports.file_actions(seen))


_BUNDLE = with_("reuse", "diff", "score") + """, b AS (SELECT 'A1' AS id, event_id % 4 <> 0 AS ok FROM events UNION ALL SELECT 'A2', event_id % 5 <> 0 FROM events
UNION ALL SELECT 'A3', doc_id % 6 <> 0 FROM documents UNION ALL SELECT 'A4', doc_id % 7 <> 0 FROM documents UNION ALL SELECT 'A5', unnest([doc_id % 8 <> 0, true]) FROM documents
UNION ALL SELECT 'A6', doc_id % 9 <> 0 FROM documents UNION ALL SELECT 'A7', doc_id % 6 <> 0 FROM old_body WHERE length(body) > 0 UNION ALL SELECT 'A8', doc_id % 10 <> 0 FROM new_body WHERE length(body) > 0
UNION ALL SELECT 'A9', doc_id % 10 <> 0 FROM new_body WHERE length(body) > 0 UNION ALL SELECT 'A10', md5(CASE WHEN o.doc_id % 6 = 0 THEN substr('~' || substr(o.body, 2), (source + 1)::INT, n) ELSE substr(o.body, (source + 1)::INT, n) END) = m FROM reuse r JOIN old_body o USING (field, file) WHERE source IS NOT NULL
UNION ALL SELECT 'A12', split_part(file, '/', 3)::BIGINT % 17 <> 0 FROM (SELECT DISTINCT field, file, m FROM reuse WHERE source IS NULL) UNION ALL SELECT 'A13', doc_id % 3 <> 0 FROM documents UNION ALL SELECT 'A14', doc_id % 13 <> 0 FROM documents WHERE doc_id % 11 <> 0
UNION ALL SELECT 'A15', state <> 'added' FROM (SELECT DISTINCT state FROM diff) UNION ALL SELECT 'A17', c <> 'added' FROM (SELECT unnest(['identical', 'no_reuse', 'reuse_in_place', 'reuse_moved', 'added', 'removed']) AS c)
UNION ALL SELECT 'A18', doc_id % 10 <> 0 AND doc_id % 14 <> 0 FROM new_body WHERE length(body) > 0 UNION ALL SELECT 'A19', CASE WHEN split_part(file, '/', 3)::BIGINT % 23 = 0 THEN state = 'identical' WHEN split_part(file, '/', 3)::BIGINT % 29 = 0 THEN state = 'changed' ELSE true END FROM diff WHERE state IN ('identical', 'changed')
UNION ALL SELECT 'A20', field <> 'en' FROM (SELECT DISTINCT field FROM reuse) UNION ALL SELECT 'A21', bool_or(source IS NULL) AND bool_or(source IS NOT NULL) FROM reuse UNION ALL SELECT 'A22', bool_or(source <> off) AND bool_or(source = off) FROM reuse
UNION ALL SELECT 'A23', bool_or(new_size > old_size) AND bool_or(new_size <= old_size) FROM diff)
"""


def _checks(spark: SparkSession, d: str) -> DataFrame:
    n, e = F.col("doc_id"), F.col("event_id")
    docs, events = table(spark, d, "documents"), table(spark, d, "events")
    # what several checks stand on is made once
    old, new = (cut_.written(build(spark, d, which)) for which in ("old", "new"))
    o, w = manifest.flatten(old), manifest.flatten(new)
    number = F.split_part("file", F.lit("/"), F.lit(3)).cast("long")
    name, sum_ = n.cast("string").alias("name"), F.md5("text")
    id_ = F.concat(F.substring(F.md5(n.cast("string")), 1, 16), F.lit("_"), F.when(n % 7 == 0, F.md5(F.lit("x"))).otherwise(sum_))
    blob = lambda wrong: docs.select(n.cast("string").alias("id"), F.lit(1).alias("compressed_size"), F.when(F.lit(wrong) & (n % 9 == 0), "x").otherwise(sum_).alias("compressed_md5"), F.lit(2).alias("uncompressed_size"), sum_.alias("uncompressed_md5"))
    files = lambda which: bodies(spark, d, which).where(F.length("body") > 0)
    found = lambda which, wrong: files(which).select(F.col("file").alias("path"), F.length("body").alias("size"), F.when(wrong, "x").otherwise(F.md5("body")).alias("md5"))
    sure, tenth = F.lit(False), n % 10 == 0
    reuse = cut_.written(manifest.chunk_reuse(w, o))
    slices = reuse.where("source is not null").join(_disk(spark, d).withColumnRenamed("rel", "file"), "file").select(F.col("file").alias("path"), "cpos", F.col("uncompressed_md5").alias("md5"), F.substring("content", (F.col("source") + 1).cast("int"), F.col("uncompressed_size").cast("int")).alias("content"))
    scores = cut_.written(manifest.path_diff(old, new))
    planned = cut_.written(manifest.patch_plan(w, o))
    rows = planned.withColumnRenamed("field", "name")
    sums = manifest.patch_totals(planned).select(F.col("field").alias("name"), F.when(F.col("field") == "en", F.col("reuse") + 1).otherwise(F.col("reuse")).alias("reuse"), "fetch", "moved", "download_bytes")
    md5s = lambda df, c: df.select("field", "file", F.col("md5").alias(c))
    both = scores.where("state in ('identical', 'changed')").join(md5s(old, "old_md5"), ["field", "file"]).join(md5s(new, "new_md5"), ["field", "file"])
    both = both.withColumn("new_md5", F.when(number % 23 == 0, F.col("old_md5")).when(number % 29 == 0, "x").otherwise(F.col("new_md5")))
    held = cut_.written(manifest.retention(w, o))
    held = held.unionByName(held.where((F.col("role") == "patch_fetch") & (number % 17 == 0)).withColumn("role", F.lit("reuse")))
    counted = scores.groupBy("state").agg(F.count("*").alias("n")).withColumn("n", F.col("n") + F.when(F.col("state") == "added", 1).otherwise(0))
    return assertions.every(
        assertions.retcodes(events.select(e.cast("string").alias("name"), F.when(e % 4 == 0, 1).otherwise(0).alias("retcode"))),
        assertions.tags(events.select(F.lit("7.1").alias("requested"), F.when(e % 5 == 0, "7.0").otherwise("7.1").alias("tag"))),
        assertions.checksums(docs.select(name, F.when(n % 6 == 0, "x").otherwise(F.upper(sum_)).alias("checksum"), F.encode("text", "utf-8").alias("content"))),
        assertions.id_suffixes(docs.select(name, sum_.alias("checksum"), id_.alias("id"))),
        bundle.reconciled(docs.select(name, F.lit(1).alias("files"), F.lit(2).alias("chunks"), F.lit(None).cast("long").alias("bytes")), docs.select(name, F.when(n % 8 == 0, 3).otherwise(1).alias("files"), F.lit(2).alias("chunks"), F.lit(9).alias("bytes"))),
        bundle.blobs(blob(False), blob(True)),
        bundle.assembled(found("old", sure), found("old", n % 6 == 0), old=True),
        bundle.assembled(found("new", sure), found("new", tenth), old=False),
        bundle.patched(found("new", sure).select("path", "md5"), found("new", tenth).select("path", "md5")),
        bundle.reused_slices(slices),
        assertions.fetch_subsets(held),
        bundle.config_tags(docs.select(name, F.lit("7.0").alias("old_tag"), F.when(n % 3 != 0, "7.0").alias("version"))),
        bundle.strays(docs.where("doc_id % 11 <> 0").select(n.cast("string").alias("path")), docs.where("doc_id % 13 <> 0").select(n.cast("string").alias("path"))),
        assertions.counts_agree(counted, scores),
        bundle.class_states(spark.createDataFrame([(c, "captured" if c != "removed" else "over_budget") for c in manifest.CLASSES if c != "added"], "class string, status string")),
        bundle.shipped(found("new", sure), found("new", tenth).where("path not rlike '/(0|[0-9]*)$' or cast(split_part(path, '/', 3) as bigint) % 14 <> 0")),
        assertions.differs_unless_identical(both.select(F.col("file").alias("name"), F.col("state").alias("class"), "old_md5", "new_md5")),
        bundle.totals_are_sums(sums, rows),
        bundle.boundaries(reuse, scores),
    )


@query(_BUNDLE + "SELECT id, count(*) AS total, count(*) FILTER (ok) AS passed, count(*) FILTER (NOT ok) AS failed FROM b GROUP BY id")
def bundle_verification(spark, d):
    return assertions.summary(_checks(spark, d))


@query(_BUNDLE + ", r AS (SELECT DISTINCT 'A' || (event_id % 25) AS id FROM events WHERE event_id % 3 > 0), v AS (SELECT id, bool_and(ok) AS again FROM b WHERE id IN ('A1', 'A2', 'A21', 'A22') GROUP BY 1) SELECT id, coalesce(again, true) AS agrees FROM r LEFT JOIN v USING (id)")
def verify_agreement(spark, d):
    """Ids that a log records as ok, against what is derived again; most of them are not."""
    n = F.col("event_id")
    recorded = table(spark, d, "events").select(F.concat(F.lit("A"), (n % 25).cast("string")).alias("id"), (n % 3 > 0).alias("ok"))
    return assertions.agreement(recorded, _checks(spark, d).where("id in ('A1', 'A2', 'A21', 'A22')"))


@query("""WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN md5(o_orderkey::VARCHAR) END AS om, CASE WHEN o_orderkey % 5 <> 0 THEN md5('n' || o_orderkey) END AS nm FROM orders)
SELECT 'A7' AS id, o_orderkey::VARCHAR AS subject, o_orderkey % 4 <> 1 AS ok FROM o WHERE om IS NOT NULL UNION ALL SELECT 'A8', o_orderkey::VARCHAR, true FROM o WHERE nm IS NOT NULL UNION ALL SELECT 'A9', o_orderkey::VARCHAR, o_orderkey % 7 <> 1 FROM o WHERE nm IS NOT NULL AND om IS NOT NULL""")
def assembly_rows(spark, d):
    k = F.col("o_orderkey")
    old, new = F.when(k % 3 != 0, F.md5(k.cast("string"))), F.when(k % 5 != 0, F.md5(F.concat(F.lit("n"), k.cast("string"))))
    out = table(spark, d, "orders").select(k.cast("string").alias("capture_id"), old.alias("old_md5"), F.when(k % 4 == 1, "x").otherwise(old).alias("old_found"), new.alias("new_md5"), new.alias("new_found"), F.when(k % 7 == 1, "x").otherwise(new).alias("patched_md5"))
    return bundle.assembly(out).select("id", "subject", "ok")


# --- documents and records


@query(with_("scored") + """SELECT field, file AS path, state, CASE WHEN state IN ('identical', 'changed') THEN old_size::VARCHAR ELSE '' END AS old_size, CASE WHEN state IN ('identical', 'changed') THEN new_size::VARCHAR ELSE '' END AS new_size,
CASE WHEN state IN ('identical', 'changed') THEN reused ELSE 0 END AS reused, CASE WHEN state IN ('identical', 'changed') THEN moved ELSE 0 END AS moved, CASE WHEN state IN ('identical', 'changed') THEN patch_bytes ELSE 0 END AS patch_bytes, CASE WHEN state IN ('identical', 'changed') THEN total_cost ELSE 0 END AS total_cost FROM scored""")
def diff_rows(spark, d):
    return records.diff_rows(manifest.scored(*_sides(spark, d)))


@query(with_("scored") + """, c AS (SELECT field, file, state, class, coalesce(CASE state WHEN 'removed' THEN old_size WHEN 'added' THEN new_bytes ELSE total_cost END, 0)::BIGINT AS budget_cost, coalesce(total_cost, 0) AS t, coalesce(moved, 0) AS mo, coalesce(reused, 0) AS re FROM scored)
SELECT field, file, state, budget_cost, CASE WHEN state = 'changed' THEN row_number() OVER (PARTITION BY state = 'changed' ORDER BY t, field <> 'game', field, mo DESC, re DESC, file) END AS rank,
CASE WHEN class IS NOT NULL THEN row_number() OVER (PARTITION BY class IS NOT NULL ORDER BY budget_cost, field <> 'game', field, file) END AS admission_rank FROM c""")
def candidates_document(spark, d):
    return selection.candidates_document(manifest.scored(*_sides(spark, d)))


@query("""SELECT o_orderkey, '{"event":"summary"' || CASE WHEN o_orderkey % 2 = 0 THEN ',"limited":1' ELSE '' END || CASE WHEN o_orderkey % 3 = 0 THEN ',"scoped":1' ELSE '' END || ',"plan_files":' || o_custkey || CASE WHEN o_orderstatus = 'F' THEN ',"stopped":"write"' ELSE '' END || '}' AS record FROM orders""")
def summary_records(spark, d):
    k = F.col("o_orderkey")
    facts: dict[str, Column | None] = {"limited": F.when(k % 2 == 0, 1), "scoped": F.when(k % 3 == 0, 1), "plan_files": F.col("o_custkey"), "ram_bytes": None, "stopped": F.when(F.col("o_orderstatus") == "F", "write")}
    return table(spark, d, "orders").select("o_orderkey", plan.run_record(facts).alias("record"))


@query("""SELECT doc_id, 'REPORT local_version=' || CASE WHEN doc_id % 4 = 0 THEN 'none' ELSE '7.' || (doc_id % 9) END || ' latest_version=8.0 biz=' || source || ' exe=a%20b.exe download_mode=chunk branch=main package_id=' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '' ELSE ' build_id=b' || doc_id END
|| ' audio_langs=' || CASE WHEN lang < 'en' THEN lang || ',en' ELSE 'en,' || lang END || ' diff_tags=7.9,7.' || (doc_id % 9) AS record FROM documents""")
def report_records(spark, d):
    n = F.col("doc_id")
    minor = F.concat(F.lit("7."), (n % 9).cast("string"))
    facts = table(spark, d, "documents").select(
        "doc_id", F.when(n % 4 > 0, minor).alias("local_version"), F.lit("8.0").alias("latest_version"), F.col("source").alias("biz"), F.lit("a b.exe").alias("exe"), F.lit("chunk").alias("download_mode"), F.lit("main").alias("branch"),
        n.cast("string").alias("package_id"), F.when(n % 3 > 0, F.concat(F.lit("b"), n.cast("string"))).alias("build_id"), F.array(F.lit("en"), F.col("lang")).alias("audio_langs"), F.array(F.lit("7.9"), minor).alias("diff_tags"),
    )
    return plan.report_record(facts).select("doc_id", "record")


_REGIONS = "(SELECT 'r' || n_nationkey AS region, 'https://' || n_nationkey || '.host/api/' AS base, 'l' || n_nationkey AS launcher_id, 'g' || n_regionkey AS game_id, n_regionkey::VARCHAR AS channel, '0' AS sub_channel FROM nation)"


@query(f"""SELECT c_custkey, base || CASE WHEN c_custkey % 3 = 0 THEN 'retired' ELSE 'list' END || '?launcher_id=' || launcher_id || '&language=en&game_ids[]=' || game_id || CASE WHEN c_custkey % 3 = 0 THEN '&channel=' || channel || '&sub_channel=0' ELSE '' END AS url
FROM customer JOIN {_REGIONS} r ON r.region = 'r' || c_nationkey""")
def region_addresses(spark, d):
    k = F.col("n_nationkey").cast("string")
    regions = table(spark, d, "nation").select(F.concat(F.lit("r"), k).alias("region"), F.concat(F.lit("https://"), k, F.lit(".host/api")).alias("base"), F.concat(F.lit("l"), k).alias("launcher_id"), F.concat(F.lit("g"), F.col("n_regionkey").cast("string")).alias("game_id"), F.col("n_regionkey").cast("string").alias("channel"), F.lit("0").alias("sub_channel"))
    asked = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("r"), F.col("c_nationkey").cast("string")).alias("region"))
    retired = F.col("c_custkey") % 3 == 0
    return requests.addressed(asked, regions, F.when(retired, "retired").otherwise("list"), F.lit("en"), retired).select("c_custkey", "url")


@query("""WITH c AS (SELECT unnest(['identical', 'no_reuse', 'reuse_in_place', 'reuse_moved', 'added', 'removed']) AS class), k AS (SELECT source, count(*) AS n, ['identical', 'no_reuse', 'reuse_in_place', 'reuse_moved', 'added', 'removed'][1 + (max(doc_id) % 6)::INT] AS lacks FROM documents GROUP BY 1)
SELECT source || ': ' || class AS class, class || ': ' || CASE WHEN n % 2 = 0 THEN 'over_budget' ELSE 'unavailable' END AS line FROM k, c WHERE class = lacks AND class <> 'added'""")
def classes_unmet(spark, d):
    """Required classes that sources lack: each source lacks one, which for some is not required."""
    names = F.array(*map(F.lit, manifest.CLASSES))
    order = ["identical", "no_reuse", "reuse_in_place", "reuse_moved", "added", "removed"]
    lacks = F.element_at(F.array(*map(F.lit, order)), (F.max("doc_id") % 6 + 1).cast("int"))
    kinds = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), lacks.alias("lacks"))
    status = F.when(F.col("class") != F.col("lacks"), F.when(F.length("class") > 9, "covered").otherwise("captured")).when(F.col("n") % 2 == 0, "over_budget").otherwise("unavailable")
    rows = kinds.select("source", "n", "lacks", F.explode(names).alias("class")).withColumn("status", status)
    return selection.unmet(rows, [c for c in manifest.CLASSES if c != "added"], "source").select(F.concat_ws(": ", "source", "class").alias("class"), "line")


@query("""SELECT (SELECT count(*) FROM orders) AS orders_n, (SELECT max(o_orderkey) FROM orders) AS orders_last, (SELECT count(*) FROM events) AS events_n, (SELECT min(event_id) FROM events WHERE event_id % 7 = 3) AS errors_error""")
def capture_summary(spark, d):
    orders, events = table(spark, d, "orders"), table(spark, d, "events")
    errors = events.where("event_id % 7 = 3").select(F.col("event_id").alias("idx"), F.col("event_id").alias("error"))
    return plan.capture_summary({"orders": orders.agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last")), "events": events.agg(F.count("*").alias("n")), "errors": plan.first_error(errors)})


@query(_ADMITTED + """, w AS (SELECT m, max(n) AS n, count(*) AS k FROM (SELECT m, n FROM oc UNION ALL SELECT m, n FROM nc) GROUP BY m), lines AS (SELECT field, file, sum(n) AS total, max(off + n) AS end_ FROM new_chunk GROUP BY ALL)
SELECT (SELECT count(*) FROM diff) AS diff_paths, (SELECT count(*) FROM diff WHERE state = 'changed') AS diff_changed, (SELECT coalesce(sum(new_size), 0) FROM diff WHERE state = 'added')::BIGINT AS diff_added_bytes,
(SELECT count(*) FROM adm) AS selection_admitted, (SELECT count(*) FROM adm LEFT JOIN old_file o USING (field, file) LEFT JOIN new_file n USING (field, file) WHERE o.md5 IS NULL AND n.md5 IS NULL) AS selection_sideless,
(SELECT count(*) FROM w) AS chunks_wanted, (SELECT sum(n) FROM w)::BIGINT AS chunks_projected, (SELECT sum(k) FROM w)::BIGINT AS chunks_references, (SELECT count(*) FROM nc WHERE source IS NULL) AS plan_fetch, (SELECT count(*) FROM nc WHERE source IS NOT NULL) AS plan_reuse,
(SELECT count(*) FROM lines) AS checks_total, 0::BIGINT AS checks_failed""")
def capture_counters(spark, d):
    """The counters of a capture's phases, each from the write of its own rows."""
    old, new, old_chunks, new_chunks = _sides(spark, d)
    admitted, run = _admitted(spark, d), Phases()
    state = lambda name: F.col("state") == name
    run.run("diff", manifest.path_diff(old, new), paths=F.count("*"), changed=F.count_if(state("changed")), added_bytes=F.sum(F.when(state("added"), F.col("new_size"))))
    run.run("selection", plan.sides_of(admitted, old, new).select("field", "file", "old.size", F.col("new.size").alias("new_size")), admitted=F.count("*"), sideless=F.count_if(F.col("size").isNull() & F.col("new_size").isNull()))
    run.run("chunks", plan.chunk_plan(admitted, old_chunks, new_chunks)[1], wanted=F.count("*"), projected=F.sum("compressed_size"), references=F.sum("references"))
    chosen = lambda df: df.join(admitted.select("field", "file"), ["field", "file"], "left_semi")
    run.run("plan", manifest.patch_plan(chosen(new_chunks), chosen(old_chunks)), fetch=F.count_if(F.col("decision") == "FETCH"), reuse=F.count_if(F.col("decision") == "REUSE"))
    sized = new_chunks.join(new.select("field", "file", "size"), ["field", "file"])
    run.run("checks", assertions.sizes_cover(sized), total=F.count("*"), failed=F.count_if(~F.col("ok")))
    return run.record(spark)


@query("""WITH f AS (SELECT doc_id::VARCHAR AS path, n_chars AS bytes, md5(text) AS md5, sha256(text) AS sha256, doc_id FROM documents), m AS (SELECT min(path) AS least FROM f)
SELECT 0 AS part, NULL AS place, '{"schema_version":1,"totals":{"files":' || count(*) || ',"bytes":' || sum(bytes)::BIGINT || '},"matrix":[{"class":"identical","status":"captured","file":"' || min(path) || '"},{"class":"added","status":"unavailable","file":null}],"totals_by_set":{"patch_fetch":' || count(*) FILTER (doc_id % 2 = 0) || ',"reuse":' || count(*) FILTER (doc_id % 2 = 1) || '},"files":[' AS piece FROM f
UNION ALL SELECT 1, path, CASE WHEN path = least THEN '' ELSE ',' END || '{"path":"' || path || '","bytes":' || bytes || ',"md5":"' || md5 || '","sha256":"' || sha256 || '","encoding":' || CASE WHEN doc_id % 3 > 0 THEN '"identity"' ELSE 'null' END || '}' FROM f, m
UNION ALL SELECT 2, NULL, ']}'""")
def long_manifest(spark, d):
    """The rows of a bundle's index that names every document."""
    n = F.col("doc_id")
    files = table(spark, d, "documents").select(n.cast("string").alias("path"), F.col("n_chars").cast("long").alias("bytes"), F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256"), F.when(n % 3 > 0, "identity").alias("encoding"), "doc_id")
    matrix = files.agg(F.min("path").alias("file")).select(F.explode(F.array(F.struct(F.lit("added").alias("class"), F.lit("unavailable").alias("status"), F.lit(None).cast("string").alias("file")), F.struct(F.lit("identical").alias("class"), F.lit("captured").alias("status"), F.col("file")))).alias("r")).select("r.*")
    sets = files.groupBy(F.when(n % 2 == 0, "patch_fetch").otherwise("reuse").alias("role")).agg(F.count("*").alias("chunks"))
    return documents.manifest_document(matrix, files, sets)


@query("""WITH g AS (SELECT doc_id, CASE WHEN doc_id % 31 = 1 THEN 'configs: absent' WHEN doc_id % 31 = 2 THEN 'configs: retcode 7' WHEN doc_id % 7 = 1 THEN 'delivery: DOWNLOAD_MODE_LDIFF' WHEN doc_id % 7 = 2 THEN 'delivery: no download mode'
  WHEN doc_id % 11 = 1 THEN 'scan folder: path.parent' WHEN doc_id % 11 = 2 THEN 'scan folder: no scan folder' WHEN doc_id % 13 = 1 THEN 'new build: absent' WHEN doc_id % 13 = 2 THEN 'new build: no answer' WHEN doc_id % 13 = 3 THEN 'new tag: tag 9 for 2'
  WHEN doc_id % 13 = 4 THEN 'new tag: no tag' WHEN doc_id % 17 = 1 THEN 'old build: retcode 9' WHEN doc_id % 17 = 2 THEN 'old tag: tag 9 for 1' WHEN doc_id % 19 = 1 THEN 'new store: new manifest_download: encrypted' WHEN doc_id % 23 = 1 THEN 'new store: new chunk_download: not zstd'
  WHEN doc_id % 29 = 1 THEN 'old store: old chunk_download: encrypted' END AS why FROM documents)
SELECT doc_id AS capture, split_part(why, ': ', 1) AS gate, substr(why, length(split_part(why, ': ', 1)) + 3) AS refusal, CASE WHEN why IS NULL THEN 'o' || doc_id END AS old_build_id, CASE WHEN why IS NULL THEN 'n' || doc_id END AS new_build_id FROM g""")
def capture_gates(spark, d):
    """Captures whose answers lack or spoil something, each with the first gate that refuses it."""
    n = F.col("doc_id")
    docs = table(spark, d, "documents").select("doc_id")
    at = lambda k, r: n % k == r
    answer = lambda data, code=0: F.to_json(F.struct(F.lit(code).alias("retcode"), F.lit("m").alias("message"), data.alias("data")))
    mode = F.when(at(7, 1), "DOWNLOAD_MODE_LDIFF").when(~at(7, 2), "DOWNLOAD_MODE_CHUNK")
    scan_dir = F.when(at(11, 1), "a/../b").when(~at(11, 2), "a/audio")
    config = F.struct(F.array(F.struct(mode.alias("default_download_mode"), scan_dir.alias("audio_pkg_scan_dir"))).alias("launch_configs"))
    store = lambda bad_e, bad_c: F.struct(F.when(bad_e, 1).otherwise(0).alias("encryption"), F.when(bad_c, 3).otherwise(1).alias("compression"))
    no = F.lit(False)
    build_ = lambda tag, id_, m, c: F.struct(tag.alias("tag"), F.concat(F.lit(id_), n.cast("string")).alias("build_id"), F.array(F.struct(store(no, no).alias("manifest_download"), store(no, no).alias("chunk_download")), F.struct(m.alias("manifest_download"), c.alias("chunk_download"))).alias("manifests"))
    new = build_(F.when(at(13, 3), "9").when(~at(13, 4), "2"), "n", store(at(19, 1), no), store(no, at(23, 1)))
    old = build_(F.when(at(17, 2), "9").otherwise("1"), "o", store(no, no), store(at(29, 1), no))
    body = lambda rows, name, text: rows.select(n.alias("capture"), F.lit(name).alias("name"), text.alias("body"))
    bodies_ = body(docs.where(~at(31, 1)), "configs", F.when(at(31, 2), answer(config, 7)).otherwise(answer(config))).unionAll(body(docs.where(~at(13, 1)), "new", F.when(at(13, 2), "<html>").otherwise(answer(new)))).unionAll(body(docs, "old", F.when(at(17, 1), answer(old, 9)).otherwise(answer(old))))
    return capture.judged(docs.select(n.alias("capture"), F.lit("1").alias("old_tag"), F.lit("2").alias("new_tag")), bodies_)


@query("""WITH b AS (SELECT event_id AS seq, event_id % 5 = 0 AS none, event_id % 7 * 100 AS bytes, event_type FROM events WHERE event_id % 10 = 3), c AS (SELECT *, coalesce(sum(bytes) OVER (PARTITION BY event_type ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b),
s AS (SELECT *, least(bytes, greatest(2000 - before, 0)) AS stored FROM c), m AS (SELECT min(seq) AS least FROM s)
SELECT 0 AS part, NULL AS place, '{"schema_version":1,"budget":2000,"count":' || count(*) || ',"retained_bytes":' || sum(stored)::BIGINT || ',"responses":[' AS piece FROM s
UNION ALL SELECT 1, seq, CASE WHEN seq = least THEN '' ELSE ',' END || '{"seq":' || seq || ',"url":"https://h/' || seq || '","status":404,"attempts":' || (seq % 3 + 1) || ',"content_type":' || CASE WHEN seq % 4 = 0 THEN 'null' ELSE '"text/html"' END || ',"bytes_received":' || bytes || ',"retained_bytes":' || stored::BIGINT
  || ',"truncated":' || (stored < bytes) || ',"stored_path":' || CASE WHEN stored > 0 THEN '"api/error_bodies/' || right('000000' || seq, 6) || '.body"' ELSE 'null' END || '}' FROM s, m
UNION ALL SELECT 2, NULL, ']}'""")
def error_responses(spark, d):
    """The rows of the index of error answers, of which a budget for each kind is stored."""
    n = F.col("event_id")
    bodies_ = table(spark, d, "events").where(n % 10 == 3).select(F.col("event_type").alias("grp"), n.alias("seq"), F.concat(F.lit("https://h/"), n.cast("string")).alias("url"), F.lit(404).alias("status"), (n % 3 + 1).alias("attempts"), F.when(n % 4 > 0, "text/html").alias("content_type"), (n % 7 * 100).alias("bytes"))
    return documents.error_document(reports.stored_bodies(bodies_, 2000), 2000)


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'usage' WHEN o_orderkey % 7 = 0 THEN 'metadata' WHEN o_orderkey % 5 > 3 THEN 'limit' WHEN o_orderkey % 3 = 0 THEN 'write' WHEN o_orderkey % 2 = 1 THEN 'damaged' ELSE 'ok' END AS status FROM orders""")
def exit_states(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select("o_orderkey", (k % 11 == 0).alias("usage_error"), (k % 7 == 0).alias("metadata_error"), F.when(k % 5 > 3, 1).otherwise(0).alias("limit_hits"), (k % 3 == 0).alias("write_error"), (k % 2).alias("failed"))
    return reports.exit_status(rows, "o_orderkey")


@query("SELECT count(*) AS requested, count(*) FILTER (event_id % 3 = 0) AS served, count(*) FILTER (event_id % 3 = 0 AND event_type NOT IN ('click', 'view')) AS served_outside FROM events")
def tag_probes(spark, d):
    probes = table(spark, d, "events").select(F.col("event_type").alias("tag"), F.when(F.col("event_id") % 3 == 0, 200).otherwise(404).alias("status"))
    return reports.tag_probe_summary(probes, ["click", "view"])


@query("SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) - 1 AS ordinal FROM orders")
def capture_ordinals(spark, d):
    return trees.first_by_group(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_custkey", "o_totalprice", "o_orderkey").select("o_orderkey", "o_custkey", "ordinal")


@query(with_("scored") + """, k AS (SELECT unnest(['identical', 'no_reuse', 'reuse_in_place', 'reuse_moved', 'added', 'removed']) AS class), n AS (SELECT class, count(file) AS n FROM k LEFT JOIN scored USING (class) GROUP BY 1) SELECT class, class || ': unavailable' AS line FROM n WHERE n = 0 AND class <> 'added'""")
def unmet_classes(spark, d):
    held = manifest.scored(*_sides(spark, d)).where("class is not null").select("class").distinct().withColumn("status", F.lit("captured"))
    every = spark.createDataFrame([(c,) for c in manifest.CLASSES], "class string")
    status = every.join(held, "class", "left").withColumn("status", F.coalesce("status", F.lit("unavailable")))
    return selection.unmet(status, [c for c in manifest.CLASSES if c != "added"])


# --- links and renames

_LINKED = """WITH RECURSIVE e AS (SELECT 'l/' || doc_id AS link, CASE WHEN doc_id % 6 = 5 THEN CASE WHEN doc_id % 4 = 1 THEN NULL ELSE 'real/' || doc_id || '/x' END ELSE 'l/' || (doc_id + 1) END AS target, doc_id FROM documents),
r AS (SELECT link, target FROM e WHERE target IS NOT NULL UNION SELECT r.link, e.target FROM r JOIN e ON e.link = r.target WHERE e.target IS NOT NULL),
"""


def _chain(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    target = F.when(n % 6 == 5, F.when(n % 4 != 1, F.concat(F.lit("real/"), n.cast("string"), F.lit("/x")))).otherwise(F.concat(F.lit("l/"), (n + 1).cast("string")))
    return table(spark, d, "documents").select(F.concat(F.lit("l/"), n.cast("string")).alias("rel"), F.lit("file").alias("kind"), target.alias("target"))


@query(_LINKED + "x AS (SELECT 1) SELECT link, target FROM r")
def link_closure(spark, d):
    return trees.link_closure(_chain(spark, d).where("target is not null").select(F.col("rel").alias("link"), "target"))


@query(_LINKED + """k AS (SELECT link FROM e WHERE doc_id % 6 = 2), n AS (SELECT DISTINCT target AS rel FROM r WHERE link IN (SELECT link FROM k)), y AS (SELECT rel, CASE WHEN rel IN (SELECT link FROM e) THEN 'link' ELSE 'storage' END AS because FROM n)
SELECT * FROM y UNION ALL SELECT DISTINCT split_part(rel, '/', 1), 'directory' FROM y UNION ALL SELECT DISTINCT split_part(rel, '/', 1) || '/' || split_part(rel, '/', 2), 'directory' FROM y WHERE rel LIKE 'real/%'""")
def link_sparing(spark, d):
    kept = table(spark, d, "documents").where("doc_id % 6 = 2").select(F.concat(F.lit("l/"), F.col("doc_id").cast("string")).alias("rel"), F.lit("file").alias("kind"))
    return sync.spared(kept, _chain(spark, d))


@query(_LINKED + """m AS (SELECT 'l/' || doc_id AS rel FROM documents WHERE doc_id % 3 = 2), s AS (SELECT r.target AS storage, r.link AS name FROM r WHERE r.target LIKE 'real/%' AND r.link IN (SELECT rel FROM m))
SELECT storage, string_agg(name, '|' ORDER BY name) AS names FROM s GROUP BY 1 HAVING count(*) > 1 AND bool_or(split_part(name, '/', 2)::BIGINT % 5 = 0)""")
def shared_storage(spark, d):
    n = F.col("doc_id")
    src = table(spark, d, "documents").where("doc_id % 3 = 2").select(F.concat(F.lit("l/"), n.cast("string")).alias("rel"), F.lit("file").alias("kind"))
    copied = table(spark, d, "documents").where("doc_id % 5 = 0").select(F.lit("COPY").alias("stage"), F.concat(F.lit("l/"), n.cast("string")).alias("rel"))
    return sync.shared_storage(src, _chain(spark, d), copied).select("storage", F.array_join("names", "|").alias("names"))


_THROUGH = """WITH RECURSIVE l AS (SELECT CASE WHEN doc_id % 8 IN (0, 4, 7) THEN 'k/' WHEN doc_id % 8 = 1 THEN 'p/' WHEN doc_id % 8 = 2 THEN 'q/' WHEN doc_id % 8 = 3 THEN 's/' ELSE 'loop/' END || doc_id AS rel,
  CASE doc_id % 8 WHEN 0 THEN 'p/' || (doc_id + 1) || '/x' WHEN 1 THEN 'q/' || (doc_id + 1) WHEN 2 THEN 's/' || (doc_id + 1) || '/in' WHEN 3 THEN CASE WHEN doc_id % 5 > 0 THEN 'real/' || doc_id END
  WHEN 4 THEN 'loop/' || (doc_id + 1) || '/x' WHEN 5 THEN 'loop/' || (doc_id + 1) WHEN 6 THEN 'loop/' || (doc_id - 1) ELSE 'P/' || (doc_id - 6) || '/Y' END AS target, doc_id % 8 IN (0, 4, 7) AS kept FROM documents),
h AS (SELECT lower(rel) AS head, rel, target FROM l),
w AS (SELECT rel AS link, target AS path FROM l WHERE kept
  UNION SELECT link, target || substr(path, length(rel) + 1) FROM w JOIN h ON head = lower(split_part(path, '/', 1) || '/' || split_part(path, '/', 2)) WHERE target IS NOT NULL),
z AS (SELECT link, path, rel AS via, target FROM w LEFT JOIN h ON head = lower(split_part(path, '/', 1) || '/' || split_part(path, '/', 2))),
"""


def _through(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """links: of files through three folder links (one of them may lead out), in a loop, or in other letters; and src."""
    n, docs = F.col("doc_id"), table(spark, d, "documents")
    to = lambda head, by=0, tail="": F.concat(F.lit(head), (n + by).cast("string"), F.lit(tail))
    case = lambda *values: F.expr("NULL") if not values else F.when(n % 8 == 8 - len(values), values[0]).otherwise(case(*values[1:]))
    rel = case(to("k/"), to("p/"), to("q/"), to("s/"), to("k/"), to("loop/"), to("loop/"), to("k/"))
    target = case(to("p/", 1, "/x"), to("q/", 1), to("s/", 1, "/in"), F.when(n % 5 > 0, to("real/")), to("loop/", 1, "/x"), to("loop/", 1), to("loop/", -1), to("P/", -6, "/Y"))
    links = docs.select(rel.alias("rel"), F.when((n % 8).isin(0, 4, 7), "file").otherwise("dir").alias("kind"), target.alias("target"))
    return links, links.where("kind = 'file'").select("rel", "kind")


@query(_THROUGH + """e AS (SELECT DISTINCT CASE WHEN via IS NOT NULL THEN replace(path, 'P/', 'p/') ELSE path END AS rel, CASE WHEN via IS NULL THEN 'storage' ELSE 'alias' END AS because FROM z UNION SELECT via, 'link' FROM z WHERE via IS NOT NULL),
x AS (SELECT rel, string_split(rel, '/') AS c FROM e), u AS (SELECT array_to_string(c[:i], '/') AS rel FROM (SELECT c, unnest(range(1, len(c))) AS i FROM x))
SELECT rel, because FROM e UNION ALL SELECT DISTINCT rel, 'directory' FROM u WHERE rel NOT IN (SELECT rel FROM e)""")
def links_through_folders(spark, d):
    """What is spared of a disk that matches case, where links lead through folder links."""
    links, src = _through(spark, d)
    held = links.where("rel like 'p/%'").select(F.explode(F.array("rel", F.concat("rel", F.lit("/Y")))).alias("rel"))
    return sync.spared(src, links, held, fold=True)


@query(_THROUGH + """r AS (SELECT link, max(path) FILTER (via IS NULL) AS end_, coalesce(bool_or(via IS NOT NULL AND target IS NULL), false) AS out_ FROM z GROUP BY 1)
SELECT 'endless-link' AS rule, link AS rel, NULL AS at FROM r WHERE end_ IS NULL AND NOT out_ UNION ALL SELECT 'storage-replaced', link, end_ FROM r WHERE end_ LIKE '%/in/x'""")
def links_that_refuse(spark, d):
    """Links in a loop, and links whose storage a plan makes a folder."""
    links, src = _through(spark, d)
    plan_ = links.where("rel like 's/%'").select(F.lit("FIX-DIR").alias("stage"), F.concat("target", F.lit("/in/x")).alias("rel"))
    return sync.link_refusals(src, links, plan_, fold=True)


@query("""WITH f AS (SELECT doc_id, 'f/' || doc_id AS rel, doc_id // 3 AS inode FROM documents), n AS (SELECT inode, count(*) AS links, count(*) FILTER (doc_id % 4 = 1) AS going FROM f GROUP BY 1)
SELECT 'hard-link' AS rule, rel, inode::VARCHAR AS at FROM f JOIN n USING (inode) WHERE doc_id % 4 = 0 AND links > 1 AND going < links - 1""")
def hard_link_guard(spark, d):
    n = F.col("doc_id")
    rows = table(spark, d, "documents").select("doc_id", F.concat(F.lit("f/"), n.cast("string")).alias("rel"), F.floor(n / 3).alias("inode"))
    inodes = rows.join(rows.groupBy("inode").agg(F.count("*").alias("links")), "inode").select("rel", "inode", "links")
    stage = F.when(n % 4 == 0, "COPY").when(n % 4 == 1, "DELETE")
    actions = rows.select(stage.alias("stage"), "rel").where("stage is not null")
    nothing = spark.createDataFrame([], "rel string, target string")
    return sync.guards(actions, rows.select("rel", F.lit("file").alias("kind")), nothing, inodes=inodes)


@query("""WITH s AS (SELECT DISTINCT upper(source) AS src_rel, source AS dst_rel FROM documents), f AS (SELECT upper(source) || '/' || lang || '/' || doc_id AS src_rel, source || '/' || lang || '/' || doc_id AS dst_rel, upper(source) || '/' || lang || '/' || doc_id AS from_rel FROM documents)
SELECT src_rel, dst_rel, dst_rel AS from_rel, 1 AS depth FROM s UNION ALL SELECT src_rel, dst_rel, from_rel, 3 FROM f""")
def rename_steps(spark, d):
    docs = table(spark, d, "documents")
    rel = lambda source: F.concat_ws("/", source, "lang", F.col("doc_id").cast("string"))
    top = docs.select(F.upper("source").alias("src_rel"), F.col("source").alias("dst_rel")).distinct()
    return trees.rename_steps(top.unionAll(docs.select(rel(F.upper("source")).alias("src_rel"), rel(F.col("source")).alias("dst_rel"))))


@query("""WITH w AS (SELECT 'A/' || doc_id AS rel, doc_id FROM documents) SELECT rel, CASE WHEN doc_id % 3 = 0 THEN rel WHEN doc_id % 3 = 1 THEN 'a/' || doc_id END AS spelling FROM w""")
def link_spellings(spark, d):
    n = F.col("doc_id").cast("string")
    docs = table(spark, d, "documents")
    held = docs.where("doc_id % 3 = 0").select(F.concat(F.lit("A/"), n).alias("rel")).unionAll(docs.where("doc_id % 3 < 2").select(F.concat(F.lit("a/"), n).alias("rel")))
    return sync.spelled(docs.select(F.concat(F.lit("A/"), n).alias("rel")), held)


@query("""WITH p AS (SELECT source || '/' || lang || '/' || doc_id AS rel, doc_id FROM documents), k AS (SELECT rel FROM p WHERE doc_id % 50 = 0) SELECT rel FROM k UNION SELECT split_part(rel, '/', 1) FROM k UNION SELECT split_part(rel, '/', 1) || '/' || split_part(rel, '/', 2) FROM k""")
def ancestors_pulled_in(spark, d):
    docs = table(spark, d, "documents")
    files = docs.select(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("rel"), F.lit("file").alias("kind"), (F.col("doc_id") % 50 == 0).alias("wanted"))
    dirs = docs.select(F.explode(F.array("source", F.concat_ws("/", "source", "lang"))).alias("rel")).distinct().select("rel", F.lit("dir").alias("kind"), F.lit(False).alias("wanted"))
    return trees.pulled_in(files.unionAll(dirs), F.col("wanted")).select("rel")


@query("""SELECT 'audio/' || lang || '/' || doc_id AS rel, 'game/voice/' || lang || '/' || doc_id AS target_rel, n_chars AS bytes FROM documents WHERE doc_id % 3 = 0 AND lang <> 'fr'""")
def cache_moves(spark, d):
    n = F.col("doc_id")
    rel = F.concat_ws("/", F.when(n % 3 == 0, "audio").otherwise("audios"), F.col("lang"), n.cast("string"))
    return plan.moves(table(spark, d, "documents").select(rel.alias("rel"), F.col("n_chars").cast("long").alias("bytes")), "audio/", "game/voice", exclude=["*/fr/*"])


@query("""WITH t AS (SELECT source || '/' || lang || '/' || doc_id AS rel, n_chars AS bytes, doc_id FROM documents) SELECT rel, bytes FROM t WHERE doc_id % 4 = 0 AND NOT rel LIKE 'src3%'""")
def deprecated_files(spark, d):
    rel = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    docs = table(spark, d, "documents")
    listed = docs.where("doc_id % 4 = 0").select(F.upper(rel).alias("rel"))
    return repair.deprecated(docs.select(rel.alias("rel"), F.col("n_chars").cast("long").alias("bytes")), listed, ~F.col("rel").startswith("src3"))


@query("""WITH r AS (SELECT l_orderkey AS k, l_linenumber AS i, l_partkey % 1000 AS a, l_partkey % 1000 + l_suppkey % 30 AS b FROM lineitem), o AS (SELECT k, a < lag(b) OVER w AND lag(a) OVER w < b AS over FROM r WINDOW w AS (PARTITION BY k ORDER BY a, b)) SELECT k AS file, coalesce(bool_or(over), false) AS terminal FROM o GROUP BY 1""")
def redo_terminal(spark, d):
    a = F.col("l_partkey") % 1000
    return reports.redo_terminal(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file"), a.alias("start"), (a + F.col("l_suppkey") % 30).alias("end")))


@query("SELECT l_orderkey AS file, NOT coalesce(bool_or(l_linenumber % 2 = 0 AND l_partkey % 100 + l_suppkey % 50 > 120), false) AS free FROM lineitem GROUP BY 1")
def trim_is_free(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file"), (F.col("l_partkey") % 100).alias("source"), (F.col("l_suppkey") % 50).alias("uncompressed_size"), (F.col("l_linenumber") % 2 == 0).alias("live"), F.lit(120).alias("target_size"))
    return reports.trim_is_free(rows)


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 100 >= l_linenumber * 20 THEN 'resumed' WHEN l_suppkey % 2 = 0 THEN 'copied' ELSE 'download' END AS action FROM lineitem")
def temp_mode_reuse(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", ((F.col("l_linenumber") - 1) * 20).alias("offset"), F.lit(20).alias("uncompressed_size"), (F.col("l_partkey") % 100).alias("prefix_len"), (F.col("l_suppkey") % 2 == 0).alias("slice_ok"))
    return reports.resumed(rows).select("l_orderkey", "l_linenumber", "action")


@query("""WITH s AS (SELECT o_custkey AS name, list(DISTINCT o_orderkey % 5) AS f, list(DISTINCT o_orderkey % 4) AS n, list(DISTINCT o_orderkey % 3 + 3) AS r FROM orders GROUP BY 1) SELECT name, list_has_all(n, f) AS subset, NOT list_has_any(f, r) AS disjoint FROM s""")
def set_checks(spark, d):
    k = F.col("o_orderkey")
    sets = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("name")).agg(F.collect_set(k % 5).alias("fetch"), F.collect_set(k % 4).alias("new"), F.collect_set(k % 3 + 3).alias("reuse"))
    return reports.set_checks(sets)


@query(with_("diff") + "SELECT state, field || ':' || file AS path FROM diff WHERE state <> 'identical'")
def diff_paths(spark, d):
    return manifest.diff_paths(manifest.path_diff(build(spark, d, "old"), build(spark, d, "new")))


@query("""SELECT 'lang' AS name, count(DISTINCT lang) AS expected, count(DISTINCT lang) AS actual, true AS ok FROM documents UNION ALL SELECT 'docs', count(*), count(*) FILTER (doc_id % 2 = 0), false FROM documents""")
def reconcile(spark, d):
    docs = table(spark, d, "documents")
    declared = docs.agg(F.count_distinct("lang").alias("lang"), F.count("*").alias("docs"), F.lit(None).cast("long").alias("bytes"))
    decoded = docs.agg(F.count_distinct("lang").alias("lang"), F.count_if(F.col("doc_id") % 2 == 0).alias("docs"), F.count("*").alias("bytes"))
    return manifest.reconcile(declared, decoded)
