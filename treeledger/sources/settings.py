"""Small text settings: versions, keep lists, audio languages, caches of older formats, bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeledger.functions.paths import audio_token, path_key

#: Languages in the order in which they are written.
AUDIO = [("Chinese", "zh-cn"), ("English(US)", "en-us"), ("Japanese", "ja-jp"), ("Korean", "ko-kr")]


def lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no, line of one text file, in order."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.posexplode(F.split(F.regexp_replace("value", r"^\x{FEFF}", ""), r"\r?\n", -1)).alias("line_no", "line"))


def game_version(found: DataFrame) -> DataFrame:
    """The last game_version of an INI's lines: split at the first `=`, an empty value is none."""
    at = F.instr("line", "=")
    pair = found.where(at > 0).select("line_no", F.rtrim(F.substring("line", F.lit(1), F.instr("line", "=") - 1)).alias("k"), F.trim(F.substring("line", F.instr("line", "=") + 1, F.length("line"))).alias("v"))
    return pair.where("k = 'game_version' and v <> ''").agg(F.max_by("v", "line_no").alias("version"))


def ini_sections(found: DataFrame) -> DataFrame:
    """section, section_pos, key, value of an INI's lines.

    Sections and keys are told apart by their ASCII fold and keep their first spelling; the last value of a key stays,
    without blanks and quotes around it. Keys before any header belong to General. Comments, blank lines, lines without
    `=` and headers without a name are passed over. A section without keys comes as one row with a null key.
    """
    line = F.regexp_replace("line", r"^\s+|\s+$", "")
    rows = found.select("line_no", line.alias("line")).where("line <> '' and not startswith(line, ';') and not startswith(line, '#')")
    header = F.when(F.col("line").rlike(r"^\[.*\]$"), F.regexp_replace(F.substring("line", F.lit(2), F.length("line") - 2), r"^\s+|\s+$", ""))
    rows = rows.withColumn("header", header)
    # one file of settings: its lines are few
    within = F.last(F.when(F.col("header") != "", F.col("header")), ignorenulls=True).over(Window.orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    at = F.instr("line", "=")
    key = F.when(F.col("header").isNull() & (at > 0), F.regexp_replace(F.substring("line", F.lit(1), at - 1), r"\s+$", ""))
    value = F.regexp_replace(F.regexp_replace(F.substring("line", at + 1, F.length("line")), r"^\s+|\s+$", ""), '^"+|"+$', "")
    rows = rows.select("line_no", F.coalesce(within, F.lit("General")).alias("section"), key.alias("key"), value.alias("value"), (F.col("header") != "").alias("is_header"))
    rows = rows.where("is_header or key <> ''").withColumns({"s": path_key(F.col("section")), "k": path_key(F.col("key"))})
    sections = rows.groupBy("s").agg(F.min_by("section", "line_no").alias("section"), F.min("line_no").alias("section_pos"))
    keys = rows.where("key is not null").groupBy("s", "k").agg(F.min_by("key", "line_no").alias("key"), F.max_by("value", "line_no").alias("value"))
    return sections.join(keys, "s", "left").select("section", "section_pos", "key", "value")


def merged_ini(found: DataFrame, forced: dict[str, str], defaults: dict[str, str] | None = None) -> DataFrame:
    """The sections with the forced keys of General over its own and with those of the defaults that it lacks
    (sdk_version, empty, unless others are given). A key keeps the spelling that it has."""
    defaults = {"sdk_version": ""} if defaults is None else defaults
    spark, own = found.sparkSession, ini_sections(found)
    added = spark.createDataFrame([(k, v, True) for k, v in forced.items()] + [(k, v, False) for k, v in defaults.items()], "key string, value string, wins boolean")
    general = own.where(path_key(F.col("section")) == "general")
    place = general.agg(F.min("section").alias("section"), F.min("section_pos").alias("section_pos"))
    had = general.where("key is not null").select(path_key(F.col("key")).alias("k"), F.col("key").alias("own_key"), F.col("value").alias("own_value"))
    both = had.join(added.withColumn("k", path_key(F.col("key"))), "k", "full_outer")
    value = F.when(F.col("own_key").isNull() | F.coalesce("wins", F.lit(False)), F.col("value")).otherwise(F.col("own_value"))
    last = F.lit((1 << 31) - 1)  # a General that is made comes after all sections
    mine = both.crossJoin(place).select(F.coalesce("section", F.lit("General")).alias("section"), F.coalesce("section_pos", last).alias("section_pos"), F.coalesce("own_key", "key").alias("key"), value.alias("value"))
    return own.where(path_key(F.col("section")) != "general").unionByName(mine)


def ini_text(merged: DataFrame) -> DataFrame:
    """One row, text: sections in their order, keys by their fold, a blank line after each section."""
    entry = F.when(F.col("key").isNotNull(), F.struct(path_key(F.col("key")).alias("k"), F.concat("key", F.lit("="), "value", F.lit("\n")).alias("line")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["line"]), "")
    parts = merged.groupBy("section", "section_pos").agg(F.concat(F.lit("["), F.col("section"), F.lit("]\n"), body, F.lit("\n")).alias("text"))
    return parts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section_pos", "text"))), lambda p: p["text"]), "").alias("text"))


def path_list(found: DataFrame, field: str = "remoteName") -> DataFrame:
    """Paths of a list with a JSON object a line; lines that are none are dropped (bad_lines() has them), but not all may be."""
    rows = found.where(F.trim("line") != "").select("line_no", F.get_json_object("line", f"$.{field}").alias("rel"))
    seen = rows.agg(F.count("*").alias("all"), F.count("rel").alias("good")).first()
    if seen["all"] and not seen["good"]:
        raise ValueError("no line of the list can be used")
    return rows.where("rel is not null").select("rel").distinct()


def bad_lines(found: DataFrame, field: str = "remoteName") -> DataFrame:
    """line_no, line of what path_list() can't use."""
    return found.where((F.trim("line") != "") & F.get_json_object("line", f"$.{field}").isNull()).select("line_no", "line")


def audio_languages(found: DataFrame | None) -> list[str]:
    """Codes of a scan file's lines; en-us without the file, an error if it names none that is known."""
    if found is None:
        return ["en-us"]
    rows = found.where(F.trim("line") != "")
    by_name = F.create_map(*[F.lit(x) for name, code in AUDIO for key in (name.lower(), code) for x in (key, code)])
    codes = {r[0] for r in rows.select(by_name[audio_token(F.col("line"))]).distinct().limit(64).collect()} - {None}
    if not codes and not rows.isEmpty():
        raise ValueError("the scan file names no known language")
    return [code for _, code in AUDIO if code in codes]


def scan_file(codes: list[str]) -> str:
    return "".join(f"{name}\n" for name, code in AUDIO if code in codes)


def import_cache(rows: DataFrame) -> DataFrame:
    """Rows of an older cache (hex digests) as rows of this one (binary digests)."""
    return rows.withColumn("hashes", F.transform_values("hashes", lambda _, v: F.unhex(v)))


def import_counts(rows: DataFrame) -> DataFrame:
    """One row: files, dirs and digests of an older cache."""
    return rows.agg(F.count_if(F.col("kind") == "file").alias("files"), F.count_if(F.col("kind") == "dir").alias("dirs"), F.coalesce(F.sum(F.size(F.map_keys("hashes"))), F.lit(0)).cast("long").alias("hashes"))


def bundles(spark: SparkSession, root: str, versions: list[int]) -> DataFrame:
    """path, schema_version, reason (null: readable) of the bundles below root, by path."""
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "MANIFEST.json").text(root, wholetext=True).select(F.input_file_name().alias("path"), "value")
    version = F.try_variant_get(F.try_parse_json("value"), "$.schema_version", "int")
    reason = F.when(F.try_parse_json("value").isNull(), "not JSON").when(version.isNull(), "no version").when(~version.isin(versions), "unknown version")
    return found.select("path", version.alias("schema_version"), reason.alias("reason")).orderBy("path")


def main_branch(body: DataFrame) -> DataFrame:
    """package, tag, diff_tags, password of the one `main` entry of a branches answer (column body)."""
    kind = "struct<retcode:int,data:struct<game_branches:array<struct<main:struct<package_id:string,branch:string,password:string,tag:string,diff_tags:array<string>>>>>>"
    rows = body.select(F.from_json("body", kind).alias("p")).where("p.retcode = 0").select(F.explode("p.data.game_branches").alias("b")).where("b.main.branch = 'main'").select("b.main.*")
    n = rows.count()
    if n != 1:
        raise ValueError(f"{n} main branches instead of one")
    return rows


def version_pair(branch: DataFrame, new: str | None = None, old: str | None = None) -> tuple[str, str]:
    """New version: as asked for or the branch's; old: as asked for or the first of its diff tags."""
    row = branch.first()
    new_tag, old_tag = new or row["tag"], old or (row["diff_tags"] or [None])[0]
    if not old_tag or new_tag.lower() == old_tag.lower():
        raise ValueError("the old version must be another than the new one")
    return new_tag, old_tag


def composed_tags(*lists: list[str]) -> list[str]:
    return list(dict.fromkeys(t for tags in lists for t in tags))


def hash_list(text: str) -> list[str]:
    """Algorithms of a comma list, in lower case, each once; `none` stands alone."""
    names = list(dict.fromkeys(n.strip().lower() for n in text.split(",") if n.strip()))
    if "none" in names and len(names) > 1:
        raise ValueError("none can't be combined with an algorithm")
    return [] if names == ["none"] else names


def distinct_sides(src: str, dst: str) -> None:
    """Two sides of a comparison must not be the same record."""
    if src.rstrip("/") == dst.rstrip("/"):
        raise ValueError(f"both sides are {src}")
