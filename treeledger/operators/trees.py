"""Two file trees, or a tree and its cache, compared by stat and digests.

A side is a relation rel, kind ('file' or 'dir'), size, mtime_ns, hashes map<string, binary>. mtime_ns stays a long: a
timestamp would round it. A digest that one side lacks says nothing, neither equal nor different.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeledger.functions.cut import written
from treeledger.functions.paths import ancestors, path_key


@dataclass(frozen=True)
class Trust:
    """Which stat fields may settle a pair."""

    size: bool = True
    mtime: bool = True


def keyed(side: DataFrame, fold: bool) -> DataFrame:
    return side.withColumn("key", path_key(F.col("rel")) if fold else F.col("rel"))


def mixed_case(side: DataFrame) -> DataFrame:
    """Spellings of one side that fold alike; any such row is an error of that side."""
    return side.groupBy(path_key(F.col("rel")).alias("key")).agg(F.array_sort(F.collect_set("rel")).alias("spellings")).where(F.size("spellings") > 1)


def joined(src: DataFrame, dst: DataFrame, fold: bool = False) -> DataFrame:
    """Full outer join of the sides: key, s and d (structs, null where a side has no such path)."""
    whole = lambda df, name: keyed(df, fold).select("key", F.struct("rel", "kind", "size", "mtime_ns", "hashes").alias(name))
    return whole(src, "s").join(whole(dst, "d"), "key", "full_outer")


def _differing(s: Column, d: Column, trusted: Trust, value: bool) -> Column:
    """Names of the stat fields that differ and whose trust is `value`."""
    fields = [F.when(s[c] != d[c], n) for c, n, t in (("size", "size", trusted.size), ("mtime_ns", "mtime", trusted.mtime)) if t is value]
    return F.array_compact(F.array(*fields)) if fields else F.array().cast("array<string>")


def verdict(s: Column, d: Column, trust: Trust, required: Column) -> Column:
    """Tag of a pair of one path: kind first, trusted stat, digests, untrusted stat. required: algorithms that decide."""
    trusted, untrusted = _differing(s, d, trust, True), _differing(s, d, trust, False)
    differing = F.filter(required, lambda a: F.coalesce(s["hashes"][a] != d["hashes"][a], F.lit(False)))
    plus = lambda xs: F.array_join(xs, "+")
    return (
        F.when(s["kind"] == "dir", "dir-present")
        .when(F.size(trusted) > 0, plus(F.transform(trusted, lambda f: F.concat(F.lit("stat-"), f))))
        .when(F.size(differing) > 0, F.concat(F.lit("digest-differs:"), plus(differing)))
        .when(F.size(required) > 0, F.concat(F.lit("digest-matches:"), plus(required)))
        .when(F.size(untrusted) > 0, F.concat(F.lit("unverifiable:"), plus(untrusted)))
        .otherwise("stat-match")
    )


def tree_diff(src: DataFrame, dst: DataFrame, trust: Trust | None = None, algos: list[str] | None = None, fold: bool = False) -> DataFrame:
    """bucket, src_rel, dst_rel, tag, case_mismatch, src_kind, dst_kind for every path of either side.

    A pair in two spellings is a case mismatch and has its own bucket besides.
    """
    s, d = F.col("s"), F.col("d")
    tag = F.when(s.isNotNull() & d.isNotNull() & (s["kind"] == d["kind"]), verdict(s, d, trust or Trust(), F.array(*map(F.lit, algos or [])).cast("array<string>")))
    same = tag.isin("dir-present", "stat-match") | tag.startswith("digest-matches")
    bucket = (
        F.when(d.isNull(), "missing").when(s.isNull(), "extra").when(s["kind"] != d["kind"], "type-conflict")
        .when(~same, "changed").otherwise("identical")
    )
    return joined(src, dst, fold).select(bucket.alias("bucket"), s["rel"].alias("src_rel"), d["rel"].alias("dst_rel"), tag.alias("tag"), F.coalesce(s["rel"] != d["rel"], F.lit(False)).alias("case_mismatch"), s["kind"].alias("src_kind"), d["kind"].alias("dst_kind"))


def diff_summary(diff: DataFrame) -> DataFrame:
    """Counts by bucket; `total` leaves case mismatches out, `in_step` does not."""
    count = lambda b: F.count_if(F.col("bucket") == b).alias(b.replace("-", "_"))
    row = diff.agg(*map(count, ("missing", "extra", "changed", "type-conflict")), F.count_if("case_mismatch").alias("case_mismatch"), count("identical"))
    total = F.col("missing") + F.col("extra") + F.col("changed") + F.col("type_conflict")
    return row.withColumn("total", total).withColumn("in_step", (total + F.col("case_mismatch")) == 0)


def case_renames(src: DataFrame, dst: DataFrame) -> DataFrame:
    """Paths that both sides hold in different spellings."""
    side = lambda df, name: df.select(path_key(F.col("rel")).alias("key"), F.col("rel").alias(name))
    return side(src, "src_rel").join(side(dst, "dst_rel"), "key").where("src_rel <> dst_rel").select("src_rel", "dst_rel")


def with_cache(live: DataFrame, cache: DataFrame, fold: bool = False) -> DataFrame:
    """live with `cached` digests and `fresh`: the cached row is a file of equal size and mtime.

    With fold, a cached spelling that is alone in its group and not on disk is taken over.
    """
    c = cache.select(F.col("rel").alias("c_rel"), F.struct(F.col("kind"), F.col("size"), F.col("mtime_ns"), F.col("hashes")).alias("c"))
    out = live.join(c, F.col("rel") == F.col("c_rel"), "left").drop("c_rel")
    if fold:
        stale = c.join(live.select("rel"), F.col("c_rel") == F.col("rel"), "left_anti")
        alone = stale.groupBy(path_key(F.col("c_rel")).alias("k")).agg(F.count("*").alias("n"), F.first("c").alias("other")).where("n = 1").select("k", "other")
        out = out.join(alone, path_key(F.col("rel")) == F.col("k"), "left").withColumn("c", F.coalesce("c", "other")).drop("k", "other")
    fresh = (F.col("kind") == "file") & (F.col("c.kind") == "file") & (F.col("c.size") == F.col("size")) & (F.col("c.mtime_ns") == F.col("mtime_ns"))
    return out.select("rel", "kind", "size", "mtime_ns", F.col("c.hashes").alias("cached"), F.coalesce(fresh, F.lit(False)).alias("fresh"))


def merged(effective: DataFrame) -> DataFrame:
    """effective (rel, fresh, cached, computed): computed digests win; cached ones stay only while fresh."""
    empty = F.create_map().cast("map<string,binary>")
    old = F.when(F.col("fresh"), F.coalesce("cached", empty)).otherwise(empty)
    new = F.coalesce("computed", empty)
    kept = F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k))
    return effective.withColumn("hashes", F.map_concat(kept, new))


def stale(cache: DataFrame, live: DataFrame) -> DataFrame:
    """Cached rows of paths that are gone."""
    return cache.join(live.select("rel"), "rel", "left_anti")


def scan_stats(effective: DataFrame, pruned: DataFrame | None = None) -> DataFrame:
    """One row: what a scan saw and what it had to read. With a column `computed` (digests that were read) also how many
    files were hashed and how many were judged by stat alone; with the stale rows of the cache also how many were pruned."""
    file = F.col("kind") == "file"
    counts = [F.count("*").alias("live"), F.count_if(file).alias("files"), F.count_if(F.col("kind") == "dir").alias("dirs"), F.count_if("fresh").alias("cache_hit"), F.count_if(file & ~F.col("fresh")).alias("undecided")]
    if "computed" in effective.columns:
        read = F.coalesce(F.size(F.map_keys("computed")) > 0, F.lit(False))
        counts += [F.count_if(file & read).alias("hashed"), F.count_if(file & ~read & ~F.col("fresh")).alias("stat_only")]
    out = effective.agg(*counts)
    return out if pruned is None else out.crossJoin(pruned.agg(F.count("*").alias("pruned")))  # one row each


def coverage(sides: DataFrame, algos: list[str]) -> DataFrame:
    """sides (side, kind, cached, fresh): for each side and algorithm how many files have a usable digest."""
    files = sides.where("kind = 'file'").select("side", "cached", "fresh", F.explode(F.array(*map(F.lit, algos))).alias("algo"))
    has = F.col("fresh") & F.coalesce(F.map_contains_key("cached", F.col("algo")), F.lit(False))
    return files.groupBy("side", "algo").agg(F.count_if(has).alias("have"), F.count_if(~has).alias("undecided"))


def any_of(src: Column, dst: Column, algos: list[str]) -> Column:
    """The algorithm that fewest sides still have to compute, the first asked for on a tie."""
    missing = lambda a: F.when(F.coalesce(F.array_contains(src, a), F.lit(False)), 0).otherwise(1) + F.when(F.coalesce(F.array_contains(dst, a), F.lit(False)), 0).otherwise(1)
    return F.array_min(F.array(*[F.struct(missing(F.lit(a)).alias("missing"), F.lit(i).alias("place"), F.lit(a).alias("algo")) for i, a in enumerate(algos)]))["algo"]


def pulled_in(live: DataFrame, kept: Column) -> DataFrame:
    """Rows that are kept, and the directories above kept files."""
    chosen = live.where(kept)
    above = chosen.where("kind = 'file'").select(F.explode(ancestors(F.col("rel"))).alias("dir")).distinct()
    dirs = live.where((F.col("kind") == "dir") & ~F.coalesce(kept, F.lit(False))).join(above, F.col("rel") == F.col("dir"), "left_semi")
    return chosen.unionAll(dirs)


def link_above(paths: DataFrame, links: DataFrame) -> DataFrame:
    """rel and the topmost prefix of it that is a link."""
    prefixes = paths.select("rel", F.posexplode(F.concat(ancestors(F.col("rel")), F.array("rel"))).alias("depth", "prefix"))
    hit = prefixes.join(links.select(F.col("rel").alias("prefix")), "prefix")
    return hit.groupBy("rel").agg(F.min_by("prefix", "depth").alias("link"))


def rename_steps(renames: DataFrame) -> DataFrame:
    """Renames (src_rel, dst_rel) parents first; `from_rel` is where the source lies once its renamed parents have moved."""
    up = renames.select(F.col("dst_rel").alias("old"), F.col("src_rel").alias("new"))
    prefixes = renames.select("src_rel", "dst_rel", F.explode(ancestors(F.col("dst_rel"))).alias("old"))
    longest = prefixes.join(up, "old").groupBy("src_rel", "dst_rel").agg(F.max_by(F.struct("old", "new"), F.length("old")).alias("p"))
    out = renames.join(longest, ["src_rel", "dst_rel"], "left")
    moved = F.concat(F.col("p.new"), F.substring("dst_rel", F.length("p.old") + 1, F.length("dst_rel")))
    return out.select("src_rel", "dst_rel", F.coalesce(moved, "dst_rel").alias("from_rel"), F.size(F.split("dst_rel", "/")).alias("depth")).orderBy("depth", "dst_rel")


def link_closure(edges: DataFrame) -> DataFrame:
    """All (link, target) pairs that following links reaches; a loop ends where it comes round.

    What is reached is joined with itself, so a chain of n links takes log n rounds; it ends when a round finds nothing.
    """
    reach = written(edges.select("link", "target").distinct())
    while True:
        further = reach.alias("a").join(reach.alias("b"), F.col("a.target") == F.col("b.link")).select("a.link", "b.target").distinct()
        new = written(further.join(reach, ["link", "target"], "left_anti"))
        if new.isEmpty():
            return reach
        reach = written(reach.unionAll(new))


def first_by_group(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """rows with `ordinal`: 0, 1, ... inside each group."""
    return rows.withColumn("ordinal", F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1)
