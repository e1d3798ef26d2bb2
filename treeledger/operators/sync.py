"""What bringing dst in step with src would do, what forbids it, and how records are refreshed. Nothing is done here.

diff is tree_diff() by exact paths, as renames come first. links: rel, target (path in dst, null: outside) of what dst
holds as links.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeledger.functions.cut import written
from treeledger.functions.globs import kept_by_filter
from treeledger.functions.paths import ancestors, path_key
from treeledger.operators.links import ends, on_the_way, ways
from treeledger.operators.trees import Trust, joined, link_above, merged, tree_diff, with_cache

#: Stages in the order of applying.
STAGES = ["FIX-DIR", "MKDIR", "DELETE", "COPY", "RMDIR"]


def _no_links(diff: DataFrame) -> DataFrame:
    return diff.sparkSession.createDataFrame([], "rel string, target string")


def _extras(diff: DataFrame, links: DataFrame) -> DataFrame:
    """Extra paths with the topmost link at or above them (null: none) and what src has at that link."""
    extra = diff.where("bucket = 'extra'").select(F.col("dst_rel").alias("rel"), F.col("dst_kind").alias("kind"))
    above = link_above(extra.select("rel"), links.select("rel"))
    at_link = diff.select(F.col("src_rel").alias("link"), F.lit(True).alias("shared"), (F.col("bucket") == "type-conflict").alias("replaced")).where("link is not null")
    return extra.join(above, "rel", "left").join(at_link, "link", "left").select("rel", "kind", "link", F.coalesce("shared", F.lit(False)).alias("shared"), F.coalesce("replaced", F.lit(False)).alias("replaced"))


def sync_plan(diff: DataFrame, links: DataFrame | None = None, missing_only: bool = False, keep_extra: bool = False) -> DataFrame:
    """stage_rank, stage, rel, because, in the order of applying.

    An extra path under a link is reached through it, so the link goes instead, unless src has it too; see
    shared_link_extras(). Directories that a copy clears out of its way are not removed once more.
    """
    links = _no_links(diff) if links is None else links
    diff = written(diff)  # each stage reads it
    stage = lambda rows, name, because=None: rows.select(F.lit(STAGES.index(name)).alias("stage_rank"), F.lit(name).alias("stage"), "rel", (because if because is not None else F.lit(None).cast("string")).alias("because"))
    src = diff.where("src_rel is not null").withColumn("rel", F.col("src_rel"))
    copied = ["missing"] if missing_only else ["missing", "changed", "type-conflict"]
    copies = src.where((F.col("src_kind") == "file") & F.col("bucket").isin(copied))
    parts = [
        stage(src.where("bucket = 'type-conflict' and src_kind = 'dir'"), "FIX-DIR"),
        stage(src.where("bucket = 'missing' and src_kind = 'dir'"), "MKDIR"),
        stage(copies, "COPY", F.col("bucket")),
    ]
    if not keep_extra:
        extras = written(_extras(diff, links))
        named = extras.where("link is not null and not shared").select(F.col("link").alias("rel")).unionAll(extras.where("link is null and kind = 'file'").select("rel")).distinct()
        wiped = copies.where("dst_kind = 'dir'").select(F.col("rel").alias("above"))
        dirs = extras.where("link is null and kind = 'dir'").select("rel")
        under = dirs.select("rel", F.explode(ancestors(F.col("rel"))).alias("above")).join(wiped, "above", "left_semi").select("rel")
        parts += [stage(named, "DELETE"), stage(dirs.join(under, "rel", "left_anti"), "RMDIR")]
    return reduce(DataFrame.unionAll, parts).orderBy("stage_rank", F.when(F.col("stage") == "RMDIR", -F.length("rel")), "rel")


def shared_link_extras(diff: DataFrame, links: DataFrame) -> DataFrame:
    """link, example: links that both sides have with extra paths below, which can't be removed without reaching through."""
    left = _extras(diff, links).where("link is not null and shared and not replaced")
    return left.groupBy("link").agg(F.min("rel").alias("example"))


def plan_summary(plan: DataFrame, renamed: int = 0, missing_only: bool = False, keep_extra: bool = False) -> DataFrame:
    """One row: the counts that end a plan's records."""
    count = lambda s, name: F.count_if(F.col("stage") == s).alias(name)
    counts = plan.agg(count("MKDIR", "mkdir"), count("COPY", "copied"), count("DELETE", "deleted"), count("RMDIR", "rmdir"))
    return counts.select(F.lit(renamed).alias("renamed"), "*", F.lit(missing_only).alias("missing_only"), F.lit(keep_extra).alias("keep_extra"))


def guards(plan: DataFrame, dst: DataFrame, links: DataFrame, shared: DataFrame | None = None, inodes: DataFrame | None = None) -> DataFrame:
    """rule, rel, at of the actions that make a plan unfit to be applied; no row: it may be.

    through-link: a link above the path that no FIX-DIR replaces. file-above: dst has a file above it that none replaces.
    shared-link: from shared_link_extras(), unless extras may stay. hard-link: a copy would truncate a file with other
    names (inodes: rel, inode, links) than those that the plan removes before it copies.
    """
    fixed = plan.where("stage = 'FIX-DIR'").select(F.col("rel").alias("at"))
    above = plan.select("rel", "stage", F.posexplode(ancestors(F.col("rel"))).alias("depth", "at"))
    linked = above.join(links.select(F.col("rel").alias("at")), "at", "left_semi").groupBy("rel").agg(F.min_by("at", "depth").alias("at"))
    through = linked.join(fixed, "at", "left_anti").select(F.lit("through-link").alias("rule"), "rel", "at")
    files = dst.where("kind = 'file'").select(F.col("rel").alias("at"))
    making = above.where(F.col("stage").isin("MKDIR", "COPY", "FIX-DIR"))
    blocked = making.join(files, "at", "left_semi").join(fixed, "at", "left_anti").groupBy("rel").agg(F.min("at").alias("at")).select(F.lit("file-above").alias("rule"), "rel", "at")
    out = through.unionByName(blocked)
    if shared is not None:
        out = out.unionByName(shared.select(F.lit("shared-link").alias("rule"), F.col("example").alias("rel"), F.col("link").alias("at")))
    if inodes is not None:
        kinds = dst.select("rel", "kind")
        known = inodes.join(kinds, "rel").where("kind = 'file'").join(links.select("rel"), "rel", "left_anti")
        going = plan.where("stage in ('DELETE', 'FIX-DIR')").join(known, "rel").groupBy("inode").agg(F.count("*").alias("going"))
        onto = plan.where("stage = 'COPY'").join(inodes.join(kinds, "rel").where("kind = 'file' and links > 1"), "rel")
        held = onto.join(going, "inode", "left").where(F.coalesce("going", F.lit(0)) < F.col("links") - 1)
        out = out.unionByName(held.select(F.lit("hard-link").alias("rule"), "rel", F.col("inode").cast("string").alias("at")))
    return out


def _kept_links(src: DataFrame, links: DataFrame) -> DataFrame:
    """The file links of dst whose path src has as a file: they stay."""
    return links.where("kind = 'file'").join(src.where("kind = 'file'").select("rel").hint("merge"), "rel", "left_semi")


def _link_ends(kept: DataFrame, links: DataFrame, fold: bool) -> DataFrame:
    """link, end, fate of the kept links that stay inside of dst for their first hop."""
    starts = kept.where("target is not null").select(F.col("rel").alias("link"), F.col("target").alias("path"))
    return starts.join(ends(ways(starts.select("path"), links, fold)).hint("merge"), "path").select("link", "end", "fate")


def spared(src: DataFrame, links: DataFrame, held: DataFrame | None = None, fold: bool = False) -> DataFrame:
    """rel, because of what must not be deleted, as a link that stays needs it.

    link: every link that a way from such a link passes, above a path or at it. alias: a path by which the way comes that
    goes on through a link above it, as the plan may name it so. storage: where the way ends. directory: what is above
    any of these. links: rel, kind, target. With fold the disk matches ASCII case, and what a link's text spells
    otherwise is named as `held` (rel: all paths of dst) spells it.
    """
    way = ways(_kept_links(src, links).select(F.col("target").alias("path")), links, fold)
    passed = on_the_way(way.select("path"), links, fold)
    at_link = passed.where("prefix = path").select("path").distinct()
    named = passed.select(F.col("via").alias("rel"), F.lit("link").alias("because"))
    named = named.unionAll(way.join(at_link.hint("merge"), "path", "left_anti").select(F.col("path").alias("rel"), F.when(F.col("via").isNull(), "storage").otherwise("alias")))
    if fold and held is not None:
        told = spelled(named.select("rel").distinct(), held)
        named = named.join(told.hint("merge"), "rel").select(F.coalesce("spelling", "rel").alias("rel"), "because")
    named = named.distinct()
    above = named.select(F.explode(ancestors(F.col("rel"))).alias("rel")).distinct().join(named.select("rel").hint("merge"), "rel", "left_anti").select("rel", F.lit("directory").alias("because"))
    return named.unionAll(above)


def sparing(plan: DataFrame, kept: DataFrame) -> DataFrame:
    """The plan without the removal of what spared() names."""
    going = F.col("stage").isin("DELETE", "RMDIR")
    return plan.where(~going).unionByName(plan.where(going).join(kept.select("rel"), "rel", "left_anti"))


def link_refusals(src: DataFrame, links: DataFrame, plan: DataFrame, fold: bool = False) -> DataFrame:
    """rule, rel, at of links that stay and make a plan unfit: endless-link (it ends nowhere), storage-replaced (its storage
    becomes a directory)."""
    found = _link_ends(_kept_links(src, links), links, fold)
    endless = found.where("fate = 'endless'").select(F.lit("endless-link").alias("rule"), F.col("link").alias("rel"), F.lit(None).cast("string").alias("at"))
    fixed = plan.where("stage = 'FIX-DIR'").select(F.col("rel").alias("end"))
    return endless.unionByName(found.join(fixed.hint("merge"), "end", "left_semi").select(F.lit("storage-replaced").alias("rule"), F.col("link").alias("rel"), F.col("end").alias("at")))


def shared_storage(src: DataFrame, links: DataFrame, plan: DataFrame, fold: bool = False) -> DataFrame:
    """storage, names: files that a plan would give two contents, as two mirrored names (kept links, or the file itself)
    end there and one of them is copied."""
    mirrored = src.where("kind = 'file'").select("rel")
    kept = _link_ends(_kept_links(src, links), links, fold).where("end is not null").select(F.col("end").alias("storage"), F.col("link").alias("name"))
    names = kept.unionAll(kept.select("storage", F.col("storage").alias("name")).distinct().join(mirrored.withColumnRenamed("rel", "name").hint("merge"), "name", "left_semi").select("storage", "name"))
    copied = plan.where("stage = 'COPY'").select(F.col("rel").alias("name"), F.lit(True).alias("copied"))
    return names.join(copied.hint("merge"), "name", "left").groupBy("storage").agg(F.count("*").alias("n"), F.coalesce(F.bool_or("copied"), F.lit(False)).alias("copied"), F.array_sort(F.collect_list("name")).alias("names")).where("n > 1 and copied").select("storage", "names")


def spelled(wanted: DataFrame, held: DataFrame) -> DataFrame:
    """rel and how `held` (rel) spells it: the same, else the one path that folds alike, else null."""
    exact = held.select("rel", F.col("rel").alias("exact"))
    alike = held.groupBy(path_key(F.col("rel")).alias("key")).agg(F.min("rel").alias("alike"))
    found = wanted.join(exact.hint("merge"), "rel", "left").join(alike.hint("merge"), path_key(F.col("rel")) == F.col("key"), "left")
    return found.select("rel", F.coalesce("exact", "alike").alias("spelling"))


def hash_plan(src: DataFrame, dst: DataFrame, trust: Trust, algos: list[str], fold: bool = False) -> DataFrame:
    """side, rel, missing: files whose pair the trusted stat fields leave open, and the digests that their side lacks."""
    s, d = F.col("s"), F.col("d")
    open_ = (s["kind"] == "file") & (d["kind"] == "file")
    for name, used in (("size", trust.size), ("mtime_ns", trust.mtime)):
        open_ = open_ & (s[name] == d[name]) if used else open_
    pairs = joined(src, dst, fold).where(open_)
    every = F.array(*map(F.lit, algos)).cast("array<string>")
    rows = pairs.select(F.explode(F.array(F.struct(F.lit("src").alias("side"), s.alias("x")), F.struct(F.lit("dst").alias("side"), d.alias("x")))).alias("p"))
    missing = F.array_except(every, F.coalesce(F.map_keys("p.x.hashes"), F.array().cast("array<string>")))
    return rows.select("p.side", "p.x.rel", missing.alias("missing")).where(F.size("missing") > 0)


def digests(content: Column, algos: list[str]) -> Column:
    """Map of the digests of a binary or text column."""
    of = {"md5": lambda c: F.unhex(F.md5(c)), "sha1": lambda c: F.unhex(F.sha1(c)), "sha256": lambda c: F.unhex(F.sha2(c, 256)), "xxhash64": lambda c: F.unhex(F.hex(F.xxhash64(c)))}
    if not algos:
        return F.create_map().cast("map<string,binary>")
    return F.create_map(*[x for a in algos for x in (F.lit(a), of[a](content))])


def updated(live: DataFrame, cache: DataFrame, contents: DataFrame, algos: list[str]) -> DataFrame:
    """A record anew: every file is read for all algorithms asked for, and what was known besides stays while the file's
    size and time are those of the record; paths that are gone fall out. contents: rel, content."""
    effective = with_cache(live, cache)
    read = contents.select("rel", digests(F.col("content"), algos).alias("computed"))
    return merged(effective.join(read, "rel", "left")).select("rel", "kind", "size", "mtime_ns", "hashes")


def record_side(record: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, fold: bool = True, own: str | None = None) -> DataFrame:
    """A record as a side of a comparison: the tool's own files and what the filter hides are never part of it.

    An exclude without wildcards, or one that ends in /** or /*, names a folder: for a comparison of exact case it is a
    prefix, and such prefixes go down to the scan of a stored record, so whole groups of its rows are passed over. Other
    globs are matched row by row.
    """
    exclude = exclude or []
    heads = [g.removesuffix("/**").removesuffix("/*") for g in exclude]
    plain = [h for h in heads if h and not set(h) & set("*?[\\")]
    side = record
    for head in [] if fold else plain:
        below = ~F.col("rel").startswith(f"{head}/")
        side = side.where(below if head not in exclude else (F.col("rel") != head) & below)
    if own:  # how the names of such files begin
        side = side.where(~F.exists(F.split("rel", "/"), lambda part: part.startswith(own)))
    return side.where(kept_by_filter(F.col("rel"), include or [], exclude, fold)) if include or exclude else side


def compare_self(record: DataFrame, live: DataFrame, contents: DataFrame, trust: Trust, algos: list[str], fold: bool = False) -> DataFrame:
    """A record against the disk that it describes, without a cache for the disk: only files of open pairs are read."""
    bare = live.withColumn("hashes", F.create_map().cast("map<string,binary>"))
    ask = hash_plan(record, bare, trust, algos, fold).where("side = 'dst'").select("rel")
    read = contents.join(ask, "rel", "left_semi").select("rel", digests(F.col("content"), algos).alias("read"))
    disk = bare.join(read, "rel", "left").withColumn("hashes", F.coalesce("read", "hashes")).drop("read")
    return tree_diff(record, disk, trust, algos, fold)
