"""Paths that lead through links: what they pass on the way and where they end.

links: rel, target (a path of the same tree; null: outside it). A path is rewritten at its topmost prefix that is a link, again
and again, as a file system resolves it, until no prefix is one. Rounds read what rounds before wrote, and none of it is broadcast: each such
table would pass the driver once a join and round.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeledger.functions.cut import written
from treeledger.functions.paths import ancestors, path_key

#: Fixed value: a way of more hops has no end.
HOPS = 64


def _key(path: Column, fold: bool) -> Column:
    return path_key(path) if fold else path


def prefixes(paths: DataFrame) -> DataFrame:
    """path, depth, prefix: every path above `path`, the topmost first, and itself."""
    return paths.select("path", F.posexplode(F.concat(ancestors(F.col("path")), F.array("path"))).alias("depth", "prefix"))


def on_the_way(paths: DataFrame, links: DataFrame, fold: bool = False) -> DataFrame:
    """path, depth, prefix, via, target: the links above and at each path. fold: the disk matches ASCII case."""
    known = links.select(_key(F.col("rel"), fold).alias("key"), F.col("rel").alias("via"), "target")
    return prefixes(paths).withColumn("key", _key(F.col("prefix"), fold)).join(known.hint("merge"), "key").drop("key")


def _step(paths: DataFrame, links: DataFrame, fold: bool) -> DataFrame:
    first = on_the_way(paths, links, fold).groupBy("path").agg(F.min_by(F.struct("prefix", "via", "target"), "depth").alias("h"))
    rest = F.substring("path", F.length("h.prefix") + 1, F.length("path"))
    return paths.join(first.hint("merge"), "path", "left").select("path", F.col("h.via").alias("via"), F.concat("h.target", rest).alias("next"))


def ways(starts: DataFrame, links: DataFrame, fold: bool = False) -> DataFrame:
    """path, via, next of every path that following links from `starts` (path) comes by, each once.

    via: the topmost link above or at it, null where the way ends; next: the path with that link replaced, null if it
    leads out of the tree. Each round follows only what no round has seen, so a loop ends where it comes round; a way that
    grows with every hop ends after HOPS of them.
    """
    new = seen = written(_step(starts.where("path is not null").distinct(), links, fold))
    for _ in range(HOPS):
        ahead = new.where("next is not null").select(F.col("next").alias("path")).distinct()
        new = written(_step(ahead.join(seen.select("path").hint("merge"), "path", "left_anti"), links, fold))
        if new.isEmpty():
            break
        seen = seen.unionAll(new)
    return seen


def ends(way: DataFrame) -> DataFrame:
    """path, end, fate of every path of ways(): inside (it ends at `end`), outside, or endless.

    By pointer jumping: one row a path, twice as many hops after each round.
    """
    last = way.where("next is null").select(F.col("path").alias("at"), F.when(F.col("via").isNull(), "inside").otherwise("outside").alias("fate"))
    told = lambda rows: rows.join(last.hint("merge"), "at", "left").select("path", "at", F.coalesce("fate", F.lit("endless")).alias("fate"))
    jumps = written(told(way.select("path", F.coalesce("next", "path").alias("at"))))
    for _ in range(math.ceil(math.log2(HOPS)) + 1):
        if jumps.where("fate = 'endless'").isEmpty():
            break
        open_ = jumps.where("fate = 'endless'").select("path", F.col("at").alias("mid"))
        further = told(open_.join(jumps.select(F.col("path").alias("mid"), "at").hint("merge"), "mid", "left").select("path", F.coalesce("at", "mid").alias("at")))
        jumps = written(jumps.where("fate <> 'endless'").unionByName(further))
    return jumps.select("path", F.when(F.col("fate") == "inside", F.col("at")).alias("end"), "fate")
