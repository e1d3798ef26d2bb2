"""Trees of files: a stat walk with nanoseconds, directories and links, and contents by Spark's own reader."""

from __future__ import annotations

import gzip
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from treeledger.functions.cut import written

STAT_SCHEMA = "rel string, is_dir boolean, size bigint, mtime_ns bigint, is_link boolean, error string"


class _Top(InputPartition):
    """A path with all below it, or alone."""

    def __init__(self, rel: str, whole: bool, depth: int) -> None:
        self.rel, self.whole, self.depth = rel, whole, depth


class _Walk(DataSourceReader):
    """Partitions are entries of the upper levels of the tree, as many levels as it takes to have enough of them; the root
    must be mounted on all executors."""

    #: Partitions that are enough, and levels that are listed for them at most.
    ENOUGH, LEVELS = 256, 3

    def __init__(self, options: dict) -> None:
        self.root, self.follow = options["path"], options.get("followlinks", "false").lower() == "true"
        self.depth, self.skip = int(options.get("maxdepth", "64")), set(filter(None, options.get("skip", "").split(",")))
        self.own = options.get("own", "")

    def _listed(self, path: str) -> list[str]:
        """Names in a folder but those that are not of the tree: the names to skip, and the tool's own files."""
        return sorted(n for n in os.listdir(path) if n not in self.skip and not (self.own and n.startswith(self.own)))

    def partitions(self) -> list[InputPartition]:
        found = [_Top(n, True, 1) for n in self._listed(self.root)]
        for level in range(2, min(self.LEVELS, self.depth) + 1):
            if len(found) >= self.ENOUGH:
                break
            found = [t for top in found for t in self._opened(top, level)]
        return found or [_Top("", False, 0)]

    def _opened(self, top: _Top, level: int) -> list[_Top]:
        """A folder alone and its entries; a file, a link or what can't be listed stays whole."""
        path = os.path.join(self.root, top.rel)
        if not top.whole or os.path.islink(path) or not os.path.isdir(path):
            return [top]
        try:
            names = self._listed(path)
        except OSError:
            return [top]
        return [_Top(top.rel, False, top.depth), *(_Top(f"{top.rel}/{n}", True, level) for n in names)]

    def read(self, partition: _Top) -> Iterator[tuple]:
        if partition.rel:
            above = ()
            parts = partition.rel.split("/")
            for i in range(1, len(parts)):
                stat = os.stat(os.path.join(self.root, *parts[:i]))
                above = (*above, (stat.st_dev, stat.st_ino))
            rows = self._visit(partition.rel, partition.depth, above)
            yield from rows if partition.whole else [next(rows)]

    def _visit(self, rel: str, depth: int, above: tuple) -> Iterator[tuple]:
        path = os.path.join(self.root, rel)
        try:
            link = os.path.islink(path)
            stat = os.stat(path, follow_symlinks=self.follow or not link)
        except OSError as e:
            yield rel, False, 0, 0, os.path.islink(path), e.strerror
            return
        is_dir = os.path.isdir(path) and (self.follow or not link)
        if is_dir and (stat.st_dev, stat.st_ino) in above:
            yield rel, True, 0, 0, link, "loop"
            return
        yield rel, is_dir, 0 if is_dir else stat.st_size, 0 if is_dir else max(stat.st_mtime_ns, 0), link, None
        if is_dir and depth < self.depth:
            try:
                names = self._listed(path)
            except OSError as e:
                yield rel, True, 0, 0, link, e.strerror
                return
            for n in names:
                yield from self._visit(f"{rel}/{n}", depth + 1, (*above, (stat.st_dev, stat.st_ino)))


class StatTree(DataSource):
    """spark.read.format('stat_tree').load(root); options maxDepth, followLinks, skip (names), own (how the names of the
    tool's own files begin). Such names are left out at every level, with all below them."""

    @classmethod
    def name(cls) -> str:
        return "stat_tree"

    def schema(self) -> str:
        return STAT_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Walk(self.options)


def stat_tree(spark: SparkSession, root: str, **options: str) -> DataFrame:
    spark.dataSource.register(StatTree)
    return spark.read.format("stat_tree").options(**options).load(root)


def first_fault(tree: DataFrame) -> DataFrame:
    """One row, rel, error: of the entries that a walk could not read the first in the walk's order (null: none)."""
    return tree.where("error is not null").agg(F.min(F.struct(F.split("rel", "/").alias("at"), "rel", "error")).alias("f")).select("f.rel", "f.error")


def whole_tree(spark: SparkSession, root: str, **options: str) -> DataFrame:
    """A walk that stands only if all of it could be read, as half a listing would have the rest deleted: otherwise it raises
    the first fault in the walk's order, whatever task met it."""
    tree = written(stat_tree(spark, root, **options))
    fault = first_fault(tree).first()
    if fault.rel is not None:
        raise ValueError(f"walk {root}: {fault.rel}: {fault.error}")
    return tree


def contents(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """rel, length, content of the files below root; without `content` selected no bytes are read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    found = (reader.option("pathGlobFilter", glob) if glob else reader).load(root)
    base = F.lit(f"{root.rstrip('/')}/")
    path = F.regexp_replace("path", "^[a-z]+:(//[^/]*)?(?=/)", "")
    plain = F.regexp_replace(base, "^[a-z]+:(//[^/]*)?(?=/)", "")
    return found.select(F.substring(path, F.length(plain) + 1, F.length(path)).alias("rel"), "length", "content")


def inventory(files: DataFrame) -> DataFrame:
    """path, bytes, md5, sha256, encoding; gzip members are digested as what they hold."""
    @F.pandas_udf("binary")
    def inflated(column: pd.Series) -> pd.Series:
        return column.map(lambda b: gzip.decompress(b))

    packed = F.col("rel").endswith(".gz")
    body = F.when(packed, inflated(F.when(packed, F.col("content")).otherwise(F.lit(gzip.compress(b""))))).otherwise(F.col("content"))
    return files.select("rel", packed.alias("packed"), body.alias("body")).select(F.col("rel").alias("path"), F.octet_length("body").cast("long").alias("bytes"), F.md5("body").alias("md5"), F.sha2("body", 256).alias("sha256"), F.when(F.col("packed"), "gzip").otherwise("identity").alias("encoding"))
