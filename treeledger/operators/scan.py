"""Which chunks of a build are where they belong on disk, which could be copied from elsewhere, and what is left to fetch."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeledger.functions.totals import saturating_sum, slice_matches
from treeledger.operators.repair import file_verdicts

#: Bytes that a file scan reads at once.
READ = 1 << 20


def fingerprint(chunks: DataFrame) -> DataFrame:
    """One row, plan: a number for a plan's files and chunks, in which their order of rows doesn't matter."""
    one = F.xxhash64("rel", "id", "uncompressed_md5", "offset", "compressed_size", "uncompressed_size")
    return chunks.agg(F.hex(F.xxhash64(F.count("*"), F.sum(one.cast("decimal(38,0)")), F.sum(F.xxhash64(one).cast("decimal(38,0)")))).alias("plan"))


def _range(offset: Column) -> Column:
    return F.struct(F.greatest(offset, F.lit(0)).cast("long").alias("offset"), F.greatest(F.col("uncompressed_size"), F.lit(0)).cast("long").alias("length"), F.col("uncompressed_md5").alias("md5"))


def ranges(chunks: DataFrame) -> DataFrame:
    """rel, asked of each file: a list of struct(cpos, dest, source), the ranges of its chunks. A chunk without a source has
    none there."""
    source = F.when(F.col("source").isNotNull(), _range(F.col("source")))
    return chunks.groupBy("rel").agg(F.collect_list(F.struct("cpos", _range(F.col("offset")).alias("dest"), source.alias("source"))).alias("asked"))


def deep_scan(chunks: DataFrame, disk: DataFrame, whole: bool = False) -> DataFrame:
    """rel, cpos, dest_ok, source_ok of each chunk (rel, cpos, offset, uncompressed_size, uncompressed_md5, source).

    disk: rel, content. A file that isn't there has nothing right; a range past its end is wrong. Each file's content
    meets the list of its ranges once. whole: also length and found, the size and the digest of the file (null: it isn't
    there), from the same read. Files too large for a row: scan_files(), scan_pieces().
    """
    met = ranges(chunks).join(disk.select("rel", "content"), "rel", "left")
    ok = lambda r: slice_matches(F.col("content"), r)
    judged = F.transform("asked", lambda r: F.struct(r["cpos"].alias("cpos"), ok(r["dest"]).alias("dest_ok"), ok(r["source"]).alias("source_ok")))
    file = [F.octet_length("content").cast("long").alias("length"), F.md5("content").alias("found")] if whole else []
    return _verdicts(met.select("rel", judged.alias("judged"), *file))


def _verdicts(seen: DataFrame) -> DataFrame:
    """rel, judged (structs), more of the file -> a row a chunk."""
    file = [c for c in seen.columns if c not in ("rel", "judged")]
    return seen.select("rel", F.explode("judged").alias("p"), *file).select("rel", "p.*", *file)


def _swept(rows: DataFrame, chunks: DataFrame, run, whole: bool) -> DataFrame:
    """What the sweeps of run told; their chunks keep the type of cpos."""
    kind = dict(chunks.dtypes)["cpos"]
    told = rows.mapInArrow(run, _SWEPT)
    told = told if whole else told.drop("length", "found")
    return _verdicts(told).withColumn("cpos", F.col("cpos").cast(kind))


def scan_files(chunks: DataFrame, root: str, whole: bool = False) -> DataFrame:
    """The same over files below root, a folder that all executors see: each is read once, READ bytes at a time, and all
    its ranges (and, with whole, the file) are digested as they pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sweep = _Sweep(row["rel"], row["asked"], whole)
                try:
                    with open(os.path.join(root, row["rel"]), "rb") as f:
                        while (at := sweep.needed()) is not None:
                            if at > sweep.at:
                                sweep.at = min(at, os.fstat(f.fileno()).st_size)
                                f.seek(sweep.at)
                            if not (data := f.read(READ)):
                                break
                            sweep.feed(data)
                    yield sweep.done()
                except OSError:
                    yield _Sweep(row["rel"], row["asked"], whole).lost()

    return _swept(ranges(chunks), chunks, run, whole)


def scan_pieces(chunks: DataFrame, pieces: DataFrame, whole: bool = False) -> DataFrame:
    """The same over files in pieces (rel, offset, content) of any size, such as rows of a table: a file's pieces pass one task
    in their order, and what is open at the end of one goes on with the next. A file with a hole or an overlap between its
    pieces isn't there."""
    asked = ranges(chunks)
    none = [F.lit(None).cast(t).alias(c) for c, t in (("offset", "long"), ("content", "binary"))]
    rows = asked.select("rel", "asked", *none).unionByName(pieces.select("rel", F.col("offset").cast("long").alias("offset"), F.col("content").cast("binary").alias("content")), allowMissingColumns=True)
    ordered = rows.repartition("rel").sortWithinPartitions("rel", F.col("offset").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep, rel, torn = None, None, True
        for batch in batches:
            for i in range(batch.num_rows):
                name, offset, content = (batch.column(c)[i].as_py() for c in ("rel", "offset", "content"))
                if name != rel:
                    if sweep:
                        yield sweep.lost() if torn else sweep.done()
                    sweep, rel, torn = None, name, True
                if content is None and offset is None:
                    sweep = _Sweep(name, batch.column("asked")[i].as_py(), whole)
                elif sweep:
                    torn = offset != sweep.at or torn and sweep.at > 0
                    if not torn:
                        sweep.feed(content)
        if sweep:
            yield sweep.lost() if torn else sweep.done()

    return _swept(ordered, chunks, run, whole)


_SWEPT = "rel string, judged array<struct<cpos:long,dest_ok:boolean,source_ok:boolean>>, length long, found string"


class _Sweep:
    """Digests of a file's ranges, and of the file, as its bytes pass; equal ranges are digested once."""

    def __init__(self, rel: str, asked: list[dict], whole: bool) -> None:
        self.rel, self.asked = rel, asked
        self.kinds = sorted({self._kind(r[side]) for r in asked for side in ("dest", "source") if r[side]})
        self.turn, self.at, self.open, self.right = 0, 0, [], set()
        self.md5 = hashlib.md5() if whole else None

    @staticmethod
    def _kind(wanted: dict) -> tuple[int, int, str]:
        return wanted["offset"], wanted["length"], (wanted["md5"] or "").lower()

    def needed(self) -> int | None:
        """The place of the next byte that anything is asked of; null if there is none."""
        if self.md5 or self.open:
            return self.at
        return max(self.at, self.kinds[self.turn][0]) if self.turn < len(self.kinds) else None

    def feed(self, data: bytes) -> None:
        if self.md5:
            self.md5.update(data)
        end = self.at + len(data)
        while self.turn < len(self.kinds) and self.kinds[self.turn][0] < end:
            self.open.append((self.kinds[self.turn], hashlib.md5()))
            self.turn += 1
        still = []
        for kind, digest in self.open:
            digest.update(data[max(0, kind[0] - self.at) : max(0, kind[0] + kind[1] - self.at)])
            if kind[0] + kind[1] > end:
                still.append((kind, digest))
            elif digest.hexdigest() == kind[2]:
                self.right.add(kind)
        self.open, self.at = still, end

    def done(self) -> pa.RecordBatch:
        """What the file holds, now that it has ended."""
        self.right |= {k for k in self.kinds[self.turn :] if k[:2] == (self.at, 0) and k[2] == hashlib.md5().hexdigest()}
        return self._told(self.at if self.md5 else None, self.md5.hexdigest() if self.md5 else None)

    def lost(self) -> pa.RecordBatch:
        self.right = set()
        return self._told(None, None)

    def _told(self, length: int | None, found: str | None) -> pa.RecordBatch:
        ok = lambda r: bool(r) and self._kind(r) in self.right
        judged = [{"cpos": r["cpos"], "dest_ok": ok(r["dest"]), "source_ok": ok(r["source"])} for r in self.asked]
        kind = pa.list_(pa.struct([("cpos", pa.int64()), ("dest_ok", pa.bool_()), ("source_ok", pa.bool_())]))
        return pa.RecordBatch.from_arrays([pa.array([self.rel]), pa.array([judged], kind), pa.array([length], pa.int64()), pa.array([found], pa.string())], names=["rel", "judged", "length", "found"])


def integrity_of(scanned: DataFrame, plan: DataFrame) -> DataFrame:
    """integrity() of plan (rel, size, md5) by what a whole scan saw of its files, without another read."""
    seen = scanned.groupBy("rel").agg(F.first("length").alias("length"), F.first("found").alias("found"))
    return file_verdicts(plan.join(seen, "rel", "left"))


def same_plan(verdicts: DataFrame, scanned: DataFrame, plan: DataFrame) -> DataFrame:
    """Verdicts of a scan whose plan (one row, plan) is the plan at hand; of another, none."""
    return verdicts.crossJoin(scanned.select(F.col("plan").alias("_scanned"))).crossJoin(plan.select(F.col("plan").alias("_plan"))).where("_scanned = _plan").drop("_scanned", "_plan")


def damage(verdicts: DataFrame) -> DataFrame:
    """Per file: chunks, damaged ones, and how many have an intact source."""
    return verdicts.groupBy("rel").agg(F.count("*").alias("chunks"), F.count_if(~F.col("dest_ok")).alias("damaged"), F.count_if("source_ok").alias("sources"))


def download_after_scan(chunks: DataFrame, verdicts: DataFrame, modes: DataFrame) -> DataFrame:
    """rel, est_download: bytes to fetch for each file. modes: rel, mode.

    discard, and a file without verdicts: all chunks. temp: those without an intact source. in_place: the bad ones that
    the better order of writing doesn't salvage (a source at or behind its place survives writing upwards, one at or
    before it writing downwards; a tie: upwards).
    """
    full = chunks.join(modes, "rel", "left").join(verdicts, ["rel", "cpos"], "left")
    bad = ~F.col("dest_ok")
    fits = bad & F.col("source_ok") & F.col("source").isNotNull()
    up, down = fits & (F.col("source") >= F.col("offset")), fits & (F.col("source") <= F.col("offset"))
    cost = F.col("compressed_size")
    sums = full.groupBy("rel").agg(
        F.max("mode").alias("mode"), F.bool_and(F.col("dest_ok").isNotNull()).alias("scanned"), saturating_sum(cost).alias("all_"), saturating_sum(F.when(~F.col("source_ok"), cost)).alias("temp"),
        F.count_if(up).alias("n_up"), F.count_if(down).alias("n_down"), saturating_sum(F.when(bad & ~F.coalesce(up, F.lit(False)), cost)).alias("up"), saturating_sum(F.when(bad & ~F.coalesce(down, F.lit(False)), cost)).alias("down"),
    )
    chosen = F.when((F.col("mode") == "discard") | ~F.col("scanned"), F.col("all_")).when(F.col("mode") == "temp", F.col("temp")).when(F.col("n_down") > F.col("n_up"), F.col("down")).otherwise(F.col("up"))
    return sums.select("rel", chosen.cast("long").alias("est_download"))
