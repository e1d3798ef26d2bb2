"""Whether the answers of a capture may be captured from: gates over several bodies in one order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeledger.functions.paths import path_rule
from treeledger.operators.reports import declared_mismatch
from treeledger.sources.requests import envelope

#: The one way of delivery, and the fields of the answers that are looked at.
CHUNKS = "DOWNLOAD_MODE_CHUNK"
_CONFIGS = "struct<launch_configs:array<struct<default_download_mode:string,audio_pkg_scan_dir:string>>>"
_STORE = "struct<encryption:int,compression:int>"
_BUILD = f"struct<tag:string,build_id:string,manifests:array<struct<manifest_download:{_STORE},chunk_download:{_STORE}>>>"


def _answers(bodies: DataFrame, name: str, schema: str) -> DataFrame:
    """capture, data, unread: why the answer of that name can't be read, null if it can."""
    read = envelope(bodies.where(F.col("name") == name).select(F.col("capture").alias("name"), "body"), schema)
    why = F.when(F.col("retcode").isNull(), "no answer").when(F.col("retcode") != 0, F.concat(F.lit("retcode "), F.col("retcode").cast("string"))).when(F.col("data").isNull(), "no data")
    return read.select(F.col("name").alias("capture"), "data", why.alias("unread"))


def _store(which: str, build: Column) -> Column:
    """What is wrong with the first store of a build that can't be decoded: in the order of its manifests, a manifest's own
    store before that of its chunks, encryption before compression."""
    one = lambda store, name: F.when(F.coalesce(store["encryption"], F.lit(0)) != 0, F.lit(f"{which} {name}: encrypted")).when(F.coalesce(store["compression"], F.lit(0)) != 1, F.lit(f"{which} {name}: not zstd"))
    stores = F.transform(F.coalesce(build["manifests"], F.array().cast("array<struct<manifest_download:struct<encryption:int,compression:int>,chunk_download:struct<encryption:int,compression:int>>>")), lambda m: F.coalesce(one(m["manifest_download"], "manifest_download"), one(m["chunk_download"], "chunk_download")))
    return F.get(F.filter(stores, lambda w: w.isNotNull()), F.lit(0))


def judged(captures: DataFrame, bodies: DataFrame) -> DataFrame:
    """capture, gate, refusal (null: accepted), old_build_id, new_build_id for each of captures (capture, old_tag, new_tag).

    bodies: capture, name (configs, old, new), body (JSON). Gates are asked in order, and one that an earlier gate has
    refused is not asked: is the configuration readable, is delivery by chunks, may its scan folder be joined onto an
    install, is the new build readable and that of the tag, the same of the old one, and can their stores be decoded, the new
    build's first. Ids are told of accepted captures only. Each kind of body is read once and joined by its capture.
    """
    config, old, new = (_answers(bodies, name, schema) for name, schema in (("configs", _CONFIGS), ("old", _BUILD), ("new", _BUILD)))
    named = lambda df, name: df.select("capture", F.struct(F.lit(True).alias("here"), "data", "unread").alias(name))
    rows = captures.join(named(config, "c"), "capture", "left").join(named(old, "o"), "capture", "left").join(named(new, "n"), "capture", "left")
    launch = F.get(F.col("c.data.launch_configs"), F.lit(0))
    unread = lambda side: F.when(F.col(f"{side}.here").isNull(), "absent").otherwise(F.col(f"{side}.unread"))
    mode, scan = launch["default_download_mode"], launch["audio_pkg_scan_dir"]
    other = lambda side, tag: F.when(F.col(f"{side}.data.tag").isNull(), "no tag").when(declared_mismatch(F.col(f"{side}.data.tag"), F.col(tag)), F.concat(F.lit("tag "), F.col(f"{side}.data.tag"), F.lit(" for "), F.col(tag)))
    gates = [
        ("configs", unread("c")), ("delivery", F.when(mode.isNull(), "no download mode").when(mode != CHUNKS, mode)), ("scan folder", F.when(scan.isNull(), "no scan folder").otherwise(path_rule(scan))),
        ("new build", unread("n")), ("new tag", other("n", "new_tag")), ("old build", unread("o")), ("old tag", other("o", "old_tag")), ("new store", _store("new", F.col("n.data"))), ("old store", _store("old", F.col("o.data"))),
    ]
    first = F.coalesce(*[F.when(why.isNotNull(), F.struct(F.lit(gate).alias("gate"), why.alias("refusal"))) for gate, why in gates])
    id_ = lambda side: F.when(F.col("f").isNull(), F.col(f"{side}.data.build_id"))
    return rows.withColumn("f", first).select("capture", "f.gate", "f.refusal", id_("o").alias("old_build_id"), id_("n").alias("new_build_id"))
