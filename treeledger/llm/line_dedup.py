"""Lines that several documents share, in a store to which documents are added and from which they are taken again.

A store has three tables: the lines of its documents (a reference each), the exact count of references of every key with
the smallest and the largest document that holds it, and cuckoo filters, one for each shard of the keys. A filter holds a
copy of a key for its first and one for its second reference. So it tells at once which keys of new documents may be known
(only these meet the counts) and which keys may have several references (only these are looked up when lines are to
go); the counts confirm either. Taking documents out takes copies out, so the store is as if they had never been in it.

A key is the line without `[\\x20\\x09-\\x0D]` at its ends and with A-Z folded, if that has 10 code points or more; keys are
told apart by two 64-bit hashes. Counts are combined before they are shuffled, so a line that very many documents hold is
one row a task.

Defined results: a null text is empty, and an empty text is one empty line. A null doc_id counts as the largest long, so it
holds a line first only if no other document does. Rows with one doc_id are one document: they drop nothing to each
other, and each gives a row. Documents added twice count twice and go together. A long text is split in the JVM and joined
in one Python call: some five times its size is held by its task. An empty table gives no rows. Other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeledger.llm.cells import runs
from treeledger.llm.cuckoo import Cuckoo
from treeledger.llm.staging import drop, small, stage

MIN_POINTS = 10
BLANKS = " \t\n\x0b\x0c\r"
#: Keys of a shard when a store begins.
SHARD_KEYS = 1 << 16
#: What a null doc_id counts as.
LAST = (1 << 63) - 1

_KEY = ["h", "g"]
_FILTER = "shard int, table binary, stash binary, h long, copies int"


@dataclass(frozen=True)
class Store:
    """lines: h, g, d, text_id, no; counts: h, g, refs, least, most; filters: shard, table, stash."""

    shards: int
    lines: DataFrame
    counts: DataFrame
    filters: DataFrame


def _placed(docs: DataFrame) -> DataFrame:
    """docs with d and text_id, which tell a document's lines."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d"), F.xxhash64(text).alias("text_id"))


def references(docs: DataFrame) -> DataFrame:
    """h, g, d, text_id, no of every line whose key is long enough."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    lines = _placed(docs).select("d", "text_id", F.posexplode(F.split(F.translate(F.coalesce("text", F.lit("")), upper, lower), "\n", -1)).alias("no", "line"))
    keyed = lines.select("d", "text_id", "no", F.btrim("line", F.lit(BLANKS)).alias("key")).where(F.char_length("key") >= MIN_POINTS)
    return keyed.select(F.xxhash64("key").alias("h"), F.xxhash64(F.lit("second"), "key").alias("g"), "d", "text_id", "no")


def _counted(lines: DataFrame) -> DataFrame:
    return lines.groupBy(*_KEY).agg(F.count("*").alias("refs"), F.min("d").alias("least"), F.max("d").alias("most"))


def _by_shard(filters: DataFrame | None, keys: DataFrame, shards: int) -> DataFrame:
    """Each shard's filter (first) and the keys (h and more) that belong to it, in order of shards."""
    keys = keys.withColumn("shard", F.pmod("h", F.lit(shards)).cast("int"))
    rows = keys if filters is None else filters.unionByName(keys, allowMissingColumns=True)
    return rows.repartition("shard").sortWithinPartitions("shard", F.col("h").asc_nulls_first())


def _parts(shard: pa.Table) -> tuple[Cuckoo | None, pa.Table]:
    """The filter of a shard, if there is one, and its keys."""
    if "table" in shard.column_names and shard["table"][0].is_valid:
        return Cuckoo.read(shard["table"][0].as_py(), shard["stash"][0].as_py()), shard.slice(1)
    return None, shard


def _changed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Filters after the references of their keys have gone from `before` to `after`. Where a filter would be crowded,
    nothing but its shard and the copies that it must have room for is told (table null): it is built anew."""
    for shard in runs(batches, "shard"):
        number = shard["shard"][0].as_py()
        held, keys = _parts(shard)
        h, before, after = (np.asarray(keys[c]) for c in ("h", "before", "after"))
        more = np.minimum(after, 2) - np.minimum(before, 2)
        if held is None:
            held = Cuckoo.sized(int(more.sum()))
        if held.crowded(int(more.sum())):
            yield _rows(number, None, None, held.copies + int(more.sum()))
            continue
        held.delete(np.repeat(h, np.maximum(-more, 0)))
        held.insert(np.repeat(h, np.maximum(more, 0)))
        yield _rows(number, *held.written(), held.copies)


def _rows(shard: int, table: bytes | None, stash: bytes | None, copies: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([table], pa.binary()), pa.array([stash], pa.binary()), pa.array([None], pa.int64()), pa.array([copies], pa.int32())], names=["shard", "table", "stash", "h", "copies"])


def _probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The copies that a shard's filter has of its keys."""
    for shard in runs(batches, "shard"):
        held, keys = _parts(shard)
        h = np.asarray(keys["h"])
        n = held.count(h) if held else np.zeros(len(h), int)
        yield pa.RecordBatch.from_arrays([pa.array(h[n > 0]), pa.array(n[n > 0].astype(np.int32))], names=["h", "copies"])


def _filters(filters: DataFrame | None, changes: DataFrame, counts: DataFrame, shards: int) -> DataFrame:
    """The filters after changes (h, before, after); counts are those after them."""
    # a shard without a change keeps its filter
    rows = _by_shard(filters, changes.select("h", F.col("before").cast("int"), F.col("after").cast("int")), shards)
    told = stage(rows.mapInArrow(_changed, _FILTER), "filters")
    crowded = told.where("table is null").select("shard")
    if crowded.isEmpty():
        return told.select("shard", "table", "stash")
    anew = counts.select("h", F.lit(0).alias("before"), F.least("refs", F.lit(2)).cast("int").alias("after"), F.pmod("h", F.lit(shards)).cast("int").alias("shard")).join(small(crowded), "shard", "left_semi")
    built = stage(_by_shard(None, anew, shards).mapInArrow(_changed, _FILTER), "built")
    return told.where("table is not null").unionByName(built).select("shard", "table", "stash")


def _maybe(filters: DataFrame, keys: DataFrame, shards: int) -> DataFrame:
    """h, copies of the keys that the filters know."""
    return _by_shard(filters, keys.select("h").distinct(), shards).mapInArrow(_probed, "h long, copies int")


def opened(docs: DataFrame, shard_keys: int = SHARD_KEYS) -> Store:
    """A store of documents (doc_id, text)."""
    lines = stage(references(docs), "lines")
    counts = stage(_counted(lines), "counts")
    shards = max(1, -(-counts.count() // shard_keys))
    changes = counts.select("h", F.lit(0).alias("before"), F.least("refs", F.lit(2)).alias("after"))
    return Store(shards, lines, counts, _filters(None, changes, counts, shards))


def added(store: Store, docs: DataFrame) -> Store:
    """The store with more documents. Only keys that a filter may know meet the counts."""
    lines = stage(references(docs), "lines")
    new = stage(_counted(lines), "new")
    maybe = _maybe(store.filters, new, store.shards).select("h")
    known = stage(store.counts.join(new.join(maybe, "h", "left_semi").select(*_KEY), _KEY, "left_semi"), "known")
    old = known.select(*_KEY, F.col("refs").alias("before"), F.col("least").alias("least0"), F.col("most").alias("most0"))
    after = stage(new.join(old, _KEY, "left").select(*_KEY, F.coalesce("before", F.lit(0)).alias("before"), (F.col("refs") + F.coalesce("before", F.lit(0))).alias("refs"), F.least("least", "least0").alias("least"), F.greatest("most", "most0").alias("most")), "after")
    counts = stage(store.counts.join(known, _KEY, "left_anti").unionByName(after.drop("before")), "counts")
    changes = after.select("h", F.least("before", F.lit(2)).alias("before"), F.least("refs", F.lit(2)).alias("after"))
    return Store(store.shards, store.lines.unionByName(lines), counts, _filters(store.filters, changes, counts, store.shards))


def removed(store: Store, ids: DataFrame) -> Store:
    """The store without the documents of ids (doc_id): references, counts and copies in the filters go."""
    ids = ids.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d")).distinct()
    touched = stage(_counted(store.lines.join(ids, "d", "left_semi")).select(*_KEY, F.col("refs").alias("gone")), "touched")
    lines = stage(store.lines.join(ids, "d", "left_anti").select(*store.lines.columns), "lines")
    left = _counted(lines.join(touched.select(*_KEY), _KEY, "left_semi"))
    after = stage(left, "after")
    counts = stage(store.counts.join(touched, _KEY, "left_anti").unionByName(after), "counts")
    changes = store.counts.join(touched, _KEY).join(after.select(*_KEY, F.col("refs").alias("rest")), _KEY, "left").select("h", F.least("refs", F.lit(2)).alias("before"), F.least(F.coalesce("rest", F.lit(0)), F.lit(2)).alias("after"))
    return Store(store.shards, lines, counts, _filters(store.filters, changes, counts, store.shards))


def shared_keys(store: Store) -> DataFrame:
    """h, g, least of the keys that two documents hold or more: those of which a filter has two copies, confirmed by the
    counts."""
    twice = _maybe(store.filters, store.counts, store.shards).where("copies > 1").select("h")
    return store.counts.where("least < most").join(twice, "h", "left_semi").select(*_KEY, "least")


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text, places of lines that go -> doc_id, n_lines, n_dropped, text of the other lines."""
    for batch in batches:
        n_lines, n_dropped, texts = [], [], []
        for text, places in zip(batch.column("text"), batch.column("places"), strict=True):
            lines = (text.as_py() or "").split("\n")
            n_lines.append(len(lines))
            going = places.as_py() or ()
            n_dropped.append(len(going))
            for place in going:
                lines[place] = None
            texts.append("\n".join(x for x in lines if x is not None) if going else "\n".join(lines))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "n_lines", "n_dropped", "text"])


def without_shared_lines(docs: DataFrame, store: Store | None = None) -> DataFrame:
    """doc_id, n_lines, n_dropped, text for every row of docs (doc_id, text): a line whose key an earlier document of the store
    holds too is dropped. store: of docs, and of more documents perhaps; that of docs alone unless given."""
    store = store or opened(docs)
    shared = stage(shared_keys(store), "shared")
    going = store.lines.join(small(shared), _KEY).where("d > least").groupBy("d", "text_id").agg(F.collect_set("no").alias("places"))
    going = stage(going, "going")
    drop(shared)
    rows = _placed(docs).join(going, ["d", "text_id"], "left").select("doc_id", "text", "places")
    kind = dict(docs.dtypes)["doc_id"]
    return rows.mapInArrow(_without, f"doc_id {kind}, n_lines long, n_dropped long, text string")
