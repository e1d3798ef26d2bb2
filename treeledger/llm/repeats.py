"""Removal of passages that an earlier document holds too, byte for byte, by suffix arrays over a partitioned corpus.

A string of `length` bytes belongs to the partition of its minimiser: the least hash of the SEED-byte strings
inside it, which depends on its bytes alone. So equal strings meet. Runs of start places with one minimiser
travel as one substring, and only minimisers that two documents share travel at all. Each partition
sorts the suffixes of its distinct substrings that begin such a string, over its length, and equal neighbours in that order
tell the smallest doc_id that holds each string. Occurrences stay out of that: they are rows of their own that are
joined to the answers, so a passage that very many documents hold is a skewed join, which Spark splits.

Defined results: a null text is empty. A row without doc_id comes after all others. Rows with the same doc_id do not
take from each other, whether their texts are equal or not. A very long text is cut like any other. Other columns of
the input are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeledger.llm.staging import drop, small, stage
from treeledger.llm.suffix_array import sorted_strings
from treeledger.llm.text import mix, passes, spans_hash

LENGTH, SEED = 50, 16
#: Text of the corpus for each partition of minimisers.
PARTITION_BYTES = 5_000_000
#: Different runs (of each pass over the texts) beyond which those of a minimiser are cut into single strings that are dealt
#: by themselves: so many are a partition's worth of text.
CROWDED = PARTITION_BYTES // (2 * LENGTH - SEED)
FEW = 8
#: Places, and substrings, that are worked on at once: what that takes is small beside the texts of a pass.
BLOCK = 1 << 16
LAST = (1 << 63) - 1
_EMPTY = hashlib.sha256(b"").hexdigest()


def _minimisers(data: np.ndarray, window: int) -> np.ndarray:
    """The least hash of each `window` strings of SEED bytes that follow each other."""
    eights = np.ndarray(len(data) - 7, "<u8", np.ascontiguousarray(data), strides=(1,)).astype(np.uint64)
    x = mix(eights[:-8] * np.uint64(0x9E3779B97F4A7C15) + eights[8:] * np.uint64(0xC2B2AE3D27D4EB4F))
    span = 1
    while 2 * span <= window:
        x = np.minimum(x[: len(x) - span], x[span:])
        span *= 2
    n = len(data) - SEED - window + 2
    return np.minimum(x[:n], x[window - span : window - span + n])


def _runs(data: np.ndarray, offsets: np.ndarray, length: int):
    """Runs of start places with the same minimiser: text, first place in it, number of places, minimiser."""
    window = length - SEED + 1
    n = len(data) - length + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    x = np.empty(n, np.uint64)
    for at in range(0, n, BLOCK):
        x[at : at + BLOCK] = _minimisers(data[at : at + BLOCK + length - 1], window)
    # places of strings that lie inside one text, which ends with a line feed; at least one place is between two texts'
    many = np.diff(offsets) - length
    stop = np.where(many > 0, offsets[:-1] + many, 0)
    edge = np.empty(n + 1, bool)
    np.not_equal(x[1:], x[:-1], out=edge[1:n])
    edge[offsets[:-1][many > 0]] = edge[stop] = edge[[0, n]] = True
    first = np.flatnonzero(edge)
    text = np.searchsorted(offsets, first[:-1], side="right") - 1
    inside = np.flatnonzero(first[:-1] < stop[text])
    count = (first[1:] - first[:-1])[inside]
    first, text = first[inside], text[inside]
    value = x[first]
    if len(count) and count.max() > window:  # periodic text: a long run is cut
        parts = -(-count // window)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first, count = np.repeat(first, parts) + nth * window, np.repeat(count, parts) - nth * window
        count, text, value = np.minimum(count, window), np.repeat(text, parts), np.repeat(value, parts)
    return text, first - offsets[text], count, value


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _slices(first: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Begin and end of groups that begin at `first`."""
    first = first.tolist()
    return list(zip(first, [*first[1:], n], strict=True)) if first else []


def _held(length: int):
    """id, tag, text -> value, low, high, n: each minimiser of some texts, the least and the greatest id that has it, and how
    many different runs do: as many of its substrings travel from here, however many places have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(_column(batch, "id"))
            for row, data, offsets in passes(_column(batch, "text")):
                text, place, count, value = _runs(data, offsets, length)
                order = np.argsort(value)
                text, place, count, value = (x[order] for x in (text, place, count, value))
                own = ids[row + text]
                first = np.flatnonzero(np.append(True, value[1:] != value[:-1])[: len(value)])
                if not len(first):
                    continue
                runs = np.diff(np.append(first, len(value)))
                group = np.repeat(np.arange(len(first)), runs)
                several = np.flatnonzero(runs[group] > FEW)
                begin = offsets[text[several]] + place[several]
                sub = spans_hash(data, begin, begin + count[several] + length - 1)
                turn = np.lexsort((sub, group[several]))
                again = (group[several][turn][1:] == group[several][turn][:-1]) & (sub[turn][1:] == sub[turn][:-1])
                n = runs - np.bincount(group[several][turn][1:][again], minlength=len(first))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(value[first].view(np.int64)), pa.array(np.minimum.reduceat(own, first)), pa.array(np.maximum.reduceat(own, first)), pa.array(n.astype(np.int64))],
                    names=["value", "low", "high", "n"],
                )

    return run


def _having(length: int):
    """id, tag, text -> id, tag, value: the distinct minimisers of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in passes(_column(batch, "text")):
                text, _, _, value = _runs(data, offsets, length)
                order = np.argsort(value)
                text, value = text[order], value[order]
                again = value[1:] == value[:-1]
                # places of a value that is there more than once, by text
                several = np.flatnonzero(np.append(again, False) | np.append(False, again)[: len(value)])
                text[several] = text[several][np.lexsort((text[several], value[several]))]
                new = np.append(True, (text[1:] != text[:-1]) | ~again)[: len(text)]
                at = pa.array(row + text[new])
                yield pa.RecordBatch.from_arrays([_column(batch, "id").take(at), _column(batch, "tag").take(at), pa.array(value[new].view(np.int64))], names=["id", "tag", "value"])

    return run


_CUT = "part long, sub long, least long, most long, data binary, id long, tag int, place int"
_CUT_NAMES = ["part", "sub", "least", "most", "data", "id", "tag", "place"]


def _cut_out(parts: int, length: int):
    """id, tag, text, shared -> the runs whose minimiser is shared: each distinct one of some texts once, as a substring with
    the least and the greatest id there (place null), and each occurrence (data null).

    A run of a minimiser that has very many different ones is cut into single strings, and these are dealt by their own
    hash: what lies beside a passage that many documents hold differs in each of them, and would else be one partition's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_ids, all_tags = (np.asarray(_column(batch, c)) for c in ("id", "tag"))
            shared = _column(batch, "shared")
            for row, data, offsets in passes(_column(batch, "text")):
                text, place, count, value = _runs(data, offsets, length)
                lists = shared.slice(row, len(offsets) - 1)
                flat = lists.flatten()
                owner = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))
                crowded = np.asarray(flat.field("crowded")).astype(bool)
                have = _paired(owner, np.asarray(flat.field("value")).view(np.uint64))
                mine = _paired(text, value)
                keep = np.isin(mine, have)
                cut = keep & np.isin(mine, have[crowded])
                text, place, count, value, cut = (x[keep] for x in (text, place, count, value, cut))
                many = np.where(cut, count, 1)
                nth = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
                text, place, value, cut, count = (np.repeat(x, many) for x in (text, place, value, cut, count))
                place, count = place + nth, np.where(cut, 1, count)
                begin, size = offsets[text] + place, count + length - 1
                sub = spans_hash(data, begin, begin + size)
                part = (np.where(cut, mix(sub), value) >> np.uint64(32)) % np.uint64(parts)
                yield from _sent(data, begin, size, part.astype(np.int64), sub.view(np.int64), all_ids[row + text], all_tags[row + text], place)

    return run


def _paired(text: np.ndarray, value: np.ndarray) -> np.ndarray:
    return mix(mix(text.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) ^ value)


def _bytes_of(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    return data[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]


def _sent(data: np.ndarray, begin: np.ndarray, size: np.ndarray, part: np.ndarray, sub: np.ndarray, ids: np.ndarray, tags: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
    if not len(sub):
        return
    order = np.lexsort((sub, part))
    first = np.flatnonzero(np.append(True, (part[order][1:] != part[order][:-1]) | (sub[order][1:] != sub[order][:-1])))
    one = order[first]
    n, nothing = len(one), pa.nulls
    held = [_bytes_of(data, begin[some], size[some]) for some in np.split(one, range(BLOCK // 16, n, BLOCK // 16))]
    blobs = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.append(0, np.cumsum(size[one])).astype(np.int32)), pa.py_buffer(np.concatenate(held))])
    own = ids[order]
    yield pa.RecordBatch.from_arrays([pa.array(part[one]), pa.array(sub[one]), pa.array(np.minimum.reduceat(own, first)), pa.array(np.maximum.reduceat(own, first)), blobs, nothing(n, pa.int64()), nothing(n, pa.int32()), nothing(n, pa.int32())], names=_CUT_NAMES)
    n = len(sub)
    yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(sub), nothing(n, pa.int64()), nothing(n, pa.int64()), nothing(n, pa.binary()), pa.array(ids), pa.array(tags.astype(np.int32)), pa.array(place.astype(np.int32))], names=_CUT_NAMES)


def _suffixes(length: int):
    """One partition's substrings (sub, least, most, data) -> part, sub, lows: for each string that begins in it the smallest
    id that holds it. Substrings that take nothing from any of their own documents are left out."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        sub, one, same = np.unique(frame["sub"].to_numpy(), return_index=True, return_inverse=True)
        least, most = np.full(len(one), LAST), np.full(len(one), -1 - LAST)
        np.minimum.at(least, same, frame["least"].to_numpy())
        np.maximum.at(most, same, frame["most"].to_numpy())
        blobs = frame["data"].to_numpy()[one]
        # the distinct substrings, a zero byte after each
        width = np.array([len(b) for b in blobs]) + 1
        base = np.cumsum(width) - width
        text = np.frombuffer(b"\0".join(blobs) + b"\0", np.uint8)
        count = width - length
        owner = np.repeat(np.arange(len(one)), width)
        starts = np.arange(len(text)) - base[owner] < count[owner]
        order, new = sorted_strings(text, np.flatnonzero(starts), length)
        first = np.flatnonzero(new)
        lowest = np.full(len(text), LAST)
        lowest[order] = np.repeat(np.minimum.reduceat(least[owner[order]], first), np.diff(np.append(first, len(order))))
        takes = np.flatnonzero(np.minimum.reduceat(np.where(starts, lowest, LAST), base) < most)
        return pd.DataFrame({"part": np.full(len(takes), frame["part"].iloc[0]), "sub": sub[takes], "lows": [lowest[base[k] : base[k] + count[k]].tobytes() for k in takes.tolist()]})

    return run


def _covered(length: int):
    """Occurrences (id, tag, place, lows) -> id, tag, start, end of the spans that an earlier document holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lows = _column(batch, "lows")
            many = np.asarray(pc.binary_length(lows)).astype(np.int64) // 8
            low = np.frombuffer(b"".join(lows.to_pylist()), np.int64)
            item = np.repeat(np.arange(batch.num_rows), many)
            nth = np.arange(len(item)) - np.repeat(np.cumsum(many) - many, many)
            ids, place = np.asarray(_column(batch, "id")), np.asarray(_column(batch, "place")).astype(np.int64)
            hit = np.flatnonzero(low < ids[item])
            item, at = item[hit], place[item[hit]] + nth[hit]
            a = np.flatnonzero(np.append(True, (item[1:] != item[:-1]) | (at[1:] != at[:-1] + 1))[: len(item)])
            z = np.append(a[1:], len(item)) - 1 if len(a) else a
            own = pa.array(item[a])
            yield pa.RecordBatch.from_arrays([_column(batch, "id").take(own), _column(batch, "tag").take(own), pa.array(at[a]), pa.array(at[z] + length)], names=["id", "tag", "start", "end"])

    return run


def _union(found: list[dict] | None) -> np.ndarray:
    """Maximal spans (start, end) of overlapping or touching ones, in order."""
    spans = np.array([(s["start"], s["end"]) for s in found or []], np.int64).reshape(-1, 2)
    if not len(spans):
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.flatnonzero(np.append(True, spans[1:, 0] > reach[:-1]))
    return np.stack((spans[first, 0], reach[np.append(first[1:], len(spans)) - 1]), axis=1)


def _rest(text: bytes, spans: np.ndarray) -> bytes:
    edge = [0, *spans.ravel().tolist(), len(text)]
    return b"".join(text[a:b] for a, b in zip(edge[0::2], edge[1::2], strict=True))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, number, sha = [], [], []
        for text, blobs in zip(_column(batch, "text").to_pylist(), _column(batch, "spans").to_pylist(), strict=True):
            spans = _union(blobs)
            removed.append(int((spans[:, 1] - spans[:, 0]).sum()))
            number.append(len(spans))
            sha.append(hashlib.sha256(_rest((text or "").encode(), spans)).hexdigest())
        yield pa.RecordBatch.from_arrays([_column(batch, "id"), _column(batch, "tag"), pa.array(removed, pa.int64()), pa.array(number, pa.int64()), pa.array(sha, pa.string())], names=["id", "tag", "removed", "number", "sha"])


class _Corpus:
    """The steps that deduplicated() and without_repeats() share."""

    def __init__(self, docs: DataFrame, length: int) -> None:
        if length < SEED + 8:
            raise ValueError(f"length must be at least {SEED + 8}")
        self.length = length
        text = F.coalesce(F.col("text").cast("string"), F.lit(""))
        # the whole row rides along in one column, so that no name of it can clash
        keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), text.alias("_text"))
        self.table = stage(keyed.select(F.col("_row.doc_id").alias("doc_id"), "id", F.octet_length("_text").cast("long").alias("n_bytes"), F.sha2("_text", 256).alias("sha"), F.pmod(F.xxhash64("_text"), F.lit(1 << 31)).cast("int").alias("t")), "texts")
        # ids that stand for different texts; the others need no tag
        odd = stage(self.table.groupBy("id").agg((F.min("sha") != F.max("sha")).alias("odd")).where("odd"), "odd")
        self.odd = None if odd.isEmpty() else small(odd)
        # only texts that several ids hold
        first = stage(self.table.groupBy("sha").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("sha", "first"), "first")
        self.marked = stage(self._tagged(self.table).join(small(first), "sha", "left").withColumn("copy", F.coalesce(F.col("first") < F.col("id"), F.lit(False))), "marked")
        self.keyed = self._tagged(keyed.withColumn("t", F.pmod(F.xxhash64("_text"), F.lit(1 << 31)).cast("int")))
        total = self.table.agg(F.sum("n_bytes")).first()[0] or 0
        self.parts = max(8, math.ceil(total / PARTITION_BYTES))

    def _tagged(self, df: DataFrame) -> DataFrame:
        if self.odd is None:
            return df.withColumn("tag", F.lit(0))
        return df.join(self.odd, "id", "left").withColumn("tag", F.when(F.col("odd"), F.col("t")).otherwise(0)).drop("odd")

    def spans(self) -> DataFrame:
        """id, tag, spans (what partitions found) of the documents that are no whole copies and lose something."""
        copies = small(stage(self.marked.where("copy").select("id", "tag").distinct(), "copies"))
        own = self.keyed.select("id", "tag", F.col("_text").alias("text")).join(copies, ["id", "tag"], "left_anti")
        held = own.mapInArrow(_held(self.length), "value long, low long, high long, n long")
        held = held.groupBy("value").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).where("low < high")
        values = stage(held.select("value", (F.col("n") > CROWDED).alias("crowded")), "values")
        having = own.mapInArrow(_having(self.length), "id long, tag int, value long").join(values, "value")
        shared = stage(having.groupBy("id", "tag").agg(F.collect_list(F.struct("value", "crowded")).alias("shared")), "shared")
        cut = stage(own.join(shared, ["id", "tag"]).mapInArrow(_cut_out(self.parts, self.length), _CUT), "cut")
        drop(shared, values)
        lows = cut.where("data is not null").select("part", "sub", "least", "most", "data").groupBy("part").applyInPandas(_suffixes(self.length), "part long, sub long, lows binary")
        hits = cut.where("data is null").select("part", "sub", "id", "tag", "place").join(lows, ["part", "sub"])
        found = hits.select("id", "tag", "place", "lows").mapInArrow(_covered(self.length), "id long, tag int, start long, end long")
        spans = stage(found.groupBy("id", "tag").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "spans")
        drop(cut)
        return spans


def deduplicated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs (doc_id, text)."""
    corpus = _Corpus(docs, length)
    cut = corpus.keyed.select("id", "tag", F.col("_text").alias("text")).join(corpus.spans(), ["id", "tag"])
    cut = stage(cut.mapInArrow(_digests, "id long, tag int, removed long, number long, sha string").withColumnRenamed("sha", "rest").dropDuplicates(["id", "tag"]), "cut")
    whole = F.col("copy") & (F.col("n_bytes") >= length)
    pick = lambda all_, some, none: F.when(whole, all_).otherwise(F.coalesce(some, none))
    return corpus.marked.join(cut, ["id", "tag"], "left").select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_bytes", pick(F.col("n_bytes"), F.col("removed"), F.lit(0).cast("long")).alias("n_removed"), pick(F.lit(1), F.col("number"), F.lit(0)).cast("long").alias("n_spans"), pick(F.lit(_EMPTY), F.col("rest"), F.col("sha")).alias("kept_sha256")
    )


def _rewritten(names: list[str]):
    """Rows without their last two columns, text and spans; what is left of the text takes its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for batch in batches:
            columns = list(batch.columns)
            spans, texts = columns.pop().to_pylist(), columns.pop().to_pylist()
            left = [_rest(t.encode(), _union(s)).decode(errors="ignore") if s else t for t, s in zip(texts, spans, strict=True)]
            columns[at] = pa.array(left, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with the text that is left; bytes of a character cut in two go with it. n_chars follows, if there is one."""
    corpus = _Corpus(docs, length)
    whole = corpus.marked.where(F.col("copy") & (F.col("n_bytes") >= length))
    found = stage(corpus.spans().withColumn("whole", F.lit(False)).unionByName(whole.select("id", "tag", F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"), F.lit(True).alias("whole"))).dropDuplicates(["id", "tag"]), "found")
    joined = corpus.keyed.join(found, ["id", "tag"], "left")
    text = F.when(F.coalesce("whole", F.lit(False)), F.lit("")).when(F.col("spans").isNotNull(), F.col("_text")).otherwise(F.col("_row.text"))
    rows = joined.select(*[F.col("_row")[c].alias(f"c{i}") for i, c in enumerate(docs.columns)], text.alias("text"), "spans")
    out = rows.mapInArrow(_rewritten(docs.columns), docs.schema)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
