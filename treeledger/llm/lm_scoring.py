"""Stupid-backoff language-model scores of documents, from counts over the same corpus, as joins of tables.

    S(w | u v) = c(u v w) / c(u v)             if c(u v w) >= MIN_COUNT
               = ALPHA * S(w | v)              otherwise
    S(w)       = c(w) / N

and so on for other orders; the first words of a text have as much context as there is. c counts over all documents, N is
the number of words. A table of each order holds the n-grams that are counted often enough, dealt by hash, with

    gain(u v w) = ln c(u v w) / c(u v)  -  ln S(w | v)  -  ln ALPHA

where the context and the shorter n-gram come by joins with the table of the order below (the parts of an n-gram are
counted at least as often as it is). An n-gram that isn't in the table backs off, so its document keeps what the shorter one gives:
a document's score is the sum of ln S(w) over its words, of ln ALPHA for each step that its words could be backed off,
and of the gains of its n-grams. Those are explodes of the texts, joined to the tables and summed by document. The words
that come most often are a short list and most of every text: their scores go to the tasks, which add them up as they
read. All other words meet their table.

Words are runs of bytes other than space and \\t \\n \\v \\f \\r, with A-Z folded. They are told apart by 64-bit hashes, and
n-grams of documents meet the tables by 64-bit hashes of theirs.
Defined results: a null or wordless text has 0 words, a log-score of 0 and a null mean. Repeated rows count as often
as they come; rows with the same doc_id are one document. A very long text is one document like any other. Other columns
of the input are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeledger.llm.staging import BROADCAST_ROWS, drop, stage
from treeledger.llm.text import mix, passes, word_hashes, words

#: Unless asked for, n-grams counted once are left out of the tables: they say no more than that the words came there.
#: Counting trigrams moves five times the text, so bigrams are the usual order.
ALPHA, MIN_COUNT, ORDER = 0.4, 2, 2
#: Passes in which documents' n-grams of two words and more meet their table.
SLICES = 2
#: Words at most whose scores every task holds.
KNOWN = BROADCAST_ROWS
#: Bytes of text whose n-grams are counted before they are sent.
FLUSH_BYTES = 8_000_000


def _hashes(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Word hashes, their rows, and how many bytes were read."""
    for row, data, offsets in passes(column):
        starts, ends, first = words(data, offsets)
        yield word_hashes(data, starts, ends).view(np.int64), row + np.repeat(np.arange(len(offsets) - 1), np.diff(first)), len(data)


def _grams(h: np.ndarray, row: np.ndarray, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The words of each n-gram, a column each, and its row."""
    n = max(0, len(h) - order + 1)
    inside = row[:n] == row[order - 1 : order - 1 + n]
    return [h[i : i + n][inside] for i in range(order)], row[:n][inside]


def _counted_runs(columns: list[np.ndarray], in_order: bool = False) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of the columns and how often each comes; in_order: as they come, which lies better in a shuffle.

    Rows are sorted by one hash, which is faster than by all columns; that a hash stands for two of them would only
    tell a row in two parts.
    """
    key = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + c.view(np.uint64))
    order = np.argsort(key)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        c = c[order]
        new[1:] |= c[1:] != c[:-1]
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(order)))
    one = order[first]
    if in_order:
        turn = np.argsort(one)
        one, n = one[turn], n[turn]
    return [c[one] for c in columns], n


def _names(order: int) -> list[str]:
    return [f"w{i}" for i in range(order)]


def _batch(columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def _counts(order: int):
    """text -> n-grams of some texts and how often each comes there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def told() -> pa.RecordBatch:
            found, n = _counted_runs([np.concatenate(c) for c in zip(*held, strict=True)])
            return _batch([*found, n], [*_names(order), "n"])

        for batch in batches:
            for h, row, read in _hashes(batch.column(0)):
                held.append(_grams(h, row, order)[0])
                size += read
                if size > FLUSH_BYTES:
                    yield told()
                    held, size = [], 0
        if held:
            yield told()

    return run


def _by_document(order: int, slices: int, which: int):
    """doc_id, text -> the distinct n-grams of each text whose first word is of one slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for h, row, _ in _hashes(batch.column(1)):
                columns, own = _grams(h, row, order)
                if slices > 1:
                    mine = columns[0].view(np.uint64) % np.uint64(slices) == which
                    columns, own = [c[mine] for c in columns], own[mine]
                (own, *columns), n = _counted_runs([own, *columns], in_order=True)
                yield _batch([ids[own], *columns, n], ["doc_id", *_names(order), "n"])

    return run


def _known(words: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, in order, and counts of the words that come at least 2^k times, with the least k for which they are at most so
    many."""
    held = dict(words.groupBy(F.floor(F.log2("n")).alias("k")).agg(F.count("*").alias("words")).collect())
    total, k = 0, max(held, default=0) + 1
    while k > 0 and total + held.get(k - 1, 0) <= most:
        k -= 1
        total += held.get(k, 0)
    found = words.where(F.floor(F.log2("n")) >= k).select("w0", "n").toArrow()
    hashes, n = (found.column(c).to_numpy() for c in ("w0", "n"))
    order = np.argsort(hashes)
    return hashes[order], n[order]


def _word_sums(known, total: int):
    """doc_id, text -> the sum x of ln S(w) over the known words of each text (w0 and n null), and its other words, each once (x
    null). known: what _known() gives, broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, n = known.value
        score = np.log(n) - math.log(total)
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for h, row, _ in _hashes(batch.column(1)):
                at = np.searchsorted(hashes, h)
                at[at == len(hashes)] = 0
                has = hashes[at] == h if len(hashes) else np.zeros(len(h), bool)
                own = np.flatnonzero(np.bincount(row[has]))
                x = np.bincount(row[has], score[at[has]])[own]
                nothing = pa.nulls(len(own), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(ids[own]), nothing, nothing, pa.array(x, pa.float64())], names=_WORD_SUMS)
                (own, rare), times = _counted_runs([row[~has], h[~has]], in_order=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(rare), pa.array(times), pa.nulls(len(own), pa.float64())], names=_WORD_SUMS)

    return run


_WORD_SUMS = ["doc_id", "w0", "n", "x"]


def _word_gains(docs: DataFrame, words: DataFrame, total: int) -> DataFrame:
    """doc_id, x: the sums of ln S(w) over the words of each document."""
    known = docs.sparkSession.sparkContext.broadcast(_known(words, KNOWN))
    told = stage(docs.mapInArrow(_word_sums(known, total), "doc_id long, w0 long, n long, x double"), "words1")
    score = words.select("w0", (F.ln("n") - F.lit(math.log(total))).alias("score"))
    rest = told.where("x is null").select("doc_id", "w0", "n").join(score.hint("shuffle_hash"), "w0")
    met = stage(rest.groupBy("doc_id").agg(F.sum(F.col("n") * F.col("score")).alias("x")), "gains1")
    return told.where("x is not null").select("doc_id", "x").unionAll(met)


def _typed(order: int) -> str:
    return ", ".join(f"{w} long" for w in _names(order))


def _key(order: int) -> Column:
    return F.xxhash64(*_names(order)) if order > 1 else F.col("w0")


def _counted(docs: DataFrame, order: int) -> DataFrame:
    """n-grams and n. Tasks have summed up what they read, so rows are dealt as they are and summed where they meet."""
    return docs.select("text").mapInArrow(_counts(order), f"{_typed(order)}, n long").repartition(*_names(order)).groupBy(*_names(order)).agg(F.sum("n").alias("n"))


def _gains(docs: DataFrame, gains: DataFrame, order: int, slices: int) -> DataFrame:
    """doc_id, x: the sum of the gains (key, gain) of each document's n-grams. They meet in so many passes over the texts, so
    that no pass shuffles all n-grams at once. A task hashes its share of the table, whose keys are distinct and dealt evenly;
    the documents' side, which is longer and may be skewed, needs no order."""
    parts = []
    for i in range(slices):
        own = docs.mapInArrow(_by_document(order, slices, i), f"doc_id long, {_typed(order)}, n long").select("doc_id", _key(order).alias("key"), "n")
        met = own.join(gains.hint("shuffle_hash"), "key").groupBy("doc_id").agg(F.sum(F.col("n") * F.col("gain")).alias("x"))
        parts.append(stage(met, f"gains{order}"))
    return reduce(DataFrame.unionByName, parts)


def _scores(docs: DataFrame, order: int, min_count: int) -> DataFrame:
    """doc_id, x: the sum of ln S(w) over the words and of the gains of all orders."""
    words = stage(_counted(docs, 1), "words")
    total = words.agg(F.sum("n")).first()[0] or 1
    # w0, ..., n, score: ln of the probability without back-off
    below = words.withColumn("score", F.ln("n") - F.lit(math.log(total)))
    parts = [_word_gains(docs, words, total)]
    held = [words]
    for k in range(2, order + 1):
        often = stage(_counted(docs, k).where(F.col("n") >= min_count), f"often{k}")
        context = below.select(*_names(k - 1), F.col("n").alias("context"))
        shorter = below.select(*[F.col(f"w{i}").alias(f"w{i + 1}") for i in range(k - 1)], F.col("score").alias("shorter"))
        score = F.ln("n") - F.ln("context")
        both = often.join(context, _names(k - 1)).join(shorter, _names(k)[1:]).withColumn("score", score)
        table = both.select(*(_names(k) if k < order else []), "n", "score", _key(k).alias("key"), (F.col("score") - F.col("shorter") - F.lit(math.log(ALPHA))).alias("gain"))
        table = stage(table if k < order else table.select("key", "gain"), f"order{k}")
        drop(often, *held)
        parts.append(_gains(docs, table.select("key", "gain"), k, SLICES))
        below, held = table, [table]
    drop(*held)
    return reduce(DataFrame.unionByName, parts)


def language_model_scores(docs: DataFrame, order: int = ORDER, min_count: int = MIN_COUNT) -> DataFrame:
    """doc_id, n_words, log_score, mean_log_score: one row per row of docs (doc_id, text).

    min_count 1: every n-gram of the corpus is in its table, and only what the corpus doesn't hold backs off. That is the
    exact form, whose tables are as long as the texts.
    """
    if min_count < 1 or order < 1:
        raise ValueError("min_count and order must be at least 1")
    nobody = F.lit(-(1 << 63))
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), nobody).alias("doc_id"), "text")
    gains = _scores(docs, order, min_count).groupBy("doc_id").agg(F.sum("x").alias("x"))
    n_words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    # word i of a text can be backed off min(i, order - 1) times
    steps = F.when(F.col("own_words") >= order, (order - 1) * (F.col("own_words") - order) + order * (order - 1) / 2).otherwise(F.col("own_words") * (F.col("own_words") - 1) / 2)
    counted = docs.select("doc_id", n_words.alias("own_words")).withColumn("steps", steps)
    sums = counted.groupBy("doc_id").agg(F.sum("own_words").alias("n_words"), F.sum("steps").alias("steps"))
    scores = sums.join(gains, "doc_id", "left").select("doc_id", "n_words", (F.coalesce("x", F.lit(0.0)) + F.col("steps") * math.log(ALPHA)).alias("log_score"))
    out = docs.select("doc_id").join(scores, "doc_id")
    return out.select(F.nullif(F.col("doc_id"), nobody).alias("doc_id"), "n_words", "log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).alias("mean_log_score"))
