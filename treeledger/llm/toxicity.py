"""Toxicity by multiple-instance learning: a document is a bag of sentences.

Each sentence has a logistic score over its words, their tails and what they begin with; the document's score is their noisy-or,
1 - prod(1 - p). Only documents have labels, and the gradient of the noisy-or hands
the blame of a toxic document to its worst sentences, which the model then locates.

Defined results: a null, empty or wordless text scores 0. A label row without doc_id or without a value
teaches nothing; repeated label rows count as often as they come. Without labels of both kinds
every score is 0. A very long text is a bag with many sentences, and is read by pieces; a sentence of any length is one. Of sentences with one score the last is the worst; of
features with one gain those with the smaller hash are kept. Other columns of the inputs are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeledger.llm.staging import stage
from treeledger.llm.text import NO_LETTER, PASS_BYTES, STOP, passes, word_hashes, words

#: At most so many labelled documents of each kind are fitted on; their kinds are weighted back to all labelled rows.
SAMPLE = 3000
#: Bytes of a word's tail, and of the heads that it has if it goes on after them: a rare language's words share these.
TAIL, HEADS = 4, range(3, 11)
#: Features the model keeps: those of toxic documents with the highest log-likelihood ratio, which must reach MIN_GAIN (nats).
VOCABULARY, MIN_GAIN = 500, 3.0
STEPS, RATE, RIDGE = 250, 0.1, 1e-4
#: What missing a toxic document costs against raising a clean one; chosen by cross-validation on the documents to learn from.
TOXIC_WEIGHT = 4.0
#: Bytes that are scored at once: their features take some hundred times as much.
SCORED_BYTES = PASS_BYTES // 2
#: Score from which a document is toxic, and a sentence offending.
THRESHOLD, OFFENDING = 0.7, 0.5


@dataclass
class Model:
    keys: np.ndarray
    weights: np.ndarray
    bias: float


def _sentences(data: np.ndarray, offsets: np.ndarray):
    """Features (words, their last TAIL bytes and their HEADS), the sentence of each feature, document and byte
    span of each sentence that has a word."""
    starts, ends, first = words(data, offsets, NO_LETTER)
    stop = np.cumsum(STOP[data])
    sentence, index = np.unique(stop[starts], return_index=True)
    which = np.searchsorted(sentence, stop[starts])
    doc = np.searchsorted(first, index, side="right") - 1
    last = np.append(index[1:], len(starts)) - 1
    kinds = [(np.arange(len(starts)), starts, ends)]
    for size in (TAIL, *HEADS):
        at = np.flatnonzero(ends - starts > size)
        kinds.append((at, ends[at] - size, ends[at]) if len(kinds) == 1 else (at, starts[at], starts[at] + size))
    salt = np.repeat(np.arange(len(kinds), dtype=np.uint64) * np.uint64(0x1F3D5B792E4C6A88), [len(k[0]) for k in kinds])
    at, begin, end = (np.concatenate(c) for c in zip(*kinds, strict=True))
    return word_hashes(data, begin, end) ^ salt, which[at], doc, starts[index], ends[last] if len(index) else ends[:0]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """toxic, text -> the features of some texts with the numbers of toxic and of other texts that have them."""
    for batch in batches:
        toxic = np.asarray(batch.column(0)).astype(np.int64)
        for row, data, offsets in passes(batch.column(1)):
            hashes, sentence, doc, _, _ = _sentences(data, offsets)
            keys, inverse = np.unique(hashes, return_inverse=True)
            n = len(offsets) - 1
            word, of = np.divmod(np.unique(inverse * n + doc[sentence]), n)
            seen = np.bincount(word, minlength=len(keys))
            bad = np.bincount(word, weights=toxic[row + of], minlength=len(keys)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(bad), pa.array(seen - bad)], names=["key", "bad", "good"])


def _gain(bads: int, goods: int) -> Column:
    """Log-likelihood ratio of label and presence, for what toxic texts have more often."""
    bad, good, n = F.col("bad"), F.col("good"), bads + goods

    def part(k: Column, of: Column, share: float) -> Column:
        return F.when(k > 0, k * F.log(k / (of * share))).otherwise(0.0)

    seen = bad + good
    terms = part(bad, seen, bads / n) + part(good, seen, goods / n) + part(bads - bad, n - seen, bads / n) + part(goods - good, n - seen, goods / n)
    return F.when(bad * goods > good * bads, terms).otherwise(0.0)


def _bags(keys: np.ndarray):
    """doc_id, toxic, text -> number of sentences, and the sentence and the number of each feature that is in keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in passes(batch.column(2)):
                n = len(offsets) - 1
                hashes, sentence, doc, _, _ = _sentences(data, offsets)
                place = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                use = np.flatnonzero(keys[place] == hashes)
                use = use[np.argsort(sentence[use], kind="stable")]
                begin = np.searchsorted(doc, np.arange(n + 1))
                cut = np.searchsorted(sentence[use], begin)
                at, col = (sentence[use] - begin[doc[sentence[use]]]).astype(np.int32), place[use].astype(np.int32)
                parts = [[x[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)] for x in (at, col)]
                part = batch.slice(row, n)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(begin)), *(pa.array(x, pa.binary()) for x in parts)], names=["doc_id", "toxic", "sentences", "at", "features"])

    return run


def fit(keys: np.ndarray, toxic: np.ndarray, weight: np.ndarray, sentences: np.ndarray, at: np.ndarray, col: np.ndarray) -> Model:
    """A model over keys from documents' labels 0 and 1, weights and numbers of sentences, and the sentence (counted
    through all documents) and the key of each feature."""
    n, doc = int(sentences.sum()), np.repeat(np.arange(len(toxic)), sentences)
    w, b = np.zeros(len(keys) + 1), -3.0
    m, v = np.zeros(len(w)), np.zeros(len(w))
    w[-1] = b
    empty = sentences == 0
    scale = weight / weight.sum()
    for step in range(1, STEPS + 1):
        z = np.clip(np.bincount(at, weights=w[col], minlength=n) + w[-1], -30, 30)
        prob = 1 / (1 + np.exp(-z))
        clean = np.exp(np.clip(np.bincount(doc, weights=np.log1p(-prob), minlength=len(toxic)), -30, -1e-9))
        clean[empty] = 0.5
        blame = np.where(toxic == 1, -clean / (1 - clean), 1.0) * scale
        slope = blame[doc] * prob
        grad = np.append(np.bincount(col, weights=slope[at], minlength=len(keys)) + RIDGE * w[:-1] / 10, slope.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return Model(keys, w[:-1], float(w[-1]))


def _spans(cut: np.ndarray, start: np.ndarray, end: np.ndarray, score: np.ndarray) -> pa.Array:
    """Lists of (start, end, score), cut at `cut`."""
    spans = pa.StructArray.from_arrays([pa.array(start), pa.array(end), pa.array(score)], names=["start", "end", "score"])
    return pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), spans)


def _pieces(data: np.ndarray, texts: int) -> Iterator[tuple[int, int]]:
    """Begin and end of what is read at once: a long text goes by whole sentences of at most SCORED_BYTES together, a sentence
    that is longer by whole words."""
    at = 0
    while texts == 1 and len(data) - at > SCORED_BYTES:
        # at the end of a sentence, else of a word
        near = data[at : at + SCORED_BYTES]
        ends = np.flatnonzero(STOP[near]) if STOP[near].any() else np.flatnonzero(NO_LETTER[near])
        to = at + 1 + (int(ends[-1]) if len(ends) else int(np.argmax(NO_LETTER[data[at:]])))
        yield at, to
        at = to
    yield at, len(data)


def _score(model: Model | None, keep_from: float | None):
    def of(column: pa.Array) -> Iterator[tuple]:
        for row, data, offsets in passes(column, SCORED_BYTES):
            n = len(offsets) - 1
            if model is None:
                yield (row, n, np.zeros(n), _spans(np.zeros(n + 1, np.int64), *np.zeros((2, 0), np.int64), np.zeros(0)), np.full((2, n), -1))
                continue
            found, stops = [], 0
            for from_, to in _pieces(data, n):
                piece = data[from_:to]
                hashes, sentence, doc, start, end = _sentences(piece, offsets if n > 1 else np.array([0, to - from_]))
                at = np.minimum(np.searchsorted(model.keys, hashes), len(model.keys) - 1) if len(model.keys) else None
                weight = np.where(model.keys[at] == hashes, model.weights[at], 0.0) if at is not None else np.zeros(len(hashes))
                nth = doc
                if n == 1:  # which sentence of the text it is, as pieces may cut one
                    ended = np.cumsum(STOP[piece])
                    nth, stops = stops + ended[start], stops + int(STOP[piece].sum())
                found.append((doc, start + from_ - offsets[doc], end + from_ - offsets[doc], np.bincount(sentence, weights=weight, minlength=len(doc)), nth))
            doc, start, end, total, nth = (np.concatenate(x) for x in zip(*found, strict=True))
            if len(found) > 1 and len(doc):  # of a long text; a sentence that goes on in the next piece is one
                first = np.flatnonzero(np.append(True, nth[1:] != nth[:-1]))
                doc, start, end, total = doc[first], start[first], end[np.append(first[1:], len(end)) - 1], np.add.reduceat(total, first)
            prob = 1 / (1 + np.exp(-np.clip(total + model.bias, -30, 30)))
            clean = np.bincount(doc, weights=np.log1p(-prob), minlength=n)
            worst, order = np.full((2, n), -1), np.argsort(prob, kind="stable")
            worst[0, doc[order]], worst[1, doc[order]] = start[order], end[order]
            hit = np.flatnonzero(prob >= OFFENDING)
            yield row, n, np.clip(-np.expm1(clean), 0, 1), _spans(np.searchsorted(doc[hit], np.arange(n + 1)), start[hit], end[hit], prob[hit]), worst

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, n, score, offending, worst in of(batch.column(batch.schema.get_field_index("text"))):
                part = batch.slice(row, n)
                if keep_from is None:
                    number = pc.list_value_length(offending).cast(pa.int64())
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), number, pa.array(worst[0]), pa.array(worst[1]), offending], names=["doc_id", "score", "n_offending", "worst_start", "worst_end", "offending"])
                else:
                    yield part.filter(pa.array(score < keep_from))

    return run


def learned(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fit on documents with labels, but for those whose crc32(doc_id) mod 3 is 1."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and crc32(cast(doc_id as string)) % 3 <> 1")
    total = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    if len(total) < 2:
        return None
    some = [rows.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    # at most 2 x sample rows
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(some[0].unionByName(some[1])), "doc_id").select("doc_id", "toxic", "text")
    texts = stage(texts, "labelled")
    kinds = {r[0]: r[1] for r in texts.groupBy("toxic").count().collect()}
    if len(kinds) < 2:
        return None
    counted = texts.select("toxic", "text").mapInArrow(_counted, "key long, bad long, good long").groupBy("key").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    best = counted.withColumn("gain", F.round(_gain(kinds[1], kinds[0]), 6)).where(F.col("gain") >= MIN_GAIN).orderBy(F.desc("gain"), "key").limit(VOCABULARY)
    keys = np.sort(np.array([r.key for r in best.select("key").collect()], np.int64).view(np.uint64))
    if not len(keys):
        keys = np.zeros(1, np.uint64)
    bags = texts.mapInArrow(_bags(keys), "doc_id long, toxic int, sentences long, at binary, features binary").toArrow().sort_by([("doc_id", "ascending"), ("toxic", "ascending")])
    toxic, sentences = (np.asarray(bags[c]).astype(np.int64) for c in ("toxic", "sentences"))
    at, col = (np.frombuffer(b"".join(bags[c].to_pylist()), np.int32) for c in ("at", "features"))
    at = at + np.repeat(np.cumsum(sentences) - sentences, np.asarray(pc.binary_length(bags["at"])) // 4)
    weight = np.array([total[0] / kinds[0], TOXIC_WEIGHT * total[1] / kinds[1]])[toxic]
    return fit(keys, toxic, weight, sentences, at, col)


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, n_offending (sentences of 0.5 or more), worst_start and
    worst_end (UTF-8 byte span of the worst sentence, offending or not, -1 without one), offending (start, end and score of
    each offending sentence, in the order of the text). Scoring is one pass over docs, no shuffle."""
    model = learned(docs, labels, sample)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_score(model, None), "doc_id long, score double, n_offending long, worst_start long, worst_end long, offending array<struct<start:long,end:long,score:double>>")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_offending", "worst_start", "worst_end", "offending")


def without_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, whole, whose score is below the threshold."""
    return docs.mapInArrow(_score(learned(docs, labels, sample), threshold), docs.schema)
