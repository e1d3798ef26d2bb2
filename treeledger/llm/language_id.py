"""Language of documents from a linear-chain conditional random field over words.

Every word is labelled by forward-backward over the whole text, so code-switched passages keep their own
language. Transitions are learned from labelled texts and from sequences that switch from one such text to one of
another language. State features are affixes and character n-grams (hashed) and the words of a learned lexicon. A
run of letters of more than WIDTH counts as several words, so a text without spaces is read whole.
Neighbours with one label make a span. The document gets the language with most posterior mass; the score is that share.

Defined results: a null text or one without letters is `und` with score 0 and no spans. If no row teaches a
language, everything is `und`. Ties go to the language that sorts first. Rows are independent,
so repeats change nothing. A very long text is one sequence like any other. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeledger.llm.staging import small, stage
from treeledger.llm.text import LETTER, point_classes, spans_hash

#: At most so many labelled documents of each language are fitted on, and of each so many code points.
SAMPLE, READ = 150, 100_000
#: Words of the lexicon for each language, and hashed features.
LEXICON, BUCKETS = 400, 1 << 15
#: Letters of a word at most.
WIDTH = 14
EPOCHS, RATE, RIDGE, WINDOW = 30, 0.15, 1e-6, 64
#: Of so many windows of a text one also begins a sequence that goes on with a window of another language.
SWITCHED = 4
#: A task forgets the emissions of words beyond so many.
REMEMBERED = 1_000_000
#: Words of a segment that runs beside the other segments of its text.
SEGMENT = 128
#: Code points that are turned into words at once; words that are labelled at once (a longer text is labelled alone).
PASS, TOGETHER = 2_000_000, 3_000_000
UNKNOWN = "und"


@dataclass
class Model:
    labels: list[str]
    lexicon: np.ndarray
    state: np.ndarray  # BUCKETS + 1 + len(lexicon) + 1 rows, one column a label; the last rows of both parts are 0
    step: np.ndarray  # transitions, exponentiated
    start: np.ndarray
    #: words met so far, and their emissions
    known: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    rows: np.ndarray | None = None

    def emissions(self, keys: np.ndarray, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of distinct words, whose keys ascend."""
        at = np.searchsorted(self.known, keys)
        new = np.flatnonzero(np.append(self.known, 0)[at] != keys) if len(self.known) else np.arange(len(keys))
        made = _emissions(self.state, _features(points, starts[new], ends[new]), _place(self.lexicon, keys[new]))
        if self.rows is None or len(self.known) + len(new) > REMEMBERED:
            self.known, self.rows = np.zeros(0, np.uint64), np.zeros((0, len(self.labels)), made.dtype)
            if len(new) < len(keys):
                return self.emissions(keys, points, starts, ends)
        both = np.concatenate((self.known, keys[new]))
        order = np.argsort(both, kind="stable")
        self.known, self.rows = both[order], np.concatenate((self.rows, made))[order]
        return self.rows[np.searchsorted(self.known, keys)]


def _lower(text: str) -> str:
    """In lower case, a code point for a code point: a letter that would become two stays."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x) == 1 else c for c, x in ((c, c.lower()) for c in text))


def _words(texts: list[str]):
    """Points of the joined texts, starts and ends of their words, number of words of each text."""
    points = np.frombuffer("\n".join(map(_lower, texts)).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = np.concatenate(([False], point_classes()[points] == LETTER, [False])).view(np.int8)
    edge = np.flatnonzero(np.diff(letter))
    starts, ends = edge[0::2], edge[1::2]
    pieces = -(-(ends - starts) // WIDTH)
    if len(pieces) and pieces.max() > 1:
        nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts, ends = np.repeat(starts, pieces) + nth * WIDTH, np.repeat(ends, pieces)
        ends = np.minimum(ends, starts + WIDTH)
    bounds = np.searchsorted(starts, np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts]))))
    return points, starts, ends, np.diff(bounds)


def _features(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashed features of each word, a column each; BUCKETS where a word has none."""
    points = np.concatenate((points, np.zeros(WIDTH, np.uint32)))
    length = np.minimum(ends - starts, WIDTH)
    at = np.arange(WIDTH)
    grid = np.where(at < length[:, None], points[starts[:, None] + at], 0).astype(np.uint64)
    tail = np.where(at < length[:, None], points[ends[:, None] - 1 - at], 0).astype(np.uint64)
    a, b, c = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
    two = grid[:, :-1] * a + grid[:, 1:] * b
    columns = [two, two[:, :-1] + grid[:, 2:] * c]
    has = [grid[:, 1:] > 0, grid[:, 2:] > 0]
    for side, mark in ((grid, 11), (tail, 13)):
        acc = np.full(len(starts), mark, np.uint64)
        for k in range(4):
            acc = acc * a + side[:, k] * b
            columns.append(acc[:, None] * c)
            has.append(side[:, k : k + 1] > 0)
    value = np.concatenate(columns, axis=1)
    value ^= value >> np.uint64(31)
    return np.where(np.concatenate(has, axis=1), (value * b) >> np.uint64(64 - 15), BUCKETS).astype(np.int32)


def _emissions(state: np.ndarray, features: np.ndarray, place: np.ndarray) -> np.ndarray:
    out = state[BUCKETS + 1 + place].copy()
    for k in range(features.shape[1]):
        out += state[features[:, k]]
    return out


def _place(lexicon: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(lexicon):
        return np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(lexicon, keys), len(lexicon) - 1)
    return np.where(lexicon[at] == keys, at, len(lexicon))


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=-1, keepdims=True)


def _marginals(e: np.ndarray, length: np.ndarray, step: np.ndarray, start: np.ndarray, end: np.ndarray, with_pairs: bool = False):
    """Forward-backward over sequences that lie end to end, all at the same step together, the longest first.

    start and end: what comes in from the left and from the right of each sequence. Returns the posterior of each
    word and, if asked for, of each pair of labels summed over all neighbours.
    """
    order = np.argsort(-length, kind="stable")
    first = (np.cumsum(length) - length)[order]
    sorted_length = length[order]
    start, end = start[order], end[order]
    steps = int(sorted_length[0]) if len(length) else 0
    active = np.searchsorted(-sorted_length, -np.arange(steps), side="left")
    post = np.empty_like(e)
    for t in range(steps):
        at = first[: active[t]] + t
        post[at] = _scaled((post[at - 1] @ step if t else start) * e[at])
    pairs = np.zeros_like(step)
    beta = end.copy()
    for t in range(steps - 1, -1, -1):
        at = first[: active[t]] + t
        b = beta[: active[t]]
        post[at] *= b
        if t:
            right = _scaled(e[at] * b)
            if with_pairs:
                before = post[at - 1]
                pairs += step * (before.T @ (right / ((before @ step) * right).sum(axis=1, keepdims=True)))
            beta[: active[t]] = right @ step.T
    return _scaled(post), pairs


def _posteriors(emission: np.ndarray, length: np.ndarray, step: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Posterior of each word of whole texts (length: their words, none 0).

    A long text is cut into segments that exchange exact messages: a segment's words multiply to one matrix, the
    few matrices of a text are passed along, and then all segments run side by side.
    """
    k = emission.shape[1]
    e = np.exp(emission - emission.max(axis=1, keepdims=True))
    parts = -(-length // SEGMENT)
    text = np.repeat(np.arange(len(length)), parts)
    number = np.arange(len(text)) - (np.cumsum(parts) - parts)[text]
    size = np.minimum(SEGMENT, length[text] - number * SEGMENT)
    left = np.tile(start, (len(text), 1)).astype(e.dtype)
    right = np.ones_like(left)
    if (parts > 1).any():
        long = np.flatnonzero(parts[text] > 1)
        begin, n = (np.cumsum(size) - size)[long], size[long]
        product = np.zeros((len(long), k, k), e.dtype)
        product[:] = np.eye(k)
        product *= e[begin][:, None, :]
        for t in range(1, int(n.max())):
            on = np.flatnonzero(n > t)
            p = (product[on] @ step) * e[begin[on] + t][:, None, :]
            product[on] = p / p.sum(axis=(1, 2), keepdims=True)
        place = np.full(len(text) + 1, -1)
        place[long] = np.arange(len(long))
        # texts by falling number of segments: those with more than i are the first ones
        turn = np.argsort(-parts, kind="stable")
        begins = (np.cumsum(parts) - parts)[turn]
        going = np.searchsorted(-parts[turn], -np.arange(int(parts.max()) + 1), side="left")
        for i in range(int(parts.max()) - 1):
            at = begins[: going[i + 1]] + i
            left[at + 1] = _scaled(np.einsum("ni,nij->nj", left[at], product[place[at]])) @ step
        for i in range(int(parts.max()) - 1, 0, -1):
            at = begins[: going[i]] + i
            right[at - 1] = _scaled(np.einsum("nij,nj->ni", product[place[at]], right[at])) @ step.T
    return _marginals(e, size, step, left, right)[0]


def _sequences(count: np.ndarray, lang: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Words (by number) of training sequences and the length of each: windows of the texts, and windows that go over to
    one of the next language in the middle. count, lang: words and label of each text."""
    begin = np.cumsum(count) - count
    windows = [[(b + i, min(WINDOW, c - i)) for i in range(0, c, WINDOW)] for b, c in zip(begin.tolist(), count.tolist(), strict=True)]
    plain = [np.arange(b, b + n) for own in windows for b, n in own]
    full = [[w for own, label in zip(windows, lang.tolist(), strict=True) if label == j for w in own[::SWITCHED] if w[1] == WINDOW] for j in range(k)]
    switched = []
    for j in range(k):
        for (a, n), (b, m) in zip(full[j], full[(j + 1) % k], strict=False) if k > 1 else ():
            switched.append(np.concatenate((np.arange(a, a + n // 2), np.arange(b + m // 2, b + m))))
            switched.append(np.concatenate((np.arange(b, b + m // 2), np.arange(a + n // 2, a + n))))
    every = plain + switched
    return np.concatenate([*every, np.zeros(0, np.int64)]).astype(np.int64), np.array([len(x) for x in every], np.int64)


def fit(texts: list[str], langs: list[str]) -> Model | None:
    """A model from texts and the language of each."""
    labels = sorted(set(langs))
    if not labels:
        return None
    points, starts, ends, count = _words(texts)
    keys, where, which = np.unique(spans_hash(points, starts, ends), return_index=True, return_inverse=True)
    lang = np.array([labels.index(x) for x in langs])
    gold = np.repeat(lang, count)
    k = len(labels)
    seen = np.bincount(which * k + gold, minlength=len(keys) * k).reshape(-1, k)
    lexicon = np.unique(keys[np.concatenate([np.lexsort((keys, -seen[:, j]))[:LEXICON] for j in range(k)])]) if len(keys) else keys
    features, place = _features(points, starts[where], ends[where]), _place(lexicon, keys)
    rows = BUCKETS + 1 + len(lexicon) + 1
    fixed = [BUCKETS, rows - 1]
    weights = [np.zeros((rows, k)), np.zeros((k, k)) + np.eye(k), np.zeros(k)]
    at, length = _sequences(count, lang, k)
    which, gold = which[at], gold[at]
    first = np.cumsum(length) - length
    hot = np.eye(k)[gold]
    inner = np.ones(len(gold), bool)
    inner[first] = False
    pair_gold = np.zeros((k, k))
    np.add.at(pair_gold, (gold[:-1][inner[1:]], gold[1:][inner[1:]]), 1)
    squares = [np.full_like(w, 1e-8) for w in weights]
    flat = features.ravel()
    for _ in range(EPOCHS if len(gold) else 0):
        emission = _emissions(weights[0], features, place)
        e = np.exp(emission - emission.max(axis=1, keepdims=True))[which]
        start = np.tile(np.exp(weights[2]), (len(length), 1))
        post, pairs = _marginals(e, length, np.exp(weights[1]), start, np.ones_like(start), with_pairs=True)
        rest = hot - post
        grad = [np.zeros((rows, k)), pair_gold - pairs, rest[first].sum(axis=0)]
        for j in range(k):
            own = np.bincount(which, weights=rest[:, j], minlength=len(keys))
            grad[0][:, j] = np.bincount(flat, weights=np.repeat(own, features.shape[1]), minlength=rows)
            grad[0][BUCKETS + 1 :, j] += np.bincount(place, weights=own, minlength=len(lexicon) + 1)
        grad[0][fixed] = 0
        for w, g, q in zip(weights, grad, squares, strict=True):
            g = g / len(gold) - RIDGE * w
            q += g * g
            w += RATE * g / np.sqrt(q)
    return Model(labels, lexicon, weights[0].astype(np.float32), np.exp(weights[1]).astype(np.float32), np.exp(weights[2]).astype(np.float32))


@dataclass
class Labelled:
    """Posterior mass of each language in each text (0 without letters), and the spans of one label: text, place in it
    (code points), label, mean posterior."""

    mass: np.ndarray
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    label: np.ndarray
    score: np.ndarray


def label(model: Model, texts: list[str]) -> Labelled:
    mass = np.zeros((len(texts), len(model.labels)))
    size = np.cumsum([len(t) + 1 for t in texts])
    held, begin, at, spans = [], 0, 0, [[np.zeros(0, np.int64)] * 4 + [np.zeros(0)]]
    while at < len(texts):
        before = size[at - 1] if at else 0
        n = max(1, int(np.searchsorted(size, before + PASS, side="right")) - at)
        points, starts, ends, count = _words(texts[at : at + n])
        keys, where, which = np.unique(spans_hash(points, starts, ends), return_index=True, return_inverse=True)
        shift = np.repeat(np.concatenate(([0], size[at : at + n - 1] - before)), count)
        held.append((model.emissions(keys, points, starts[where], ends[where])[which], count, starts - shift, ends - shift))
        at += n
        if at == len(texts) or sum(len(h[0]) for h in held) > TOGETHER:
            emission, length, start, end = (np.concatenate(x) for x in zip(*held, strict=True))
            has = length > 0
            if has.any():
                post = _posteriors(emission, length[has], model.step, model.start)
                mass[begin:at][has] = np.add.reduceat(post.astype(np.float64), (np.cumsum(length) - length)[has], axis=0)
                spans.append(_spans(post, begin + np.repeat(np.arange(len(length)), length), start, end))
            held, begin = [], at
    return Labelled(mass, *(np.concatenate(x) for x in zip(*spans, strict=True)))


def _spans(post: np.ndarray, text: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Runs of words of one text with one label: text, start, end, label, mean posterior."""
    best = post.argmax(axis=1)
    first = np.flatnonzero(np.append(True, (best[1:] != best[:-1]) | (text[1:] != text[:-1])))
    last = np.append(first[1:], len(best)) - 1
    sums = np.add.reduceat(post[np.arange(len(best)), best].astype(np.float64), first)
    return [text[first], start[first], end[last], best[first], sums / (last - first + 1)]


_SPAN = "array<struct<start:long,end:long,lang:string,score:double>>"


def _labeller(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            found = label(model, [t or "" for t in batch.column(1).to_pylist()]) if model else Labelled(np.zeros((n, 1)), *[np.zeros(0, np.int64)] * 4, np.zeros(0))
            names = pa.array([*(model.labels if model else []), UNKNOWN])
            total = found.mass.sum(axis=1)
            lang = names.take(pa.array(np.where(total > 0, found.mass.argmax(axis=1), len(names) - 1)))
            score = np.clip(found.mass.max(axis=1) / np.maximum(total, 1e-300), 0, 1)
            each = pa.StructArray.from_arrays([pa.array(found.start), pa.array(found.end), names.take(pa.array(found.label)), pa.array(np.clip(found.score, 0, 1))], names=["start", "end", "lang", "score"])
            cut = np.searchsorted(found.text, np.arange(n + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), lang, pa.array(score), pa.array(np.maximum(np.diff(cut) - 1, 0).astype(np.int64)), pa.ListArray.from_arrays(pa.array(cut), each)], names=["doc_id", "lang_pred", "score", "n_switches", "spans"])

    return run


def learned(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fit on documents with a language, but for those whose crc32(doc_id) mod 5 is 0."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null and coalesce(crc32(cast(doc_id as string)) % 5 <> 0, true)")
    order = F.xxhash64("doc_id", F.lit("language"))
    many = small(stage(rows.groupBy("lang").count(), "many"))
    # about twice the sample of each language passes by its hash, so no language is ranked whole
    some = rows.join(many, "lang").where(F.pmod(order, F.lit(1_000_003)) < F.lit(2_000_006.0 * sample + 20e6) / F.col("count"))
    ranked = some.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy(order, "doc_id", "text"))).where(F.col("n") <= sample)
    found = ranked.select("lang", "n", F.substring("text", 1, READ).alias("text")).toArrow().sort_by([("lang", "ascending"), ("n", "ascending")])
    return fit(found["text"].to_pylist(), found["lang"].to_pylist())


def languages(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_switches, spans (start and end in code points, lang, mean posterior of the words)
    for every row of docs (doc_id, text, lang). One pass, no shuffle of texts."""
    model = learned(docs, sample)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_labeller(model), f"doc_id long, lang_pred string, score double, n_switches long, spans {_SPAN}")
    return out.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "n_switches", "spans")
