"""Token counts of whole texts under a BPE vocabulary, by rank-synchronous merging of ragged arrays.

The vocabulary file (tokenizers JSON: NFC, white space, lower case, a split pattern,
byte-level symbols, merges with an end-of-word suffix) is a parameter. A batch's
distinct pre-tokens lie end to end in one numpy array; every round applies each
sequence's lowest-ranked pair in all sequences at once, until no pair has a rank.

What is a letter, a number, a blank or a small letter is asked of the library that the file belongs to, as such tables differ
between versions of Unicode.

Defined results: a null text counts as empty (0 bytes, 0 tokens); special strings inside a text are
one token each, as in the library's default. Rows are independent, so repeats and ties
change nothing. A text of any length is split and merged whole, in its task alone, which holds some 40 bytes for each of its
bytes. An empty table gives no rows. Other columns of the input are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeledger.llm.text import BLANK, LETTER, NUMBER, OTHER, spans_hash

#: A task forgets the counts of pre-tokens beyond so many; they are counted anew when met again.
REMEMBERED = 800_000
#: Pre-tokens that are merged together; code points that are split together (a longer text is split alone).
TOGETHER, PASS = 100_000, 2_000_000

_NONE = np.int64(1 << 40)
#: What this module reads a split pattern as: contractions, runs of letters, single digits, runs of the rest.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SHORT = {"s", "t", "m", "d"}
_LONG = {"re", "ve", "ll"}


@lru_cache(maxsize=2)
def point_classes(path: str) -> np.ndarray:
    """Class of each code point, as the library splits for the vocabulary file: white space, letter, number or other."""
    from tokenizers import Tokenizer

    splitter = Tokenizer.from_file(path).pre_tokenizer
    out = np.full(0x110000, BLANK, np.uint8)
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    # in the order of code points a pre-token is a run of one class, which its first one tells beside a letter and a stop
    runs = [span for _, span in splitter.pre_tokenize_str("".join(map(chr, points)))]
    asked = {a for _, (a, _) in splitter.pre_tokenize_str("\n".join(f"a{chr(points[a])}." for a, _ in runs))}
    for i, (a, b) in enumerate(runs):
        kind = LETTER if 4 * i + 1 not in asked else NUMBER if 4 * i + 2 in asked else OTHER
        out[points[a] : points[b - 1] + 1] = kind
    return out


def split(text: str, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pre-tokens of a normalised text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = classes[points]
    before = np.concatenate(([np.uint8(BLANK)], kind[:-1]))
    start = (kind != BLANK) & ((kind != before) | (kind == NUMBER))
    inside = np.zeros(len(kind) + 3, bool)  # ends a pre-token, if it isn't a blank's place
    for q in np.flatnonzero((points == 39) & (before != OTHER)).tolist():
        n = 2 if text[q + 1 : q + 2] in _SHORT else 3 if text[q + 1 : q + 3] in _LONG else 0
        if n:
            start[q + 1] = False
            inside[q + n] = True
    start |= inside[: len(kind)] & (kind != BLANK)
    starts = np.flatnonzero(start)
    # a pre-token ends where the next starts, less the blanks between
    blank_before = np.cumsum(kind == BLANK)
    ends = np.append(starts[1:], len(kind))
    ends = ends - (blank_before[ends - 1] - blank_before[starts]) if len(starts) else ends[:0]
    return starts, ends


class _Pairs:
    """Rank and result of a pair of symbols, from two hash tables; what collides in the first is in the second."""

    BITS = 20

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = np.append(keys, -1)
        rng = np.random.default_rng(7)
        self.odd = [int(rng.integers(1 << 62)) | 1]
        self.table = [np.full(1 << self.BITS, len(keys), np.int32)]
        at = self._slot(keys, self.odd[0])
        _, first = np.unique(at, return_index=True)
        self.table[0][at[first]] = first
        rest = np.setdiff1d(np.arange(len(keys)), first)
        while len(self.odd) < 2:
            odd = int(rng.integers(1 << 62)) | 1
            at = self._slot(keys[rest], odd)
            if len(np.unique(at)) == len(rest):
                self.odd.append(odd)
                self.table.append(np.full(1 << self.BITS, len(keys), np.int32))
                self.table[1][at] = rest

    def _slot(self, key: np.ndarray, odd: int) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(odd)) >> np.uint64(64 - self.BITS)

    def find(self, key: np.ndarray) -> np.ndarray:
        """Index of each key, or the number of keys."""
        out = self.table[0][self._slot(key, self.odd[0])]
        miss = np.flatnonzero(self.keys[out] != key)
        again = self.table[1][self._slot(key[miss], self.odd[1])]
        out[miss] = np.where(self.keys[again] == key[miss], again, len(self.keys) - 1)
        return out


class BytePairs:
    """Counts of symbols that are left when all merges of a vocabulary file are done."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] != PATTERN:
            raise ValueError(f"not a lower-casing BPE vocabulary with word ends: {path}")
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right, made = (np.array([vocab[f(p)] for p in pairs], np.int64) for f in (lambda p: p[0], lambda p: p[1], lambda p: p[0] + p[1]))
        self.size = max(vocab.values()) + 1
        keys = left * self.size + right
        self.pairs, self.made = _Pairs(keys), np.append(made, 0)
        self.ranks = np.append(np.arange(len(keys)), _NONE)
        # printable bytes stand for themselves, the others for the characters from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = iter(range(256, 512))
        symbol = [chr(b) if b in plain else chr(next(other)) for b in range(256)]
        self.inner = np.array([vocab[c] for c in symbol], np.int64)
        self.last = np.array([vocab[c + suffix] for c in symbol], np.int64)
        special = [regex.escape(t["content"]) for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(special)) if special else None
        self.known: dict[str, int] = {}
        self.library, self.classes = Tokenizer.from_file(path).normalizer, point_classes(path)

    def normal(self, text: str) -> str:
        """Composed and in lower case, as the library does it."""
        return text.lower() if text.isascii() else self.library.normalize_str(text)

    def merged(self, words: list[str]) -> np.ndarray:
        """Number of symbols of each word after all merges."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        length = np.array([len(r) for r in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(length)
        sym = self.inner[data]
        sym[ends - 1] = self.last[data[ends - 1]]
        word = np.repeat(np.arange(len(raw)), length)
        out = length.copy()
        while len(sym) > 1:
            key = sym[:-1] * self.size + sym[1:]
            at = self.pairs.find(key)
            rank = np.append(np.where(word[:-1] == word[1:], self.ranks[at], _NONE), _NONE)
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            lowest = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(sym)))
            going = lowest < _NONE
            out[word[first]] = size
            if not going.any():
                break
            pick = np.flatnonzero((rank == np.repeat(lowest, size)) & np.repeat(going, size))
            # of overlapping pairs (a run like aaa) every second one merges, from the left
            new_run = np.concatenate(([True], (np.diff(pick) != 1) | (word[pick[1:]] != word[pick[:-1]])))
            start = np.maximum.accumulate(np.where(new_run, np.arange(len(pick)), 0))
            pick = pick[(np.arange(len(pick)) - start) % 2 == 0]
            sym[pick] = self.made[at[pick]]
            keep = np.repeat(going, size)
            keep[pick + 1] = False
            short = np.bincount(word[pick], minlength=len(out))
            out -= short
            sym, word = sym[keep], word[keep]
        return out

    def counts(self, texts: list[str]) -> list[int]:
        """Number of tokens of each text."""
        out, parts, owner = np.zeros(len(texts), np.int64), [], []
        for i, text in enumerate(texts):
            own = self.special.split(text) if self.special and "<|" in text else [text]
            out[i] = len(own) - 1
            parts += map(self.normal, own)
            owner += [i] * len(own)
        size = np.cumsum([len(p) + 1 for p in parts])
        at = 0
        while at < len(parts):
            n = max(1, int(np.searchsorted(size, (size[at - 1] if at else 0) + PASS, side="right")) - at)
            joined = "\n".join(parts[at : at + n])
            starts, ends = split(joined, self.classes)
            tokens = self._each(joined, starts, ends)
            first = np.searchsorted(starts, size[at : at + n] - (size[at - 1] if at else 0))
            np.add.at(out, owner[at : at + n], np.diff(np.concatenate(([0], np.concatenate(([0], np.cumsum(tokens)))[first]))))
            at += n
        return out.tolist()

    def _each(self, text: str, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Number of tokens of each pre-token. What is remembered is told apart by its characters."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        _, where, which = np.unique(spans_hash(points, starts, ends), return_index=True, return_inverse=True)
        if not _same(points, starts, ends, where[which]):
            _, where, which = np.unique(np.array([text[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], object), return_index=True, return_inverse=True)
        words = [text[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)]
        got = list(map(self.known.get, words))
        new = [i for i, n in enumerate(got) if n is None]
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
        for i in range(0, len(new), TOGETHER):
            part = new[i : i + TOGETHER]
            counts = self.merged([words[k] for k in part]).tolist()
            self.known.update(zip([words[k] for k in part], counts, strict=True))
            for k, n in zip(part, counts, strict=True):
                got[k] = n
        return np.array(got, np.int64)[which] if got else np.zeros(0, np.int64)


def _same(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, like: np.ndarray) -> bool:
    """Whether each span holds what the span that it is like holds."""
    size = ends - starts
    if (size != size[like]).any():
        return False
    nth = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    return bool((points[np.repeat(starts, size) + nth] == points[np.repeat(starts[like], size) + nth]).all())


@lru_cache(maxsize=2)
def _loaded(path: str) -> BytePairs:
    return BytePairs(path)


def _counter(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = _loaded(path)
        for batch in batches:
            for row in range(0, batch.num_rows, 512):
                part = batch.slice(row, 512)
                texts = [t or "" for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array(pairs.counts(texts), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit for every row of docs (doc_id, text).

    vocabulary: path of the file, readable on every executor. One pass, no shuffle.
    """
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_counter(vocabulary), "doc_id long, n_bytes long, n_tokens long")
    return counted.select("*", (F.col("n_tokens") > limit).alias("over_limit"))
