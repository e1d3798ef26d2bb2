"""Whole texts of an Arrow batch as byte arrays: words, their hashes, shingles. Runs inside tasks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Bytes of text that one numpy pass holds at once; a longer text is a pass of its own.
PASS_BYTES = 2 << 20

#: Bytes that separate words: space and \t \n \v \f \r.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Unicode white space.
BLANKS = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
BLANK, LETTER, NUMBER, OTHER = range(4)

#: Bytes of a block of a long span; such a span is hashed by the hashes of its blocks.
BLOCK_BYTES = 256
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def point_classes() -> np.ndarray:
    """Class of each code point: white space, letter, number or other."""
    out = np.full(0x110000, OTHER, np.uint8)
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, what in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(what, everything):
            a, b = (x + 0x800 * (x >= 0xD800) for x in (m.start(), m.end() - 1))
            out[a : b + 1] = kind
    out[BLANKS] = BLANK
    return out


def passes(column: pa.Array, most: int = PASS_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of at most so many bytes; a line feed follows each text; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    sizes = np.asarray(pc.binary_length(column)).astype(np.int64)
    row = 0
    while row < len(column):
        total = np.cumsum(sizes[row : row + 65536])
        n = max(1, int(np.searchsorted(total, most, side="right")))
        part = column.slice(row, n)
        joined = pc.binary_join_element_wise(part, pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
        _, offsets, data = joined.buffers()
        offsets = np.frombuffer(offsets, np.int64)[joined.offset : joined.offset + n + 1]
        data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        yield row, data, offsets - offsets[0]
        row += n


#: Bytes that are no part of a run of letters: ASCII but for A-Z and a-z.
NO_LETTER = np.ones(256, bool)
NO_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
#: Bytes that end a sentence.
STOP = np.zeros(256, bool)
STOP[[10, 33, 46, 63]] = True


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the index of its first word for each text (one more at the end)."""
    gap = separator[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap)).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, A-Z folded."""
    return spans_hash(LOWER[data], starts, ends)


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of an array of unsigned integers.

    A span's bytes are taken eight at a time, each eight mixed by a bijection into what came before, starting from its
    length. So spans of one length of at most eight bytes never share a hash, and no sums or products of the
    contents can cancel.
    """
    width = values.dtype.itemsize
    data = np.concatenate((np.ascontiguousarray(values).view(np.uint8), np.zeros(8, np.uint8)))
    at, size = np.asarray(starts, np.int64) * width, (np.asarray(ends, np.int64) - starts) * width
    return _hashed(data, at, size)


def _hashed(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of data[at:at + size]; data goes on for eight bytes after the last span."""
    acc = mix(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    large = np.flatnonzero(size > BLOCK_BYTES)
    if len(large):
        blocks = -(-size[large] // BLOCK_BYTES)
        first = np.cumsum(blocks) - blocks
        nth = (np.arange(int(blocks.sum())) - np.repeat(first, blocks)) * BLOCK_BYTES
        inner = _hashed(data, np.repeat(at[large], blocks) + nth, np.minimum(BLOCK_BYTES, np.repeat(size[large], blocks) - nth))
        acc[large] = mix(acc[large] ^ spans_hash(inner, first, first + blocks))
    eights = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    live = np.flatnonzero((size > 0) & (size <= BLOCK_BYTES))
    done = 0
    while len(live):
        rest = size[live] - done
        lane = eights[at[live] + done] & _MASK[np.minimum(rest, 8)]
        acc[live] = mix(acc[live] * np.uint64(0xD6E8FEB86659FD93) ^ lane)
        live, done = live[rest > 8], done + 8
    return acc


def shingle_hashes(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of every run of `width` words; a text with fewer words gives all of them as one."""
    count = np.diff(first)
    at = np.repeat(np.arange(len(count)), count)
    acc = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    for i in range(width):
        acc = acc * np.uint64(0xD1B54A32D192ED03) + hashes[i : i + len(acc)]
    inside = at[: len(acc)] == at[width - 1 :] if len(acc) else np.zeros(0, bool)
    doc, value = at[: len(acc)][inside], mix(acc[inside])
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for i in range(width - 1):
            has = count[short] > i
            whole[has] = whole[has] * np.uint64(0xD1B54A32D192ED03) + hashes[first[short[has]] + i]
        doc, value = np.concatenate((doc, short)), np.concatenate((value, mix(whole ^ np.uint64(0xA5A5A5A5A5A5A5A5))))
        order = np.argsort(doc, kind="stable")
        doc, value = doc[order], value[order]
    return doc, value


def distinct_per_text(doc: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct values in order; returns values and n + 1 offsets."""
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    keep = np.ones(len(doc), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    doc, value = doc[keep], value[keep]
    return value, np.searchsorted(doc, np.arange(n + 1))
