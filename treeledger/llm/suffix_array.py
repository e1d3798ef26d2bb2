"""Suffix sorting of byte arrays in numpy, to a depth: the part of a suffix-array deduplication that a task does."""

from __future__ import annotations

import numpy as np


def _coded(text: np.ndarray, depth: int) -> tuple[np.ndarray, int, int]:
    """From every place, as many bytes as fit into 64 bits, as one number in their order; how many; and bits for each.

    Bytes are numbered by rank among those that occur, from 1 on: beyond the end are zeros, so a suffix comes before what it begins.
    """
    occurs = np.bincount(text, minlength=256) > 0
    rank = np.cumsum(occurs).astype(np.uint64)
    bits = int(rank[-1]).bit_length()
    most = 64 // bits
    x = np.concatenate((rank[text], np.zeros(depth + 2 * most, np.uint64)))
    width = 1
    while width < most:
        more = min(width, most - width)
        # numbers of `width` bytes: the first `more` of the next one follow
        x = x[: len(x) - width] << np.uint64(bits * more) | x[width:] >> np.uint64(bits * (width - more))
        width += more
    return x, most, bits


def sorted_strings(text: np.ndarray, places: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """places in order of the suffixes there, compared over `depth` bytes, and whether each has a common prefix of less
    than that with the one before it.

    The first bytes that fit into 64 bits are sorted. After that only places that are not told apart yet are sorted, by the
    number of their group and as many bytes more as fit beside it; a group that is equal to the full depth is done.
    """
    if not len(places):
        return places, np.zeros(0, bool)
    words, most, bits = _coded(text, depth)
    key = words[places]
    done = min(most, depth)
    key >>= np.uint64(bits * (most - done))
    order = np.argsort(key)
    places, key = places[order], key[order]
    new = np.append(True, key[1:] != key[:-1])
    live = np.arange(len(places))
    while done < depth:
        starts = new[live]
        open_ = ~(starts & np.append(starts[1:], True))
        live, starts = live[open_], starts[open_]
        if not len(live):
            break
        own = places[live]
        first = np.flatnonzero(starts)
        same = np.ones(len(live) - 1, bool)
        for k in range(done, depth, most):
            word = words[own + k] >> np.uint64(bits * max(0, most - (depth - k)))
            same &= word[1:] == word[:-1]
        differs = np.logical_or.reduceat(np.append(False, ~same) & ~starts, first)
        group = np.cumsum(starts) - 1
        stay = differs[group]
        live, own = live[stay], own[stay]
        if not len(live):
            break
        group = (np.cumsum(differs) - 1)[group[stay]].astype(np.uint64)
        room = 64 - int(group[-1]).bit_length()
        more = min(most, room // bits, depth - done)
        key = group << np.uint64(bits * more) if bits * more < 64 else np.zeros(len(group), np.uint64)
        key |= words[own + done] >> np.uint64(bits * (most - more))
        order = np.argsort(key)
        places[live], key = own[order], key[order]
        new[live[1:]] |= key[1:] != key[:-1]
        done += more
    return places, new


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of all suffixes in order of their first `depth` bytes."""
    return sorted_strings(text, np.arange(len(text)), depth)[0]
