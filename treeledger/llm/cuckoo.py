"""A cuckoo filter over 64-bit keys whose operations take whole arrays. Runs inside tasks.

A key's fingerprint of 16 bits lies in one of two buckets of four slots, each of which follows from the other and the
fingerprint. A key may be put in several times: the filter then holds copies. What finds no room lies in a stash, so nothing
is ever lost: count() is never less than the copies put in, and more only where fingerprints coincide.
"""

from __future__ import annotations

import numpy as np

from treeledger.llm.text import mix

SLOTS = 4
#: Share of the slots that a new filter fills, and from which it is built anew with more buckets.
FILLED, CROWDED = 0.7, 0.9
#: Rounds of turning fingerprints out before those that are left go to the stash.
ROUNDS = 200


class Cuckoo:
    def __init__(self, table: np.ndarray, stash: np.ndarray | None = None) -> None:
        """table: buckets (a power of two) x SLOTS of uint16, 0 is free; stash: codes of what found no room."""
        self.table = table
        self.stash = np.zeros(0, np.int64) if stash is None else stash

    @classmethod
    def sized(cls, copies: int) -> Cuckoo:
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, copies) / (SLOTS * FILLED)))))
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def read(cls, table: bytes, stash: bytes) -> Cuckoo:
        return cls(np.frombuffer(table, np.uint16).reshape(-1, SLOTS).copy(), np.frombuffer(stash, np.int64))

    def written(self) -> tuple[bytes, bytes]:
        return self.table.tobytes(), self.stash.tobytes()

    @property
    def copies(self) -> int:
        return int(np.count_nonzero(self.table)) + len(self.stash)

    def crowded(self, more: int) -> bool:
        return self.copies + more > CROWDED * self.table.size

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprint and first bucket of each key."""
        x = mix(np.asarray(keys, np.int64).view(np.uint64))
        return ((x >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16), (x & np.uint64(len(self.table) - 1)).astype(np.int64)

    def _other(self, bucket: np.ndarray, print_: np.ndarray) -> np.ndarray:
        return bucket ^ (mix(print_.astype(np.uint64)) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def _code(self, bucket: np.ndarray, print_: np.ndarray) -> np.ndarray:
        return np.minimum(bucket, self._other(bucket, print_)) << 16 | print_.astype(np.int64)

    def _put(self, bucket: np.ndarray, print_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fill free slots; returns what found its bucket full."""
        order = np.argsort(bucket, kind="stable")
        bucket, print_ = bucket[order], print_[order]
        rank = np.arange(len(bucket)) - np.searchsorted(bucket, bucket)
        free = np.cumsum(self.table[bucket] == 0, axis=1)
        fits = rank < free[:, -1]
        self.table[bucket[fits], (free[fits] == rank[fits, None] + 1).argmax(axis=1)] = print_[fits]
        return bucket[~fits], print_[~fits]

    def insert(self, keys: np.ndarray) -> None:
        """One copy of each key; a key that occurs several times is put in as often."""
        print_, bucket = self._places(keys)
        bucket, print_ = self._put(bucket, print_)
        bucket, print_ = self._put(self._other(bucket, print_), print_)
        for turn in range(ROUNDS):
            if not len(bucket):
                return
            here, first = np.unique(bucket, return_index=True)  # one guest a bucket turns one lodger out
            slot = (print_[first].astype(np.int64) + turn) % SLOTS
            out = self.table[here, slot]
            self.table[here, slot] = print_[first]
            rest = np.delete(np.arange(len(bucket)), first)
            bucket, print_ = self._put(np.concatenate((bucket[rest], self._other(here, out))), np.concatenate((print_[rest], out)))
        self.stash = np.sort(np.concatenate((self.stash, self._code(bucket, print_))))

    def delete(self, keys: np.ndarray) -> None:
        """Take out one copy of each key. Only for copies that were put in."""
        print_, first = self._places(keys)
        while len(print_):
            second = self._other(first, print_)
            both = np.concatenate((self.table[first], self.table[second]), axis=1) == print_[:, None]
            at = both.argmax(axis=1)
            slot = np.where(at < SLOTS, first, second) * SLOTS + at % SLOTS
            slot[~both.any(axis=1)] = -1
            found, one = np.unique(slot, return_index=True)
            one = one[found >= 0]
            self.table.reshape(-1)[slot[one]] = 0
            left = np.ones(len(print_), bool)
            left[one] = False
            if not len(one):
                codes, n = np.unique(self._code(first, print_), return_counts=True)
                for code, k in zip(codes, n, strict=True):
                    self.stash = np.delete(self.stash, np.flatnonzero(self.stash == code)[:k])
                return
            print_, first = print_[left], first[left]

    def count(self, keys: np.ndarray) -> np.ndarray:
        """Copies of each key, or more where another key has its fingerprint and buckets."""
        print_, first = self._places(keys)
        second = self._other(first, print_)
        n = (self.table[first] == print_[:, None]).sum(axis=1)
        n += np.where(first == second, 0, (self.table[second] == print_[:, None]).sum(axis=1))
        if len(self.stash):
            code = self._code(first, print_)
            n += np.searchsorted(self.stash, code, side="right") - np.searchsorted(self.stash, code)
        return n
