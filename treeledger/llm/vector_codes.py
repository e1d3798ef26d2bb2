"""Vectors as codes of a product quantiser whose nearest entries are found by norm.

Vectors become whole numbers and are cut into parts; each part position has a codebook of its own that rounds of assigning and
averaging improve. The entries of a codebook are sorted by norm. A part is first measured against the entry of the
nearest norm; an entry can be as near as that only if its norm differs by no more than that distance, so the interval of
such norms is found by binary search and its entries, both ends included, are measured exactly. Ties go to the lower index.

Defined results: rows whose vector is null or holds a null or a number that is not finite (or whose multiple is no long) are
left out, and so are vectors of another length than the commonest. Where the length is no multiple of the number of parts,
part i goes from floor(i * length / parts) to floor((i + 1) * length / parts). Fewer rows than entries: as many entries
as rows. Rows with one vec_id start in the order of their vectors, null ids last, and each gives a row. An error that is no
long is null. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeledger.llm.lattice import bounds, exact_sums, halves, matrix, on_grid
from treeledger.llm.staging import small, stage

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Pairs of a part and an entry that are measured at once.
PAIRS = 1 << 18


def _squared(a: np.ndarray) -> np.ndarray:
    return (a * a).sum(axis=1)


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each point's nearest entry, the lower one of equally near ones, and the squared distance. Whole numbers, of a
    kind that holds all squares and sums."""
    order = np.argsort(np.sqrt(_squared(entries).astype(float)), kind="stable")
    ring = entries[order]
    norm = np.sqrt(_squared(ring).astype(float))
    index, distance = np.zeros(len(points), np.int64), np.zeros(len(points), points.dtype)
    step = max(1, PAIRS // len(entries))
    for start in range(0, len(points), step):
        part = points[start : start + step]
        own = np.sqrt(_squared(part).astype(float))
        right = np.clip(np.searchsorted(norm, own), 0, len(norm) - 1)
        left = np.maximum(right - 1, 0)
        first = np.where(np.abs(norm[left] - own) <= np.abs(norm[right] - own), left, right)
        best = _squared(part - ring[first])
        reach = np.sqrt(best.astype(float))
        slack = 1e-12 * (own + norm[-1])  # norms are rounded; the interval may only be too wide
        low = np.searchsorted(norm, own - reach - slack, side="left")
        many = np.searchsorted(norm, own + reach + slack, side="right") - low
        row = np.repeat(np.arange(len(part)), many)
        place = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
        told = _squared(part[row] - ring[place])
        by = np.lexsort((order[place], told, row)) if told.dtype != object else sorted(range(len(row)), key=lambda i: (row[i], told[i], order[place[i]]))
        by = np.asarray(by)[np.cumsum(many) - many]
        index[start : start + step], distance[start : start + step] = order[place[by]], told[by]
    return index, distance


class Codebooks:
    """Entries x length, cut into parts; small and the same in every task."""

    def __init__(self, entries: list[list[int]], parts: int, wide: bool) -> None:
        self.entries, self.parts = entries, parts
        length = len(entries[0])
        self.cuts = [length * i // parts for i in range(parts + 1)]
        self.kind = object if wide else np.int64

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of every part of every row, and the rows' errors."""
        x, books = x.astype(self.kind), np.array(self.entries, self.kind)
        index, error = np.zeros((len(x), self.parts), np.int64), np.zeros(len(x), self.kind)
        for p, (a, z) in enumerate(zip(self.cuts, self.cuts[1:], strict=False)):
            if a < z and len(x):
                index[:, p], distance = nearest(x[:, a:z], books[:, a:z])
                error = error + distance
        return index, error

    def sums(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """In halves: the sum of the parts of each entry, by entry and component, and after them their number by entry and
        part."""
        index, _ = self.assign(x)
        k, high, low = len(self.entries), *halves(x)
        total = np.zeros((2, k, x.shape[1] + self.parts), np.int64)
        for p, (a, z) in enumerate(zip(self.cuts, self.cuts[1:], strict=False)):
            for j in range(k):
                mine = index[:, p] == j
                total[0, j, a:z], total[1, j, a:z] = high[mine, a:z].sum(axis=0), low[mine, a:z].sum(axis=0)
                total[1, j, x.shape[1] + p] = mine.sum()
        return total[0].reshape(-1), total[1].reshape(-1)

    def moved(self, sums: list[int]) -> Codebooks:
        """Each entry at the floor of its parts' mean; entries without parts stay."""
        length = self.cuts[-1]
        width = length + self.parts
        out = [list(e) for e in self.entries]
        for j, entry in enumerate(out):
            for p, (a, z) in enumerate(zip(self.cuts, self.cuts[1:], strict=False)):
                if n := sums[j * width + length + p]:
                    entry[a:z] = [s // n for s in sums[j * width + a : j * width + z]]
        return Codebooks(out, self.parts, self.kind is object)

    def digest(self) -> str:
        """SHA-256 of all components by part, entry and place."""
        numbers = [str(e[i]) for a, z in zip(self.cuts, self.cuts[1:], strict=False) for e in self.entries for i in range(a, z)]
        return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def trained(rows: DataFrame, length: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks of rows (vec_id, x); None without rows."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()
    if not first:
        return None
    _, low, high = bounds(rows)
    books = Codebooks([list(r.x) for r in first], parts, length * max(high - low, abs(low), abs(high)) ** 2 >= 1 << 62)
    for _ in range(rounds):
        told = lambda batch, books=books: books.sums(matrix(batch.column(0), length))
        books = books.moved(exact_sums(rows.select("x"), told, len(first) * (length + parts)))
    return books


def coded(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks | None]:
    """vec_id, code, error, label_error, codebooks_sha256 for every usable row of vectors (vec_id, embedding, label), and the
    codebooks. entries: 256 at most."""
    rows, length = on_grid(vectors, SCALE, 0, "label")
    books = trained(rows, length, parts, entries, rounds)
    kinds = dict(rows.dtypes)
    if books is None:
        return vectors.sparkSession.createDataFrame([], f"vec_id {kinds['vec_id']}, code string, error long, label_error long, codebooks_sha256 string"), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, error = books.assign(matrix(batch.column(2), length))
            error = [int(e) if e < 1 << 63 else None for e in error]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([bytes(i).hex() for i in index.astype(np.uint8)], pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    told = stage(rows.select("vec_id", "label", "x").mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"), "codes")
    known = F.bool_and(F.col("error").isNotNull())
    total = F.when(known, F.sum(F.col("error").cast("decimal(38,0)"))).try_cast("long")
    by = stage(told.groupBy(F.col("label").alias("of")).agg(total.alias("label_error")), "labels")
    out = told.join(small(by), F.col("label").eqNullSafe(F.col("of")), "left")
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256")), books
