"""Near-duplicate vectors by randomised-rotation binary codes.

Each vector is turned by several random rotations (each three times random signs and a Hadamard transform, so a
rotation is a few signs and not a matrix); the signs of the coordinates are its codes, and the inner product
of a code with its vector is kept as the correction that makes estimates of inner products unbiased.
Bands of code bits bring vectors of one label together. There the estimate, averaged over the rotations, and
its confidence bound decide which pairs are recomputed exactly, in double precision.
The number of bits of a band follows the largest label and the number of bands follows
from that, so that a pair at the threshold shares no band with a probability of MISS.

Defined results: a vector that is null, zero, or holds a null or a non-finite number links with nothing, as does a row
without label or vec_id (n_links 0, a component of its own, kept). Only vectors of equal length are compared.
Each repeated row counts as a vector, and so do unequal vectors with one vec_id; a component's id is the smallest vec_id
in it. Other columns of the input are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeledger.llm.cells import in_cells, runs, sides
from treeledger.llm.components import components, forest
from treeledger.llm.staging import drop, stage
from treeledger.llm.text import mix

COSINE = 0.98
#: Chance that a pair at the threshold is in no common bucket; standard deviations of an estimate that are allowed for.
MISS, SIGMAS = 1e-6, 5.0
#: Padded length up to which rotations are held as matrices.
DENSE = 256
#: Vectors of a bucket that are compared in one task step; a larger bucket is compared block by block.
BLOCK = 256


class Codes:
    """The rotations and how bits become bands; small and the same in every task."""

    def __init__(self, largest: int, cosine: float = COSINE) -> None:
        self.cosine = cosine
        self.bits = min(32, max(16, math.ceil(math.log2(max(2, largest)))))
        agree = (1 - math.acos(cosine) / math.pi) ** self.bits
        self.bands = math.ceil(math.log(MISS) / math.log(1 - agree))
        self.rotations = math.ceil(self.bands / (64 // self.bits))

    def turns(self, width: int) -> np.ndarray:
        """The rotations of vectors of that length, padded to a power of two: of short ones matrices, rotations x width x
        size, of longer ones the signs alone, rotations x 3 x size."""
        size = max(64, 1 << (width - 1).bit_length())
        signs = np.random.default_rng(size).integers(0, 2, (self.rotations, 3, size)).astype(np.float32) * 2 - 1
        return np.stack([_hadamard(np.eye(width, dtype=np.float32), s) for s in signs]) if size <= DENSE else signs

    def encode(self, unit: np.ndarray, turns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sign bits (packed, by rotation) and corrections <code, vector> of unit vectors."""
        turned = _turned(unit, turns)
        return np.packbits(turned > 0, axis=2).transpose(1, 0, 2), np.abs(turned).sum(axis=2).T / math.sqrt(turned.shape[2])

    def banded(self, bits: np.ndarray) -> np.ndarray:
        """The number that each band of each code spells."""
        flat = np.unpackbits(bits, axis=2)[:, :, : 64 // self.bits * self.bits].reshape(len(bits), self.rotations, -1, self.bits)
        number = flat.astype(np.uint64) @ (np.uint64(1) << np.arange(self.bits, dtype=np.uint64))
        return number.reshape(len(bits), -1)[:, : self.bands]


def _hadamard(unit: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Rows, padded with zeros, after one rotation: three times signs and a transform."""
    n, size = len(unit), signs.shape[1]
    x = np.zeros((n, size), np.float32)
    x[:, : unit.shape[1]] = unit
    for s in signs:
        x *= s
        step = 1
        while step < size:
            pair = x.reshape(n, -1, 2, step)
            x = np.stack((pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]), axis=2).reshape(n, size)
            step *= 2
        x *= np.float32(1 / math.sqrt(size))
    return x


def _turned(unit: np.ndarray, turns: np.ndarray) -> np.ndarray:
    """Rows after each rotation: rotations x rows x size."""
    return unit @ turns if turns.shape[2] <= DENSE else np.stack([_hadamard(unit, s) for s in turns])


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, by way of rows whose largest number is 1, so that no square overflows."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of each length, and their matrix."""
    length = np.asarray(column.value_lengths())
    for n in np.unique(length).tolist():
        rows = np.flatnonzero(length == n)
        yield rows, np.asarray(column.take(pa.array(rows)).flatten()).reshape(len(rows), n)


def _coded(codes: Codes):
    """rep, same, embedding -> rep, bits, corrections, keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            rep, same = (np.asarray(batch.column(i)) for i in range(2))
            for rows, x in _vectors(batch.column(2)):
                x = _unit(x)
                if x.shape[1] not in known:
                    known[x.shape[1]] = codes.turns(x.shape[1])
                bits, corrections = codes.encode(x.astype(np.float32), known[x.shape[1]])
                number = codes.banded(bits)
                seed = mix(same[rows].view(np.uint64) + np.uint64(x.shape[1]))[:, None]
                keys = mix(seed ^ mix(number * np.uint64(1024) + np.arange(codes.bands, dtype=np.uint64))).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(rep[rows]), pa.array([b.tobytes() for b in bits], pa.binary()), pa.array([c.astype(np.float32).tobytes() for c in corrections], pa.binary()), pa.array(list(keys), pa.list_(pa.int64()))], names=["rep", "bits", "corrections", "keys"])

    return run


def _linked(codes: Codes, x: np.ndarray, bits: np.ndarray, corrections: np.ndarray, turns: np.ndarray, left: np.ndarray, right: np.ndarray, band: int):
    """Pairs (of indices left x right) that first meet in this band and whose cosine is large enough."""
    unit = _unit(x).astype(np.float32)
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    norm = np.linalg.norm(x, axis=1)
    number = codes.banded(bits)
    size = turns.shape[2]
    signs = (np.unpackbits(bits[left], axis=2).astype(np.float32) * 2 - 1) / (math.sqrt(size) * corrections[left])[:, :, None]
    estimate = (signs.transpose(1, 0, 2) @ _turned(unit[right], turns).transpose(0, 2, 1)).mean(axis=0)
    spread = np.sqrt(np.mean((1 - corrections[left] ** 2) / corrections[left] ** 2, axis=1) / (size - 1) / codes.rotations)
    a, b = np.nonzero(estimate + SIGMAS * spread[:, None] >= codes.cosine)
    a, b = left[a], right[b]
    turn = a < b if left is right else np.ones(len(a), bool)
    a, b = a[turn], b[turn]
    first = (number[a] == number[b]).argmax(axis=1) == band
    a, b = a[first], b[first]
    cosine = np.einsum("nd,nd->n", x[a], x[b]) / (norm[a] * norm[b])
    a, b = a[cosine >= codes.cosine], b[cosine >= codes.cosine]
    return a, b


def _compare(codes: Codes):
    """Rows in order of cell -> for each vector of a cell how many it is linked with there (a, m), and links (a, b) that keep
    together what the cell's links do. A cell is one pair of blocks of one bucket, at most 2 * BLOCK rows or so."""

    def told(cell: pa.Table, known: dict) -> pa.RecordBatch | None:
        x = np.asarray(cell["embedding"].combine_chunks().flatten()).reshape(cell.num_rows, -1)
        if x.shape[1] not in known:
            known[x.shape[1]] = codes.turns(x.shape[1])
        turns = known[x.shape[1]]
        bits = np.frombuffer(b"".join(cell["bits"].to_pylist()), np.uint8).reshape(len(x), codes.rotations, -1)
        corrections = np.frombuffer(b"".join(cell["corrections"].to_pylist()), np.float32).reshape(len(x), -1)
        left, right = sides(cell)
        if not len(left) or not len(right):
            return None
        a, b = _linked(codes, x, bits, corrections, turns, left, right, cell["band"][0].as_py())
        if not len(a):
            return None
        rep, many = np.asarray(cell["rep"]), np.asarray(cell["many"])
        others = np.zeros(len(x), np.int64)
        np.add.at(others, a, many[b])
        np.add.at(others, b, many[a])
        node, low = forest(len(x), a, b)
        has = np.flatnonzero(others)
        ends = pa.concat_arrays([pa.nulls(len(has), pa.int64()), pa.array(rep[low], pa.int64())])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate((rep[has], rep[node]))), ends, pa.array(np.concatenate((others[has], np.zeros(len(node), np.int64))))], names=["a", "b", "m"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {}
        for cell in runs(batches, "key", "i", "j"):
            if cell.num_rows > 1 and (out := told(cell, known)):
                yield out

    return run


def similar_vectors(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding, label)."""
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"), "label")
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.forall("embedding", number) & F.exists("embedding", lambda x: x != 0)
    rows = stage(rows.withColumn("usable", F.coalesce(usable, F.lit(False))), "rows")
    # a class of equal vectors has a number of its own; as it is written, the number stays
    classes = rows.where("usable").groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("many"))
    classes = stage(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    codes = Codes(largest, cosine)
    coded = stage(classes.select("rep", F.xxhash64("label").alias("same"), "embedding").mapInArrow(_coded(codes), "rep long, bits binary, corrections binary, keys array<long>"), "coded")
    keyed = coded.select("rep", F.posexplode("keys").alias("band", "key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = in_cells(keyed.join(shared, "key"), "key", "rep", F.col("n"), block).drop("n")
    full = met.join(coded.select("rep", "bits", "corrections").join(classes.select("rep", "embedding", "many"), "rep"), "rep")
    cells = full.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    told = stage(cells.select("key", "i", "j", "band", "block", "rep", "bits", "corrections", "embedding", "many").mapInArrow(_compare(codes), "a long, b long, m long"), "told")
    drop(coded)
    found = components(told.where("b is not null").select("a", "b"))
    counted = told.where("b is null").groupBy("a").agg(F.sum("m").alias("others"))
    known = classes.join(counted, F.col("rep") == F.col("a"), "left").join(found, F.col("rep") == F.col("vertex"), "left")
    known = stage(known.select("label", "embedding", "least", (F.col("many") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component_id", "rep").alias("component")), "known")
    first = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(first, "component").select("label", "embedding", "n_links", "component_id", F.lit(True).alias("usable"))
    out = rows.join(known, ["usable", "label", "embedding"], "left")
    component = F.when(F.col("usable"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.when(F.col("usable"), F.col("n_links")).otherwise(0).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
