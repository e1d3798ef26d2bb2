"""Vectors of whole numbers, and sums over them that stay exact at any size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeledger.llm.staging import stage

#: Numbers from here on are taken as infinite: as multiples of the grid they are no longs.
BEYOND = float(1 << 62)


def on_grid(vectors: DataFrame, scale: int, shift: int = 0, *more: str) -> tuple[DataFrame, int]:
    """vec_id, more, x (longs floor(scale * c) + shift) of the usable vectors, as a staged table, and the length of x.

    Rows whose vector is null or holds a null, a number that is not finite or one whose multiple is no long are left out. All
    vectors must have one length: those of another length than the commonest (of equally common ones the longest) are
    left out too.
    """
    c = F.col("embedding").cast("array<double>")
    fine = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < BEYOND / scale))
    rows = vectors.where(F.col("embedding").isNotNull() & F.coalesce(fine, F.lit(False)))
    rows = stage(rows.select("vec_id", *more, F.transform(c, lambda v: F.floor(v * scale).cast("long") + shift).alias("x")), "grid")
    lengths = rows.groupBy(F.size("x").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    if lengths is None:
        return rows, 0
    return rows.where(F.size("x") == lengths["length"]), lengths["length"]


def bounds(rows: DataFrame) -> tuple[int, int, int]:
    """Number of rows, least and largest component."""
    n, low, high = rows.agg(F.count("*"), F.min(F.array_min("x")), F.max(F.array_max("x"))).first()
    return n, low or 0, high or 0


def matrix(column: pa.Array, length: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), length)


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """High and low 32 bits, whose sums over a task stay longs."""
    return x >> 32, x & 0xFFFFFFFF


def exact_sums(rows: DataFrame, told: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]], cells: int) -> list[int]:
    """Sums over all rows of the cells that told(batch) gives in halves; each task sends one row a cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = np.zeros(cells, np.int64), np.zeros(cells, np.int64)
        for batch in batches:
            h, s = told(batch)
            high += h
            low += s
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells, dtype=np.int32)), pa.array(high), pa.array(low)], names=["cell", "high", "low"])

    long = "decimal(38,0)"  # of tasks' sums, which may exceed a long together
    found = rows.mapInArrow(run, "cell int, high long, low long").groupBy("cell").agg(F.sum(F.col("high").cast(long)).alias("high"), F.sum(F.col("low").cast(long)).alias("low"))
    out = [0] * cells
    for r in found.collect():  # as many rows as there are cells
        out[r.cell] = (int(r.high) << 32) + int(r.low)
    return out


def double_sums(rows: DataFrame, told: Callable[[pa.RecordBatch], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """Sums over all rows of the array that told(batch) gives; each task sends one row a cell."""
    cells = int(np.prod(shape))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells)
        for batch in batches:
            total += told(batch).reshape(-1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells, dtype=np.int32)), pa.array(total)], names=["cell", "value"])

    out = np.zeros(cells)
    for r in rows.mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect():
        out[r.cell] = r.value
    return out.reshape(shape)
