"""Comparing all of a group with all of it without one task that holds the group and without a row for each pair.

Members are dealt to blocks; a cell is a pair of blocks of one group and holds two blocks' rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_cells(rows: DataFrame, group: str, member: str, size: Column, block: int) -> DataFrame:
    """rows once for each cell of its group (size: members of the group): + block, i, j. A block meets itself and each
    other block once."""
    placed = rows.withColumn("_blocks", F.ceil(size / block).cast("int"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64(member, group), F.col("_blocks")).cast("int"))
    met = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other"))
    return met.withColumns({"i": F.least("block", "_other"), "j": F.greatest("block", "_other")}).drop("_blocks", "_other")


def runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """Tables of rows with equal keys, of batches in order of the keys."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        cell = np.stack([np.asarray(table[c]) for c in keys])
        first = np.flatnonzero(np.append(True, (cell[:, 1:] != cell[:, :-1]).any(axis=0))[: table.num_rows])
        for s, e in zip(first[:-1], first[1:], strict=True):
            yield table.slice(s, e - s)
        held = table.slice(first[-1]).combine_chunks() if len(first) else None
    if held is not None:
        yield held


def sides(cell: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Rows of block i and of block j; the same array where these are one block."""
    block, i, j = np.asarray(cell["block"]), cell["i"][0].as_py(), cell["j"][0].as_py()
    left = np.flatnonzero(block == i)
    return left, left if i == j else np.flatnonzero(block == j)
