"""Connected components of a link table, all in DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeledger.llm.staging import drop, stage

#: Links that one task contracts at once.
CONTRACTED = 500_000


def forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each of the nodes 0 ... n - 1 that hangs together with a smaller one by the links, and the smallest such one."""
    low = np.arange(n)
    while True:
        both = np.minimum(low[a], low[b])
        new = low.copy()
        np.minimum.at(new, a, both)
        np.minimum.at(new, b, both)
        new = new[new]
        if (new == low).all():
            node = np.flatnonzero(low != np.arange(n))
            return node, low[node]
        low = new


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) -> of each vertex the smallest one that it reaches by them."""
    held = [np.stack([np.asarray(c) for c in b.columns]) for b in batches]
    if held:
        links = np.concatenate(held, axis=1)
        vertex, ends = np.unique(links, return_inverse=True)
        ends = ends.reshape(links.shape)
        node, low = forest(len(vertex), ends[0], ends[1])
        yield pa.RecordBatch.from_arrays([pa.array(vertex[node]), pa.array(vertex[low])], names=["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """Smallest reachable vertex of every vertex that has a link.

    links: columns a, b (long). First each task contracts some CONTRACTED links to stars, so what is left is at most a star
    for each vertex and task; one task's worth of links is done with that. Then alternating large-star and small-star
    steps: each is one aggregation and one join, and the number of links never grows. A star
    centre with many links is a skewed join, which adaptive execution splits. It ends when every
    vertex hangs on one centre and no centre hangs on another.
    Returns vertex, component_id. No links: no rows. Self-links and repeats do no harm.
    """
    edges = stage(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "links")
    parts = -(-edges.count() // CONTRACTED)
    contracted = stage(edges.coalesce(max(1, parts)).mapInArrow(_contracted, "u long, v long"), "contracted")
    drop(edges)
    edges = contracted
    while parts > 1 and not _stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        stars = stage(small.select("e.u", "e.v").where("u <> v").distinct(), "stars")
        drop(edges)
        edges = stars
    top = edges.select(F.col("v").alias("vertex"), F.col("v").alias("component_id")).distinct()
    return edges.select(F.col("u").alias("vertex"), F.col("v").alias("component_id")).unionByName(top)


def _stars(edges: DataFrame) -> bool:
    ends = F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")), F.struct(F.col("v").alias("x"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
    counted = edges.select(F.explode(ends).alias("e")).groupBy("e.x").agg(F.sum("e.hangs").alias("hangs"), F.sum("e.holds").alias("holds"))
    return counted.where("hangs > 1 or (hangs > 0 and holds > 0)").isEmpty()
