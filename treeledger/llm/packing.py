"""Packing into length buckets whose boundaries minimise padding.

A text of more than `longest` words is cut into pieces of that length and a remainder. The histogram of piece
lengths, at most longest + 1 numbers whatever the input, goes to the driver, where dynamic
programming finds the boundaries with the least padding of all. Inside each bucket, pieces fill
batches whose padded size stays within the budget.

Defined results: a null or wordless text is one piece of 0 words. Repeated rows are packed as often as they come. A very
long text is many pieces.
Ties are broken by hash, doc_id and piece. Other columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeledger.llm.mixing import words_in
from treeledger.llm.staging import stage

LONGEST, BUCKETS, BUDGET = 2048, 8, 32_768
#: Pieces that one window orders; a larger bucket is dealt to several by hash.
SHARD = 20_000


def boundaries(counts: np.ndarray, buckets: int) -> list[int]:
    """Upper ends of at most `buckets` buckets over lengths 0, 1, ... with the least total padding."""
    lengths = np.flatnonzero(counts)
    if not len(lengths):
        return []
    n = np.concatenate(([0], np.cumsum(counts[lengths])))
    total = np.concatenate(([0], np.cumsum(counts[lengths] * lengths)))
    # padding[i, j]: all of lengths[i] ... lengths[j - 1] padded to the last of them
    top = np.concatenate(([0], lengths))
    padding = top[None, :] * (n[None, :] - n[:, None]) - (total[None, :] - total[:, None])
    padding = np.where(np.arange(len(top))[:, None] < np.arange(len(top))[None, :], padding, np.iinfo(np.int64).max // 4)
    best = np.full(len(top), np.iinfo(np.int64).max // 4)
    best[0] = 0
    back = []
    for _ in range(min(buckets, len(lengths))):
        through = best[:, None] + padding
        back.append(through.argmin(axis=0))
        best = through.min(axis=0)
    ends, j = [], len(top) - 1
    for step in reversed(back):
        ends.append(int(top[j]))
        j = int(step[j])
    return ends[::-1]


def packed(docs: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, budget: int = BUDGET, shard: int = SHARD, length: Column | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start_word, n_words, bucket_len, batch_id, slot.

    batch_id is unique over all buckets; (rows of a batch) * bucket_len <= budget, unless one piece alone is longer.
    length: what a text is measured by instead of its words, such as a column of token counts; pieces and the budget are
    in its unit then. A null or negative length is 0.
    """
    size = words_in(F.col("text")) if length is None else F.greatest(F.coalesce(length.cast("long"), F.lit(0)), F.lit(0)).cast("long")
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"))
    last = F.greatest(F.ceil(F.col("size") / longest) - 1, F.lit(0))
    pieces = sized.select("doc_id", "size", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece")).select("doc_id", "piece", (F.col("piece") * longest).alias("start_word"), F.least(F.lit(longest), F.col("size") - F.col("piece") * longest).cast("long").alias("n_words"))
    pieces = stage(pieces, "pieces")
    counts = np.zeros(longest + 1, np.int64)
    for length, n in pieces.groupBy("n_words").count().collect():  # at most longest + 1 rows
        counts[length] = n
    ends = boundaries(counts, buckets)
    bucket, shards = F.lit(None).cast("int"), F.lit(1)
    for i in reversed(range(len(ends))):
        held = int(counts[(ends[i - 1] + 1 if i else 0) : ends[i] + 1].sum())
        inside = F.col("n_words") <= ends[i]
        bucket = F.when(inside, F.lit(i)).otherwise(bucket)
        shards = F.when(inside, F.lit(-(-held // shard))).otherwise(shards)
    upper = F.element_at(F.array(*map(F.lit, ends)), F.col("bucket") + 1) if ends else F.lit(0)
    h = F.xxhash64("doc_id", "piece")
    dealt = pieces.select("*", bucket.alias("bucket"), F.pmod(h, shards).alias("shard"), h.alias("h")).withColumn("bucket_len", upper.cast("long"))
    place = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("h", "doc_id", "piece", "n_words")) - 1
    rows = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest("bucket_len", F.lit(1))))
    placed = dealt.withColumn("place", place).withColumn("rows", rows)
    batch = F.shiftleft(F.col("bucket").cast("long"), 56) + F.shiftleft(F.col("shard").cast("long"), 24) + F.floor(F.col("place") / F.col("rows"))
    return placed.select("doc_id", "piece", "start_word", "n_words", "bucket_len", batch.alias("batch_id"), F.pmod(F.col("place"), F.col("rows")).alias("slot"))
