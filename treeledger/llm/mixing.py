"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

A source's documents all have the same expected number of copies, target / size of the source. Its whole part
is certain; the fractions are rounded in pairs: two documents fight, words pass at random from one to the
other until one of them is 0 or 1, and the other goes on. Every fight keeps the expected words
of the pair, so only the one remainder at the end misses the words wanted. Blocks of
documents are folded first, then blocks of what they leave, as a tree. Documents of more
than twice their source's mean size are rounded before the others, which then
share what is still wanted; so what a source misses at the end is a small document.

Defined results: a null or wordless text has size 0 and takes nothing. Null is a source of its own, the last.
A source without words has target 0. Each repeated row is decided for itself. Random numbers
are hashes of the ids, so reruns agree. Other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeledger.llm.staging import small, stage

WORD = r"[^\x20\x09-\x0D]+"
#: Expected number of documents, or of remainders, that one fold takes.
BLOCK = 128
#: No document is taken more often than this.
MOST = 3
SEED = 20240601


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, most: int = MOST) -> DataFrame:
    """source, source_size -> + target, whole, part: weights 1, 2, 3 in turn, no target above `most` times its size.

    Sharing the excess again and again ends at min(cap, level * weight) with one level for all, which is found
    from running sums over the sources in the order in which they reach their caps.
    """
    # one row a source: these windows see as many rows as there are sources
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weighed = sizes.withColumn("w", (F.pmod(rank - 1, F.lit(3)) + 1).cast("double")).withColumn("cap", most * F.col("source_size").cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest)
    found = weighed.withColumn("level", level).withColumn("open", F.col("level") * F.col("w") <= F.col("cap"))
    water = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("w"), F.col("level")))).over(everything)["level"]
    target = F.least("cap", F.coalesce(water * F.col("w"), F.col("cap")))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    out = found.withColumn("target", target).withColumn("ratio", F.least(ratio, F.lit(float(most))))
    return out.select("source", "source_size", "target", F.floor("ratio").alias("whole"), (F.col("ratio") - F.floor("ratio")).alias("part"))


def _uniform(*of: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(SEED), *of), F.lit(1 << 53)).cast("double") / float(1 << 53)


def _unit(row: Column, p: Column) -> Column:
    return F.struct(row["size"].alias("size"), row["doc_id"].alias("doc_id"), row["h"].alias("h"), p.alias("p"))


def _fight(state: Column, b: Column) -> Column:
    """One pivotal step of the unit that is held against the next: state is (held, decided)."""
    a = state["held"]
    a_up, a_down, b_up, b_down = (1 - a["p"]) * a["size"], a["p"] * a["size"], (1 - b["p"]) * b["size"], b["p"] * b["size"]
    up, down = F.least(a_up, b_down), F.least(a_down, b_up)
    # words pass to a with the chance that keeps both expectations
    rises = _uniform(a["doc_id"], a["h"], b["doc_id"], b["h"]) * (up + down) < down
    a_ends = F.when(rises, a_up <= b_down).otherwise(a_down <= b_up)
    b_left = _unit(b, b["p"] + F.when(rises, -up).otherwise(down) / b["size"])
    a_left = _unit(a, a["p"] + F.when(rises, up).otherwise(-down) / a["size"])
    gone = F.when(a_ends, a).otherwise(b)
    decided = F.struct(gone["size"].alias("size"), gone["doc_id"].alias("doc_id"), F.when(rises == a_ends, 1).otherwise(0).alias("copy"))
    held = F.when(a_ends, b_left).otherwise(a_left)
    return F.when(a.isNull(), F.struct(b.alias("held"), state["decided"].alias("decided"))).otherwise(F.struct(held.alias("held"), F.concat(state["decided"], F.array(decided)).alias("decided")))


_STATE = "struct<held:struct<size:bigint,doc_id:bigint,h:bigint,p:double>,decided:array<struct<size:bigint,doc_id:bigint,copy:int>>>"


def _fold(units: DataFrame) -> DataFrame:
    """source, block, size, doc_id, h, p -> one row a block: source, block, held, decided."""
    blocks = units.groupBy("source", "block").agg(F.sort_array(F.collect_list(F.struct("size", "doc_id", "h", "p")), asc=False).alias("units"))
    start = F.from_json(F.lit('{"decided":[]}'), _STATE)
    return blocks.select("source", "block", F.aggregate("units", start, _fight).alias("s")).select("source", "block", "s.held", "s.decided")


def _rounded(units: DataFrame, widest: int, block: int) -> DataFrame:
    """source, block, size, doc_id, h, p -> doc_id, source, size, copy (0 or 1). widest: most blocks of a source."""
    done = None
    while True:
        folded = stage(_fold(units), "folded")
        own = folded.select("source", F.explode("decided").alias("d")).select("d.doc_id", "source", "d.size", "d.copy")
        done = own if done is None else done.unionByName(own)
        if widest <= 1:
            last = F.col("held")
            lucky = _uniform(F.lit("last"), last["doc_id"], last["h"]) < last["p"]
            return done.unionByName(folded.select("held.doc_id", "source", "held.size", lucky.cast("int").alias("copy")))
        units = folded.select("source", F.floor(F.col("block") / block).alias("block"), "held.size", "held.doc_id", "held.h", "held.p")
        widest = -(-widest // block)


def copies(sized: DataFrame, block: int = BLOCK, most: int = MOST) -> DataFrame:
    """doc_id, source, size of each document -> + source_size, target, copies."""
    sized = sized.withColumn("h", F.xxhash64(F.lit(SEED), "doc_id", "size"))
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    mean = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.avg(F.when(F.col("size") > 0, F.col("size"))).alias("mean"))
    shared = targets(mean.select("source", "source_size"), most)
    by_source = small(stage(shared.alias("t").join(mean.alias("m"), same("t", "m")).select("t.*", "m.mean"), "targets"))
    docs = sized.alias("d").join(by_source.alias("t"), same("d", "t")).select("d.*", "part", (F.col("size") > 2 * F.col("mean")).alias("large"))
    done = docs.where("part = 0 or size = 0").select("doc_id", "source", "size", F.lit(0).alias("copy"))
    open_ = docs.where("part > 0 and size > 0")
    wanted = open_.groupBy("source").agg(F.sum(F.col("size") * F.col("part")).alias("wanted"), F.sum(F.when(~F.col("large"), F.col("size"))).alias("rest_size"), F.ceil(F.count_if("large") / block).alias("large_blocks"), F.ceil(F.count_if(~F.col("large")) / block).alias("blocks"))
    wanted = small(stage(wanted, "wanted"))
    widest = wanted.agg(F.max("large_blocks"), F.max("blocks")).first()
    taken = None
    for large, name, most_blocks in ((True, "large_blocks", widest[0]), (False, "blocks", widest[1])):
        if not most_blocks:
            continue
        p = F.col("part")
        of = wanted.withColumn("before", F.lit(0.0))
        if not large and taken is not None:
            before = taken.groupBy("source").agg(F.sum(F.col("size") * F.col("copy")).cast("double").alias("before"))
            of = wanted.alias("w").join(small(stage(before, "before")).alias("b"), same("w", "b"), "left").select("w.*", F.coalesce("b.before", F.lit(0.0)).alias("before"))
        if not large:
            p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("wanted") - F.col("before")) / F.col("rest_size")))
        units = open_.where(F.col("large") == large).alias("d").join(of.alias("w"), same("d", "w"))
        units = units.select("d.source", F.pmod("h", name).alias("block"), "size", "doc_id", "h", p.alias("p"))
        own = _rounded(units, most_blocks, block)
        taken = stage(own, "rounded")
        done = done.unionByName(taken)
    copies = (F.col("whole") + F.col("copy")).cast("long").alias("copies")
    return done.alias("d").join(by_source.alias("t"), same("d", "t")).select("d.doc_id", "d.source", "d.size", "source_size", "target", copies)


def mixed(docs: DataFrame, block: int = BLOCK, most: int = MOST) -> DataFrame:
    """doc_id, size, source_size, target, taken (size times copies) for every row of docs (doc_id, text, source)."""
    sized = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words_in(F.col("text")).alias("size")), "sized")
    out = copies(sized, block, most)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def take(docs: DataFrame, block: int = BLOCK, most: int = MOST) -> DataFrame:
    """The rows of docs as often as the mix takes them; rows with the same doc_id, source and size share a decision."""
    key = [F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words_in(F.col("text")).alias("size")]
    chosen = copies(stage(docs.select(*key), "sized"), block, most).groupBy("doc_id", "source", "size").agg(F.max("copies").alias("copies")).where("copies > 0")
    chosen = small(stage(chosen, "chosen")).alias("c")
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *key).alias("d")
    on = F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & F.col("d.source").eqNullSafe(F.col("c.source")) & (F.col("d.size") == F.col("c.size"))
    return d.join(chosen, on).select("row", F.explode(F.sequence(F.lit(1), F.col("c.copies").cast("int"))).alias("copy")).select("row.*")
