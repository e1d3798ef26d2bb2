"""Ranking candidate files and admitting them under a byte budget."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from treeledger.functions.cut import checkpointed
from treeledger.functions.paths import field_rank
from treeledger.functions.totals import at_least_0
from treeledger.operators.manifest import CLASSES

#: Candidates of a class that can matter: those picked and those that earlier classes may have taken.
KEPT_PER_CLASS = 64


def ranked(scores: DataFrame) -> DataFrame:
    """Scores with `rank` by cost, then field, moved and reused chunks (more first) and path.

    The ranking is numbered by a range sort and counts of what lies before each range, not by one window over all.
    """
    order = [F.col("total_cost"), field_rank(F.col("field")), F.col("moved").desc(), F.col("reused").desc(), F.col("file")]
    return numbered(scores, order, "rank")


def admission_ranked(candidates: DataFrame) -> DataFrame:
    return numbered(candidates, [F.col("budget_cost"), field_rank(F.col("field")), F.col("file")], "admission_rank")


def _ranged(rows: DataFrame, order: list) -> DataFrame:
    """Rows dealt to ranges of a total order and kept there: `_part` is the range, `_in` rises within it."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    return checkpointed(ranged.withColumns({"_part": F.shiftright("_at", 33), "_in": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_at"))


def _with_before(ranged: DataFrame, amount: Column) -> DataFrame:
    """`_before`: the sum of `amount` over all earlier ranges, from one row a range."""
    sums = ranged.groupBy("_part").agg(amount.alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.join(F.broadcast(sums.select("_part", before.alias("_before"))), "_part")


def numbered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """Row numbers 1, 2, ... over a total order."""
    return _with_before(_ranged(rows, order), F.count("*")).withColumn(name, F.col("_before") + F.col("_in") + 1).drop("_part", "_in", "_before")


def _range_sums(left: int, half: int):
    """A range of costs -> its number, the sum of those up to half, and the least that a larger one needs to fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total, needs = None, 0, left + 1
        for batch in batches:
            for part, cost in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if cost <= half:
                    total += cost
                else:
                    needs = min(needs, total + cost)
        if part is not None:
            # what is beyond the budget need not be exact
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([min(total, left + 1)], pa.int64()), pa.array([needs], pa.int64())], names=["part", "total", "needs"])

    return run


def _range_walk(left: int):
    """A range of costs -> what its walk leaves of the budget."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = left
        for batch in batches:
            for cost in batch.column(1).to_pylist():
                if cost <= rest:
                    rest -= cost
        yield pa.RecordBatch.from_arrays([pa.array([rest], pa.int64())], names=["left"])

    return run


def _lefts(costs: DataFrame, budget: int) -> tuple[list[int], list[int]]:
    """Ranges, ascending, and what is left of the budget before each; in any other range nothing fits of what is left before the next.

    Costs up to half of what is left all fit until their sum is beyond it, and a larger one that fits halves what is
    left. So sums by range find the first range where either happens, that range is walked, and what is left has
    halved: the rounds are at most the bits of the budget, and the driver holds a few numbers for each range.
    """
    parts, lefts, left, done = [0], [budget], budget, -1
    while left > 0:
        rest = costs.where((F.col("_part") > done) & (F.col("_cost") <= left))
        stop = None
        for part, total, needs in sorted(tuple(r) for r in rest.mapInArrow(_range_sums(left, left // 2), "part long, total long, needs long").collect()):
            parts.append(part)
            lefts.append(left)
            if total > left or needs <= left:
                stop = part
                break
            left -= total
        if stop is None:
            break
        left, done = min(r.left for r in costs.where(F.col("_part") == stop).mapInArrow(_range_walk(left), "left long").collect()), stop
    parts.append(parts[-1] + 1)
    lefts.append(left)
    return parts, lefts


def _admit(parts: list[int], lefts: list[int], budget: int):
    """Rows that end in _part and _cost -> the rows with `spent` where they are admitted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in batches:
            *columns, part, cost = batch.columns
            if left is None and len(part):
                left = lefts[min(bisect_left(parts, part[0].as_py()), len(parts) - 1)]
            spent = []
            for c in cost.to_pylist():
                ok = c is not None and c <= left
                left -= c if ok else 0
                spent.append(budget - left if ok else None)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spent, pa.int64())], names=[*batch.schema.names[:-2], "spent"])

    return run


def greedy(items: DataFrame, budget: int, *order: str, cost: str = "cost", key: str = "key") -> DataFrame:
    """Walk the items in order and admit what still fits; what is refused is not charged.

    An item that costs more than the whole budget never fits, and items that cost nothing always do, so both are
    decided where they are. Of what lies before a range of the order, its walk needs only what is left of the
    budget; once that is known for each range, all are walked at once.
    """
    ranged = _ranged(items, [*order, cost, key]).drop("_in")
    rows = ranged.select(*[F.col(f"`{c}`") for c in items.columns], "_part", F.when((F.col(cost) > 0) & (F.col(cost) <= budget), F.col(cost).cast("long")).alias("_cost"))
    parts, lefts = _lefts(rows.where("_cost is not null").select("_part", "_cost"), budget)
    schema = StructType([*items.schema.fields, StructField("spent", LongType())])
    return rows.mapInArrow(_admit(parts, lefts, budget), schema).withColumn("admitted", F.col("spent").isNotNull() | (F.col(cost) <= 0))


def admitted_prefix(items: DataFrame, budget: int, *order: str, cost: str = "cost", already: int = 0) -> DataFrame:
    """The same for a list in ascending order of cost, where what is admitted is a prefix: running sums decide.

    Sums run within ranges of the order, on top of what the earlier ranges cost.
    """
    ranged = _with_before(_ranged(items.where(F.col(cost) <= budget - already), [cost, *order]), F.sum(cost))
    running = F.sum(cost).over(Window.partitionBy("_part").orderBy("_in").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return ranged.withColumn("spent", already + F.col("_before") + running).where(F.col("spent") <= budget).drop("_part", "_in", "_before")


def candidates(scores: DataFrame) -> DataFrame:
    """field, file, state, budget_cost and all classes that a file could stand for."""
    partial = (F.col("reused") > 0) & (F.col("reused") < F.col("nchunks"))
    changed = F.col("state") == "changed"
    fits = {
        "identical": F.col("state") == "identical", "no_reuse": changed & (F.col("reused") == 0) & (F.col("nchunks") > 1), "reuse_in_place": changed & (F.col("moved") == 0) & partial,
        "reuse_moved": changed & (F.col("moved") > 0), "added": F.col("state") == "added", "removed": F.col("state") == "removed",
    }
    classes = F.array_compact(F.array(*[F.when(fits[c], c) for c in CLASSES]))
    cost = F.when(F.col("state") == "removed", at_least_0(F.col("old_size"))).when(F.col("state") == "added", F.col("new_bytes")).otherwise(F.col("total_cost"))
    return scores.select("field", "file", "state", F.coalesce(cost, F.lit(0)).alias("budget_cost"), classes.alias("classes"))


def unmet(status: DataFrame, required: list[str], *keys: str) -> DataFrame:
    """keys, class, line of the required classes that are neither captured nor covered, of one selection or of each of many."""
    asked = status.where(F.col("class").isin(required) & ~F.col("status").isin("captured", "covered"))
    return asked.select(*keys, "class", F.concat(F.col("class"), F.lit(": "), F.col("status")).alias("line"))


def require(status: DataFrame, required: list[str]) -> None:
    """Raise with every unmet class (there are six at most)."""
    lines = [r.line for r in unmet(status, required).orderBy("class").collect()] if required else []
    if lines:
        raise ValueError("; ".join(lines))


def select_by_class(found: DataFrame, per_class: int, budget: int, forced: list[tuple[str, str]] | None = None) -> tuple[list[dict], list[dict]]:
    """(admitted or refused files, status of each class).

    Forced files (field, file) come first, in the order given, each charged as often as it is named. Then each class in order is
    covered by what is in, or gets its `per_class` cheapest files that no class took before. Spark ranks;
    the driver folds over at most KEPT_PER_CLASS files of each of the six classes.
    """
    forced = forced or []
    rank = F.row_number().over(Window.partitionBy("class").orderBy("budget_cost", field_rank(F.col("field")), "file"))
    per = found.select("*", F.explode("classes").alias("class")).withColumn("nth", rank).where(F.col("nth") <= max(KEPT_PER_CLASS, 6 * per_class + len(forced)))
    rows = [r.asDict() for r in per.orderBy("class", "nth").collect()]
    key = lambda row: (row["field"], row["file"])
    # as many rows as files are named
    names = found.sparkSession.createDataFrame(sorted(set(forced)), "field string, file string") if forced else None
    named = {key(r): r.asDict() for r in found.join(F.broadcast(names), ["field", "file"]).collect()} if forced else {}
    spent, out, taken = 0, [], {}

    def admit(row: dict, why: str) -> bool:
        nonlocal spent
        ok = spent + row["budget_cost"] <= budget
        spent += row["budget_cost"] if ok else 0
        out.append({"field": row["field"], "file": row["file"], "class": why, "budget_cost": row["budget_cost"], "admitted": ok})
        if ok:
            taken[key(row)] = row
        return ok

    for f in forced:
        if f in named:
            admit(named[f], "forced")
    wanted, status = [], {}
    for c in CLASSES:
        own = [r for r in rows if r["class"] == c]
        cover = [r for r in taken.values() if c in r["classes"]]
        earlier = sorted((w for w in wanted if c in w[0]["classes"]), key=lambda w: (w[0]["budget_cost"], w[0]["file"]))
        if cover:
            status[c] = ("covered", key(cover[0]))
        elif earlier:
            status[c] = ("covered", key(earlier[0][0]))
        else:
            used = {key(w[0]) for w in wanted} | taken.keys()
            picked = [r for r in own if key(r) not in used][:per_class]
            wanted += [(r, c) for r in picked]
            status[c] = ("captured", key(picked[0])) if picked else ("unavailable", (None, None))
    for row, c in sorted(wanted, key=lambda w: (w[0]["budget_cost"], w[0]["field"] != "game", w[0]["field"], w[0]["file"])):
        admit(row, c)
    refused = {key(o) for o in out if not o["admitted"]} - taken.keys()
    return out, [{"class": c, "status": "over_budget" if k in refused else s, "field": k[0], "file": k[1]} for c, (s, k) in status.items()]


def candidates_document(scores: DataFrame) -> DataFrame:
    """field, file, state, budget_cost of all paths, with the rank of those that are scored as changed and the admission rank
    of those that stand for a class; both null for the others."""
    found = candidates(scores.fillna(0, ["reused", "moved", "nchunks", "total_cost"]))
    key = ["field", "file"]
    rank = ranked(scores.where("state = 'changed'").select(*key, "total_cost", "moved", "reused")).select(*key, "rank")
    admission = admission_ranked(found.where(F.size("classes") > 0).select(*key, "budget_cost")).select(*key, "admission_rank")
    return found.select(*key, "state", "budget_cost").join(rank, key, "left").join(admission, key, "left")
