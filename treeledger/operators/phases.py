"""Counters of a run's phases, taken from the run itself: no table is read again to be counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from treeledger.functions.cut import written


class Phases:
    """Each phase's rows are watched as they are written, and the counters end in one record."""

    def __init__(self) -> None:
        self._seen: dict[str, tuple[Observation, list[str]]] = {}

    def run(self, phase: str, rows: DataFrame, /, **counters: Column) -> DataFrame:
        """rows as a written table, and its counters (aggregates) under the phase's name."""
        seen = Observation(phase)
        self._seen[phase] = (seen, list(counters))
        return written(rows.observe(seen, *[c.alias(name) for name, c in counters.items()]))

    def counters(self) -> dict[str, object]:
        """phase_counter of every phase that ran, in their order; a sum over no rows is 0."""
        found = {}
        for phase, (seen, names) in self._seen.items():
            got = seen.get
            found |= {f"{phase}_{n}": got[n] or 0 for n in names}
        return found

    def record(self, spark: SparkSession) -> DataFrame:
        """One row with all counters, as longs."""
        found = self.counters()
        return spark.range(1).select(*[F.lit(v).cast("long").alias(k) for k, v in found.items()])
