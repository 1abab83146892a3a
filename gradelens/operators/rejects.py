"""Rows that a plan turns away, counted while it runs.

Counters ride along with the plan (``DataFrame.observe``), so nothing is read a second time for
them. They are known once the plan has run.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class Rejects:
    """Counters by the step that counts and the reason."""

    def __init__(self) -> None:
        self._steps: list[tuple[str, Observation]] = []

    def observe(self, df: DataFrame, step: str, counters: Mapping[str, Column]) -> DataFrame:
        """The same rows, with aggregates over them taken on the way."""
        seen = Observation()
        self._steps.append((step, seen))
        named = [F.coalesce(x, F.lit(0)).cast("bigint").alias(name) for name, x in counters.items()]
        return df.observe(seen, *named)

    def counts(self) -> dict[tuple[str, str], int]:
        """(step, reason) -> rows, summed over all plans that have run; waits for those that have not."""
        found: dict[tuple[str, str], int] = {}
        for step, seen in self._steps:
            for reason, n in seen.get.items():
                found[step, reason] = found.get((step, reason), 0) + n
        return found


def split_off(
    df: DataFrame, step: str, reasons: Mapping[str, Column], rejects: Rejects | None
) -> DataFrame:
    """Rows for which no reason holds; a row counts under the first reason that does.

    Reasons are conditions that are never null.
    """
    if rejects is None:
        return reduce(lambda rows, holds: rows.where(~holds), reasons.values(), df)
    reason = F.coalesce(*[F.when(holds, F.lit(name)) for name, holds in reasons.items()])
    flagged = df.withColumn("_reason", reason)
    counters = {name: F.count_if(F.col("_reason") == name) for name in reasons}
    return rejects.observe(flagged, step, counters).where(F.col("_reason").isNull()).drop("_reason")
