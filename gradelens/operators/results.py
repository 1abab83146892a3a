"""The results table: planning what is left, upserting, reshaping and comparing."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradelens import values as v

KEY = ("model", "condition", "task")
COLUMNS = (*KEY, "value", "n")


def pending_work(
    models: DataFrame,
    results: DataFrame,
    conditions: Sequence[str] = v.CONDITIONS,
    tasks: Sequence[str] = v.TASKS,
) -> DataFrame:
    """Cells of the models x conditions x tasks grid without a recorded value."""
    unknown = set(tasks) - set(v.TASKS)
    if unknown:
        raise ValueError(f"unknown tasks: {sorted(unknown)}")
    grid = (
        models.select("model")
        .distinct()
        .withColumn("condition", F.explode(F.array(*map(F.lit, conditions))))
        .withColumn("task", F.explode(F.array(*map(F.lit, tasks))))
    )
    return grid.join(results.where(F.col("value").isNotNull()), list(KEY), "left_anti")


def append_scores(*parts: DataFrame) -> DataFrame:
    """Rows of all parts, matched by column name."""
    return reduce(DataFrame.unionByName, parts)


def upsert_results(results: DataFrame, fresh: DataFrame) -> DataFrame:
    """Results with the fresh cells added, or put in the place of the same cells.

    One pass over each side; of repeated fresh cells the greatest is kept.
    """
    rest = [c for c in COLUMNS if c not in KEY]
    sides = [side.select(*COLUMNS, F.lit(new).alias("fresh")) for new, side in enumerate((results, fresh))]
    newest = append_scores(*sides).groupBy(*KEY).agg(F.max(F.struct("fresh", *rest)).alias("cell"))
    return newest.select(*[F.col(c) if c in KEY else F.col(f"cell.{c}").alias(c) for c in COLUMNS])


def round_score(value: Column, digits: int = 2) -> Column:
    """Round half to even on the exact binary value.

    ``round`` and ``bround`` work on the shortest decimal text of a double, which turns
    2.675 (a little less in binary) into a tie. Here the part behind the point is scaled by a
    power of two to a whole number, exactly, and the rest of the rounding is whole-number
    arithmetic. From 2**46 on doubles lie further apart than two digits and stay as they are.
    """
    if digits != 2:
        raise ValueError("scores are kept at two digits")
    whole = "decimal(38,0)"
    size = F.abs(value)
    large = size >= 2.0**46
    front = F.floor(F.when(large | F.isnan(value), F.lit(0.0)).otherwise(size))
    value, sign = F.when(large | F.isnan(value), value).otherwise(size - front), F.signum(value)
    small = value < 0.0625
    unit = F.when(small, F.lit(2**60)).otherwise(F.lit(2**56)).cast(whole)
    part = F.when(large | F.isnan(value), F.lit(0.0)).otherwise(value)
    scaled = (part * F.when(small, float(2**60)).otherwise(float(2**56))).cast("bigint")
    hundredfold = scaled.cast(whole) * F.lit(100)
    rest = hundredfold % unit
    below = ((hundredfold - rest) / unit).cast("bigint")
    twice = rest * F.lit(2)
    up = (twice > unit) | ((twice == unit) & (F.pmod(below, F.lit(2)) == 1))
    exact = sign * ((front * 100 + below + up.cast("bigint")) / 100.0)
    return F.when(large | F.isnan(value), value).otherwise(exact)


def results_pivot(results: DataFrame) -> DataFrame:
    """One row per model and condition, one column per task, blank where not run."""
    cells = [F.max(F.when(F.col("task") == t, F.col("value"))).alias(t) for t in v.TASKS]
    return results.groupBy("model", "condition").agg(*cells)


def results_unpivot(wide: DataFrame) -> DataFrame:
    """Long results from the wide form; blank cells give no row."""
    long = wide.unpivot(["model", "condition"], list(v.TASKS), "task", "value")
    return long.where(F.col("value").isNotNull()).withColumn("n", F.lit(None).cast("bigint"))


def final_report(results: DataFrame) -> DataFrame:
    """The wide form, rounded and ordered by model and condition."""
    rounded = [round_score(F.col(t)).alias(t) for t in v.TASKS]
    wide = results_pivot(results)
    return wide.select("model", "condition", *rounded).orderBy("model", "condition")


def print_report(results: DataFrame, most: int = 1000) -> None:
    """Show result rows, at most so many, or say that there is none."""
    shown = final_report(results).take(most + 1)
    if not shown:
        print("No results yet.")
        return
    table = [list(shown[0].asDict()), *[["" if x is None else str(x) for x in row] for row in shown[:most]]]
    widths = [max(map(len, column)) for column in zip(*table)]
    for line in table:
        print("  ".join(cell.ljust(width) for cell, width in zip(line, widths)).rstrip())
    if len(shown) > most:
        print(f"... and more than these {most} rows")


def compare_conditions(results: DataFrame) -> DataFrame:
    """Each model's and task's score without and with the summary, and the gain.

    A cell that only one condition has is kept, with the other side blank.
    """
    sides = [
        F.max(F.when(F.col("condition") == c, F.col("value"))).alias(c) for c in v.CONDITIONS
    ]
    paired = results.groupBy("model", "task").agg(*sides)
    return paired.withColumn("delta", F.col("summary") - F.col("plain"))
