"""Row filters and projections over examples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradelens import values as v


def filter_lang(examples: DataFrame, lang: str | None = None) -> DataFrame:
    """Examples of one language; the argument is lower-cased, the column is not."""
    if not lang:
        return examples
    return examples.where(F.col("lang") == lang.lower())


def eligible_for_task(examples: DataFrame, task: str) -> DataFrame:
    """Examples that count for the task: solution tasks leave out pure removals."""
    if task not in v.TASKS:
        raise ValueError(f"unknown task: {task}")
    if task in ("SIE", "SIH"):
        return examples.where(~F.col("type_correct").eqNullSafe("remove_only"))
    return examples


def with_summary_condition(
    examples: DataFrame, conditions: Sequence[str] = v.CONDITIONS
) -> DataFrame:
    """One row per example and prompt condition."""
    unknown = set(conditions) - set(v.CONDITIONS)
    if unknown:
        raise ValueError(f"unknown conditions: {sorted(unknown)}")
    return examples.withColumn("condition", F.explode(F.array(*map(F.lit, conditions))))


def language_label(lang: str | None = None) -> Column:
    """Header text of a prompt: the argument as given, else the default."""
    return F.lit(lang or v.DEFAULT_LABEL)


def task_code(kind: str, mode: Column) -> Column:
    """Result column of a question kind in easy or hard mode; other modes are an error."""
    code = F.when(mode == "easy", v.TASK_OF_MODE[kind, "easy"]).when(
        mode == "hard", v.TASK_OF_MODE[kind, "hard"]
    )
    return code.otherwise(
        F.raise_error(
            F.concat(F.lit("unknown mode: "), F.coalesce(mode, F.lit("null")))
        ).cast("string")
    )


def option_mode(
    examples: DataFrame, kind: str, modes: Sequence[str] = v.MODES
) -> DataFrame:
    """One row per example and mode with that mode's wrong options in ``wrong`` (P5)."""
    prefix = {"location": "loc", "solution": "solution"}[kind]
    unknown = set(modes) - set(v.MODES)
    if unknown:
        raise ValueError(f"unknown modes: {sorted(unknown)}")
    stacked = F.array(
        *[
            F.struct(F.lit(mode).alias("mode"), F.col(f"{prefix}_wrong_{mode}").alias("wrong"))
            for mode in modes
        ]
    )
    return (
        examples.withColumn("_choice", F.explode(stacked))
        .withColumns({"mode": F.col("_choice.mode"), "wrong": F.col("_choice.wrong")})
        .withColumn("task", task_code(kind, F.col("mode")))
        .drop("_choice")
    )


def summary_default(summary: Column) -> Column:
    """A missing summary reads as an empty text."""
    return F.coalesce(summary, F.lit(""))


def summary_status(examples: DataFrame) -> DataFrame:
    """Mark summaries that hold a recorded failure; their text is kept."""
    failed = F.startswith(summary_default(F.col("summary")), F.lit(v.SUMMARY_ERROR_PREFIX))
    return examples.withColumn("summary_failed", failed)


def add_summary_column(examples: DataFrame, summaries: DataFrame) -> DataFrame:
    """Examples with the ``summary`` of their id; an older summary is replaced."""
    return examples.drop("summary").join(
        summaries.select("example_id", "summary"), "example_id", "left"
    )
