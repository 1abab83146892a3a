"""All tasks, models and conditions scored as one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradelens import values as v
from gradelens.operators import fanout, results, scoring
from gradelens.operators.rejects import Rejects


def generation_results(scored: DataFrame) -> DataFrame:
    """Result rows of the generation task: its exact-match percent."""
    report = scoring.refine_report(scored)
    return report.select(
        "model", "condition", F.lit("ACR").alias("task"), F.col("em_pct").alias("value"), "n"
    )


def choice_results(scored: DataFrame) -> DataFrame:
    """Result rows of the choice tasks: their order-invariant accuracy."""
    return scoring.choice_report(scored).select(*results.COLUMNS)


def scored_examples(
    examples: DataFrame,
    generations: DataFrame,
    choices: DataFrame,
    tasks: Sequence[str] = v.CHOICE_TASKS,
) -> DataFrame:
    """One row per cell and example with its hit, over all tasks; the last deliveries count."""
    generated = scoring.score_deliveries(examples, generations)
    chosen = scoring.score_choices(choices, fanout.answer_keys(examples, tasks))
    columns = [*scoring.CELL, "example_id", "lang", "type_correct", "hit"]
    return results.append_scores(
        generated.withColumns({"task": F.lit("ACR"), "hit": F.col("em")}).select(*columns),
        chosen.select(*columns),
    )


def evaluate(
    examples: DataFrame, generations: DataFrame, choices: DataFrame, rejects: Rejects | None = None
) -> DataFrame:
    """Fresh result rows of every cell that has answers.

    Both kinds of answers may hold repeats; the last delivered answer counts. ``rejects`` counts
    examples without a gold text or with a wrong number of options, and answers without a place.
    """
    keys = fanout.answer_keys(examples, rejects=rejects)
    return results.append_scores(
        generation_results(scoring.score_deliveries(examples, generations, rejects)),
        choice_results(scoring.score_choices(choices, keys, rejects)),
    )
