"""Multiple-choice questions as tables: all orderings in long form, or one key per example."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradelens import values as v
from gradelens.functions import options as op
from gradelens.operators import rows
from gradelens.operators.rejects import Rejects

WRONG_AND_CORRECT = {
    "CTR": ("type_wrong", "type_correct"),
    "CLE": ("loc_wrong_easy", "loc_correct"),
    "CLH": ("loc_wrong_hard", "loc_correct"),
    "SIE": ("solution_wrong_easy", "solution_correct"),
    "SIH": ("solution_wrong_hard", "solution_correct"),
}


def with_options(examples: DataFrame, task: str) -> DataFrame:
    """Eligible examples with ``task``, ``correct`` and the ``options`` list (A1)."""
    wrong, correct = WRONG_AND_CORRECT[task]
    return rows.eligible_for_task(examples, task).withColumns(
        {
            "task": F.lit(task),
            "correct": F.col(correct),
            "options": op.build_options(F.col(wrong), F.col(correct)),
        }
    )


def option_count_check(examples: DataFrame, task: str) -> DataFrame:
    """Mark with ``accepted`` whether an example offers as many options as the task asks (A4)."""
    return with_options(examples, task).withColumn(
        "accepted", op.option_count_check(F.col("options"), v.OPTION_COUNT[task])
    )


def all_orderings(examples: DataFrame, task: str) -> DataFrame:
    """One row per ordering of the options, with the right letter (A2, A3, A5)."""
    k = v.OPTION_COUNT[task]
    accepted = option_count_check(examples, task).where("accepted")
    fanned = accepted.select(
        "example_id",
        "task",
        "correct",
        "options",
        F.posexplode(op.orderings(k)).alias("perm_idx", "order"),
    ).withColumn("perm_options", op.arrange(F.col("options"), F.col("order")))
    return fanned.select(
        "example_id",
        "task",
        "perm_idx",
        "perm_options",
        op.correct_symbol(F.col("perm_options"), F.col("correct")).alias("correct_symbol"),
    )


def combinations(examples: DataFrame, task: str) -> DataFrame:
    """The options of an example and their ``orders``, in ordering order (A5).

    Texts stay once in the row; ``ordered_options`` puts them in order where they are shown.
    """
    k = v.OPTION_COUNT[task]
    accepted = option_count_check(examples, task).where("accepted")
    return accepted.select(
        "example_id",
        "task",
        "options",
        op.orderings(k).alias("orders"),
    )


def ordered_options(shown=lambda ordered: ordered) -> Column:
    """Every ordering of ``combinations`` as ``shown`` makes it from the ordered options."""
    return F.transform("orders", lambda order: shown(op.arrange(F.col("options"), order)))


def _eligible(task: str) -> Column:
    if task in ("SIE", "SIH"):
        return ~F.col("type_correct").eqNullSafe("remove_only")
    return F.lit(True)


def _counted(task: str) -> Column:
    return F.coalesce(F.size(F.col(WRONG_AND_CORRECT[task][0])) == v.OPTION_COUNT[task] - 1, F.lit(False))


def _key(task: str) -> Column:
    wrong, correct = WRONG_AND_CORRECT[task]
    return F.when(
        _counted(task) & _eligible(task), op.answer_key(F.col(wrong), F.col(correct), v.OPTION_COUNT[task])
    )


def answer_keys(
    examples: DataFrame, tasks: Sequence[str] = v.CHOICE_TASKS, rejects: Rejects | None = None
) -> DataFrame:
    """One short row per example: for every task, the right letter of every ordering.

    ``keys`` maps a task to a text of at most 24 letters, or to null where the example has no
    such question. Options never leave the row they came from, and joins need the id alone.
    ``rejects`` counts for every task the eligible examples with a wrong number of options (A4).
    """
    if rejects is not None:
        uneven = {f"option_count_{task}": F.count_if(_eligible(task) & ~_counted(task)) for task in tasks}
        examples = rejects.observe(examples, "examples", uneven)
    pairs = [part for task in tasks for part in (F.lit(task), _key(task))]
    return examples.select(
        "example_id", "lang", "type_correct", F.create_map(*pairs).alias("keys")
    )


def with_key(answers: DataFrame, keys: DataFrame) -> DataFrame:
    """Answers of existing questions, beside the ``key`` of their example and task."""
    joined = answers.join(keys, "example_id").withColumn("key", F.col("keys")[F.col("task")])
    return joined.where(F.col("key").isNotNull()).drop("keys")
