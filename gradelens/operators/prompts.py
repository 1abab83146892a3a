"""Prompts as string projections.

Numbered code and rendered options are made once per example, before an example is fanned out
over conditions and orderings. Choice prompts come ``whole``, one row and one text for every ordering,
or in parts: one row for all orderings, whose texts ``inference`` puts together where the client is
called. The parts of a prompt are the texts around its options and the options as they are shown.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradelens import values as v
from gradelens.functions import options as op
from gradelens.functions import text as tx
from gradelens.operators import rows
from gradelens.operators.rejects import Rejects, split_off


def fill(template: str, slots: Mapping[str, Column]) -> Column:
    """Concatenate the template's texts and the columns of its ``{slots}``.

    The template is cut before any value is put in, so values may contain slot names.
    """
    return fill_around(template, slots, ())[0]


def fill_around(template: str, slots: Mapping[str, Column], left_out: Sequence[str]) -> list[Column]:
    """``fill`` without the slots ``left_out``, which come in this order: the texts before, between and behind them."""
    texts: list[list[Column]] = [[]]
    for literal, slot, _, _ in Formatter().parse(template):
        if literal:
            texts[-1].append(F.lit(literal))
        if slot in left_out:
            assert slot == left_out[len(texts) - 1]
            texts.append([])
        elif slot is not None:
            texts[-1].append(slots[slot])
    return [F.concat(*pieces) if pieces else F.lit("") for pieces in texts]


def summary_section(condition: Column, summary: Column) -> Column:
    """The summary part of a prompt, empty outside the summary condition."""
    text = fill(v.SUMMARY_SECTION, {"summary": rows.summary_default(summary)})
    return F.when(condition == "summary", text).otherwise("")


def summary_prompt(examples: DataFrame) -> DataFrame:
    """Add the request for a change summary; missing fields read as empty (B1)."""
    empty = F.lit("")
    slots = {
        "old_code": F.coalesce("old", empty),
        "new_code": F.coalesce("new", empty),
        "review": F.coalesce("review", empty),
    }
    return examples.withColumn("prompt", fill(v.SUMMARY_REQUEST, slots))


def _common_slots(label: str | None) -> dict[str, Column]:
    return {
        "lang": rows.language_label(label),
        "code_snippet": F.col("_snippet"),
        "code_review": F.col("review"),
        "summary_section": summary_section(F.col("condition"), F.col("summary")),
    }


def askable(examples: DataFrame, rejects: Rejects | None = None) -> DataFrame:
    """Examples that a prompt can be made of; one without code or without a review is rejected."""
    reasons = {"null_old": F.col("old").isNull(), "null_review": F.col("review").isNull()}
    return split_off(examples, "prompts", reasons, rejects)


def _offered(options: Column, k: int) -> Column:
    """Whether there are ``k`` options and each is known."""
    return op.option_count_check(options, k) & F.forall(options, lambda o: o.isNotNull())


def _in_conditions(prepared: DataFrame, conditions: Sequence[str] | None) -> DataFrame:
    """Rows for every condition; without conditions the rows already carry theirs."""
    return prepared if conditions is None else rows.with_summary_condition(prepared, conditions)


def refine_prompt(
    examples: DataFrame, label: str | None = None, conditions=v.CONDITIONS
) -> DataFrame:
    """Generation prompts, one per example and condition (B2)."""
    numbered = askable(examples).withColumn("_snippet", tx.number_lines(F.col("old")))
    asked = _in_conditions(numbered, conditions)
    return asked.select(
        F.lit("ACR").alias("task"),
        "condition",
        "example_id",
        fill(v.REFINE_PROMPT, _common_slots(label)).alias("prompt"),
    )


def _choice_prompts(
    prepared: DataFrame, template: str, k: int, label: str | None, conditions, missing: str | None, whole: bool
) -> DataFrame:
    """Fan out over conditions and orderings; needs task, _snippet, _phrase and _shown.

    ``missing`` names a column of bits: only orderings whose bit is set are asked.
    """
    asked = _in_conditions(prepared, conditions)
    if not whole:
        offered = [f"option_{letter.lower()}" for letter in v.LETTERS[:k]]
        around = fill_around(template, _common_slots(label) | {"ct": F.col("_phrase")}, offered)
        every = F.lit(2 ** op.ordering_count(k) - 1) if missing is None else F.col(missing)
        parts = F.struct(
            F.array(*around).alias("around"),
            F.col("_shown").alias("shown"),
            every.cast("long").alias("missing"),
        )
        return asked.select("task", "condition", "example_id", parts.alias("prompt"))
    fanned = asked.select("*", F.posexplode(op.orderings(k)).alias("perm_idx", "_order"))
    if missing:
        fanned = fanned.where(F.getbit(missing, F.col("perm_idx")) == 1)
    slots = _common_slots(label) | {"ct": F.col("_phrase")}
    for slot in range(k):
        name = f"option_{v.LETTERS[slot].lower()}"
        slots[name] = F.get(F.col("_shown"), F.get("_order", F.lit(slot)))
    return fanned.select(
        "task", "condition", "example_id", "perm_idx", fill(template, slots).alias("prompt")
    )


def change_type_prompt(
    examples: DataFrame, label: str | None = None, conditions=v.CONDITIONS, missing=None, whole: bool = True
) -> DataFrame:
    """Three-option questions on the kind of change, all orderings."""
    options = op.build_options(F.col("type_wrong"), F.col("type_correct"))
    prepared = (
        askable(examples)
        .where(_offered(options, 3))
        .withColumn("task", F.lit("CTR"))
        .withColumn("_snippet", tx.number_lines(F.col("old")))
        .withColumn("_phrase", F.lit(""))
        .withColumn("_shown", F.transform(options, op.change_type_phrase))
    )
    return _choice_prompts(prepared, v.CHANGE_TYPE_PROMPT, 3, label, conditions, missing, whole)


def location_prompt(
    examples: DataFrame,
    label: str | None = None,
    conditions=v.CONDITIONS,
    modes=v.MODES,
    missing=None,
    whole: bool = True,
) -> DataFrame:
    """Four-option questions on line numbers, both modes, all orderings."""
    options = op.build_options(F.col("wrong"), F.col("loc_correct"))
    numbered = askable(examples).withColumns(
        {
            "_snippet": tx.number_lines(F.col("old")),
            "_phrase": op.change_type_phrase(F.col("type_correct")),
        }
    )
    prepared = (
        rows.option_mode(numbered, "location", modes)
        .where(_offered(options, 4))
        .withColumn(
            "_shown",
            F.transform(options, lambda o: F.array_join(o.cast("array<string>"), ",")),
        )
    )
    return _choice_prompts(prepared, v.LOCATION_PROMPT, 4, label, conditions, missing, whole)


def solution_prompt(
    examples: DataFrame,
    label: str | None = None,
    conditions=v.CONDITIONS,
    modes=v.MODES,
    missing=None,
    whole: bool = True,
) -> DataFrame:
    """Four-option questions on code revisions, both modes, all orderings."""
    options = op.build_options(F.col("wrong"), F.col("solution_correct"))
    numbered = askable(rows.eligible_for_task(examples, "SIE")).withColumns(
        {
            "_snippet": tx.number_lines(F.col("old")),
            "_phrase": op.change_type_phrase(F.col("type_correct")),
        }
    )
    prepared = (
        rows.option_mode(numbered, "solution", modes)
        .where(_offered(options, 4))
        .withColumn("_shown", F.transform(options, lambda o: F.concat(F.lit("\n"), o)))
    )
    return _choice_prompts(prepared, v.SOLUTION_PROMPT, 4, label, conditions, missing, whole)
