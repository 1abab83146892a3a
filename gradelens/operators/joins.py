"""Answers meet examples, by key."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradelens import values as v
from gradelens.functions import answers as an
from gradelens.functions import metrics as mx
from gradelens.functions import text as tx
from gradelens.operators import fanout
from gradelens.operators.rejects import Rejects, split_off

GENERATION_KEY = ("model", "condition", "example_id")


def delivery_time() -> Column:
    """When an answer was delivered, in microseconds; an unknown time is the start of 1970."""
    return F.coalesce(F.unix_micros("ingest_ts"), F.lit(0))


def text_digest() -> Column:
    """Settles which of several texts delivered at the same time counts: the greatest digest."""
    return F.xxhash64(F.coalesce("content", F.lit("")))


def latest_answers(responses: DataFrame, key: Sequence[str]) -> DataFrame:
    """The last delivered answer of every key, as whole rows.

    An aggregate, not a window: each task keeps one row per key before anything is shuffled,
    so a key with very many copies is no hot spot. Scoring gets by without it and moves fewer
    texts (``scoring.score_deliveries``, ``scoring.answers_by_example``); equal times are settled
    here as they are there: by the greater pick of choices, and the greater digest of texts.
    Choices that ``decode_answers`` has read move their picks alone.
    """
    carried = [c for c in responses.columns if c not in key]
    if "pick" in carried:
        ranked = responses.withColumn("_tie", F.col("pick"))
    elif "logprobs" in carried:
        ranked = task_scores(responses).withColumn("_tie", an.pick_index(F.col("scores")))
    elif "content" in carried:
        ranked = responses.withColumn("_tie", text_digest())
    else:
        ranked = responses.withColumn("_tie", F.lit(0))
    latest = ranked.groupBy(*key).agg(
        F.max(F.struct(delivery_time().alias("_time"), "_tie", *carried)).alias("_latest")
    )
    return latest.select(*[F.col(c) if c in key else F.col(f"_latest.{c}").alias(c) for c in responses.columns])


def generated_texts(responses: DataFrame) -> DataFrame:
    """Answers reduced to their key, cleaned text and delivery time."""
    content = F.coalesce("content", F.lit(""))
    text = tx.drop_line_numbers(an.clean_generation(content))
    return responses.select(
        *GENERATION_KEY, text.alias("generation"), "ingest_ts", text_digest().alias("_digest")
    )


def gold_texts(examples: DataFrame, rejects: Rejects | None = None) -> DataFrame:
    """Examples reduced to their id, groups and gold text; one without a gold text is rejected."""
    given = split_off(examples, "examples", {"null_gold": F.col("new").isNull()}, rejects)
    gold = tx.strip_markers(F.col("new")).alias("gold")
    return given.select("example_id", "lang", "type_correct", gold)


def attach_generations(examples: DataFrame, responses: DataFrame) -> DataFrame:
    """Cleaned answers beside their gold texts.

    Both sides are reduced to an id and one text before the join.
    """
    return generated_texts(responses).drop("_digest").join(gold_texts(examples), "example_id")


def gold_forms(examples: DataFrame, rejects: Rejects | None = None) -> DataFrame:
    """Ids, groups and the forms of the gold texts that metrics compare with."""
    return gold_texts(examples, rejects).withColumns(mx.gold_forms(F.col("gold"))).drop("gold")


def attach_gold_forms(golds: DataFrame, responses: DataFrame) -> DataFrame:
    """Cleaned answers beside the ``gold_forms`` of their example.

    A gold text is normalised once, before it meets the answers of all models. Answers to a hot
    example are split over several tasks and its forms copied to each. Where no example is hot,
    rows are joined by example alone, so tables that are bucketed by example are not shuffled.
    """
    texts = generated_texts(responses)
    hot = hot_examples(responses)
    if not hot:
        return texts.join(golds, "example_id")
    # at most two thousand rows in all, whatever the tables hold
    parts = F.broadcast(responses.sparkSession.createDataFrame(hot, "example_id long, _parts int"))
    mine = F.coalesce(F.pmod(F.xxhash64("_digest", "ingest_ts", "model", "condition"), "_parts"), F.lit(0))
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))
    salted = texts.join(parts, "example_id", "left").withColumn("_part", mine.cast("int")).drop("_parts")
    copied = golds.join(parts, "example_id", "left").withColumn("_part", copies).drop("_parts")
    return salted.join(copied, ["example_id", "_part"]).drop("_part")


#: An example is hot from one in HOT_SHARE of all answers on, if these are HOT_LEAST at least.
HOT_SHARE, HOT_LEAST = 1000, 10_000


def hot_examples(responses: DataFrame, share: int = HOT_SHARE, least: int = HOT_LEAST) -> list[tuple[int, int]]:
    """Examples that hold many of the answers, with the number of parts to split them into.

    One sketch of heavy hitters, folded on the map side, reads ids alone. Fewer than ``share``
    examples can hold more than that share, and the parts of all are at most twice as many.
    """
    found = responses.agg(
        F.expr(f"approx_top_k(example_id, {share}, {10 * share})").alias("top"), F.count("*").alias("n")
    ).first()
    part = max(found.n / share, least)
    return [(x["item"], math.ceil(x["count"] / part)) for x in found.top if x["item"] is not None and x["count"] > part]


def letter_scores(responses: DataFrame, offered: Callable[[Column], Column] = lambda four: four) -> DataFrame:
    """Add the ``scores`` of the four letters, as ``offered`` makes them from all four (G3 with G4).

    In steps, so that tokens are read once for all letters.
    """
    latest_first = F.reverse("logprobs")
    # usual content needs no stripping: whitespace at its ends is no part of the pattern
    content, usual = F.coalesce("content", F.lit("")), F.col("_usual")
    read = responses.withColumns({"_latest": latest_first, "_usual": an.usual_answer(content)}).withColumns(
        {
            "_tokens": an.stripped_tokens(F.col("_latest")["token"]),
            "_values": F.col("_latest")["logprob"],
            "_stripped": F.when(usual, content).otherwise(tx.strip(content)),
        }
    )
    four = an.scores_of(F.col("_tokens"), F.col("_values"), v.LETTERS)
    scores = an.scores_if(an.valid_content(usual, F.col("_stripped")), offered(F.col("_four")), v.LETTERS)
    seen = read.withColumn("_four", four).withColumn("scores", scores)
    return seen.drop("_latest", "_usual", "_tokens", "_values", "_stripped", "_four")


def task_scores(responses: DataFrame) -> DataFrame:
    """``letter_scores`` of the letters that the row's task offers."""
    return letter_scores(responses, lambda four: an.offered_scores(F.col("task"), four))


def decode_answers(responses: DataFrame) -> DataFrame:
    """Replace content and token log-probabilities by the picked letter."""
    return task_scores(responses).select(
        "model",
        "condition",
        "task",
        "example_id",
        "perm_idx",
        an.pick_index(F.col("scores")).alias("pick"),
        "ingest_ts",
    )


def attach_choice_answers(responses: DataFrame, keys: DataFrame) -> DataFrame:
    """Decoded answers beside the right letter of their ordering, in long form.

    The key row of the example is joined, not its exploded orderings. Needs one answer per
    ordering; scoring with repeats goes through ``answers_by_example``. Answers that have been decoded
    are taken as they are.
    """
    decoded = responses if "pick" in responses.columns else decode_answers(responses)
    return fanout.with_key(decoded, keys).select(
        "model",
        "condition",
        "task",
        "example_id",
        "perm_idx",
        F.get(an.letter_array(4), F.col("pick")).alias("picked"),
        F.substr("key", F.col("perm_idx") + 1, F.lit(1)).alias("correct_symbol"),
        "lang",
        "type_correct",
    )
