"""Per-example scores and the reports over them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradelens import values as v
from gradelens.functions import answers as an
from gradelens.functions import metrics as mx
from gradelens.functions import options as op
from gradelens.operators import fanout, joins
from gradelens.operators.rejects import Rejects

CELL = ("model", "condition", "task")
MOST_ORDERINGS = op.ordering_count(4)


def score_generations(examples: DataFrame, responses: DataFrame) -> DataFrame:
    """The exact-match scores of every generated answer; one answer per key."""
    paired = joins.attach_gold_forms(joins.gold_forms(examples), responses)
    return mx.score_against_forms(paired).select(
        *joins.GENERATION_KEY, "lang", "type_correct", *mx.METRICS
    )


def score_ranks(golds: DataFrame, responses: DataFrame) -> DataFrame:
    """Every key with the ``rank`` of its last delivered answer, from which scores are read.

    ``golds`` are ``joins.gold_forms``. Each delivery meets its gold text and shrinks to one number
    that grows with delivery time, then with the text's digest, and ends in the four scores; ``max``
    finds the last delivery's. So every text is shuffled once at most, and numbers are folded by
    hashing, map side first.
    """
    scored = mx.score_against_forms(joins.attach_gold_forms(golds, responses))
    wide = "decimal(38,0)"
    flags = sum(F.col(m) * 2**i for i, m in enumerate(mx.METRICS))
    digest = F.col("_digest").cast(wide) + F.lit(str(2**63)).cast(wide)
    # years up to 9999 stay below 10**38
    rank = (joins.delivery_time().cast(wide) * F.lit(str(2**64)).cast(wide) + digest) * F.lit(16).cast(wide)
    return fold_ranks(scored.withColumn("rank", (rank + flags).cast(wide)))


def fold_ranks(ranks: DataFrame) -> DataFrame:
    """The greatest rank of every key; folding parts and folding all of them give the same."""
    return ranks.groupBy(*joins.GENERATION_KEY, "lang", "type_correct").agg(F.max("rank").alias("rank"))


def read_ranks(folded: DataFrame) -> DataFrame:
    """Ranks as the four exact-match scores."""
    flags = F.pmod("rank", F.lit(16).cast("decimal(38,0)")).cast("int")
    bits = [F.getbit("_flags", F.lit(i)).cast("int").alias(m) for i, m in enumerate(mx.METRICS)]
    return folded.withColumn("_flags", flags).select(
        *joins.GENERATION_KEY, "lang", "type_correct", *bits
    )


def score_deliveries(
    examples: DataFrame, responses: DataFrame, rejects: Rejects | None = None
) -> DataFrame:
    """The exact-match scores of the last delivered answer of every key."""
    return read_ranks(score_ranks(joins.gold_forms(examples, rejects), responses))


def answers_by_example(decoded: DataFrame, counted: bool = False) -> DataFrame:
    """All picks of one example in one row, the last delivered answer of each ordering.

    Every ordering owns one slot. A slot is a number that grows with delivery time and ends
    in the pick, so ``max`` finds the last pick. Orderings and repeats fold together on the
    map side, and one row per example is what gets shuffled. With ``counted`` the row also
    tells how many answers were delivered, and how many to orderings that exist.
    """
    rank = joins.delivery_time() * 4 + F.col("pick")
    slots = [
        F.max(F.when(F.col("perm_idx") == i, rank)).alias(f"s{i}") for i in range(MOST_ORDERINGS)
    ]
    ends = {"_of_3": op.ordering_count(3), "_of_4": MOST_ORDERINGS}
    held = {name: F.col("perm_idx").between(0, end - 1) for name, end in ends.items()}
    tallies = [F.count("*").alias("_all"), *[F.count_if(x).alias(n) for n, x in held.items()]] if counted else []
    return decoded.groupBy(*CELL, "example_id").agg(*slots, *tallies)


#: Answers that are folded together where they lie; so many to the power of the four keys fit in 64 bits.
ANSWERS_AT_ONCE = 50_000


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, ``ANSWERS_AT_ONCE`` of them or what is left at the end."""
    held, rows = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, ANSWERS_AT_ONCE - rows)
            batch, rows = batch.slice(part.num_rows), rows + part.num_rows
            held.append(part)
            if rows == ANSWERS_AT_ONCE:
                yield pa.concat_batches(held)
                held, rows = [], 0
    if held:
        yield pa.concat_batches(held)


def _groups(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray]:
    """The examples' keys in a batch of answers, and the place of each answer's among them."""
    key = [*CELL, "example_id"]
    code = np.zeros(batch.num_rows, np.int64)
    for name in key:
        column = batch.column(name).dictionary_encode(null_encoding="encode")
        code = code * (len(column.dictionary) + 1) + column.indices.to_numpy()
    _, first, group = np.unique(code, return_index=True, return_inverse=True)
    return batch.select(key).take(pa.array(first)), group


def _fold_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The slots of each batch of ranked answers."""
    nothing = np.iinfo(np.int64).min
    for batch in _gathered(batches):
        keys, group = _groups(batch)
        place = batch.column("perm_idx").fill_null(-1).to_numpy()
        rank = batch.column("rank").fill_null(nothing).to_numpy()
        held = (place >= 0) & (place < MOST_ORDERINGS)
        slots = np.full((MOST_ORDERINGS, keys.num_rows), nothing, np.int64)
        np.maximum.at(slots, (place[held], group[held]), rank[held])
        columns = [*keys.columns, *[pa.array(s, mask=s == nothing) for s in slots]]
        yield pa.RecordBatch.from_arrays(columns, [*keys.schema.names, *[f"s{i}" for i in range(MOST_ORDERINGS)]])


def _last_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch of ranked and scored answers, the last answer of every ordering, beside its example's key."""
    kept = [field.split()[0] for field in RECORD]
    for batch in _gathered(batches):
        keys, group = _groups(batch)
        columns = {name: batch.column(name).to_numpy() for name in kept}
        slot = group * MOST_ORDERINGS + columns["perm_idx"]
        # by slot, then as the fields come; numbers that are none come last, as in a maximum
        order = np.lexsort([*[columns[name] for name in reversed(kept[1:])], slot])
        last = order[np.append(np.diff(slot[order]) != 0, True)]
        ends = np.append(0, np.cumsum(np.bincount(group[last], minlength=keys.num_rows)))
        found = pa.StructArray.from_arrays([pa.array(columns[name][last]) for name in kept], kept)
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)
        yield pa.RecordBatch.from_arrays([*keys.columns, lists], [*keys.schema.names, "found"])


def answers_by_neighbours(decoded: DataFrame) -> DataFrame:
    """``answers_by_example`` of each batch of neighbouring answers, so with several rows where an example's lie apart.

    Nothing is shuffled and no task holds more than a batch. Folding these rows gives ``answers_by_example``.
    """
    rank = joins.delivery_time() * 4 + F.col("pick")
    ranked = decoded.select(*CELL, "example_id", "perm_idx", rank.alias("rank"))
    kinds = dict(ranked.dtypes)
    slots = [f"s{i} long" for i in range(MOST_ORDERINGS)]
    return ranked.mapInArrow(_fold_batches, ", ".join([*[f"{k} {kinds[k]}" for k in (*CELL, "example_id")], *slots]))


def unplaced_answers(decoded: DataFrame, keys: DataFrame) -> DataFrame:
    """How many answers of each cell belong to no ordering of an existing question.

    Such answers count in no score: their ordering number is missing or outside the task's
    orderings, or their example offers no such question or is not there.
    """
    asked = decoded.select(*CELL, "example_id", "perm_idx").join(keys, "example_id", "left")
    orderings = F.coalesce(F.length(F.col("keys")[F.col("task")]), F.lit(0))
    placed = F.coalesce(F.col("perm_idx").between(F.lit(0), orderings - 1), F.lit(False))
    return asked.where(~placed).groupBy(*CELL).agg(F.count("*").alias("unplaced"))


def position_lists(slots: DataFrame, keys: DataFrame) -> DataFrame:
    """Slots beside the key, as two lists in ordering order.

    The lists are as long as the task has orderings; a missing answer is null.
    """
    return _position_lists(fanout.with_key(slots, keys))


def _position_lists(keyed: DataFrame) -> DataFrame:
    letters = an.letter_array(4)
    ranks = F.array(*[F.col(f"s{i}") for i in range(MOST_ORDERINGS)])
    return keyed.select(
        *CELL,
        "example_id",
        "lang",
        "type_correct",
        F.transform(
            F.slice(ranks, F.lit(1), F.length("key")),
            lambda rank: F.get(letters, F.pmod(rank, F.lit(4)).cast("int")),
        ).alias("model_answers"),
        F.split("key", "").alias("correct_answers"),
    )


def orderings_by_position(decoded: DataFrame, keys: DataFrame) -> DataFrame:
    """Answers and right letters of each example as lists in ordering order."""
    return position_lists(answers_by_example(decoded), keys)


#: An ordering's answer in a record, as it is folded: the greatest of these counts.
RECORD = ("perm_idx int", "rank long", *[f"{letter} double" for letter in v.LETTERS])


def _records_by_neighbours(scored: DataFrame) -> DataFrame:
    """The answers of each example as one list ``found``, or several where its answers lie apart.

    An ordering is in a list once, with the last answer that lies near. Nothing is sorted or shuffled.
    """
    rank = joins.delivery_time() * 4 + an.pick_index(F.col("scores"))
    letters = [F.get("scores", F.lit(i)).alias(letter) for i, letter in enumerate(v.LETTERS)]
    ranked = scored.select(*CELL, "example_id", "perm_idx", rank.alias("rank"), *letters)
    kinds = dict(ranked.dtypes)
    fields = ", ".join(field.replace(" ", ": ") for field in RECORD)
    keys = ", ".join(f"{k} {kinds[k]}" for k in (*CELL, "example_id"))
    return ranked.mapInArrow(_last_scores, f"{keys}, found array<struct<{fields}>>")


def choice_records(responses: DataFrame, keys: DataFrame) -> DataFrame:
    """What is kept of every example: picks, right letters and all letters' scores, by ordering.

    The last delivered answer of an ordering counts, as in ``answers_by_example``; an ordering without
    an answer has a null pick and null scores. Answers fold to lists where they lie, lists are shuffled once,
    by example, and what follows keeps that partitioning.
    """
    scored = joins.task_scores(responses).where(F.col("perm_idx").between(0, MOST_ORDERINGS - 1))
    lists = _records_by_neighbours(scored).repartition("example_id")
    together = lists.groupBy(*CELL, "example_id").agg(F.sort_array(F.flatten(F.collect_list("found"))).alias("_all"))

    def last(answer: Column, i: Column) -> Column:
        return F.coalesce(F.get("_all", i + 1)["perm_idx"] != answer["perm_idx"], F.lit(True))

    scores = lambda answer: F.array(*[answer[letter] for letter in v.LETTERS])
    entries = F.transform(
        F.filter("_all", last),
        lambda a: F.struct(a["perm_idx"], F.struct(F.pmod(a["rank"], F.lit(4)).cast("int").alias("pick"), scores(a).alias("scores"))),
    )
    found = together.select(*CELL, "example_id", F.map_from_entries(entries).alias("_found"))
    keyed = fanout.with_key(found, keys)
    places = F.sequence(F.lit(0), F.length("key") - 1)
    letters = an.letter_array(4)
    return keyed.select(
        *CELL,
        "example_id",
        "lang",
        F.col("type_correct").alias("ground_truth"),
        F.split("key", "").alias("correct_answers"),
        F.transform(places, lambda p: F.get(letters, F.col("_found")[p]["pick"])).alias("model_answers"),
        F.transform(places, lambda p: F.col("_found")[p]["scores"]).alias("symbol_scores"),
    )


def score_slots(slots: DataFrame, keys: DataFrame) -> DataFrame:
    """Right answers per example and whether every ordering was answered right."""
    return _score_lists(position_lists(slots, keys))


def _score_lists(lists: DataFrame) -> DataFrame:
    return lists.select(
        *CELL,
        "example_id",
        "lang",
        "type_correct",
        mx.matching_answers(F.col("model_answers"), F.col("correct_answers")).alias("matches"),
        F.size("correct_answers").alias("orderings"),
    ).withColumn("hit", (F.col("matches") == F.col("orderings")).cast("int"))


def score_choices(
    responses: DataFrame, keys: DataFrame, rejects: Rejects | None = None
) -> DataFrame:
    """``score_slots`` over raw answers; ``rejects`` counts what ``unplaced_answers`` does."""
    decoded = joins.decode_answers(responses)
    if rejects is None:
        return score_slots(answers_by_example(decoded), keys)
    asked = answers_by_example(decoded, counted=True).join(keys, "example_id", "left")
    asked = asked.withColumn("key", F.col("keys")[F.col("task")]).drop("keys")
    three = F.length("key") == op.ordering_count(3)
    placed = F.when(F.col("key").isNull(), 0).when(three, F.col("_of_3")).otherwise(F.col("_of_4"))
    seen = rejects.observe(asked, "choices", {"unplaced": F.sum(F.col("_all") - placed)})
    return _score_lists(_position_lists(seen.where(F.col("key").isNotNull())))


def percent(part: Column, whole: Column) -> Column:
    """Share of a whole in percent, divided first as the published scores are."""
    return part / whole * 100


def refine_report(scored: DataFrame) -> DataFrame:
    """Count, hits and percent of each exact-match metric per model and condition."""
    sums = [F.sum(m).alias(m) for m in mx.METRICS]
    return scored.groupBy("model", "condition").agg(F.count("*").alias("n"), *sums).select(
        "model",
        "condition",
        "n",
        *mx.METRICS,
        *[percent(F.col(m), F.col("n")).alias(f"{m}_pct") for m in mx.METRICS],
    )


def choice_report(scored: DataFrame) -> DataFrame:
    """Order-invariant accuracy (R2) and mean right orderings (R3) per cell."""
    return (
        scored.groupBy(*CELL)
        .agg(
            F.count("*").alias("n"),
            F.sum("hit").alias("invariant"),
            F.sum("matches").alias("_matches"),
            F.max("orderings").alias("orderings"),
        )
        .select(
            *CELL,
            "n",
            "invariant",
            percent(F.col("invariant"), F.col("n")).alias("value"),
            (F.col("_matches") / F.col("n")).alias("avg_correct"),
            "orderings",
        )
    )


def invariant_accuracy(scored: DataFrame) -> DataFrame:
    """Examples answered right in every ordering, as count and percent (R2)."""
    return choice_report(scored).select(*CELL, "n", "invariant", "value")


def avg_correct(scored: DataFrame) -> DataFrame:
    """Mean number of right orderings per example."""
    return choice_report(scored).select(*CELL, "n", "avg_correct", "orderings")


def answer_positions(lists: DataFrame) -> DataFrame:
    """How often each letter was picked when each letter was right."""
    pairs = F.explode(F.arrays_zip("correct_answers", "model_answers"))
    return (
        lists.select("task", pairs.alias("_p"))
        .groupBy(
            "task",
            F.col("_p.correct_answers").alias("correct_symbol"),
            F.col("_p.model_answers").alias("picked"),
        )
        .agg(F.count("*").alias("n"))
    )


def by_ground_truth(scored: DataFrame, hit: str = "hit") -> DataFrame:
    """Score of each cell overall, per change type and per language.

    Rows are summed once; only the few sums are grouped in three ways.
    """
    parts = scored.groupBy(*CELL, "type_correct", "lang").agg(
        F.count("*").alias("_n"), F.sum(hit).alias("_hits")
    )
    grouped = parts.groupingSets(
        [
            [F.col(c) for c in CELL],
            [*[F.col(c) for c in CELL], F.col("type_correct")],
            [*[F.col(c) for c in CELL], F.col("lang")],
        ],
        *[F.col(c) for c in CELL],
        F.col("type_correct"),
        F.col("lang"),
    ).agg(
        F.grouping("type_correct").alias("_t"),
        F.grouping("lang").alias("_l"),
        F.sum("_n").alias("n"),
        F.sum("_hits").alias("hits"),
    )
    breakdown = F.when(F.col("_t") == 0, "type_correct").when(F.col("_l") == 0, "lang")
    return grouped.select(
        *CELL,
        breakdown.otherwise("all").alias("breakdown"),
        F.coalesce("type_correct", "lang").alias("part"),
        "n",
        "hits",
        percent(F.col("hits"), F.col("n")).alias("value"),
    )
