"""Scores kept current while answers arrive as files (R6s).

Answers may be delivered again, in a later file, and the last one counts. So each micro-batch
is reduced to small rows that carry their delivery time and is stored under its stream and number;
a batch that runs again after a loss overwrites itself, and a stream that starts anew with another
checkpoint never overwrites what an earlier one stored. Totals are one aggregate over those small
rows, the same one that batch scoring uses, so rows stored twice count once. Stored batches are
merged level by level (``store``), and gold texts lie ready in buckets (``gold``), so neither a look
nor a batch reads more as batches and examples grow in number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from gradelens import schemas
from gradelens.operators import joins, scoring
from gradelens.streaming import store
from gradelens.streaming.gold import gold_forms_of

AT_ONCE = {"availableNow": True}
STORED_RANKS = T.StructType(
    [
        *[schemas.GENERATIONS[k] for k in joins.GENERATION_KEY],
        *[schemas.EXAMPLES[k] for k in ("lang", "type_correct")],
        T.StructField("rank", T.DecimalType(38, 0)),
    ]
)
SLOTS = [f"s{i}" for i in range(scoring.MOST_ORDERINGS)]
STORED_SLOTS = T.StructType(
    [
        *[schemas.CHOICES[k] for k in (*scoring.CELL, "example_id")],
        *[T.StructField(s, T.LongType()) for s in SLOTS],
    ]
)


def _follow(
    spark: SparkSession, feed: str, schema: T.StructType, reduce_batch, stored: T.StructType, fold, folder: str,
    checkpoint: str, files_per_batch: int, trigger: dict,
) -> StreamingQuery:
    def keep(batch: DataFrame, number: int) -> None:
        # the stream's own id, which its checkpoint holds before the first batch
        told = spark.read.schema("id string").json(f"{checkpoint}/metadata").first()
        kept = store.batch_folder(folder, told.id, number)
        reduce_batch(batch).write.mode("overwrite").parquet(kept, compression="zstd")
        store.compact(spark, folder, stored, fold)

    arriving = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(feed)
    )
    return (
        arriving.writeStream.foreachBatch(keep)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def _fold_slots(slots: DataFrame) -> DataFrame:
    return slots.groupBy(*scoring.CELL, "example_id").agg(*[F.max(s).alias(s) for s in SLOTS])


def stream_generations(
    spark: SparkSession,
    feed: str,
    gold: str,
    folder: str,
    checkpoint: str,
    files_per_batch: int = 1000,
    trigger: dict = AT_ONCE,
) -> StreamingQuery:
    """Score the generated answers that arrived since the last run and store the scores in ``folder``.

    ``gold`` is where ``gold.store_gold_forms`` has put the gold texts.
    """

    def score(batch: DataFrame) -> DataFrame:
        return scoring.score_ranks(gold_forms_of(spark, gold, batch), batch)

    return _follow(
        spark, feed, schemas.GENERATIONS, score, STORED_RANKS, scoring.fold_ranks, folder, checkpoint,
        files_per_batch, trigger,
    )


def generation_totals(spark: SparkSession, folder: str) -> DataFrame:
    """The report over everything stored so far."""
    ranks = store.read(spark, folder, STORED_RANKS)
    return scoring.refine_report(scoring.read_ranks(scoring.fold_ranks(ranks)))


def stream_choices(
    spark: SparkSession, feed: str, folder: str, checkpoint: str, files_per_batch: int = 1000,
    trigger: dict = AT_ONCE,
) -> StreamingQuery:
    """Fold the choice answers that arrived since the last run into slots and store those.

    The orderings of one example may arrive in different batches. Answers that lie together are folded
    where they lie; rows of one example that are left are folded when stored batches are merged or looked at.
    """

    def fold(batch: DataFrame) -> DataFrame:
        return scoring.answers_by_neighbours(joins.decode_answers(batch))

    return _follow(
        spark, feed, schemas.CHOICES, fold, STORED_SLOTS, _fold_slots, folder, checkpoint, files_per_batch, trigger
    )


def choice_totals(spark: SparkSession, folder: str, keys: DataFrame) -> DataFrame:
    """The choice report over everything stored so far; the fold and the keys share one shuffle by example."""
    slots = _fold_slots(store.read(spark, folder, STORED_SLOTS).repartition("example_id"))
    return scoring.choice_report(scoring.score_slots(slots, keys))
