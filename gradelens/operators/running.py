"""Running sums that stay parallel inside one large group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gradelens.functions import text as tx
from gradelens.functions.metrics import once
from gradelens.session import fresh_path

CELL = ("model", "condition", "task")
#: Ranges of ids that every cell is cut into.
RANGES = 256


def line_offsets(df: DataFrame, key: str, text: Column) -> DataFrame:
    """Offsets at which the lines of each text start, then the end offset.

    An offset is the summed length of the lines before it. Sums are made inside the row, so
    nothing is shuffled.
    """
    return df.select(key, F.posexplode(offsets(text)).alias("pos", "line_offset"))


def _sums(numbers: Column) -> Column:
    """The sum before each number of a short list, then the sum of all; every step copies the list."""
    start = F.array(F.lit(0).cast("bigint"))
    return F.aggregate(numbers, start, lambda sums, n: F.array_append(sums, F.element_at(sums, -1) + n))


def offsets(text: Column) -> Column:
    """``line_offsets`` as a list.

    Lines are cut into blocks, about as many as a block has lines: sums are made inside every
    block and over the blocks' totals, so the lists that steps copy stay short.
    """

    def in_blocks(lengths: Column) -> Column:
        wide = F.ceil(F.sqrt(F.size(lengths))).cast("int")
        starts = F.sequence(F.lit(1), F.size(lengths), wide)
        blocks = F.transform(starts, lambda at: _sums(F.slice(lengths, at, wide)))
        return once(blocks, put_together)

    def put_together(blocks: Column) -> Column:
        return once(
            _sums(F.transform(blocks, lambda sums: F.element_at(sums, -1))),
            lambda before: F.array_append(
                F.flatten(
                    F.zip_with(
                        blocks,
                        F.slice(before, F.lit(1), F.size(blocks)),
                        lambda sums, base: F.transform(
                            F.slice(sums, F.lit(1), F.size(sums) - 1), lambda offset: offset + base
                        ),
                    )
                ),
                F.element_at(before, -1),
            ),
        )

    return once(F.transform(tx.lines(text), lambda line: F.length(line).cast("bigint")), in_blocks)


def range_of(column: Column, bounds: list[int], first: int = 0) -> Column:
    """The number of bounds up to a value, by a binary search written out as conditions."""
    if not bounds:
        return F.lit(first)
    middle = len(bounds) // 2
    below = range_of(column, bounds[:middle], first)
    return F.when(column < bounds[middle], below).otherwise(
        range_of(column, bounds[middle + 1 :], first + middle + 1)
    )


def progress(scored: DataFrame, hit: str = "hit", ranges: int = RANGES) -> DataFrame:
    """Hits and rows so far of every cell, in example order.

    Scores are computed once and stored in the shared folder. A cell can hold most of the rows, so
    all cells are cut at the same ``ranges`` quantiles of the stored ids, which one sketch, folded
    on the map side, estimates; that ids are sparse or crowded does not matter. Rows are shuffled
    once, by cell and range: totals and running sums read the same shuffle, and the totals of
    earlier ranges, one row for each cell and range, are added to the sums inside a range.
    """
    spark, path = scored.sparkSession, fresh_path(scored.sparkSession, "progress")
    hits = F.col(hit).cast("bigint").alias("_hit")
    scored.select(*CELL, "example_id", hits).write.parquet(path)
    stored = spark.read.parquet(path)
    shares = [i / ranges for i in range(1, ranges)]
    quantiles = stored.agg(F.percentile_approx("example_id", shares)).first()[0] if shares else None
    place = range_of(F.col("example_id"), sorted(set(quantiles or [])))
    ranged = stored.withColumn("_range", F.when(F.col("example_id").isNull(), 0).otherwise(place)).repartition(
        *CELL, "_range"
    )
    totals = ranged.groupBy(*CELL, "_range").agg(
        F.sum("_hit").alias("_hits"),
        F.count("example_id").alias("_rows"),
    )
    earlier = W.partitionBy(*CELL).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select(
        *CELL,
        "_range",
        *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("_hits", "_rows")],
    )
    within = (
        W.partitionBy(*CELL, "_range")
        .orderBy("example_id")
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    counted = ranged.select(
        *CELL,
        "_range",
        "example_id",
        F.sum("_hit").over(within).alias("_hits_in"),
        F.count("example_id").over(within).alias("_rows_in"),
    )
    return counted.join(carried, [*CELL, "_range"]).select(
        *CELL,
        "example_id",
        (F.col("_hits_in") + F.col("_hits_before")).alias("hits_so_far"),
        (F.col("_rows_in") + F.col("_rows_before")).alias("rows_so_far"),
    )
