"""One large JSON array of objects, read in parallel.

Byte ranges of a file are read by Spark's text reader with the closing brace as the end of a record, so
a range is a row of short pieces in order. Whether a piece begins inside a string, and how deep,
depends on all pieces before it, but each of them only flips or keeps the first and adds to the
second. So quotes are summed first, by range and then over the few ranges' totals; that settles which
braces count, and depths are summed the same way. An element ends with the piece that comes back to
the depth of the array, and its place is the number of such pieces before it. Pieces of an
element are put together again and parsed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANGE = ("file", "range")


def _count(text: Column, among: str) -> Column:
    """How many of the characters ``among`` a text holds."""
    return F.length(text) - F.length(F.regexp_replace(text, among, ""))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Pieces between closing braces, with their quotes and the depth they add.

    ``depth_out`` holds for a piece that begins outside strings and ``depth_in`` inside.
    """
    read = spark.read.option("lineSep", "}").text(path)
    pieces = read.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("range"),
        F.monotonically_increasing_id().alias("at"),
        "value",
    )
    # without escapes, every other part between quotes lies outside strings
    parts = F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"', -1)
    cut = pieces.withColumn("_parts", parts).withColumn("quotes", F.size("_parts") - 1)

    def depth(begins: int) -> Column:
        outside = F.array_join(F.filter("_parts", lambda _, i: i % 2 == begins), "")
        ends_outside = F.pmod(F.col("quotes") + begins, F.lit(2)) == 0
        return _count(outside, r"[\[{]") - _count(outside, r"[\]}]") - ends_outside.cast("int")

    return cut.withColumns({"depth_out": depth(0), "depth_in": depth(1)}).drop("_parts")


def _so_far(rows: DataFrame, value: str, name: str, *across: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over all earlier rows of the same ``across``.

    Sums run inside every range; the ranges' totals, a row each, are summed over ranges.
    """
    inside = W.partitionBy(*RANGE).orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    order = [c for c in RANGE if c not in across]
    before = W.partitionBy(*(across or [F.lit(0)])).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    totals = rows.groupBy(*RANGE).agg(F.sum(value).alias("_total"))
    starts = totals.select(*RANGE, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"))
    summed = rows.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return summed.join(starts, list(RANGE)).withColumn(name, F.col("_start") + F.col("_inside")).drop("_start", "_inside")


def read_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The objects of an array file, or of several in the order of their names, and their ``place``.

    ``place`` counts from 0. Anything but one array of objects in each file is an error; a file of no
    bytes has no objects.
    """
    pieces = _pieces(spark, path)
    where = pieces.drop("value")
    where = _so_far(where, "quotes", "quotes_before", "file")
    inside = F.pmod("quotes_before", F.lit(2)) == 1
    where = where.withColumn("depth", F.when(inside, F.col("depth_in")).otherwise(F.col("depth_out")))
    where = _so_far(where.select(*RANGE, "at", "quotes", "quotes_before", "depth"), "depth", "depth_before", "file")
    # the reader ends a file's last piece as if a brace followed it
    closed = where.groupBy("file").agg((F.sum("depth") == -1).alias("closed"))
    outside = F.pmod(F.col("quotes_before") + F.col("quotes"), F.lit(2)) == 0
    ends = outside & (F.col("depth_before") + F.col("depth") == 1)
    where = where.withColumn("ends", ends.cast("int"))
    where = _so_far(where.select(*RANGE, "at", "ends", "depth_before"), "ends", "place")
    # what follows the last element of a file has a place of its own in it
    found = pieces.select(*RANGE, "at", "value").join(where, [*RANGE, "at"])
    elements = found.groupBy("file", "place").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("range", "at", "value"))), lambda p: p["value"]), "}").alias("text"),
        F.max("ends").alias("ended"),
        F.min("depth_before").alias("depth"),
    )
    first = F.col("depth") == 0
    opening = F.when(first, r"^\s*\[\s*\{").otherwise(r"^\s*,\s*\{")
    closing = F.when(first, r"^\s*\[\s*\]\s*$").otherwise(r"^\s*\]\s*$")
    good = F.col("closed") & F.when(F.col("ended") == 1, F.rlike("text", opening)).otherwise(F.rlike("text", closing))
    wrong = F.raise_error(F.concat(F.lit("no array of objects: "), "file")).cast("string")
    checked = elements.join(closed, "file").withColumn("text", F.when(good, F.col("text")).otherwise(wrong))
    checked = checked.withColumn("kept", F.when(F.col("text").isNotNull(), F.col("ended")))
    whole = F.concat(F.regexp_replace("text", r"^[^{]*", ""), F.lit("}"))
    parsed = checked.where("kept = 1").select("place", F.from_json(whole, schema, {"mode": "FAILFAST"}).alias("e"))
    return parsed.select("place", "e.*")
