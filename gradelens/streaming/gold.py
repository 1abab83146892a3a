"""Gold texts in the forms that metrics compare with, stored once for streams of answers.

They are a table bucketed by example, in buckets of about equal size. A batch whose answers touch most
buckets joins the table, of which nothing is shuffled; any other batch reads the files of the buckets of
the examples it answers. The number of buckets grows with the examples and their size does not, so what
a batch reads depends on its answers alone.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelens.functions import text as tx
from gradelens.operators import joins
from gradelens.sources import markers

ROWS_A_BUCKET = 100_000
KEPT = ["example_id", "lang", "type_correct"]
STORED = "example_id long, lang string, type_correct string, forms array<string>"
FILE_OF_BUCKET = re.compile(r"_(\d+)\.c\d+[^/]*\.parquet$")


def _bucket(buckets: int) -> Column:
    """The bucket as ``bucketBy`` numbers it."""
    return F.pmod(F.hash(F.col("example_id").cast("long")), F.lit(buckets)).cast("int")


def store_gold_forms(examples: DataFrame, path: str, rows_a_bucket: int = ROWS_A_BUCKET) -> None:
    """Normalise the gold text of every example and store it below ``path``.

    Texts are shuffled before their forms are made: those are longer than the text. The forms of a text
    lie side by side in one column, where they compress as copies.
    """
    spark = examples.sparkSession
    buckets = max(1, -(-examples.select("example_id").count() // rows_a_bucket))
    texts = joins.gold_texts(examples).withColumn("example_id", F.col("example_id").cast("long"))
    dealt = texts.repartition(buckets, "example_id")
    forms = dealt.select(*KEPT, F.array(tx.spaced(F.col("gold")), tx.spaced(tx.remove_comments(F.col("gold")))).alias("forms"))
    name = f"gold_forms_{uuid.uuid4().hex}"
    writer = forms.write.bucketBy(buckets, "example_id").sortBy("example_id").format("parquet")
    writer.options(path=f"{path}/forms", compression="zstd").saveAsTable(name)
    spark.createDataFrame([(buckets, name)], "buckets int, name string").write.json(f"{path}/about")


def _table(spark: SparkSession, path: str, buckets: int, name: str) -> DataFrame:
    """The stored table, which a session that did not write it does not know yet."""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({STORED}) USING parquet "
        f"CLUSTERED BY (example_id) SORTED BY (example_id) INTO {buckets} BUCKETS LOCATION '{path}/forms'"
    )
    return spark.table(name)


def gold_forms_of(spark: SparkSession, path: str, answers: DataFrame) -> DataFrame:
    """The stored forms in the buckets of the answered examples; files of other buckets are not read.

    Where most buckets are touched this is the whole table, which joins by example without a shuffle.
    """
    about = spark.read.schema("buckets int, name string").json(f"{path}/about").first()
    # at most as many numbers as there are buckets
    touched = {r.bucket for r in answers.select(_bucket(about.buckets).alias("bucket")).distinct().collect()}
    if 2 * len(touched) > about.buckets:
        stored = _table(spark, path, about.buckets, about.name)
    else:
        files = [m.getPath().toString() for m in markers.listed(spark, f"{path}/forms/*.parquet")]
        there = [f for f in files if (found := FILE_OF_BUCKET.search(f)) and int(found[1]) in touched]
        stored = spark.read.schema(STORED).parquet(*there) if there else spark.createDataFrame([], STORED)
    # blanks are the only whitespace left in spaced texts
    squashed = F.replace(F.col("forms")[1], F.lit(" "), F.lit(""))
    return stored.select(*KEPT, F.col("forms")[0].alias("_gold_spaced"), squashed.alias("_gold_bare_squashed"))
