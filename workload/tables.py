"""Examples and answers derived from the driver's tables, over whole tables and whole texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelens import schemas
from gradelens import values as v
from gradelens.functions import text as tx
from gradelens.operators import fanout
from gradelens.session import fresh_path

START = 1_704_067_200  # delivery times count from here, in seconds


#: Tables that ``store`` has written: (folder of the given tables, name) -> path.
STORED: dict[tuple[str, str], str] = {}


def store(spark: SparkSession, sf_dir: str) -> dict[str, int]:
    """Write documents, examples and answers once, and read them from there from now on; their rows."""
    parts, rows = spark.sparkContext.defaultParallelism * 2, {}
    for name, derive in (("documents", documents), ("examples", examples), ("generations", generations), ("choices", choices)):
        path, made = fresh_path(spark, f"stored-{name}"), derive(spark, sf_dir)
        if name == "choices":
            made.write.partitionBy("task").parquet(path)
        else:
            made.repartition(parts, made.columns[0]).write.parquet(path)
        STORED[sf_dir, name] = path
        rows[name] = spark.read.parquet(path).count()
    return rows


def _stored(spark: SparkSession, sf_dir: str, name: str) -> DataFrame | None:
    path = STORED.get((sf_dir, name))
    return spark.read.parquet(path) if path else None


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir, "documents") or spark.read.parquet(f"{sf_dir}/documents.parquet")


def _pick(position: Column, *choices) -> Column:
    return F.get(F.array(*choices), position.cast("int"))


def with_gold(docs: DataFrame) -> DataFrame:
    head = F.concat(F.lit("// note "), F.col("doc_id").cast("string"), F.lit("\n"))
    return docs.withColumn("gold", F.concat(head, "text"))


def metric_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold texts with eleven kinds of predictions."""
    gold = F.col("gold")
    form = F.pmod("doc_id", F.lit(11))
    pred = (
        F.when(form == 0, gold)
        .when(form == 1, F.concat(gold, F.lit("\ntail")))
        .when(form == 2, F.replace(gold, F.lit(" "), F.lit("  ")))
        .when(form == 3, F.col("text"))
        .when(form == 4, F.concat(F.lit("intro\n"), gold))
        .when(form == 5, F.replace(gold, F.lit(" "), F.lit("")))
        .when(form == 6, F.concat(F.lit("# c\n"), gold, F.lit("\n/* x\n y */")))
        .when(form == 7, F.lit(""))
        .when(form == 8, F.concat(F.lit("ab\nq "), gold))
        .when(form == 9, F.concat(F.lit("x"), gold))
        .otherwise(F.replace(gold, F.lit(" "), F.lit("\xa0")))
    )
    return with_gold(documents(spark, sf_dir)).select("doc_id", "gold", pred.alias("generation"))


def commented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts with comments of every kind put around and into them."""
    body = F.replace("text", F.lit(". "), F.lit(". // aside\n\n  # note\n"))
    whole = F.concat(
        F.lit("/* head\n more */"), body, F.lit("\nhttp://u/v\n#include <x>\n/* open\n"), "text"
    )
    return documents(spark, sf_dir).select("doc_id", whole.alias("code"))


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One review example per document."""
    if found := _stored(spark, sf_dir, "examples"):
        return found
    reviews = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(
        "item_id", F.col("text").alias("review")
    )
    review_count = reviews.agg(F.count("*")).scalar()
    docs = with_gold(documents(spark, sf_dir)).withColumn(
        "item_id", F.pmod("doc_id", review_count)
    )
    reviewed = docs.join(reviews, "item_id")
    i, gold = F.col("doc_id"), F.col("gold")
    b = F.pmod(i, F.lit(5)).cast("int")
    types = [F.lit(t) for t in v.CHANGE_PHRASES]
    kind = F.pmod(i, F.lit(3))
    first = F.pmod(i, F.lit(10))
    loc = F.array(b + 1, b + 2)
    return reviewed.select(
        i.alias("example_id"),
        F.concat(F.lit(" "), F.replace("text", F.lit("\n"), F.lit("\n "))).alias("old"),
        F.concat(F.lit("+"), F.replace("gold", F.lit("\n"), F.lit("\n+"))).alias("new"),
        "review",
        "lang",
        _pick(kind, *types).alias("type_correct"),
        _pick(
            kind,
            F.array(types[1], types[2]),
            F.array(types[0], types[2]),
            F.array(types[0], types[1]),
        ).alias("type_wrong"),
        loc.alias("loc_correct"),
        F.array(
            F.array(b + 20),
            F.when(F.pmod(i, F.lit(50)) == 0, loc).otherwise(F.array(b + 21, b + 22)),
            F.array(b + 23),
        ).alias("loc_wrong_easy"),
        F.array(F.array(b + 1), F.array(b + 2), F.array(b + 2, b + 3)).alias("loc_wrong_hard"),
        gold.alias("solution_correct"),
        F.array(
            F.concat(gold, F.lit("x")),
            F.concat(gold, F.lit("y")),
            F.when(F.pmod(i, F.lit(50)) == 7, gold).otherwise(F.concat(gold, F.lit("z"))),
        ).alias("solution_wrong_easy"),
        F.array(*[F.concat(F.lit(c), gold) for c in "xyz"]).alias("solution_wrong_hard"),
        F.when(first == 0, F.lit(None))
        .when(first == 1, F.lit("ERROR: timeout"))
        .otherwise(F.concat("source", F.lit(" changed as asked: "), "review"))
        .alias("summary"),
    )


def _grid(df: DataFrame, models: int = 2) -> DataFrame:
    """One row per model and condition, with their numbers ``m`` and ``c``."""
    return (
        df.withColumn("m", F.explode(F.array(*map(F.lit, range(models)))))
        .withColumn("c", F.explode(F.array(F.lit(0), F.lit(1))))
        .withColumn("model", F.concat(F.lit("m"), F.col("m").cast("string")))
        .withColumn("condition", _pick(F.col("c"), *map(F.lit, v.CONDITIONS)))
    )


def _delivered(df: DataFrame) -> DataFrame:
    """Every seventh example was answered twice; ``attempt`` 1 is the delivery that counts."""
    repeated = F.pmod("example_id", F.lit(7)) == 0
    attempts = F.when(repeated, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))
    seconds = F.lit(START) + F.col("example_id") * 10 + F.col("attempt")
    return df.withColumn("attempt", F.explode(attempts)).withColumn(
        "ingest_ts", F.timestamp_seconds(seconds)
    )


def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated answers of two models under both conditions."""
    if found := _stored(spark, sf_dir, "generations"):
        return found
    asked = examples(spark, sf_dir).select(
        "example_id", "review", tx.number_lines(F.col("new")).alias("num")
    )
    num = F.col("num")
    form = F.pmod(F.col("example_id") * 7 + F.col("m") + F.col("c") * 3, F.lit(8))
    content = (
        F.when(F.col("attempt") == 0, F.lit("1 stale"))
        .when(form == 0, num)
        .when(form == 1, F.concat(F.lit("```python\n"), num, F.lit("\n```")))
        .when(form == 2, F.concat(F.lit("[code]\n"), num, F.lit("\n[/code]")))
        .when(form == 3, F.concat(F.lit("```\n[code]\n"), num, F.lit("\n[/code]\n```\n")))
        .when(form == 4, F.replace(num, F.lit(" "), F.lit("  ")))
        .when(form == 5, F.concat(F.lit("Here it is\n"), num))
        .when(form == 6, F.col("review"))
        .otherwise(F.lit(""))
    )
    return _delivered(_grid(asked)).select(
        "model",
        "condition",
        "example_id",
        content.alias("content"),
        F.lit(None).cast("string").alias("error"),
        "ingest_ts",
    )


USUAL = '{"answer": "<right>"}'
STALE = 24
# content and tokens of the answer forms 0 to 23, and of a stale delivery
ANSWERS = [(USUAL, [("<right>", -0.1)])] * 12 + [
    ("", [("<right>", -0.1)]),
    ('{"answer":', [("<right>", -0.1)]),
    (USUAL, [("{", -0.1)]),
    (USUAL, [("<right>", -1.5), (" A", -0.2)]),
    (USUAL, [("<right>", -0.1), ("<right>", -5.0), ("A", -3.0)]),
    (USUAL, [("C", -1.0), ("B", -1.0)]),
    (USUAL, [("<other>", -0.3)]),
    (USUAL, [("<other>", -0.3)]),
    (USUAL + " x", [("<right>", -0.1)]),
    (" \n ", [("<right>", -0.1)]),
    (USUAL, None),
    (USUAL, [("\n<right> ", -0.4)]),
    ('{"answer": "A"}', [("A", -0.05)]),
]


def _sql(value: str | float | None) -> str:
    return f"'{value}'" if isinstance(value, str) else f"{value}D"


def _answer_table() -> tuple[Column, Column]:
    """Contents by form and right letter, and token lists by form, right and other letter, as literals."""
    contents, lists = [], []
    for content, tokens in ANSWERS:
        for right in v.LETTERS[:4]:
            contents.append(content.replace("<right>", right))
            for other in v.LETTERS[:4]:
                pairs = [(t.replace("<right>", right).replace("<other>", other), s) for t, s in tokens or ()]
                entries = ",".join(f"named_struct('token', {_sql(t)}, 'logprob', {_sql(s)})" for t, s in pairs)
                lists.append(f"array({entries})" if pairs else "null")
    return (F.expr(f"array({','.join(map(_sql, contents))})"), F.expr(f"array({','.join(lists)})"))


def choices(
    spark: SparkSession, sf_dir: str, tasks: Sequence[str] = v.CHOICE_TASKS
) -> DataFrame:
    """Choice answers of two models under both conditions, all orderings."""
    if found := _stored(spark, sf_dir, "choices"):
        return found.select(schemas.CHOICES.names).where(F.col("task").isin(list(tasks)))
    keys = fanout.answer_keys(examples(spark, sf_dir), tasks)
    by_task = keys.select("example_id", F.explode("keys").alias("task", "key"))
    keyed = _delivered(_grid(by_task.where(F.col("key").isNotNull())))
    asked = keyed.select("*", F.posexplode(F.split("key", "")).alias("perm_idx", "sym"))
    i, p, m, c = (F.col(n) for n in ("example_id", "perm_idx", "m", "c"))
    number = F.array_position(F.array(*map(F.lit, v.CHOICE_TASKS)), F.col("task")).cast("int") - 1
    k = F.when(F.col("task") == "CTR", 3).otherwise(4)
    steady = (F.pmod(i + c, F.lit(3)) == 0) & ~((m == 1) & (p == 5))
    h = F.when(steady, 0).otherwise(F.pmod(i * 31 + p * 17 + m * 7 + c * 3 + number, F.lit(24)))
    form = F.when(F.col("attempt") == 0, STALE).otherwise(h).cast("int")
    contents, lists = _answer_table()
    right = F.instr(F.lit("".join(v.LETTERS[:4])), F.col("sym")) - 1
    shaped = asked.withColumn("_right", (form * 4 + right).cast("int"))
    other = F.pmod(p, k).cast("int")
    return shaped.select(
        "model",
        "condition",
        "task",
        "example_id",
        "perm_idx",
        F.get(contents, F.col("_right")).alias("content"),
        F.get(lists, F.col("_right") * 4 + other).alias("logprobs"),
        F.lit(None).cast("string").alias("error"),
        "ingest_ts",
    )
