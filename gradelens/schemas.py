"""Declared schemas of the tables the engine reads and writes."""

from pyspark.sql import types as T

EXAMPLE_FIELDS = T.StructType(
    [
        T.StructField("old", T.StringType()),
        T.StructField("new", T.StringType()),
        T.StructField("review", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("type_correct", T.StringType()),
        T.StructField("type_wrong", T.ArrayType(T.StringType())),
        T.StructField("loc_correct", T.ArrayType(T.IntegerType())),
        T.StructField("loc_wrong_easy", T.ArrayType(T.ArrayType(T.IntegerType()))),
        T.StructField("loc_wrong_hard", T.ArrayType(T.ArrayType(T.IntegerType()))),
        T.StructField("solution_correct", T.StringType()),
        T.StructField("solution_wrong_easy", T.ArrayType(T.StringType())),
        T.StructField("solution_wrong_hard", T.ArrayType(T.StringType())),
        T.StructField("summary", T.StringType()),
    ]
)

EXAMPLES = T.StructType([T.StructField("example_id", T.LongType()), *EXAMPLE_FIELDS.fields])

LOGPROBS = T.ArrayType(
    T.StructType(
        [T.StructField("token", T.StringType()), T.StructField("logprob", T.DoubleType())]
    )
)

GENERATIONS = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("condition", T.StringType()),
        T.StructField("example_id", T.LongType()),
        T.StructField("content", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("ingest_ts", T.TimestampType()),
    ]
)

CHOICES = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("condition", T.StringType()),
        T.StructField("task", T.StringType()),
        T.StructField("example_id", T.LongType()),
        T.StructField("perm_idx", T.IntegerType()),
        T.StructField("content", T.StringType()),
        T.StructField("logprobs", LOGPROBS),
        T.StructField("error", T.StringType()),
        T.StructField("ingest_ts", T.TimestampType()),
    ]
)

RESULTS = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("condition", T.StringType()),
        T.StructField("task", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("n", T.LongType()),
    ]
)
