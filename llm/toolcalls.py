"""Linking of tool calls: calls meet results by identifier, in topological order, as canonical JSON.

``link`` uses DataFrame functions only. Calls and results are hash-joined on (conv_id, call_id), the
results folded to one row for each identifier as the side that is hashed.
Arguments are parsed once into a variant and checked against the schema of the call's tool: required
fields, types, and no other fields. Each call becomes one canonical JSON text: keys in order, no
white space, nulls written out.

Order: a call stands behind the calls whose results it uses. Its place is the greatest of (its own
position, 0) and (place, step + 1) of every call it depends on, so sorting by (place, step,
position, call_id) is a topological order that keeps the given one where that is possible. Where
every call follows what it depends on, the usual case, one join settles the conversation. Otherwise
only calls from the first one on that a link the wrong way puts too early can move, and only they
are carried on, by pointer doubling: a link to a call that itself depends on one other call is
replaced by a link to that other call, as many steps further, and links to calls that depend on
nothing end. Links never grow in number. Chains and trees settle in rounds that grow with the
logarithm of their depth; where calls depend on several unsettled ones, a round settles at least
those that depend on settled calls only. When no link ends any more, what still has links lies on or
behind a cycle and gets a null place. No conversation is gathered into one task.

Cases: repeated calls of one identifier count once (the one that is first in position, then by
arguments); of repeated results the first in position, then by content, counts, and ``n_results``
says how many there were. Calls without a result have null content; results without a call are left
out of the rows and counted by ``orphans``. Dependencies on unknown identifiers, on the call itself,
and null ones are ignored; repeated ones count once. Arguments that are null or no JSON object are invalid and serialised as
null. Unknown tools are invalid. Rows with a null conv_id, call_id or position have no identity and
are left out. Other columns are not read. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import cut, salted

#: JSON types by the names Spark gives to parts of a variant.
TYPES = {"string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DOUBLE", "DECIMAL"), "boolean": ("BOOLEAN",), "object": ("OBJECT",), "array": ("ARRAY",)}
KEY = ["conv_id", "call_id"]


def _first(calls: DataFrame) -> DataFrame:
    rows = calls.where("conv_id is not null and call_id is not null and position is not null")
    kept = rows.groupBy(KEY).agg(F.min(F.struct("position", "arguments", "name", F.array_sort("depends_on").alias("depends_on"))).alias("c"))
    return kept.select(*KEY, "c.*")


def problems(name: Column, arguments: Column, parsed: Column, schemas: Mapping[str, Mapping[str, str]]) -> Column:
    """What is wrong with the arguments: fields by name, with "missing", "type" or "unknown" before them."""
    out = F.array(F.lit("tool"))
    for tool, fields in sorted(schemas.items()):
        checks = []
        for field, kind in sorted(fields.items()):
            optional, kind = kind.endswith("?"), kind.removesuffix("?")
            part = F.schema_of_variant(F.try_variant_get(parsed, f"$['{field}']", "variant"))
            absent = part.isNull() | (part == "VOID")
            right = F.lit(False)
            for start in TYPES[kind]:
                right = right | part.startswith(start)
            wrong = F.when(absent, F.lit(None if optional else f"missing {field}")).when(~right, F.lit(f"type {field}"))
            checks.append(wrong.cast("string"))
        others = F.array_sort(F.array_except(F.json_object_keys(arguments), F.array(*map(F.lit, sorted(fields)))))
        here = F.concat(F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>"), F.transform(others, lambda x: F.concat(F.lit("unknown "), x)))
        out = F.when(name == tool, here).otherwise(out)
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    return F.when(~is_object, F.array(F.lit("arguments"))).otherwise(out)


#: Steps are counted up to here; on a cycle they would double for ever.
FAR = 1 << 40


def _unsettled(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    """Links between calls that a link the wrong way can move or close: ``call_id`` uses ``needed``."""
    uses = nodes.select(*KEY, "position", F.explode("depends_on").alias("needed")).where("needed is not null and needed <> call_id").distinct()
    links = uses.join(nodes.select("conv_id", F.col("call_id").alias("needed"), F.col("position").alias("needed_position")), ["conv_id", "needed"])
    links = cut(spark, links, "links")
    wrong = F.col("needed_position") >= F.col("position")
    bounds = links.groupBy("conv_id").agg(F.count("*").alias("n"), F.min(F.when(wrong, F.col("position"))).alias("low"))
    bounds = cut(spark, bounds.where("low is not null"), "bounds")
    return cut(spark, salted(links, bounds, "conv_id").where("position >= low and needed_position >= low").drop("low"), "links")


def _moved(spark: SparkSession, links: DataFrame) -> DataFrame:
    """conv_id, call_id, place, step of the calls of ``links``; null place and step on or behind a cycle."""
    at = F.struct(F.col("position").alias("place"), F.lit(0).cast("long").alias("step"))
    ends = links.select(*KEY, at.alias("at")).unionByName(links.select("conv_id", F.col("needed").alias("call_id"), F.struct(F.col("needed_position").alias("place"), F.lit(0).cast("long").alias("step")).alias("at")))
    places = cut(spark, ends.distinct(), "places")
    links = links.select(*KEY, "needed", F.lit(1).cast("long").alias("steps"))
    while True:
        heads = links.groupBy(KEY).agg(F.count("*").alias("n"), F.max(F.struct("needed", "steps")).alias("far"))
        state = places.join(heads, KEY, "left").select("conv_id", F.col("call_id").alias("needed"), "at", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") == 1, F.col("far")).alias("far"))
        seen = cut(spark, links.join(state, ["conv_id", "needed"]), "seen")
        push = seen.groupBy(KEY).agg(F.max(F.struct(F.col("at.place").alias("place"), F.least(F.col("at.step") + F.col("steps"), F.lit(FAR)).alias("step"))).alias("after"))
        places = cut(spark, places.join(push, KEY, "left").select(*KEY, F.greatest("at", "after").alias("at")), "places")
        open_ = seen.where("n > 0").select(*KEY, F.coalesce("far.needed", "needed").alias("needed"), F.least(F.col("steps") + F.coalesce("far.steps", F.lit(0)), F.lit(FAR)).alias("steps"))
        links = cut(spark, open_.groupBy(*KEY, "needed").agg(F.max("steps").alias("steps")), "links")
        if seen.where("n = 0").isEmpty():
            break
    stuck = links.select(*KEY, F.lit(True).alias("stuck")).distinct()
    value = lambda part: F.when(F.col("stuck").isNull(), F.col(f"at.{part}")).alias(part)
    return places.join(stuck, KEY, "left").select(*KEY, value("place"), value("step"), F.lit(True).alias("moved"))


def order(spark: SparkSession, calls: DataFrame) -> DataFrame:
    """conv_id, call_id, place, step: sorting by (place, step, position, call_id) is a topological order."""
    nodes = calls.select(*KEY, F.col("position").cast("long").alias("position"), "depends_on")
    links = _unsettled(spark, nodes)
    if links.isEmpty():
        return nodes.select(*KEY, F.col("position").alias("place"), F.lit(0).cast("long").alias("step"))
    either = lambda part, own: F.when(F.col("moved").isNull(), own).otherwise(F.col(part)).alias(part)
    return nodes.join(_moved(spark, links), KEY, "left").select(*KEY, either("place", F.col("position")), either("step", F.lit(0).cast("long")))


def link(spark: SparkSession, calls: DataFrame, results: DataFrame, schemas: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """conv_id, call_id, position, place, step, name, n_results, errors, canonical of every call.

    ``calls``: conv_id, call_id, position, name, arguments (JSON text), depends_on. ``results``:
    conv_id, call_id, position, content. ``schemas``: tool -> field -> JSON type, "?" behind it for
    optional ones.
    """
    first = cut(spark, _first(calls), "calls")
    answers = results.where("conv_id is not null and call_id is not null").groupBy(KEY).agg(F.count("*").alias("n_results"), F.min(F.struct("position", "content")).alias("r"))
    answers = answers.select(*KEY, "n_results", F.col("r.content").alias("content"))
    rows = first.join(answers.hint("shuffle_hash"), KEY, "left").join(order(spark, first), KEY).withColumn("parsed", F.try_parse_json("arguments"))
    errors = problems(F.col("name"), F.col("arguments"), F.col("parsed"), schemas)
    is_object = F.schema_of_variant("parsed").startswith("OBJECT")
    message = F.struct(F.when(is_object, F.col("parsed")).alias("arguments"), F.col("call_id").alias("id"), "name", F.col("content").alias("result"))
    return rows.select(*KEY, "position", "place", "step", "name", F.coalesce("n_results", F.lit(0)).alias("n_results"), errors.alias("errors"), F.to_json(message, {"ignoreNullFields": "false"}).alias("canonical"))


def orphans(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Results whose identifier no call has."""
    return results.join(calls.select(*KEY), KEY, "left_anti")
