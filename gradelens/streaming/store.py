"""The small rows of micro-batches on storage, merged level by level.

A batch's rows are written to a folder of their own, which the batch overwrites when it runs again.
Once ``FAN`` young batches are there they are folded into one run of the first level; ``FAN`` runs of a
level are folded into one of the next, so a row is rewritten once a level and a look reads fewer than
``FAN`` folders a level, however many batches there have been. A manifest, published in one step,
names the runs and, for each stream, the last batch they hold; later batches are read as they are.
Folders that no manifest names any more are deleted one compaction later, when looks that began
before have had that time to end.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from gradelens.sources import markers

FAN = 8
NOTHING = {"upto": {}, "runs": [], "old": []}


def batch_folder(store: str, stream: str, number: int) -> str:
    return f"{store}/stream={stream}/batch={number}"


def _manifest(spark: SparkSession, store: str) -> tuple[int, dict]:
    number, text = markers.newest(spark, f"{store}/manifests")
    return number, json.loads(text) if text else NOTHING


def _batches(spark: SparkSession, store: str) -> list[tuple[str, int, str]]:
    """Stream, number and folder of every batch that was written to its end."""
    done = [m.getPath().getParent() for m in markers.listed(spark, f"{store}/stream=*/batch=*/_SUCCESS")]
    return sorted(
        (f.getParent().getName().split("=", 1)[1], int(f.getName().split("=", 1)[1]), f.toString()) for f in done
    )


def _young(batches: list[tuple[str, int, str]], state: dict) -> list[tuple[str, int, str]]:
    return [b for b in batches if b[1] > state["upto"].get(b[0], -1)]


def read(spark: SparkSession, store: str, schema: T.StructType) -> DataFrame:
    """All rows that count: the manifest's runs and the batches behind it."""
    _, state = _manifest(spark, store)
    folders = [f"{store}/runs/{folder}" for _, folder in state["runs"]]
    folders += [folder for _, _, folder in _young(_batches(spark, store), state)]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*folders)


def compact(
    spark: SparkSession, store: str, schema: T.StructType, fold: Callable[[DataFrame], DataFrame], fan: int = FAN
) -> bool:
    """Fold the young batches, if there are enough, and the levels that are full by that."""
    number, state = _manifest(spark, store)
    batches = _batches(spark, store)
    young = _young(batches, state)
    if len(young) < fan:
        return False
    merged, level, kept = [f for _, _, f in young], 1, state["runs"]
    while len(full := [run for run in kept if run[0] == level]) + 1 >= fan:
        merged += [f"{store}/runs/{folder}" for _, folder in full]
        kept = [run for run in kept if run[0] != level]
        level += 1
    folder = uuid.uuid4().hex
    merged_rows = fold(spark.read.schema(schema).parquet(*merged)).select(schema.names)
    merged_rows.write.parquet(f"{store}/runs/{folder}", compression="zstd")
    upto = dict(state["upto"])
    for stream, last, _ in young:
        upto[stream] = max(last, upto.get(stream, -1))
    gone = [run[1] for run in state["runs"] if run not in kept]
    after = {"upto": upto, "runs": [*kept, [level, folder]], "old": gone}
    if not markers.publish(spark, f"{store}/manifests", number + 1, json.dumps(after)):
        return False  # another stream into this store was faster; the next batch tries again
    stale = [f for stream, last, f in batches if last <= state["upto"].get(stream, -1)]
    for folder in [*stale, *(f"{store}/runs/{x}" for x in state["old"])]:
        named, files = markers.file_system(spark, folder)
        files.delete(named, True)
    return True
