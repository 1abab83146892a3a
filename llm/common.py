"""Helpers that the operators share: hashing of words, tables cut to the shared folder, components.

Words are maximal runs of bytes other than the six ASCII white-space characters. They are hashed
to 64 bits, and sequences of words by a polynomial over these hashes, so that tasks work on numpy
arrays. Everything is deterministic across processes, so a task that runs again gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelens.session import fresh_path

#: Odd, so that multiplying by it loses nothing modulo 2**64.
BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def cut(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """The same rows, written once to the folder that all executors share, and read back."""
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Words(dict):
    """word -> 64-bit hash; keeps the words met first up to a bound, and hashes the others anew."""

    def __init__(self, bound: int = 300_000) -> None:
        super().__init__()
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.bound:
            self[word] = value
        return value

    def hashes(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A fixed permutation of the 64-bit integers that spreads every bit (the splitmix64 finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def doubled(h: np.ndarray, length: int, base: int = BASE) -> np.ndarray:
    """From hashes of windows of one length those of twice the length, at every start that has one."""
    if len(h) <= length:
        return h[:0]
    return h[:-length] * np.uint64(pow(base, length, 1 << 64)) + h[length:]


def window_hashes(words: np.ndarray, length: int, base: int = BASE) -> np.ndarray:
    """Hashes of all windows of ``length`` words, put together from windows of powers of two."""
    n = len(words) - length + 1
    if n <= 0:
        return words[:0]
    out, covered, level, size = None, 0, words, 1
    while True:
        if length & size:
            part = level[covered : covered + n]
            out = part if out is None else out * np.uint64(pow(base, size, 1 << 64)) + part
            covered += size
        if covered == length:
            return out
        level, size = doubled(level, size, base), size * 2


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum over each window of ``width`` values, by windows of powers of two."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    level, size = values, 1
    while size * 2 <= width:
        level, size = np.minimum(level[:-size], level[size:]), size * 2
    return np.minimum(level[:n], level[width - size : width - size + n])


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def as_bytes(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def lowered(text: str) -> str:
    """The text in lower case with every character at its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x) == 1 else c for c in text for x in [c.lower()])


def list_array(parts: Iterable[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A column of lists from one array for each row."""
    parts = list(parts)
    ends = np.cumsum([0, *map(len, parts)])
    flat = np.concatenate(parts) if parts else np.empty(0, kind.to_pandas_dtype())
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind))


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows: bounds what a task holds at once beside the batch itself."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def crc_fold(doc_id: str = "doc_id") -> Column:
    """The part of five that a document is in; part 0 is held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def components(spark: SparkSession, links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component: the smallest node reachable over links (a, b), for every linked node.

    Large-star and small-star steps: each replaces links by links to the smallest neighbour, found
    with aggregates that fold on the map side and joins that Spark may split, so a node with very
    many links needs no task of its own. The number of rounds grows with the logarithm of the
    longest chain; each round's links are written and read back.
    """

    def stars(edges: DataFrame, larger_only: bool) -> DataFrame:
        """edges: (a, b) with a > b. Large: all neighbours count; small: only the smaller ones."""
        if larger_only:
            least = edges.groupBy("a").agg(F.min("b").alias("m"))
            joined = edges.join(least, "a")
            return joined.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # the neighbours above a node move to its smallest neighbour; each link (a > b) is seen from b
        return edges.select(F.col("b").alias("u"), F.col("a").alias("v")).join(least.withColumnRenamed("a", "u"), "u").select(F.col("v").alias("a"), F.col("m").alias("b"))

    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    edges, seen = cut(spark, edges, "links"), None
    for _ in range(rounds):
        edges = stars(edges, larger_only=False).where("a > b").distinct()
        edges = cut(spark, stars(edges, larger_only=True).where("a > b").distinct(), "links")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def salted(rows: DataFrame, classes: DataFrame, key: str, share: int = 1000) -> DataFrame:
    """``rows`` joined with ``classes``, which has one row for each key and its number of rows ``n``.

    A key with more than one in ``share`` of all rows is split: its rows by their hash, its class
    copied to each part, so a part holds about that share at most. There are fewer than ``share``
    such keys, whatever the tables hold, so their list may be broadcast. ``classes`` may leave out
    keys, whose rows are left out then; it is read several times and should be a stored table.
    """
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = F.ceil(F.col("n") * share / F.lit(max(total, 1))).cast("int")
    hot = F.broadcast(classes.where(F.col("n") * share > total).select(key, parts.alias("_parts")))
    mine = F.coalesce(F.pmod(F.xxhash64(*[c for c in rows.columns if c != key]), "_parts"), F.lit(0)).cast("int")
    rows = rows.join(hot, key, "left").withColumn("_part", mine).drop("_parts")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))
    copied = classes.join(hot, key, "left").withColumn("_part", copies).drop("_parts", "n")
    return rows.join(copied, [key, "_part"]).drop("_part")
