"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Two permutations make the whole signature. The first scatters a document's shingles over 2**20
places (an odd multiplier, then the high bits); the second is one table of ranks that is shifted
circularly by 0, 1, 2, ... places: coordinate k of the signature is the least rank found at
(place + k). One shingle's ranks for all coordinates are neighbours in the table, so they are read
together. Four coordinates make a band; documents that agree in a band are candidates, and links are
confirmed on full shingle sets. A pair at the threshold of 0.85 escapes all 24 bands with a
probability of 2e-8 (3.2e-6 at 0.8), more similar pairs with less.

No group is gathered and no group's pairs are listed:

1. Equal sets become one class by a 128-bit digest of the set; only classes go on.
2. In each band's bucket every class is compared with the smallest one (a star), which joins do.
3. Components of the links so far settle most buckets. A bucket that still holds several components
   is swept: its classes outside the bucket's largest component are compared with all its members,
   in cells of bounded size, by inverted lists of shingles. Each cell returns a spanning forest.
   Buckets with the same members are swept once.

Cases: words are runs without ASCII white space, A-Z in lower case. A text with fewer words than a
shingle has its whole sequence as its one shingle. Null, empty and blank texts have no shingles and
are linked with nothing. A row with a null doc_id keeps a null component and is kept. Rows that
share a doc_id count as one document. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import Words, as_bytes, components, cut, list_array, mix, signed, slices, window_hashes

BANDS = 24
ROWS = 4
BITS = 20
SCATTER = np.uint64(0xD6E8FEB86659FD93)
#: Most shingles of members, of probes, and most pairs that one cell of a sweep takes.
CELL_MEMBERS, CELL_PROBES, CELL_PAIRS = 2_000_000, 1_000_000, 4_000_000


def shingles(cache: Words, data: bytes, size: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words = data.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = cache.hashes(words)
    return np.unique(mix(window_hashes(hashes, min(size, len(words)))))


class Signer:
    """Band keys of shingle sets."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS) -> None:
        self.bands, self.rows = bands, rows
        ranks = np.random.Generator(np.random.PCG64(20)).permutation(1 << BITS).astype(np.uint32)
        ring = np.concatenate([ranks, ranks[: bands * rows]])
        self.table = np.lib.stride_tricks.sliding_window_view(ring, bands * rows)
        self.salt = mix(np.arange(1, bands + 1, dtype=np.uint64))

    def bands_of(self, found: np.ndarray) -> np.ndarray:
        places = (found * SCATTER) >> np.uint64(64 - BITS)
        least = np.full(self.bands * self.rows, 1 << BITS, np.uint32)
        for at in range(0, len(places), 4096):
            np.minimum(least, self.table[places[at : at + 4096]].min(axis=0), out=least)
        key = self.salt.copy()
        for part in least.reshape(self.bands, self.rows).T.astype(np.uint64):
            key = mix(key ^ part) * np.uint64(0x9E3779B97F4A7C15) + part
        return signed(key)


def _profile(docs: DataFrame, size: int) -> DataFrame:
    """Set size, digest of the set, and band keys of each document; no digest without shingles."""
    kinds = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, signer = Words(), Signer()
        for batch in slices(batches, 500):
            n, digests, bands = [], [], []
            for data in as_bytes(batch.column(1)):
                found = shingles(cache, data, size)
                n.append(len(found))
                digests.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                bands.append(signer.bands_of(found) if len(found) else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), list_array(bands, pa.int64())], schema=kinds)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, digest binary, bands array<long>")


def _sets(texts: DataFrame, size: int) -> DataFrame:
    """Shingle sets of the documents that have candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Words()
        for batch in slices(batches, 200):
            sets = [signed(shingles(cache, data, size)) for data in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), list_array(sets, pa.int64())], names=["id", "shingles"])

    return texts.select("doc_id", "text").mapInArrow(run, "id long, shingles array<long>")


def _sweep(group: pa.Table, num: int, den: int) -> pa.Table:
    """Links (a, b) that join components: probes against members of one cell, by inverted lists."""
    ids = group.column("id").to_numpy()
    sets = [x.values.to_numpy() for x in group.column("shingles")]
    parent = {c: c for c in group.column("component").to_pylist()}
    mine = group.column("component").to_pylist()

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    probe = group.column("probe").to_numpy(zero_copy_only=False)
    members, probes = np.flatnonzero(~probe), np.flatnonzero(probe)
    out = []
    if len(members) and len(probes):
        lengths = np.array([len(sets[i]) for i in members])
        flat = np.concatenate([sets[i] for i in members])
        owner = np.repeat(np.arange(len(members)), lengths)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        for p in probes:
            low, high = np.searchsorted(flat, sets[p], "left"), np.searchsorted(flat, sets[p], "right")
            span = high - low
            at = np.repeat(high - np.cumsum(span), span) + np.arange(span.sum())
            common = np.bincount(owner[at], minlength=len(members))
            for m in np.flatnonzero(den * common >= num * (lengths + len(sets[p]) - common)):
                a, b = root(mine[p]), root(mine[members[m]])
                if a != b:
                    parent[a] = b
                    out.append((int(ids[p]), int(ids[members[m]])))
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


def near_duplicates(spark: SparkSession, docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row; links have den * common >= num * union."""
    profile = cut(spark, _profile(docs, size), "profile")
    classes = profile.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("class_id"))
    profile = cut(spark, profile.join(classes, "digest", "left"), "classes")

    heads = profile.where("doc_id = class_id").select("class_id", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    shared = heads.groupBy("bucket").agg(F.min("class_id").alias("least"), F.max("class_id").alias("most"), F.count("*").alias("members")).where("least < most")
    buckets = cut(spark, heads.join(shared.drop("most"), "bucket"), "buckets")

    wanted = buckets.select(F.col("class_id").alias("doc_id")).distinct()
    sets = cut(spark, _sets(docs.select("doc_id", "text").join(wanted, "doc_id"), size).dropDuplicates(["id"]), "sets")

    pairs = buckets.where("class_id > least").select(F.col("least").alias("a"), F.col("class_id").alias("b")).distinct()
    both = pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b").join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
    common = F.size(F.array_intersect("x", "y"))
    links = both.withColumn("common", common).where(den * F.col("common") >= num * (F.size("x") + F.size("y") - F.col("common"))).select("a", "b")
    links = cut(spark, links, "links")
    settled = components(spark, links)

    # buckets that hold several components, each set of members once
    node = buckets.where("members > 2").join(settled.select(F.col("node").alias("class_id"), "component"), "class_id", "left").withColumn("component", F.coalesce("component", "class_id"))
    node = cut(spark, node, "open")
    sizes = node.groupBy("bucket", "component").agg(F.count("*").alias("size"), F.sum("n").alias("weight"), F.sum(F.xxhash64("class_id").cast("decimal(38,0)")).alias("print"))
    spread = sizes.groupBy("bucket").agg(
        F.max_by("component", "size").alias("home"), F.max("size").alias("home_size"), F.sum("size").alias("total"), F.sum("weight").alias("weight"), F.count("*").alias("parts"), F.sum("print").alias("print")
    ).where("parts > 1")
    spread = spread.groupBy("total", "print").agg(F.min(F.struct("bucket", "home", "home_size", "weight")).alias("s")).select("total", "s.*")
    wide = F.ceil(F.greatest(F.col("weight") / CELL_MEMBERS, F.lit(1.0))).cast("int")
    deep = F.ceil(F.greatest(F.col("weight") / CELL_PROBES, (F.col("total") - F.col("home_size")) * F.col("total") / CELL_PAIRS / wide, F.lit(1.0))).cast("int")
    spread = spread.select("bucket", "home", wide.alias("wide"), deep.alias("deep"))
    cells = node.select("bucket", "class_id", "component").join(spread, "bucket")
    column = F.pmod(F.xxhash64("class_id"), F.col("wide")).cast("int")
    line = F.pmod(F.xxhash64("class_id", F.lit(1)), F.col("deep")).cast("int")
    rows = cells.select(
        F.col("class_id").alias("id"), "component", "bucket",
        F.explode(F.concat(
            F.transform(F.sequence(F.lit(0), F.col("deep") - 1), lambda i: F.struct(i.alias("line"), column.alias("column"), F.lit(False).alias("probe"))),
            F.when(F.col("component") != F.col("home"), F.transform(F.sequence(F.lit(0), F.col("wide") - 1), lambda j: F.struct(line.alias("line"), j.alias("column"), F.lit(True).alias("probe")))).otherwise(F.array()),
        )).alias("cell"),
    ).select("id", "component", "bucket", "cell.*")
    swept = rows.join(sets, "id").groupBy("bucket", "line", "column").applyInArrow(lambda table: _sweep(table, num, den), "a long, b long")
    more = cut(spark, swept, "swept")

    joined = settled.where("node > component").select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)
    settled = components(spark, joined).select(F.col("node").alias("class_id"), "component")
    return profile.select("doc_id", "n_shingles", "class_id").join(settled, "class_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "class_id", "doc_id").alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
