"""Target-distribution importance resampling with hashed n-grams and Gumbel noise.

A text's features are its runs of 1 to ``order`` words; a feature's bucket is the CRC-32 of its
bytes modulo ``buckets``. CRCs are made for many features at once: the distinct features of a slice of
texts are grouped by length, those of one length stand below each other as rows of a matrix of
bytes, all CRCs of the matrix are updated column by column, and the buckets are scattered back to
the features' places. (A feature longer than ``WIDE`` bytes would be a matrix of one row; its CRC is
taken directly.)

Counts of buckets over all documents and over all target texts give every bucket's gain, a log ratio;
a document's weight is the sum of its features' gains, and the documents of greatest weight plus Gumbel
noise are a draw from the target's distribution without replacement. Noise comes from a digest of
seed and doc_id, so a task that runs again draws the same.

Texts are read twice and never shuffled. Each task of the first pass sends one row for each bucket;
the gains, one number a bucket, go with the second pass. Ranks come from one distributed sort of
(score, doc_id): every sorted part numbers its rows, and the parts' sizes say where it starts. No
key is gathered anywhere, so copies, sources and frequent words make no task uneven.

Cases: A-Z are lower-cased, and words are runs of a-z, 0-9 and characters above U+007F. Null and empty
texts have no word, weight 0, and take part only where ``least_words`` is 0. Noise of a null doc_id is
that of an empty one. Ties in score go to the smaller doc_id (null last); rows that also share
the doc_id are ranked in any order. Other columns are not read. Without documents there are no rows,
without target texts all gains still follow the formula with T = 0.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import as_bytes, cut, slices

#: CRC-32 of every byte value, from the reflected polynomial.
TABLE = np.arange(256, dtype=np.uint32)
for _ in range(8):
    TABLE = np.where(TABLE & 1, TABLE >> 1 ^ np.uint32(0xEDB88320), TABLE >> 1)

#: Lower case for A-Z, a blank for every other byte below 0x80 that is no part of a word.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
WIDE = 1024
#: Features whose buckets a task remembers, and their greatest length.
REMEMBERED, SHORT = 300_000, 64


def crc32s(features: list[bytes]) -> np.ndarray:
    """The CRC-32 of every feature, by matrices of equal length."""
    out = np.zeros(len(features), np.uint32)
    lengths = np.fromiter(map(len, features), np.int64, len(features))
    order = np.argsort(lengths, kind="stable")
    sizes, starts = np.unique(lengths[order], return_index=True)
    for size, start, end in zip(sizes.tolist(), starts.tolist(), [*starts[1:].tolist(), len(order)]):
        rows = order[start:end]
        if size > WIDE:
            out[rows] = [zlib.crc32(features[i]) for i in rows.tolist()]
            continue
        matrix = np.frombuffer(b"".join([features[i] for i in rows.tolist()]), np.uint8).reshape(len(rows), size)
        crc = np.full(len(rows), 0xFFFFFFFF, np.uint32)
        for column in matrix.T:
            crc = TABLE[(crc ^ column) & 0xFF] ^ (crc >> 8)
        out[rows] = ~crc
    return out


class Buckets(dict):
    """feature -> bucket for features met before, up to a bound; the others of a slice are in ``extra``."""

    def __init__(self, count: int, order: int) -> None:
        super().__init__()
        self.count, self.order, self.extra = count, order, {}

    def __missing__(self, feature: bytes) -> int:
        return self.extra[feature]

    def features(self, data: bytes) -> tuple[int, list[bytes]]:
        words = data.translate(FOLD).split()
        grams = [b" ".join(words[i : i + k]) for k in range(2, self.order + 1) for i in range(len(words) - k + 1)]
        return len(words), words + grams if grams else words

    def of(self, texts: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
        """The number of words and the buckets of all features, for every text."""
        found = [self.features(data) for data in texts]
        fresh = [x for x in set().union(*(features for _, features in found)) if x not in self]
        self.extra = dict(zip(fresh, (crc32s(fresh) % np.uint32(self.count)).tolist()))
        short = (pair for pair in self.extra.items() if len(pair[0]) <= SHORT)
        self.update(islice(short, max(0, REMEMBERED - len(self))))
        for n, features in found:
            yield n, np.fromiter(map(self.__getitem__, features), np.int64, len(features))


def counts(spark: SparkSession, texts: DataFrame, order: int, buckets: int) -> np.ndarray:
    """How many features of all texts fall into each bucket; one number a bucket reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = Buckets(buckets, order), np.zeros(buckets, np.int64)
        for batch in slices(batches, 500):
            for _, places in known.of(as_bytes(batch.column(0))):
                np.add.at(total, places, 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    rows = texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for row in rows:
        out[row.bucket] = row.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's gain in thousandths: the log of its smoothed share in the target over that in the corpus."""
    n, size, wanted = len(corpus), int(corpus.sum()), int(target.sum())
    ratio = lambda s, t: (t + 1.0) * (size + n) / ((s + 1.0) * (wanted + n))
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, order: int) -> DataFrame:
    """doc_id, n_words, n_features and weight of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Buckets(len(gain), order)
        for batch in slices(batches, 500):
            rows = [(n, len(places), int(gain[places].sum())) for n, places in known.of(as_bytes(batch.column(1)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in zip(*rows))], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(seed: int, doc_id: str = "doc_id") -> Column:
    """Gumbel noise in thousandths from the first 32 bits of the SHA-256 of seed and doc_id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    drawn = F.conv(F.substr(F.sha2(name.cast("binary"), 256), F.lit(1), F.lit(8)), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((drawn + 0.5) / 4294967296.0)))


def placed(spark: SparkSession, rows: DataFrame, *by: Column) -> DataFrame:
    """``rows`` with their ``place`` in one order over all of them, from 1 on.

    The rows are sorted in parts; a part and a row's place in it are read from the id that Spark gives
    to rows in order, and the sizes of the parts, a row each, say where a part starts.
    """
    # an id is the part's number times 2**33 plus the place in the part
    numbered = cut(spark, rows.orderBy(*by).withColumn("_id", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("_id", 33).alias("_part")
    sizes = sorted((r._part, r.n) for r in numbered.groupBy(part).agg(F.count("*").alias("n")).collect())
    ends = accumulate((n for _, n in sizes), initial=0)
    starts = spark.createDataFrame([(p, start) for (p, _), start in zip(sizes, ends)], "_part long, _start long")
    # as many rows as the sort has parts
    here = numbered.withColumn("_part", F.shiftright("_id", 33)).join(F.broadcast(starts), "_part")
    return here.withColumn("place", F.col("_start") + F.col("_id").bitwiseAND(F.lit(2**33 - 1)) + 1).drop("_id", "_part", "_start")


def resample(spark: SparkSession, docs: DataFrame, target: DataFrame, order: int = 1, buckets: int = 10_000, seed: int = 2024, least_words: int = 20, percent: int = 10) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; rank is null where it is not drawn.

    ``percent`` of the documents with at least ``least_words`` words are drawn, rounded down.
    """
    gain = gains(counts(spark, docs, order, buckets), counts(spark, target, order, buckets))
    scored = weighed(docs, gain, order).withColumn("score", F.col("weight") + noise(seed))
    scored = cut(spark, scored, "scored")
    enough = F.col("n_words") >= least_words
    drawn = scored.where(enough).count() * percent // 100
    ranked = placed(spark, scored.where(enough), F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = ranked.withColumn("rank", F.when(F.col("place") <= drawn, F.col("place")))
    rest = scored.where(~enough).withColumn("rank", F.lit(None).cast("long"))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(*columns).unionByName(rest.select(*columns))
