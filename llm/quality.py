"""Quality: random-indexing word vectors, pooled per document, and a two-layer network.

A word gives two tokens: its letters, and its shape with the signs around it (a word equal to the
one before has the shape of a repetition). Every token has a sparse random index vector; a token's
own vector is the sum of the index vectors of its neighbours, gathered over the whole corpus. Tasks
add up dense counts for a fixed number of buckets, Spark sums them, and the sums (buckets times
dimensions, whatever the corpus's size) go to the driver and out again as a broadcast.

Documents are pooled by the mean of their tokens' unit vectors. A network with one hidden layer is
trained in numpy on a bounded sample of labelled documents; a part of it that training does not see
picks the step to stop at and fits one temperature that scales the output into probabilities.

Cases: null, empty and blank texts pool to zero and are scored by the network like others; without
labels of both kinds every score is the share of label 1 (0.5 without labels); other columns are not
read; an empty table gives no rows. Repeated documents count as often as they occur.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import as_bytes, crc_fold, mix, slices
from llm.labelled import SAMPLE, fitting_rows

BITS = 15
DIM = 32
HIDDEN = 16
REPEAT = 0  # the bucket of the shape of a repetition
LETTERS = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


class Tokens(dict):
    """word -> buckets of its letters and of its shape, in one number; the words met first are kept."""

    def __missing__(self, word: bytes) -> int:
        letters = b"".join(LETTERS.findall(word))
        signs = LETTERS.sub(b"", word)
        shape = b"d" if letters.isdigit() else b"A" if len(letters) > 1 and letters.isupper() else b"a" if letters else b""
        size = (1 << BITS) - 1
        value = (1 + xxhash.xxh3_64_intdigest(letters.lower()) % size) << BITS | (1 + xxhash.xxh3_64_intdigest(b"%s %s" % (shape, signs), 1) % size)
        if len(self) < 300_000:
            self[word] = value
        return value

    def tokens(self, data: bytes) -> np.ndarray:
        """Letters and shape of each word, by turns."""
        words = data.split()
        codes = np.fromiter(map(self.__getitem__, words), np.uint32, len(words))
        out = np.empty(2 * len(words), np.int64)
        out[::2], out[1::2] = codes >> BITS, codes & np.uint32((1 << BITS) - 1)
        out[3::2][codes[1:] == codes[:-1]] = REPEAT
        return out


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Two places and signs for every bucket."""
    h = mix(np.arange(1, 2 * (1 << BITS) + 1, dtype=np.uint64)).reshape(-1, 2)
    return (h % np.uint64(DIM)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0)


def gather(docs: DataFrame) -> DataFrame:
    """bucket and its summed context vector, over all documents."""
    names = [f"v{i}" for i in range(DIM)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, total = Tokens(), np.zeros((1 << BITS) * DIM)
        place, sign = index_vectors()
        for batch in slices(batches, 1000):
            tokens = [cache.tokens(x) for x in as_bytes(batch.column(0))]
            # zero between documents: nothing is a neighbour across it, as -1 is never counted
            line = np.concatenate([np.append(t, [-1, -1]) for t in tokens])
            for at in range(0, len(line), 1_000_000):
                part = line[at : at + 1_000_002]
                for gap in (1, 2):
                    left, right = part[: min(1_000_000, len(part) - gap)], part[gap : gap + 1_000_000]
                    real = (left >= 0) & (right >= 0)
                    left, right = left[real], right[real]
                    for a, b in ((left, right), (right, left)):
                        for k in range(2):
                            total += np.bincount(a * DIM + place[b, k], weights=sign[b, k], minlength=len(total))
        sums = total.reshape(-1, DIM).astype(np.int64)
        some = np.flatnonzero(sums.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), *(pa.array(sums[some, i]) for i in range(DIM))], names=["bucket", *names])

    rows = docs.select("text").mapInArrow(run, ", ".join(f"{x} long" for x in ["bucket", *names]))
    return rows.groupBy("bucket").agg(*(F.sum(x).alias(x) for x in names))


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit vectors of all buckets; buckets without words are zero."""
    vectors = np.zeros((1 << BITS, DIM), np.float32)
    for row in gather(docs).collect():
        vectors[row[0]] = row[1:]
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(norm > 0, norm, 1)


def pooled(vectors: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """The mean of the tokens' vectors, from how often each occurs, and of the shapes' alone."""
    if not len(tokens):
        return np.zeros(2 * DIM)
    out = []
    for part in (tokens[::2], tokens[1::2]):
        some, times = np.unique(part, return_counts=True)
        out.append(times @ vectors[some] / len(part))
    return np.concatenate(out)


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.first + self.first_bias) @ self.second + self.second_bias

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, apart: np.ndarray, steps: int = 400) -> Network:
    """Full-batch gradient descent with moments; ``apart`` marks the rows that stop it and fit the temperature."""
    rng = np.random.Generator(np.random.PCG64(7))
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    width = x.shape[1] if x.ndim == 2 else 2 * DIM
    net = Network(np.zeros(width), np.ones(width), rng.normal(0, width**-0.5, (width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), float(np.log(share / (1 - share))))
    if len(np.unique(y[~apart])) < 2:
        return net
    net.mean, net.scale = x[~apart].mean(axis=0), x[~apart].std(axis=0) + 1e-6
    z, t = (x[~apart] - net.mean) / net.scale, y[~apart]
    net.second = rng.normal(0, 0.3, HIDDEN)
    values = [net.first, net.first_bias, net.second, np.array([net.second_bias])]
    slow, fast = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    check, best, least = (x[apart] - net.mean) / net.scale, None, np.inf
    side = np.where(y[apart] == 1, -1, 1)
    for step in range(1, steps + 1):
        h = np.tanh(z @ values[0] + values[1])
        d = (1 / (1 + np.exp(-np.clip(h @ values[2] + values[3], -30, 30))) - t) / len(t)
        back = np.outer(d, values[2]) * (1 - h * h)
        for v, g, m, s in zip(values, (z.T @ back + 1e-4 * values[0], back.sum(0), h.T @ d + 1e-4 * values[2], np.array([d.sum()])), slow, fast):
            m *= 0.9
            m += 0.1 * g
            s *= 0.99
            s += 0.01 * g * g
            v -= 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
        if len(side) and (loss := np.mean(np.logaddexp(0, side * (np.tanh(check @ values[0] + values[1]) @ values[2] + values[3])))) < least:
            best, least = [v.copy() for v in values], loss
    net.first, net.first_bias, net.second, values[3] = best or values
    net.second_bias = float(values[3][0])
    if len(np.unique(y[apart])) == 2:
        logits, t = net.logits(x[apart]), y[apart]
        grid = np.exp(np.linspace(-1.5, 2.5, 81))
        loss = [np.mean(np.logaddexp(0, np.where(t == 1, -1, 1) * logits / g)) for g in grid]
        net.temperature = float(grid[int(np.argmin(loss))])
    return net


def scored(spark: SparkSession, docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted (score of at least 0.3) of every document."""
    vectors = spark.sparkContext.broadcast(word_vectors(docs))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, known = Tokens(), vectors.value
        for batch in slices(batches, 1000):
            x = [pooled(known, cache.tokens(t)).tolist() for t in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "label", "x"])

    rows = fitting_rows(docs, labels, "quality", bound).select("doc_id", "text", "label").mapInArrow(features, "doc_id long, label int, x array<double>").collect()
    rows.sort(key=lambda r: (r.doc_id, r.x))
    apart = np.array([zlib.crc32(f"apart {r.doc_id}".encode()) % 5 == 0 for r in rows], bool)
    net = spark.sparkContext.broadcast(fit(np.array([r.x for r in rows]).reshape(len(rows), 2 * DIM), np.array([int(r.label > 0) for r in rows], int), apart))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, known, judge = Tokens(), vectors.value, net.value
        for batch in slices(batches, 1000):
            x = np.array([pooled(known, cache.tokens(t)) for t in as_bytes(batch.column(1))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(judge.probabilities(x))], names=["doc_id", "score"])

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", (crc_fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
