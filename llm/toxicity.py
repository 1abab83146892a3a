"""Toxicity: a convolutional text classifier in numpy, scored inside tasks.

A word (lower case, punctuation cut off) has three hashed embeddings, of itself and of its first
seven and five bytes, which are added. Filters over one, two and three words, a rectifier and the maximum over the
whole text feed a logistic output. Half of the labelled sample gives each embedding its first value,
a shrunken log-odds of its class; on three tenths filters, embeddings and output are trained by
gradient descent, where only the window that won a maximum passes a gradient. The rest calibrates the
output and a threshold for each language; language is never an input of the score.

The model (about 6 MB) is fitted on a bounded sample (see ``labelled`` and ``digest``) and broadcast. Scoring reads
each text once and shuffles nothing.

Cases: null, empty and blank texts get the score of no evidence; languages that are null or were not
met in fitting use the threshold over all languages; without labels of both kinds every score is the
share of label 1 (0 without labels); other columns are untouched; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import as_bytes, crc_fold, slices
from llm.labelled import SAMPLE, fitting_rows

BITS = 16
STARTS = (7, 5)
DIM = 8
FILTERS = 8
WIDTHS = (1, 2, 3)
EPOCHS = 3
RATE = 0.01
#: Share of the rate that embeddings move with; few words are met often enough to be trusted more.
SLOW = 0.02
PIECE = 8_192
#: Toxic documents that a calibration needs at least.
FEW = 10
#: Bytes that end words, besides white space; A-Z become a-z.
TABLE = bytes(32 if (b < 48 or 57 < b < 65 or 90 < b < 97 or 122 < b < 128) else b + 32 if 65 <= b <= 90 else b for b in range(256))


class Buckets(dict):
    """word -> buckets of the word and of its beginnings, in one number; bounded like ``common.Words``."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word) & ((1 << BITS) - 1)
        for length in STARTS:
            value = value << BITS | xxhash.xxh3_64_intdigest(word[:length], length) & ((1 << BITS) - 1)
        if len(self) < 300_000:
            self[word] = value
        return value

    def words(self, data: bytes) -> np.ndarray:
        words = data.translate(TABLE).split()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def digest(codes: np.ndarray) -> np.ndarray:
    """What fitting needs of a text: all of it, or of a long one each word where it stands first.

    Maxima do not see how often a window occurs. Of a text of more than ``PIECE`` words every
    word's first place is kept with its neighbours, in order, so all of its words are there and what
    goes to the driver is bounded by the number of buckets; words beside a gap become neighbours.
    """
    if len(codes) <= PIECE:
        return codes
    first = np.unique(codes >> BITS * len(STARTS), return_index=True)[1]
    kept = np.zeros(len(codes) + 2, bool)
    for side in (0, 1, 2):
        kept[first + side] = True
    return codes[kept[1:-1]]


def _parts(codes: np.ndarray) -> list[np.ndarray]:
    """Rows of the embedding table, which has one section for words and one for each beginning."""
    return [(codes >> BITS * k & (1 << BITS) - 1) + (k << BITS) for k in range(len(STARTS) + 1)]


@dataclass
class Model:
    embedding: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    shift: float
    thresholds: dict[str | None, float] = field(default_factory=dict)

    def pooled(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The maximum of each filter, the window that won it, and the words' embeddings."""
        x = sum(self.embedding[part] for part in _parts(codes))
        best, place = [], []
        for w, kernel, bias in zip(WIDTHS, self.filters, self.bias):
            n = len(x) - w + 1
            if n <= 0:
                best.append(np.zeros(FILTERS, np.float32))
                place.append(np.full(FILTERS, -1))
                continue
            y = x[:n] @ kernel[0]
            for j in range(1, w):
                y += x[j : j + n] @ kernel[j]
            won = y.argmax(axis=0)
            top = y[won, np.arange(FILTERS)] + bias
            place.append(np.where(top > 0, won, -1))
            best.append(np.maximum(top, 0))
        return np.concatenate(best), np.concatenate(place), x

    def score(self, codes: np.ndarray) -> float:
        """Long texts go in pieces that overlap by the longest window less one; the maximum is the same."""
        best = np.zeros(FILTERS * len(WIDTHS), np.float32)
        step = PIECE - max(WIDTHS) + 1
        for at in range(0, max(1, len(codes) - max(WIDTHS) + 1), step):
            best = np.maximum(best, self.pooled(codes[at : at + PIECE])[0])
        return float(1 / (1 + np.exp(-np.clip(best @ self.out + self.shift, -30, 30))))


def _log_odds(docs: list[np.ndarray], labels: np.ndarray, size: int) -> np.ndarray:
    """Shrunken log-odds of each embedding's row over documents that have it."""
    counts = np.zeros((2, size))
    for codes, label in zip(docs, labels):
        for part in _parts(codes):
            counts[label, np.unique(part)] += 1
    share = np.clip(labels.mean(), 0.01, 0.99)
    strength = 4.0
    odds = (counts[1] + strength * share) / (counts[0] + strength * (1 - share))
    return np.clip(np.log(odds * (1 - share) / share), -3, 6).astype(np.float32)


def fit(docs: list[np.ndarray], labels: np.ndarray, langs: list[str | None], part: np.ndarray) -> Model:
    """``part``: whether a document gives first values (0), trains (1) or calibrates (2)."""
    rng = np.random.Generator(np.random.PCG64(8))
    size, n = len(STARTS) + 1 << BITS, FILTERS * len(WIDTHS)
    embedding = rng.normal(0, 0.05, (size, DIM)).astype(np.float32)
    filters = [rng.normal(0, 0.1, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    bias = [np.full(FILTERS, -0.5, np.float32) for _ in WIDTHS]
    share = float(labels.mean()) if len(labels) else 0.0
    model = Model(embedding, filters, bias, np.zeros(n, np.float32), float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
    model.thresholds = {None: 0.5}
    if len(np.unique(labels[part == 0])) < 2 or len(np.unique(labels[part == 1])) < 2:
        return model
    first = [d for d, k in zip(docs, part) if k == 0]
    embedding[:, 0] = _log_odds(first, labels[part == 0], size) / 3
    for w, kernel in zip(WIDTHS, filters):
        kernel[:, 0, :] += 1.0 / w
    model.out[:] = 1.0 / n
    rows = np.flatnonzero(part == 1)
    weight = {0: 1.0, 1: min(8.0, (1 - share) / share)}
    epochs = EPOCHS and max(EPOCHS, min(40, 8_000 // len(rows)))
    for epoch in range(epochs):
        for i in rng.permutation(rows).tolist():
            codes, label = docs[i], int(labels[i])
            if not len(codes):
                continue
            best, place, x = model.pooled(codes)
            p = 1 / (1 + np.exp(-np.clip(best @ model.out + model.shift, -30, 30)))
            g = weight[label] * (p - label)
            back = (g * model.out).astype(np.float32)
            step = RATE / (1 + epoch)
            model.out -= step * np.clip(g * best, -2, 2)
            model.shift -= step * g
            parts = _parts(codes)
            for k, (w, kernel, bias_) in enumerate(zip(WIDTHS, filters, bias)):
                for f in range(FILTERS):
                    at = place[k * FILTERS + f]
                    if at < 0:
                        continue
                    d = step * back[k * FILTERS + f]
                    bias_[f] -= d
                    for j in range(w):
                        change = SLOW * d * kernel[j, :, f]
                        kernel[j, :, f] -= np.clip(d * x[at + j], -0.05, 0.05)
                        for row in parts:
                            embedding[row[at + j]] -= change
    if labels[part == 2].sum() >= FEW:
        rows = np.flatnonzero(part == 2)
    _calibrate(model, [docs[i] for i in rows], labels[rows], [langs[i] for i in rows])
    return model


def _calibrate(model: Model, docs: list[np.ndarray], labels: np.ndarray, langs: list[str | None]) -> None:
    """Moves the output so that the best threshold over all languages is one half, then by language."""
    scores = np.array([model.score(d) for d in docs])
    logit = lambda p: np.log(p / (1 - p))
    model.shift -= float(np.clip(logit(_best(scores, labels)), -4, 4))
    scores = np.array([model.score(d) for d in docs])
    for lang in {x for x in langs if x is not None}:
        mine = np.array([x == lang for x in langs])
        if labels[mine].sum() >= FEW:
            model.thresholds[lang] = float(np.clip(_best(scores[mine], labels[mine]), 0.3, 0.7))


def _best(scores: np.ndarray, labels: np.ndarray) -> float:
    """The middle of the widest gap among thresholds with the greatest F1."""
    order = np.argsort(-scores, kind="stable")
    s = scores[order]
    hit = np.cumsum(labels[order])
    f1 = 2 * hit / (np.arange(1, len(s) + 1) + labels.sum())
    f1[:-1][s[:-1] == s[1:]] = -1
    after = np.append(s[1:], 0.0)
    i = max(np.flatnonzero(f1 >= f1.max() - 1e-12), key=lambda k: s[k] - after[k])
    return float(np.clip((s[i] + after[i]) / 2, 1e-3, 1 - 1e-3))


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Model:
    """A model from a bounded sample of labelled documents outside the held-out fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Buckets()
        for batch in slices(batches, 500):
            codes = [digest(cache.words(x)).tobytes() for x in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(codes, pa.binary())], names=["doc_id", "lang", "label", "codes"])

    rows = fitting_rows(docs, labels, "toxic", bound).select("doc_id", "text", "lang", "label").mapInArrow(run, "doc_id long, lang string, label int, codes binary").collect()
    rows.sort(key=lambda r: (r.doc_id, bytes(r.codes)))
    part = np.array([(0, 0, 0, 0, 0, 1, 1, 1, 2, 2)[zlib.crc32(f"part {r.doc_id}".encode()) % 10] for r in rows], int)
    return fit([np.frombuffer(r.codes, np.int64) for r in rows], np.array([int(r.label > 0) for r in rows], int), [r.lang for r in rows], part)


def score(spark: SparkSession, docs: DataFrame, model: Model, name: str = "toxic_score") -> DataFrame:
    """The same rows and columns with the score behind them, in a column called ``name``."""
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index("text")
    if name.lower() in map(str.lower, docs.columns):
        raise ValueError(f"a column {name} is there already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, known = Buckets(), shared.value
        for batch in slices(batches, 500):
            scores = [known.score(cache.words(x)) for x in as_bytes(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{name}` double"
    return docs.mapInArrow(run, schema)


def threshold(model: Model, lang: str = "lang"):
    """The threshold for each row's language."""
    out = F.lit(model.thresholds[None])
    for name, value in sorted((k, v) for k, v in model.thresholds.items() if k is not None):
        out = F.when(F.col(lang) == name, F.lit(value)).otherwise(out)
    return out


def scored(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, and whether its language's threshold rejects it."""
    model = train(spark, docs, labels)
    rows = score(spark, docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")), model)
    return rows.select(
        "doc_id",
        (crc_fold() == 0).alias("held_out"),
        F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"),
        (F.col("toxic_score") >= threshold(model)).alias("rejected"),
    )
