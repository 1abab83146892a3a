"""Substring dedup by level-wise doubling of word windows.

Levels are the window's length halved until it is short, shortest first: 13, 25 and 50 words for
``op10_passages``. At each level windows that one document alone holds end there; of those that are
repeated, two of one document that lie the right distance apart make a window of the next level,
which is twice as long, or as much as is left to the full length (13 and 13 words, 12 apart, make
25). Its hash is made of theirs, by a task that holds the text again: hashes cannot be compressed and
weigh more than the words they stand for, so levels hand on places alone. Levels below the full
length compare one hash of 64 bits, the full length two (independent polynomials). ``extend`` goes
on from there until no window is repeated, whatever the length.

The first level would have a row for each word of the corpus. Each full window therefore names the
least hash among the first-level windows it holds (its anchor), so equal windows have equal anchors,
and about one first-level window in twenty is an anchor. Anchors that occur in one document alone
end there, and the first level holds the windows that full windows with a repeated anchor are made
of. That loses nothing: a repeated full window has its anchor, and all its parts, in both documents.

Exact copies of a text are settled first by the text's digest, so copies bring no windows. All
groups are folded on the map side (least and greatest document of a window), and the way back to
documents is an equi-join that Spark may split, so a window that a third of all documents share is
no task's burden. Texts move once to meet their repeated anchors; after that only candidates move,
their texts once for each level.

Cases: a null or empty text has no words and keeps nothing (the digest of an empty text); texts
shorter than a window keep all; rows with a null doc_id keep all and remove nothing; rows that
share a doc_id do not remove each other's words, and equal ones get equal results; other columns
are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import BASE, Words, as_bytes, cut, list_array, mix, salted, signed, slices, sliding_min, window_hashes

SECOND = 0xC2B2AE3D27D4EB4F
EMPTY = hashlib.sha256(b"").hexdigest()


def lengths(length: int, least: int = 13) -> list[int]:
    """The levels' window lengths: the next is at most twice the one before, the last is ``length``."""
    levels = [length]
    while levels[0] >= 2 * least - 1 and levels[0] > 1:
        levels.insert(0, (levels[0] + 1) // 2)
    return levels


def anchors(hashes: np.ndarray, length: int) -> np.ndarray:
    """For each window of ``length`` words the least hash among the first-level windows it holds."""
    first = lengths(length)[0]
    return sliding_min(mix(window_hashes(hashes, first)), length - first + 1)


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.col("text").alias("text"), F.unhex(F.md5(text)).alias("digest")).withColumn("row", F.xxhash64("doc_id", "digest"))


def _profile(keyed: DataFrame, length: int) -> DataFrame:
    """Words, digest of all words and distinct anchors of each document."""
    kinds = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("digest", pa.binary()), ("n_words", pa.int64()), ("all_sha256", pa.string()), ("anchors", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Words()
        for batch in slices(batches, 500):
            n, sha, lists = [], [], []
            for data in as_bytes(batch.column(0)):
                words = data.split()
                n.append(len(words))
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
                lists.append(signed(np.unique(anchors(cache.hashes(words), length))) if len(words) >= length else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), batch.column(3), pa.array(n, pa.int64()), pa.array(sha), list_array(lists, pa.int64())], schema=kinds)

    return keyed.select("text", "doc_id", "row", "digest").mapInArrow(run, "doc_id long, row long, digest binary, n_words long, all_sha256 string, anchors array<long>")


NAMES = ["h1", "h2", "doc_id", "tag"]
WINDOWS = ", ".join(f"{x} long" for x in NAMES) + ", places array<int>"


class _Rows:
    """Collects windows of many documents: one row for each document and window, with its places."""

    def __init__(self) -> None:
        self.parts, self.sizes, self.places = [], [], []

    def add(self, doc_id: int, tag: int, h1: np.ndarray, h2: np.ndarray, places: np.ndarray) -> None:
        order = np.lexsort((places, h2, h1))
        h1, h2 = signed(h1[order]), signed(h2[order])
        first = np.flatnonzero(np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))[: len(h1)])
        self.parts.append((h1[first], h2[first], np.full(len(first), doc_id), np.full(len(first), tag)))
        self.sizes.append(np.diff(np.append(first, len(h1))))
        self.places.append(places[order].astype(np.int32))

    def batch(self) -> pa.RecordBatch:
        ends = np.cumsum(np.concatenate([[0], *self.sizes]).astype(np.int64))
        column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int32), *self.places]), pa.int32()))
        flat = [np.concatenate([np.empty(0, np.int64), *x]) for x in (zip(*self.parts) if self.parts else [()] * 4)]
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in flat), column], names=[*NAMES, "places"])


def level_hashes(words: np.ndarray, levels: list[int], base: int = BASE) -> np.ndarray:
    """Hashes of all windows of the last level, each made of two of the level before."""
    h = window_hashes(words, levels[0], base)
    for short, long in zip(levels, levels[1:]):
        apart = long - short
        h = mix(h[: max(len(h) - apart, 0)] * np.uint64(base) + h[apart:])
    return h


def _first_level(candidates: DataFrame, length: int) -> DataFrame:
    """First-level windows that full windows with a repeated anchor are made of."""
    levels, offsets = lengths(length), np.zeros(1, np.int64)
    for short, long in zip(levels, levels[1:]):
        offsets = np.union1d(offsets, offsets + long - short)

    def places(words: np.ndarray, known: np.ndarray) -> np.ndarray:
        full, needed = np.flatnonzero(np.isin(signed(anchors(words, length)), known)), np.zeros(len(words), bool)
        for offset in offsets:
            needed[full + offset] = True
        return np.flatnonzero(needed)

    return _windows(candidates.withColumnRenamed("anchors", "known"), levels[:1], places, len(levels) == 1)


def _next_level(candidates: DataFrame, survivors: DataFrame, levels: list[int], last: bool) -> DataFrame:
    """Windows of the last of ``levels``: two survivors of one document that lie as far apart as it is longer."""
    apart = levels[-1] - levels[-2]
    kept = survivors.groupBy("doc_id", "tag").agg(F.flatten(F.collect_list("places")).alias("known"))

    def places(words: np.ndarray, known: np.ndarray) -> np.ndarray:
        known = np.unique(known)
        return known[np.isin(known + apart, known, assume_unique=True)]

    return _windows(candidates.join(kept, ["doc_id", "tag"]), levels, places, last)


def _windows(docs: DataFrame, levels: list[int], places: Callable[[np.ndarray, np.ndarray], np.ndarray], last: bool) -> DataFrame:
    """The windows of the last of ``levels`` at the places that ``places`` finds from the words and ``known``.

    The second hash is needed at the full length alone and 0 before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Words()
        for batch in slices(batches, 100):
            rows = _Rows()
            for data, doc_id, tag, known in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                words = cache.hashes(data.split())
                at = places(words, known.values.to_numpy())
                h1 = level_hashes(words, levels)[at]
                rows.add(doc_id, tag, h1, level_hashes(mix(words), levels, SECOND)[at] if last else np.zeros_like(h1), at)
            yield rows.batch()

    return docs.select("text", "doc_id", "tag", "known").mapInArrow(run, WINDOWS)


def _survivors(windows: DataFrame) -> DataFrame:
    """Windows that start in several documents, with the smallest of them."""
    again = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    return windows.join(again.select("h1", "h2", "low"), ["h1", "h2"])


def _short_survivors(windows: DataFrame) -> DataFrame:
    """Windows below the full length that may start in several documents: doc_id, tag and places.

    One hash is compared; what it takes for equal by chance is a part of a longer window, and that is
    told apart by both hashes at the full length.
    """
    again = windows.groupBy("h1").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    return windows.select("h1", "doc_id", "tag", "places").join(again.select("h1"), "h1").drop("h1")


def _kept(flagged: DataFrame, length: int) -> DataFrame:
    """Words removed, and digest and text of the words kept, of documents with repeated windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 200):
            gone, texts, sha = [], [], []
            for data, places in zip(as_bytes(batch.column(0)), batch.column(3)):
                words = data.split()
                edge = np.zeros(len(words) + 1, np.int64)
                starts = np.unique(places.values.to_numpy())
                np.add.at(edge, starts, 1)
                np.add.at(edge, starts + length, -1)
                covered = np.cumsum(edge)[:-1] > 0
                kept = b" ".join(w for w, out in zip(words, covered.tolist()) if not out)
                gone.append(int(covered.sum()))
                texts.append(kept.decode(errors="replace"))
                sha.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(gone, pa.int64()), pa.array(sha), pa.array(texts)], names=["doc_id", "row", "gone", "sha", "kept_text"])

    return flagged.select("text", "doc_id", "row", "places").mapInArrow(run, "doc_id long, row long, gone long, sha string, kept_text string")


def repeated(spark: SparkSession, keyed: DataFrame, sources: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Candidate documents with their texts, and their full windows of which all parts are repeated."""
    half = sources.select("doc_id", "row", F.explode("anchors").alias("anchor"))
    again = half.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("anchor")
    lists = half.join(again, "anchor").groupBy("doc_id", "row").agg(F.collect_set("anchor").alias("anchors"))
    # windows name their row by its doc_id; a tag is only needed where other texts have that doc_id too
    shared = sources.groupBy("doc_id").agg(F.min("row").alias("least"), F.max("row").alias("greatest")).where("least < greatest").select("doc_id", F.lit(True).alias("shared"))
    lists = lists.join(shared, "doc_id", "left").select("doc_id", "row", F.when(F.col("shared"), F.col("row")).otherwise(F.lit(0)).alias("tag"), "anchors")
    candidates = cut(spark, keyed.select("doc_id", "row", "text").join(lists, ["doc_id", "row"]), "candidates")
    levels = lengths(length)
    windows = cut(spark, _first_level(candidates, length), "windows")
    for i in range(1, len(levels)):
        windows = cut(spark, _next_level(candidates, _short_survivors(windows), levels[: i + 1], i + 1 == len(levels)), "windows")
    return candidates, windows


def remove_repeats(spark: SparkSession, docs: DataFrame, length: int = 50) -> DataFrame:
    """Each document's words outside windows that also start in a document with a smaller doc_id.

    Columns: doc_id, n_words, n_removed, kept_sha256, and kept_text where something was removed.
    """
    keyed = _keyed(docs)
    profile = cut(spark, _profile(keyed, length), "profile")
    first = cut(spark, profile.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "classes")
    profile = cut(spark, salted(profile, first, "digest"), "profile")
    candidates, windows = repeated(spark, keyed, profile.where("doc_id = first"), length)
    places = _survivors(windows).where("doc_id > low").groupBy("doc_id", "tag").agg(F.flatten(F.collect_list("places")).alias("places"))
    kept = _kept(candidates.join(places, ["doc_id", "tag"]), length)
    kept = kept.groupBy("doc_id", "row").agg(F.max("gone").alias("gone"), F.max("sha").alias("sha"), F.max("kept_text").alias("kept_text"))
    copy = F.coalesce((F.col("doc_id") > F.col("first")) & (F.col("n_words") >= length), F.lit(False))
    return profile.drop("anchors", "digest").join(kept, ["doc_id", "row"], "left").select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(EMPTY)).otherwise(F.coalesce("sha", "all_sha256")).alias("kept_sha256"),
        F.when(copy, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"),
    )


def extend(spark: SparkSession, candidates: DataFrame, windows: DataFrame, length: int) -> DataFrame:
    """Goes on doubling: for each level the windows repeated in several documents, until none is.

    ``candidates`` and ``windows`` are those of ``repeated`` at ``length``. Columns: length, doc_id,
    tag, place; the tag is the document's row hash where several texts share a doc_id, else 0.
    """
    found, levels = None, lengths(length)
    while True:
        windows = cut(spark, _survivors(windows), "level")
        level = windows.select(F.lit(levels[-1]).alias("length"), "doc_id", "tag", F.explode("places").alias("place"))
        found = level if found is None else found.unionByName(level)
        if windows.isEmpty():
            return found
        levels = [*levels, 2 * levels[-1]]
        windows = _next_level(candidates, windows, levels, last=True)
