"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared in lower case with each run of white space as one blank. An item of m
characters may differ by e = m * rate edits (rounded down). It is split into e + 1 pieces; a passage
within e edits holds at least one piece unchanged. One Aho-Corasick pass over a text finds all
pieces of all items; each hit names a window of the text, windows of an item that overlap are
joined, and Myers' bit-parallel algorithm gives the least edit distance of the item to any passage
of the window. The search is exact: every passage within the budget is found.

Items are broadcast in slices of at most ``SLICE`` characters, so a benchmark of any size takes as
many passes over the documents as it has slices, each of bounded memory. Documents are not shuffled.

Cases: null, empty and blank texts and items match nothing; items shorter than 1 / rate characters
must occur unchanged, between characters that are not letters or digits. Rows with a null item_id
count as items without a name. Repeated items or documents give equal rows once. Other columns are
not read. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import slices

RATE = 0.05
SLICE = 4_000_000


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece): budget + 1 pieces of nearly equal length."""
    cuts = [len(item) * k // (budget + 1) for k in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


class Pattern:
    """Myers' algorithm for one item, with Python's integers as bit vectors."""

    def __init__(self, item: str, budget: int) -> None:
        self.size, self.budget = len(item), budget
        self.mask, self.top = (1 << len(item)) - 1, 1 << len(item) - 1
        self.peq: dict[str, int] = {}
        for i, c in enumerate(item):
            self.peq[c] = self.peq.get(c, 0) | 1 << i

    def best(self, text: str) -> tuple[int, int]:
        """The least distance of the item to a passage of the text, and where that passage first ends."""
        pv, mv, score, mask, top, get = self.mask, 0, self.size, self.mask, self.top, self.peq.get
        least, end = score, 0
        for at, c in enumerate(text, 1):
            eq = get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | ~(xh | pv) & mask
            mh = pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
                if score < least:
                    least, end = score, at
            # nothing is carried in: a passage may begin anywhere
            ph = ph << 1
            mh = mh << 1
            pv = (mh | ~(xv | ph)) & mask
            mv = ph & xv & mask
        return least, end


class Matcher:
    """All items of a slice."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float = RATE) -> None:
        self.items = []
        found: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            text = normal(text or "")
            if not text:
                continue
            budget = int(len(text) * rate)
            self.items.append((item_id, Pattern(text, budget), budget))
            for offset, piece in pieces(text, budget):
                found.setdefault(piece, []).append((len(self.items) - 1, offset))
        self.machine = ahocorasick.Automaton()
        for piece, places in found.items():
            self.machine.add_word(piece, (len(piece), places))
        if found:
            self.machine.make_automaton()

    def matches(self, text: str) -> list[tuple[int | None, int, int]]:
        """(item_id, distance, end in the normalised text) of each item that the text holds."""
        if not self.items or not (text := normal(text)):
            return []
        windows: dict[int, list[list[int]]] = {}
        for end, (length, places) in self.machine.iter(text):
            for item, offset in places:
                _, pattern, budget = self.items[item]
                if budget == 0 and (text[end - length : end - length + 1].isalnum() or text[end + 1 : end + 2].isalnum()):
                    continue
                low = end + 1 - length - offset - budget
                high = low + pattern.size + 2 * budget
                spans = windows.setdefault(item, [])
                spans.append([max(0, low), min(len(text), high)])
        out = []
        for item, spans in windows.items():
            item_id, pattern, budget = self.items[item]
            spans.sort()
            best, end, at = budget + 1, 0, 0
            while at < len(spans) and best:
                low, high = spans[at]
                at += 1
                while at < len(spans) and spans[at][0] <= high:
                    high = max(high, spans[at][1])
                    at += 1
                distance, place = pattern.best(text[low:high])
                if distance < best:
                    best, end = distance, low + place
            if best <= budget:
                out.append((item_id, best, end))
        return out


def matches(spark: SparkSession, docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, item_id, distance, end_place: one row for each document and each item that it holds."""
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-chars // SLICE))
    names = ["doc_id", "item_id", "distance", "end_place"]
    kinds = pa.schema([(x, pa.int64()) for x in names])
    found = None
    for part in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).select("item_id", "text").distinct().collect()
        shared = spark.sparkContext.broadcast([tuple(r) for r in rows])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, rate)
            for batch in slices(batches, 1000):
                out = [(doc_id, *m) for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if text for m in matcher.matches(text)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], schema=kinds)

        one = docs.select("doc_id", "text").mapInArrow(run, ", ".join(f"{x} long" for x in names))
        found = one if found is None else found.unionByName(one)
    return found.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"), F.min_by("end_place", "distance").alias("end_place"))


def clean(spark: SparkSession, docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """The documents that hold no item, all columns unchanged. Rows with a null doc_id are kept."""
    held = matches(spark, docs, items, rate).select(F.col("doc_id").alias("held")).distinct()
    return docs.join(held, docs["doc_id"] == held["held"], "left_anti")
