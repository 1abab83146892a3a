"""Periodic runs of words by online dyadic square catching.

Words arrive in order. For every power of two B the last completed block of B words is a catcher: a
window of B words that starts anywhere in the block after it is compared with it, by hash. Equality
at distance p, B <= p < 2B, is a catch: the words from the block on look like the words p further on.
A run of period p and at least three periods keeps catching at its p block after block, so a catch
becomes a square only when as many neighbouring blocks caught at p as any wanted run must have. Then
a suffix comparison opens: it is led back to where the repetition starts and forward word by word,
both on exact word numbers, and every word appended later advances it until one differs. Overlapping
squares of one period are thereby one stretch, and a stretch of enough words and periods is a run.

Catches inside a stretch whose period divides p repeat what that stretch says and are passed over
(a stretch that holds a block and its copy at p inside one of period q, q | p, is that one), so a
text that repeats one word a million times opens one comparison. There are log2(n) catchers at a
time and n comparisons of hashes for each, all in numpy arrays: n log n for any text. Hashes only
propose; words decide.

A text is worked on in the task that read it, and nothing is shuffled: no source, copy or key can
make a task uneven beyond the length of its texts.

Cases: words are runs of bytes other than ASCII white space. A null, empty or blank text has no word
and no run, and an empty collapsed text. Rows with a null doc_id and rows that share a doc_id are
each worked on as they are. Of a very long text the task holds the words and some 40 bytes for each.
Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import BASE, as_bytes, mix, slices

#: Words that are appended at once; any other number gives the same runs.
STEP = 1 << 16
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


class Powers:
    """Powers of the base and of its inverse modulo 2**64, as far as a text has needed them."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            steps = np.ones((2, 2 * n), np.uint64)
            steps[0, 1:], steps[1, 1:] = BASE, pow(BASE, -1, 1 << 64)
            self.up, self.down = np.multiply.accumulate(steps, axis=1)


class Catchers:
    """Runs of at least ``least`` words and ``exponent`` (3 or more) periods of a growing text."""

    def __init__(self, powers: Powers, least: int = 6, exponent: int = 4) -> None:
        if exponent < 3:
            raise ValueError("catchers one block long find runs of three periods or more")
        self.powers, self.least, self.exponent = powers, least, exponent
        self.n = 0
        self.words, self.sums = np.empty(0, np.int64), np.zeros(1, np.uint64)
        self.compared: dict[int, int] = {}  # block size -> first window that is not compared yet
        self.chains: dict[int, dict[int, tuple[int, int]]] = {}  # block size -> period -> its blocks so far
        self.stretches: list[list[int]] = []  # start, end, period; those that still matter to catches
        self.found: list[list[int]] = []
        self.seen: set[tuple[int, int]] = set()

    def wanted(self, period: int) -> int:
        return max(self.least, self.exponent * period)

    def append(self, ids: np.ndarray) -> None:
        """The next words, as numbers that are equal where words are."""
        old, self.n = self.n, self.n + len(ids)
        if self.n > len(self.words):
            room = max(self.n, 2 * len(self.words))
            self.words = np.concatenate([self.words[:old], np.empty(room - old, np.int64)])
            self.sums = np.concatenate([self.sums[: old + 1], np.empty(room - old, np.uint64)])
        self.powers.reach(self.n + 1)
        self.words[old : self.n] = ids
        terms = mix(ids.astype(np.uint64) + np.uint64(1)) * self.powers.up[old : self.n]
        self.sums[old + 1 : self.n + 1] = self.sums[old] + np.cumsum(terms, dtype=np.uint64)
        for stretch in self.stretches:
            if stretch[1] == old:
                stretch[1] = self.forward(old - stretch[2], stretch[2])
        self.stretches = [s for s in self.stretches if s[1] == self.n or 2 * s[1] - s[0] > old]
        size = 1
        while self.exponent * size <= self.n:
            self.catch(size)
            size *= 2

    def windows(self, first: int, last: int, size: int) -> np.ndarray:
        sums = self.sums
        return (sums[first + size : last + size + 1] - sums[first : last + 1]) * self.powers.down[first : last + 1]

    def catch(self, size: int) -> None:
        """Compare the windows that were completed since the last time with the block before theirs."""
        first, last = self.compared.get(size, size), self.n - size
        if first > last:
            return
        self.compared[size] = last + 1
        row, rows = first // size, last // size - first // size + 1
        hashes = np.zeros(rows * size, np.uint64)
        hashes[first - row * size : last + 1 - row * size] = self.windows(first, last, size)
        at = np.arange(row - 1, row - 1 + rows) * size
        blocks = (self.sums[at + size] - self.sums[at]) * self.powers.down[at]
        hits = hashes.reshape(rows, size) == blocks[:, None]
        hits[0, : first - row * size] = False
        hits[-1, last + 1 - (row + rows - 1) * size :] = False
        if not hits.any():
            self.link(size, last, *np.empty((2, 0), np.int64))
            return
        for start, end, period in self.stretches:
            if end - start >= 2 * size and end > (row - 1) * size:
                low, whole = max(row, -(-start // size) + 1), (end - 2 * size + 1) // size
                column = -size % period
                hits[low - row : max(low, whole + 1) - row, column::period] = False
                for r in range(max(low, whole + 1), min(whole + 3, row + rows)):
                    hits[r - row, column : max(0, end - size - r * size + 1) : period] = False
        found = np.flatnonzero(hits)
        self.link(size, last, found // size + (row - 1), found % size + size)

    def link(self, size: int, last: int, blocks: np.ndarray, periods: np.ndarray) -> None:
        """Join catches of neighbouring blocks at one period; long enough chains open a comparison."""
        order = np.lexsort((blocks, periods))
        blocks, periods = blocks[order], periods[order]
        edge = np.flatnonzero(np.append(True, (periods[1:] != periods[:-1]) | (blocks[1:] != blocks[:-1] + 1))[: len(blocks)])
        heads, tails, periods = blocks[edge], blocks[np.append(edge[1:], len(blocks)) - 1] if len(edge) else blocks, periods[edge]
        before, waiting = self.chains.get(size, {}), {}
        needed = (np.maximum(self.least, self.exponent * periods) - periods - size + 1) // size
        open_end = (tails + 1) * size + periods > last
        keep = (tails - heads + 1 >= needed) | open_end
        if before:
            keep |= np.isin(periods, list(before))
        for head, tail, period, need, is_open in zip(*(x[keep].tolist() for x in (heads, tails, periods, needed, open_end))):
            if period in before and before[period][1] == head - 1:
                head = before[period][0]
            if tail - head + 1 >= need:
                self.open(head * size, (tail + 1) * size, period)
            elif is_open:
                waiting[period] = (head, tail)
        for period, (head, tail) in before.items():
            if (tail + 1) * size + period > last:
                waiting.setdefault(period, (head, tail))
        self.chains[size] = waiting

    def open(self, low: int, high: int, period: int) -> None:
        """The stretches of one period around words low to high, which hashes say are equal p further on."""
        equal = np.concatenate([[False], self.words[low:high] == self.words[low + period : high + period], [False]])
        edges = np.flatnonzero(equal[1:] != equal[:-1]) + low
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
            start, end = self.back(start, period), self.forward(end, period)
            if (start, period) not in self.seen:
                self.seen.add((start, period))
                self.found.append([start, end, period])
                self.stretches.append(self.found[-1])

    def forward(self, at: int, period: int) -> int:
        """Where the repetition ends: words from ``at`` on are compared with those a period further on."""
        words, step = self.words, 64
        while at + period < self.n:
            step = min(2 * step, self.n - period - at)
            differ = words[at : at + step] != words[at + period : at + period + step]
            if differ.any():
                return at + int(differ.argmax()) + period
            at += step
        return at + period

    def back(self, at: int, period: int) -> int:
        words, step = self.words, 64
        while at > 0:
            step = min(2 * step, at)
            differ = words[at - step : at] != words[at - step + period : at + period]
            if differ.any():
                return at - int(differ[::-1].argmax())
            at -= step
        return 0

    def runs(self) -> list[tuple[int, int, int]]:
        """start, length and smallest period of the runs of the text so far, by start, then period."""
        best: dict[tuple[int, int], int] = {}
        for start, end, period in self.found:
            if end - start >= self.wanted(period):
                best[start, end] = min(period, best.get((start, end), period))
        return sorted(((start, end - start, period) for (start, end), period in best.items()), key=lambda r: (r[0], r[2]))


def runs_of(words: list[bytes], powers: Powers, least: int = 6, exponent: int = 4, step: int = STEP) -> list[tuple[int, int, int]]:
    numbers: dict[bytes, int] = {}
    catchers = Catchers(powers, least, exponent)
    for at in range(0, len(words), step):
        part = words[at : at + step]
        catchers.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in part), np.int64, len(part)))
    return catchers.runs()


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds behind its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    gone = (np.cumsum(edge) > 0).tolist()
    return b" ".join(w for w, out in zip(words, gone) if not out)


def collapse(docs: DataFrame, least: int = 6, exponent: int = 4, edit: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """doc_id, ``runs`` (start, length, period) and the ``collapsed`` text of every row.

    ``edit`` may change a document's words before they are looked at.
    """
    kind = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in slices(batches, 500):
            found, texts = [], []
            for doc_id, data in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                words = data.split()
                if edit:
                    words = edit(doc_id, words)
                runs = runs_of(words, powers, least, exponent)
                found.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
                texts.append(collapsed(words, runs))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind), pa.array(texts, pa.binary())], names=["doc_id", "runs", "collapsed"])

    # texts come back as bytes, so that one that is no UTF-8 stays as it is
    made = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, runs {RUNS}, collapsed binary")
    return made.withColumn("collapsed", F.col("collapsed").cast("string"))


def longest(runs: Column) -> Column:
    """The run of greatest length; of equal ones the first, then the one of smallest period."""
    ranked = F.array_max(F.transform(runs, lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    return F.struct((-ranked.start).alias("start"), ranked.length.alias("length"), (-ranked.period).alias("period"))


def listed(runs: Column) -> Column:
    """One line ``start,length,period`` for every run."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
