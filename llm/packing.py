"""Order-preserving packing of documents into training sequences, by dynamic programming.

The token stream of a partition (its documents in order, each closed by an end token) is cut into
windows of at most ``capacity`` tokens. Windows may end at document ends, at sentence ends (a
penalty) or at any 16th token (a larger penalty). The cuts minimise
padding plus penalties: with f(j) the least cost up to cut place c_j,

    f(j) = penalty_j + capacity - c_j + min { f(i) + c_i : c_j - capacity <= c_i < c_j },

where the minimum over the moving window comes from a monotone queue, so each place enters and
leaves once. A window whose length is a power of two needs no padding and is a second transition.

Nothing is shuffled: a task packs its own partition batch after batch, holds about a million
tokens at a time, and carries the last, unfinished window into the next batch. A task that runs
again over the same partition gives the same rows.

Cases: a null or empty text is the end token alone; a null doc_id and repeated rows are packed like
any others; an empty table gives no rows; columns other than doc_id and text are not read. Texts
longer than a sequence go over as many as they need.
"""

from __future__ import annotations

import os
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from llm.common import slices

CAPACITY = 1024
SENTENCE_PENALTY = 3
TOKEN_PENALTY = 8
#: Cost of a window as such; keeps short windows of a power of two from replacing full ones.
WINDOW_COST = 24
SHORT = (512, 256)
STEP = 16
HELD_TOKENS = 1_000_000

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
ARROW = pa.schema([(x.split()[0], pa.int64()) for x in SCHEMA.split(", ")])

#: White space besides blank and line feed.
OTHER_SPACE = [chr(i) for i in range(1, 0x3001) if chr(i).isspace() and chr(i) not in " \n"]


def uneven(text: str) -> bool:
    """Where white space meets a blank, pieces of the text are not independent of each other."""
    return "  " in text or " \n" in text or "\n " in text or text[0].isspace() or text[-1].isspace() or any(x in text for x in OTHER_SPACE) or "<|endoftext|>" in text


class Encoder(dict):
    """chunk after a blank -> its ids as little-endian bytes; the chunks met first are kept, up to a bound.

    The ids are those of the ``tokenizers`` file. Pieces of a text that follow single blanks encode
    independently, so frequent ones are looked up; the rest go through the same vocabulary as ranks.
    Texts with other white space around blanks, or with the special token, are encoded whole.
    """

    def __init__(self, path: str, bound: int = 300_000) -> None:
        import json

        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        super().__init__()
        self.bound, self.whole = bound, Tokenizer.from_file(path)
        model = json.load(open(path, encoding="utf-8"))["model"]
        symbol = {c: b for b, c in self.symbols().items()}
        ranks = {bytes(symbol[c] for c in token): i for token, i in model["vocab"].items() if all(c in symbol for c in token) and token != "<|endoftext|>"}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.ranks = ranks
        self.encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary

    @staticmethod
    def symbols() -> dict[int, str]:
        """Byte-level vocabularies write printable Latin-1 bytes as themselves, the others from U+0100 on."""
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(shown)]
        return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def __missing__(self, chunk: str) -> bytes:
        ids = np.array(self.encode(" " + chunk), "<u4").tobytes()
        if len(self) < self.bound:
            self[chunk] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if uneven(text):
            if "<|endoftext|>" in text:
                return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            return np.array(self.encode(text), "<u4").tobytes()
        first, *rest = text.split(" ")
        return np.array(self.encode(first), "<u4").tobytes() + b"".join(map(self.__getitem__, rest))

    def sentence_ends(self) -> np.ndarray:
        """For each id whether a sentence may end after it."""
        ends = np.zeros(1 << 16, bool)
        for token, i in self.ranks.items():
            ends[i] = token[-1:] in b".!?\n" and token[-1:] != b""
        return ends


def cut_places(total: int, doc_ends: np.ndarray, sentence_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where windows may end, ascending and ending with ``total``, and their penalties."""
    penalty = np.full(total + 1, -1, np.int16)
    penalty[STEP::STEP] = TOKEN_PENALTY
    penalty[sentence_ends] = SENTENCE_PENALTY
    penalty[total] = 0
    penalty[doc_ends] = 0
    penalty[0] = -1
    places = np.flatnonzero(penalty >= 0)
    return places, penalty[places]


def best_cuts(places: np.ndarray, penalty: np.ndarray, capacity: int = CAPACITY) -> list[int]:
    """The ends of the windows that cost least in sum. Each step to the next place is at most ``capacity``."""
    c, q = [0, *places.tolist()], [0, *penalty.tolist()]
    index = {x: i for i, x in enumerate(c)}
    cost, before = [0] * len(c), [0] * len(c)
    queue: deque[tuple[int, int, int]] = deque([(0, 0, 0)])  # f(i) + c_i, c_i, i; values ascend
    for j in range(1, len(c)):
        at = c[j]
        low = at - capacity
        while queue[0][1] < low:
            queue.popleft()
        value, _, i = queue[0]
        value += capacity - at
        for short in SHORT:
            if (k := index.get(at - short)) is not None and cost[k] < value:
                value, i = cost[k], k
        value += q[j] + WINDOW_COST
        cost[j], before[j] = value, i
        value += at
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, at, j))
    ends, j = [], len(c) - 1
    while j:
        ends.append(c[j])
        j = before[j]
    return ends[::-1]


class Packer:
    """Packs the documents of one partition as they come."""

    def __init__(self, path: str, capacity: int = CAPACITY) -> None:
        self.encoder, self.capacity = Encoder(path), capacity
        self.ending = self.encoder.sentence_ends()
        self.sequence = TaskContext.get().partitionId() << 32 if TaskContext.get() else 0
        self.open: list[tuple] = []  # (doc_id, start of the part, its ids as bytes, tokens of the document)
        self.held = 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        ids = self.encoder.ids(text or "") + b"\0\0\0\0"
        self.open.append((doc_id, 0, ids, len(ids) // 4))
        self.held += len(ids) // 4

    def pieces(self, last: bool) -> Iterator[tuple]:
        """Rows of the finished windows; the last window stays open unless ``last``."""
        if not self.open:
            return
        stream = np.frombuffer(b"".join(x[2] for x in self.open), "<u4")
        bounds = np.cumsum([len(x[2]) // 4 for x in self.open])
        sentence = np.flatnonzero(self.ending[stream]) + 1
        places, penalty = cut_places(len(stream), bounds, sentence)
        ends = best_cuts(places, penalty, self.capacity)
        if not last:
            ends = ends[:-1]
        at, k, rest = 0, 0, []
        first = 0  # where the current part begins in the stream
        for doc_id, start, ids, total in self.open:
            end = first + len(ids) // 4
            while at < end:
                if k == len(ends):
                    rest.append((doc_id, start + at - first, ids[4 * (at - first) :], total))
                    at = end
                    break
                begin = ends[k - 1] if k else 0
                stop = min(end, ends[k])
                part = ids[4 * (at - first) : 4 * (stop - first)]
                yield doc_id, start + at - first, stop - at, zlib.crc32(part), total, self.sequence, at - begin
                at = stop
                if at == ends[k]:
                    k += 1
                    self.sequence += 1
            first = end
        self.open, self.held = rest, sum(len(x[2]) // 4 for x in rest)


def _columns(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], schema=ARROW)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece of a document: where it begins, its length, and its place in a sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = None
        for batch in slices(batches, 500):
            packer = packer or Packer(tokenizer, capacity)
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                packer.add(doc_id, text)
            if packer.held >= HELD_TOKENS and (rows := list(packer.pieces(last=False))):
                yield _columns(rows)
        if packer and (rows := list(packer.pieces(last=True))):
            yield _columns(rows)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
