"""License scans by conditional compression.

The words around a cue, as many each side as the longest template can cover, are candidate
blocks, joined where they meet. Cues come from the templates: a place must agree with so many of a
template's words that it holds one of any quarter of them and one more; of these the least common
are looked for, all at once, by an Aho-Corasick automaton, so nothing that could be confirmed is
passed over. Line ends and marks of comments count as blanks. Each template is
aligned with a block's words, and every place whose exact differences stay within bounds is a
candidate. Its words are compressed by themselves and with the template as a zstandard raw
dictionary. The bytes that a template saves rank the candidates, and those kept do not overlap: a
block reports all its notices, whatever prose surrounds them. Templates are notices people put on
works; the list is a parameter.

Cases: null and empty texts, and texts without a cue, have no rows. The
length of lines does not matter. Equal documents give equal rows; a null doc_id is
kept. Ties in bytes
saved go to the higher share of agreed words, then to the template that is named first. Other columns are not read. Rows are
independent: nothing is shuffled, and a task holds one batch of texts.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Mapping
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from llm.common import lowered, slices

# Notices by which works are put under public licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
    "BSD-clauses": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "Released under CC0 1.0 Universal.",
    "All-rights-reserved": "All rights reserved.",
}
# Words that are common in any English text, and are cues only where nothing else is left.
COMMON = frozenset("a all and any are as at be by charge conditions either file following for free from general hereby if in including is it may modify not obtain of on or other person program provided published public redistribute source subject terms that the this to under use version with without work you your".split())
WORD = re.compile(r"[\w+-]+(?:\.\d+)*")
#: Characters that are cut at first in search of the words before a cue.
REACH = 400
#: Least share of the bytes it could save that a template must save, and of words that must agree both ways.
SAVED, AGREED = 0.2, 0.75


def words(text: str) -> list[tuple[str, int, int]]:
    return [(m[0].lower(), m.start(), m.end()) for m in WORD.finditer(text)]


def cues_of(wanted: list[str]) -> set[str]:
    """Words of a template of which every place that can be confirmed holds at least one."""
    needed = len(wanted) - math.ceil(AGREED * len(wanted)) + 1
    times = Counter(wanted)
    out: set[str] = set()
    for word in sorted(times, key=lambda w: (w in COMMON, -len(w), w)):
        if needed <= 0:
            break
        out.add(word)
        needed -= times[word]
    return out


def blocks(text: str, hits: list[tuple[int, int]], reach: int) -> list[tuple[int, int]]:
    """Places of candidate blocks: ``reach`` words each side of a cue across line ends, joined where they meet."""
    out: list[tuple[int, int]] = []
    for begin, end in hits:
        for x in islice(WORD.finditer(text, end), reach + 1):
            end = x.end()
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
            continue
        low, size = 0, REACH
        while True:
            low = max(0, begin - size)
            before = [x.start() for x in WORD.finditer(text, low, begin)]
            if low == 0 or len(before) > reach + 1:
                break
            size *= 2
        # a first word may be cut, unless the text begins there
        start = before[-reach - 1] if len(before) > reach + 1 else low
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


class Scanner:
    def __init__(self, templates: Mapping[str, str] = TEMPLATES, level: int = 3) -> None:
        self.plain = zstandard.ZstdCompressor(level=level, write_content_size=False)
        self.number: dict[str, int] = {}  # words of the templates, from 1; other words are 0
        self.templates = []
        for name, text in templates.items():
            wanted = [w for w, _, _ in words(text)]
            if not wanted:
                continue
            low = " ".join(wanted).encode()
            data = zstandard.ZstdCompressionDict(low, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            given = zstandard.ZstdCompressor(level=level, dict_data=data, write_content_size=False)
            most = len(self.plain.compress(low)) - len(given.compress(low))
            self.templates.append((name, [self.number.setdefault(w, len(self.number) + 1) for w in wanted], given, most))
        self.counts = np.zeros((len(self.templates), len(self.number) + 1), np.int64)
        for i, (_, wanted, _, _) in enumerate(self.templates):
            np.add.at(self.counts[i], wanted, 1)
        self.least = AGREED * self.counts.sum(axis=1)
        self.reach = math.ceil(self.counts.sum(axis=1).max(initial=0) / AGREED)
        self.machine = ahocorasick.Automaton()
        for cue in set().union(*(cues_of([w for w, _, _ in words(text)]) for text in templates.values())):
            self.machine.add_word(cue, len(cue))
        self.machine.make_automaton()

    def cues(self, text: str) -> list[tuple[int, int]]:
        """Where cues stand as words or at the beginning of one, in order."""
        low = lowered(text)
        if not len(self.machine):
            return []
        found = ((at + 1 - length, at + 1) for at, length in self.machine.iter(low))
        return [(a, b) for a, b in found if not (a and (low[a - 1].isalnum() or low[a - 1] in "_+-")) and not low[b : b + 1].isalpha()]

    def scan(self, text: str) -> list[tuple]:
        """(start, end, template, plain size, size given the template, words added, missing, agreed share)."""
        out = []
        for start, end in blocks(text, self.cues(text), self.reach):
            found = np.array([(self.number.get(m[0].lower(), 0), m.start(), m.end()) for m in WORD.finditer(text, start, end)], np.int64).reshape(-1, 3)
            ids = found[:, 0]
            have = np.minimum(self.counts, np.bincount(ids, minlength=len(self.number) + 1)).sum(axis=1)
            hits = []
            for i in np.flatnonzero(have >= self.least):
                name, wanted, given, most = self.templates[i]
                for a, b, added, missing, share in places(ids, wanted):
                    left, right = int(found[a, 1]), int(found[b - 1, 2])
                    data = " ".join(w for w, _, _ in words(text[left:right])).encode()
                    size, less = len(self.plain.compress(data)), len(given.compress(data))
                    if size - less >= SAVED * most:
                        hits.append((less - size, -share, i, left, right, name, size, less, added, missing, share))
            kept, taken = [], Taken()
            for _, _, _, left, right, *rest in sorted(hits):
                if taken.take(left, right):
                    kept.append((left, right, *rest))
            out += sorted(kept)
        return out


class Taken:
    """Spans that do not overlap, in order."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def before(self, place: int) -> int:
        """Where the last span that begins before a place ends."""
        i = bisect_left(self.starts, place)
        return self.ends[i - 1] if i else 0

    def take(self, start: int, end: int) -> bool:
        """Add a span, unless it overlaps one."""
        i = bisect_left(self.starts, end)
        if i and self.ends[i - 1] > start:
            return False
        self.starts.insert(i, start)
        self.ends.insert(i, end)
        return True


def places(ids: np.ndarray, wanted: list[int]) -> list[tuple[int, int, int, int, float]]:
    """Where a block holds a template: places that do not overlap, best first, with their differences.

    (first word, behind the last word, words added, words missing, agreed share). A template is
    aligned with any part of the block at the least number of words added and missing, and at the
    least number missing among these.
    """
    cost = len(wanted) + 1  # of a word added; a missing word costs one more
    row, steps = np.zeros(len(ids) + 1, np.int64), np.arange(len(ids) + 1) * cost
    for word in wanted:
        new = row + cost + 1
        new[1:] = np.where(ids == word, row[:-1], new[1:])
        row = np.minimum.accumulate(new - steps) + steps
    bound = len(wanted) * (1 / AGREED - AGREED)
    ends = 1 + np.flatnonzero((row[1:] // cost <= bound) & (row[1:] < row[:-1] + cost))
    out: list[tuple[int, int, int, int, float]] = []
    taken = Taken()
    for end in ends[np.argsort(row[ends], kind="stable")].tolist():
        last = taken.before(end)
        if last >= end:
            continue
        low = max(0, end - math.ceil(len(wanted) / AGREED), last)
        pairs = _agreed(ids[low:end].tolist(), wanted)
        if not pairs:
            continue
        agreed, a, b = len(pairs), low + pairs[0], low + pairs[-1] + 1
        missing, added = len(wanted) - agreed, b - a - agreed
        if agreed >= AGREED * len(wanted) and agreed >= AGREED * (b - a):
            out.append((a, b, added, missing, agreed / (agreed + added + missing)))
            taken.take(a, b)
    return out


def _agreed(found: list[int], wanted: list[int]) -> list[int]:
    """Words that agree when the template is aligned with a part of ``found`` that ends at its end."""
    cost = len(wanted) + 1
    table = [[0] * (len(found) + 1)]
    for i, word in enumerate(wanted):
        above, row = table[i], [(i + 1) * (cost + 1)]
        for j, x in enumerate(found):
            row.append(above[j] if x == word else min(above[j + 1] + cost + 1, row[j] + cost))
        table.append(row)
    i, j, out = len(wanted), len(found), []
    while i and j:
        if found[j - 1] == wanted[i - 1]:
            i, j = i - 1, j - 1
            out.append(j)
        elif table[i - 1][j] + cost + 1 == table[i][j]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES) -> DataFrame:
    """One row for each place of a document that a template confirms; places are code points."""
    schema = "doc_id long, start long, end long, template string, plain_bytes long, given_bytes long, words_added long, words_missing long, agreed double"
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 4, pa.float64()]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in slices(batches, 1000):
            rows = [(doc_id, *hit) for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if text for hit in scanner.scan(text)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
