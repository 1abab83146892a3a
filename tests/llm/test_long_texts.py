"""Texts that repeat one cue for a megabyte, templates without usual words, and long labelled texts."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest

from llm import labelled, licenses, pii, toxicity
from llm.quality import Tokens

UNITS = ["http://", "secret_", "secret", "account", "account.", "token=", "password", "http://a@", "iban", "api_key-", "secret_x/", "accountx."]


def within(seconds, work):
    start = time.time()
    out = work()
    assert time.time() - start < seconds
    return out


@pytest.mark.parametrize("unit", UNITS)
def test_repeated_anchors_take_time_in_proportion(unit):
    text = unit * (1_000_000 // len(unit))
    assert within(5, lambda: pii.Finder().spans(text)) == []
    tail = " account: DE89 3704 0044 0532 0130 00"
    assert pii.Finder().spans(text + tail)[-1][1:] == (6, len(text + tail))


def test_skipping_barren_runs_changes_nothing(monkeypatch):
    rng = random.Random(1)
    bits = [*UNITS, "_", "konto", "1", "234", "abc", " ", ": ", "=", '"', "'", "-", ".", "x" * 70, "y_" * 40, "DE89370400440532013000", "nummer", "number", "~", "\n", "12345678", "a.b", "/"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 14))) for _ in range(6000)]
    quick = [pii.Finder().spans(t) for t in texts]
    monkeypatch.setattr(pii, "BARREN", 10**9)
    assert [pii.Finder().spans(t) for t in texts] == quick and any(kind == 6 for spans in quick for _, kind, _ in spans)


@pytest.mark.parametrize("unit", ["All rights reserved. ", "Released under the MIT License. "])
def test_repeated_notices_take_time_in_proportion(unit):
    found = within(15, lambda: licenses.Scanner().scan(unit * (1_000_000 // len(unit))))
    assert len(found) == 1_000_000 // len(unit)


def test_templates_need_no_usual_words():
    scan = licenses.Scanner({"X": "This is free to use by anyone for any purpose whatsoever"}).scan
    assert [x[2] for x in scan("abc. This is free to use by anyone for any purpose whatsoever, xyz")] == ["X"]
    assert [x[2] for x in scan("This is free to use by everyone for any purpose")] == ["X"]
    assert licenses.Scanner({}).scan("All rights reserved.") == []


def test_cues_pass_over_nothing_that_could_be_confirmed(monkeypatch):
    """Whole texts as blocks give the same places as blocks around cues."""
    rng = random.Random(2)
    names = sorted(licenses.TEMPLATES)
    texts = []
    for _ in range(150):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            parts += [f"v{rng.randrange(999)}" for _ in range(rng.choice([0, 5, 200]))]
            words = licenses.TEMPLATES[rng.choice(names)].split()
            for _ in range(rng.randrange(len(words) // 4 + 1)):
                words[rng.randrange(len(words))] = f"u{rng.randrange(99)}"
            parts += words
        texts.append(" ".join(parts))
    scanner = licenses.Scanner()
    around = [[x[:3] for x in scanner.scan(t)] for t in texts]
    monkeypatch.setattr(licenses, "blocks", lambda text, hits, reach: [(0, len(text))])
    whole = [[x[:3] for x in scanner.scan(t)] for t in texts]
    assert around == whole and sum(map(len, whole)) > 100


def test_long_labelled_texts_are_fitted_on(spark):
    long = " ".join(f"w{i % 7000}" for i in range(30_000))
    docs = spark.createDataFrame([(1, long, "en"), (2, "short", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in (1, 2)], "doc_id long, quality int")
    rows = labelled.fitting_rows(docs, labels, "quality").collect()
    assert {r.doc_id for r in rows} == {i for i in (1, 2) if __import__("zlib").crc32(str(i).encode()) % 5}
    codes = toxicity.Buckets().words(long.encode())
    kept = toxicity.digest(codes)
    assert set((codes >> 32).tolist()) == set((kept >> 32).tolist()) and len(kept) <= 3 * 7000
    assert np.array_equal(toxicity.digest(codes[:100]), codes[:100])
    # a word that stands once near the end of a long text still wins a maximum
    late = long + " needle"
    assert toxicity.Buckets().words(b"needle")[0] in toxicity.digest(toxicity.Buckets().words(late.encode()))
    assert len(Tokens().tokens(long.encode())) > 8000
