"""The whole pipeline on planted documents, against every stage done plainly, in both directions."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from llm import decontamination, minhash, pii, toxicity
from llm.common import read
from llm.queries import tokenizer_path
from tests.llm.test_text_operators import DOCS, edit_distance, split

pipeline = pytest.importorskip("corpus_pipeline")


def components(texts):
    """Smallest id reachable over links of at least 80 % common five-word shingles."""
    sets = {}
    for i, t in texts.items():
        words = split((t or "").lower())
        sets[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())
    low = {i: i for i in sets}
    links = [(i, j) for i in sets for j in sets if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    for _ in sets:
        for i, j in links:
            low[i] = low[j] = min(low[i], low[j])
    return low


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = random.Random(12)
    folder = str(tmp_path_factory.mktemp("planted"))
    plain = [f"{a}{b}{c}" for a in "bdfglmnprst" for b in "aeiou" for c in ("r", "n", "l", "k", "")]
    foul = [f"zz{x}ork" for x in "aeiou"]
    word = lambda n: [rng.choice(plain) for _ in range(n)]
    items = [" ".join(word(rng.choice([15, 30]))) for _ in range(5)]
    rows, labels = [], []
    for i in range(420):
        words = word(rng.choice([8, 40, 90]))
        bad = i % 6 == 5
        if bad:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(foul)
        rows.append((i, " ".join(words)))
        if i % 2 or i < 300:
            labels.append((i, 0, int(bad)))
    body = word(80)
    near = [list(body) for _ in range(4)]
    for k, copy in enumerate(near):
        copy[10 * k + 3] = "changed"
    changed = list(items[1])
    changed[5:6] = []
    rows += [(500 + k, " ".join(copy)) for k, copy in enumerate(near)] + [(510, " ".join(body)), (511, " ".join(body))]
    rows += [(520, "before " + items[0].upper() + " after " + " ".join(word(20))), (521, " ".join(word(5)) + " " + "".join(changed) + " end"), (522, items[2][: len(items[2]) // 2])]
    rows += [(530, "write to jane.doe@example.com or +1 (555) 010-9999 " + " ".join(word(20))), (531, "host 10.0.0.1 and card 4111 1111 1111 1111 " + " ".join(word(9)))]
    rows += [(540, ""), (541, None), (542, " ".join(word(4000))), (543, "zzaork " * 30)]
    spark.createDataFrame([(i, t, "en" if i % 2 else "fr", "s", 0) for i, t in rows], DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, dict(rows), items


def test_run_equals_every_stage_done_plainly(spark, planted):
    folder, texts, items = planted
    got = pipeline.run(spark, folder).collect()
    # toxicity: the model that run() fits, applied here document by document
    model = toxicity.train(spark, read(spark, folder, "documents"), read(spark, folder, "labels"))
    bound = lambda i: model.thresholds.get("en" if i % 2 else "fr", model.thresholds[None])
    left = {i: t for i, t in texts.items() if model.score(toxicity.Buckets().words((t or "").encode())) < bound(i)}
    foul = {i for i, t in texts.items() if "zz" in (t or "")}
    assert len(foul - set(left)) >= 0.9 * len(foul) and len(set(texts) - foul - set(left)) <= 0.05 * len(texts)
    # near copies: one of each group stays
    low = components(left)
    gone = {i for i in left if low[i] != i}
    assert gone >= {501, 502, 503, 510, 511} & set(left)
    left = {i: t for i, t in left.items() if i not in gone}
    # benchmark passages within the edit budget
    hit = set()
    for i, t in left.items():
        text = decontamination.normal(t or "")
        for item in map(decontamination.normal, items):
            if edit_distance(item, text) <= int(len(item) * decontamination.RATE):
                hit.add(i)
    assert {520, 521} <= hit and 522 not in hit
    left = {i: t for i, t in left.items() if i not in hit}
    # personal data masked, everything packed once
    finder = pii.Finder()
    left = {i: t and pii.masked(t, finder.spans(t)) for i, t in left.items()}
    assert "[EMAIL]" in left[530] and "[PHONE]" in left[530] and "[IP]" in left[531] and "[CARD]" in left[531]
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = {}
    pieces = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == set(left)
    for i, t in left.items():
        want[i] = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(want[i][at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(want[i])


def test_stages_are_named_and_of_no_documents(spark, planted, tmp_path):
    folder, *_ = planted
    assert [name for name, _ in pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "pii", "packing"]
    for name in ("documents", "labels", "benchmark"):
        read(spark, folder, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).collect() == [] and minhash.BANDS
