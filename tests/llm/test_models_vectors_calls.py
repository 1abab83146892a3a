"""Classifiers on held-out rows, vectors against brute force, tool calls, and the pipeline."""

from __future__ import annotations

import json
import os
import zlib

import numpy as np
import pytest

from llm import quality, toolcalls, toxicity, vectors
from llm.common import read
from llm.queries import TOOLS, QUERIES, tool_tables

DATA = "/root/testdata/sf0.01"


def auc(score, label):
    rank = np.argsort(np.argsort(score, kind="stable"), kind="stable") + 1
    p = label.sum()
    return (rank[label == 1].sum() - p * (p + 1) / 2) / (p * (len(label) - p))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name, column, least", [("op7_quality", "quality", 0.97), ("op8_toxicity", "toxic", 0.7)])
def test_classifiers_on_held_out_documents(spark, name, column, least):
    labels = {r.doc_id: r[column] for r in read(spark, DATA, "labels").collect()}
    rows = QUERIES[name](spark, DATA).collect()
    assert len(rows) == read(spark, DATA, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert auc(np.array([r.score for r in held]), np.array([labels[r.doc_id] for r in held])) >= least


@pytest.mark.parametrize("run", [toxicity.scored, quality.scored])
def test_classifiers_edge_cases(spark, run):
    docs = "doc_id long, text string, lang string, held_out string"
    texts = [(1, "fine words", "en", "x"), (1, "fine words", "en", "x"), (2, None, None, None), (3, "", "en", None), (None, " \n", None, None), (5, "long " * 50_000, "xx", None)]
    labels = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    got = run(spark, spark.createDataFrame(texts, docs), labels).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert run(spark, spark.createDataFrame([], docs), labels).collect() == []
    assert len(run(spark, spark.createDataFrame(texts, docs), labels.limit(0)).collect()) == 6


def test_a_long_text_is_scored_whole():
    rng = np.random.default_rng(1)
    model = toxicity.fit([], np.array([], int), [], np.array([], int))
    model.out[:] = 0.1
    for kernel in model.filters:
        kernel += rng.normal(0, 1, kernel.shape).astype(np.float32)
    cache = toxicity.Buckets()
    codes = cache.words(" ".join(f"w{i}" for i in range(20_000)).encode())
    best, _, _ = model.pooled(codes)
    assert abs(model.score(codes) - 1 / (1 + np.exp(-(best @ model.out + model.shift)))) < 1e-6


def test_network_learns_and_is_calibrated():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 2 * quality.DIM))
    y = (rng.random(3000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(int)
    net = quality.fit(x[:2500], y[:2500], np.arange(2500) % 5 == 0)
    p = net.probabilities(x[2500:])
    assert auc(p, y[2500:]) > 0.8 and abs(p.mean() - y[2500:].mean()) < 0.06


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for label in (0, 1, None):
        for c in rng.normal(size=(12, 16)):
            rows += [(label, (c * rng.uniform(0.1, 5) + rng.normal(0, 0.12, 16)).astype(np.float32).tolist()) for _ in range(6)]
    rows += [rows[0], rows[0], (0, None), (0, []), (0, [0.0] * 16), (0, [float("nan")] * 16), (1, [float("inf")] * 16), (1, [None] * 16), (1, [1.0] * 8), (1, [1.0] * 8), (0, [1e-38] * 16), (0, [1e-38] * 16)]
    table = [(i, v, label, "x") for i, (label, v) in enumerate(rows)] + [(None, rows[0][1], 0, "x")]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(spark, spark.createDataFrame(table, "vec_id long, embedding array<float>, label int, print string")).collect()}
    good = {}
    for i, v, label, _ in table[:-1]:
        if label is not None and v and None not in v and np.isfinite(v).all() and np.any(v):
            a = np.array(v, np.float32).astype(float)
            a /= np.abs(a).max()
            good[i] = (label, a / np.linalg.norm(a))
    links = {i: [j for j in good if j != i and good[j][0] == good[i][0] and len(good[i][1]) == len(good[j][1]) and good[i][1] @ good[j][1] >= 0.93] for i in good}
    component = {i: i for i in range(len(rows))}
    for _ in range(len(rows)):
        for i, js in links.items():
            component[i] = min([component[i], *(component[j] for j in js)])
    assert {i: x for i, x in got.items() if i is not None} == {i: (len(links.get(i, [])), component[i], component[i] == i) for i in range(len(rows))}
    assert got[None] == (0, None, True) and any(links.values())


def test_vectors_in_chunks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    table = spark.createDataFrame([(i, (np.ones(8) + rng.normal(0, 0.3, 8)).tolist(), 1) for i in range(90)], "vec_id long, embedding array<double>, label int")
    whole = sorted(vectors.near_duplicates(spark, table).collect())
    monkeypatch.setattr(vectors, "CHUNK", 7)
    assert sorted(vectors.near_duplicates(spark, table).collect()) == whole
    assert vectors.near_duplicates(spark, table.limit(0)).collect() == []


CALLS = "conv_id long, call_id string, position long, name string, arguments string, depends_on array<string>"
RESULTS = "conv_id long, call_id string, position long, content string"
SCHEMAS = {"add": {"a": "integer", "b": "number", "note": "string?"}, "list": {"of": "array"}}


def test_tool_calls(spark):
    calls = [
        (1, "a", 5, "add", '{"b": 1.5, "a": 2}', None),
        (1, "b", 4, "add", '{"a": "2", "c": 1, "note": null}', ["a"]),
        (1, "c", 3, "list", '{"of":[3, {"z":1,"y":"\\u00e9"}]}', ["b", "zz", "c", None]),
        (1, "d", 9, "list", "no json", ["a"]),
        (1, "e", 1, "none", "{}", []),
        (2, "a", 1, "add", None, ["a"]),
        (2, "x", 2, "add", "{}", ["y"]),
        (2, "y", 3, "add", "{}", ["x"]),
        (2, "z", 4, "add", "{}", ["y"]),
        (1, "a", 6, "add", '{"a": 0, "b": 0}', None),
        (None, "a", 1, "add", "{}", None),
    ]
    results = [(1, "a", 7, "three"), (1, "a", 8, "later"), (1, "q", 7, "orphan"), (2, "x", 9, None)]
    c, r = spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS)
    got = {(x.conv_id, x.call_id): x for x in toolcalls.link(spark, c, r, SCHEMAS).collect()}
    assert len(got) == 9
    assert got[1, "a"].canonical == '{"arguments":{"a":2,"b":1.5},"id":"a","name":"add","result":"three"}' and got[1, "a"].n_results == 2 and got[1, "a"].errors == []
    assert got[1, "b"].errors == ["type a", "missing b", "unknown c"]
    assert json.loads(got[1, "c"].canonical)["arguments"] == {"of": [3, {"y": "é", "z": 1}]} and got[1, "c"].errors == []
    assert got[1, "d"].errors == ["arguments"] and got[1, "e"].errors == ["tool"] and got[2, "a"].errors == ["arguments"]
    line = sorted((k for k in got if k[0] == 1), key=lambda k: (got[k].place, got[k].step, got[k].position, k[1]))
    assert [k[1] for k in line] == ["e", "a", "b", "c", "d"]
    assert [got[2, k].place for k in "xyz"] == [None] * 3 and got[2, "a"].place == 1
    assert [x.call_id for x in toolcalls.orphans(c, r).collect()] == ["q"]
    assert toolcalls.link(spark, c.limit(0), r.limit(0), SCHEMAS).collect() == []


def plain_places(nodes):
    """(place, step) of every call once all it depends on have theirs; None on or behind a cycle."""
    out, left = {}, {k: {d for d in uses if d in nodes and d != k} for k, (_, uses) in nodes.items()}
    while ready := [k for k, uses in left.items() if uses <= out.keys()]:
        for k in ready:
            out[k] = max([(nodes[k][0], 0)] + [(out[d][0], out[d][1] + 1) for d in left.pop(k)])
    return {k: out.get(k) for k in nodes}


def test_tool_call_order_equals_brute_force(spark):
    rng, rows, want = np.random.default_rng(11), [], {}
    for conv in range(120):
        n = int(rng.integers(1, 14))
        ids = [f"k{i}" for i in rng.permutation(n)]
        nodes = {}
        for i, k in enumerate(ids):
            pool = ids[:i] if conv % 3 else ids  # a third may hold cycles
            uses = [str(x) for x in rng.choice(pool, min(len(pool), int(rng.integers(0, 3))))] if pool else []
            nodes[k] = (int(rng.integers(0, 9)), uses)
        want |= {(conv, k): place for k, place in plain_places(nodes).items()}
        rows += [(conv, k, pos, "add", "{}", uses) for k, (pos, uses) in nodes.items()]
    got = toolcalls.order(spark, spark.createDataFrame(rows, CALLS)).collect()
    assert {(r.conv_id, r.call_id): None if r.place is None else (r.place, r.step) for r in got} == want
    assert None in want.values() and max(x[1] for x in want.values() if x) > 2


def test_long_chains_settle_in_few_rounds(spark, monkeypatch):
    rounds = []
    cut = toolcalls.cut
    monkeypatch.setattr(toolcalls, "cut", lambda s, d, name: rounds.append(name) or cut(s, d, name))
    rows = [(1, f"k{i}", -i, "add", "{}", [f"k{i - 1}"]) for i in range(1000)] + [(2, f"k{i}", i, "add", "{}", [f"k{i - 1}"]) for i in range(1000)]
    got = {(r.conv_id, r.call_id): (r.place, r.step) for r in toolcalls.order(spark, spark.createDataFrame(rows, CALLS)).collect()}
    assert got == {(1, f"k{i}"): (0, i) for i in range(1000)} | {(2, f"k{i}"): (i, 0) for i in range(1000)}
    assert rounds.count("seen") <= 12


def test_tool_calls_stay_native(spark):
    plan = toolcalls.link(spark, *tool_tables(read(spark, DATA, "conversations")), TOOLS)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_pipeline_stages(spark):
    import corpus_pipeline as pipeline
    from llm import decontamination, pii

    docs = read(spark, "/root/testdata/sf0.001", "documents")
    sf_dir, seen = "/root/testdata/sf0.001", {}
    for name, stage in pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf_dir)
        assert after.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        after = spark.createDataFrame(after.collect(), docs.schema)
        seen[name] = (docs, after)
        docs = after
    items = [decontamination.normal(r.text) for r in read(spark, sf_dir, "benchmark").collect()]
    before, after = ({r.doc_id: r.text for r in x.collect()} for x in seen["decontamination"])
    assert {i for i, t in before.items() if any(s in decontamination.normal(t) for s in items)} <= set(before) - set(after)
    before, after = ({r.doc_id: r.text for r in x.collect()} for x in seen["pii"])
    assert before.keys() == after.keys()
    finder = pii.Finder()
    assert all(after[i] == pii.masked(t, finder.spans(t)) for i, t in before.items())
    packed = pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r.doc_id for r in packed.collect()} == set(after)
    labels = {r.doc_id: r.toxic for r in read(spark, sf_dir, "labels").collect()}
    before, after = ({r.doc_id for r in x.collect()} for x in seen["toxicity"])
    clean = [i for i in before if labels.get(i) == 0]
    assert sum(i in after for i in clean) >= 0.8 * len(clean)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_pipeline_keeps_a_column_named_like_the_score(spark):
    import corpus_pipeline as pipeline

    sf_dir = "/root/testdata/sf0.001"
    docs = read(spark, sf_dir, "documents")
    want = {r.doc_id for r in pipeline.drop_toxic(spark, docs, sf_dir).collect()}
    extra = docs.selectExpr("*", "doc_id * 2 as toxic_score", "'x' as Toxic_Score_")
    got = pipeline.drop_toxic(spark, extra, sf_dir)
    assert got.columns == extra.columns
    assert {r.doc_id: r.toxic_score for r in got.collect()} == {i: 2 * i for i in want}
