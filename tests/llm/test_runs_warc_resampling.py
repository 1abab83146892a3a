"""Runs of words, the WARC archive and importance resampling against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gradelens.session import fresh_path
from llm import common, queries, resampling, runs, warc
from workload.check import connect, difference

DOCS = "doc_id long, text string, lang string, runs int, start string, score int, digest string"
PAGES = "page_id long, url string, html string, digest string, n int"


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", 1, "x", 2, "y") for i, t in texts], DOCS)


def brute_runs(words, least=6, exponent=4):
    found = {}
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(least, exponent * q):
                found.setdefault((start, i - start + q), q)
            i += i == start
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def repeating(rng, n, k):
    words = [b"%d" % rng.randrange(k) for _ in range(n)]
    for _ in range(rng.randrange(4) if n else 0):
        a = rng.randrange(n)
        p, end = rng.randrange(1, 1 + max(1, (n - a) // 3)), rng.randrange(a, n + 1)
        for i in range(a, end):
            words[i] = words[a + (i - a) % p]
    return words


def test_runs_equal_brute_force_however_words_arrive():
    rng, powers = random.Random(5), runs.Powers()
    for _ in range(600):
        words = repeating(rng, rng.randrange(100), rng.choice([1, 2, 3, 9]))
        for step in (1, 3, 17, 1000):
            assert runs.runs_of(words, powers, step=step) == brute_runs(words), (words, step)
        assert runs.runs_of(words, powers, 1, 3, step=5) == brute_runs(words, 1, 3), words
    with pytest.raises(ValueError):
        runs.Catchers(powers, exponent=2)


def test_runs_do_not_rest_on_hashes(monkeypatch):
    """Where every window seems equal to every other, exact words still decide."""
    monkeypatch.setattr(runs, "mix", lambda ids: ids * 0)
    rng, powers = random.Random(6), runs.Powers()
    for _ in range(100):
        words = repeating(rng, rng.randrange(70), rng.choice([1, 2, 3]))
        assert set(runs.runs_of(words, powers)) <= set(brute_runs(words))


def test_runs_of_very_long_texts_take_time_in_proportion():
    powers, n = runs.Powers(), 199_920
    texts = [[b"a"] * n, [b"a", b"b", b"c"] * (n // 3), [b"%d" % (i // 7) for i in range(n)], [b"%d" % (i % 977) for i in range(n)], ([b"a"] * 6 + [b"b"]) * (n // 7)]
    start = time.time()
    counts = [len(runs.runs_of(words, powers)) for words in texts]
    assert counts == [1, 1, n // 7, 1, n // 7 + 1] and time.time() - start < 40


def test_collapse_keeps_the_first_period(spark):
    texts = [(0, "a b c " * 5 + "d"), (1, None), (2, ""), (3, " \n\t"), (None, "x " * 9), (3, "x x x x x"), (4, "x x " * 7), (5, "p q " * 3 + "p")]
    got = [(r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in runs.collapse(documents(spark, texts)).collect()]
    want = [
        (0, [(0, 15, 3)], "a b c d"), (1, [], ""), (2, [], ""), (3, [], ""), (None, [(0, 9, 1)], "x"),
        (3, [], "x x x x x"), (4, [(0, 7, 1)], "x x"), (5, [], "p q p q p q p"),
    ]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert runs.collapse(documents(spark, []).limit(0)).collect() == []


def test_runs_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(7)
    texts = [(i, b" ".join(repeating(rng, rng.randrange(160), 3)).decode()) for i in range(120)]
    documents(spark, [*texts, (120, None), (121, "")]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op11_runs(spark, str(tmp_path)).collect()}
    for i, text in [*texts, (120, None), (121, "")]:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str(i).encode()), len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[j if j < a else a + (j - a) % p] for j in range(n)]
        found = brute_runs(words)
        gone = {j for s, m, q in found for j in range(s + q, s + m)}
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        first = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
        r = got[i]
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(found), *first)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(w for j, w in enumerate(words) if j not in gone).encode()).hexdigest()


@pytest.mark.parametrize("name", ["op11_runs", "op12_warc", "op13_resampling"])
def test_queries_equal_their_sql(spark, small, name):
    assert difference(spark, connect(small), name, small) is None


@pytest.fixture(scope="module")
def pages(spark):
    long, longer = "é" * 50, "x" * 99
    rows = [
        (9, "http://a/9", long), (4, "http://a/ 4\r\nWARC-Type: bad\r\n", long), (4, "http://b/4", long), (7, None, long), (None, "http://n/", long),
        (1, "u", longer), (2, "u", longer), (3, "u", None), (5, "u", ""), (-6, "u", "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n" + "y" * 90),
        (None, "u", "z" * 200), (None, "u", "z" * 200), *((100 + i, f"http://c/{i}", "copy " * 40) for i in range(400)),
    ]
    return spark.createDataFrame([(*r, "mine", 3) for r in rows], PAGES), rows


def test_archive_gives_back_what_was_written(spark, pages):
    table, rows = pages
    path = fresh_path(spark, "archive")
    warc.write(spark, table, path)
    least = {}
    for page_id, _, html in rows:
        if page_id is not None:
            least[html or ""] = min(page_id, least.get(html or "", page_id))
    want = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        again = page_id is not None and len(data) >= 100 and page_id > least[html]
        want.append((page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", least[html] if again else None))
    got = [tuple(r) for r in warc.read(spark, path).collect()]
    assert Counter(got) == Counter(want) and sum(r[3] == "revisit" for r in want) == 401
    stored = [bytes(r.payload) for r in spark.read.parquet(f"{path}/payloads").collect()]
    assert sorted(stored) == sorted({(html or "").encode() for _, _, html in rows})
    whole = Counter((r.page_id, bytes(r.payload)) for r in warc.read_records(spark, path, originals=True).collect())
    assert whole == Counter((page_id, (html or "").encode()) for page_id, _, html in rows)
    out = fresh_path(spark, "files")
    warc.export(spark, path, out, records_a_file=50)
    read = Counter((bytes(r.header), bytes(r.payload)) for r in warc.import_files(spark, out).collect())
    assert read == Counter((bytes(r.header), bytes(r.payload)) for r in warc.read_records(spark, path).collect())
    header = next(h for h, _ in read if b"urn:page:4>" in h and b"%0D%0A" in h)
    assert header.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and b"WARC-Target-URI: http://a/%204%0D%0AWARC-Type:%20bad%0D%0A\r\n" in header


def test_archive_refuses_a_changed_or_lost_payload(spark, pages):
    path = fresh_path(spark, "archive")
    warc.write(spark, pages[0].where("page_id in (1, 9)"), path)
    stored = spark.read.parquet(f"{path}/payloads")
    for change in (stored.withColumn("payload", F.concat("payload", F.lit("!").cast("binary"))), stored.limit(1)):
        other = fresh_path(spark, "archive")
        spark.read.parquet(f"{path}/records").write.parquet(f"{other}/records")
        change.write.parquet(f"{other}/payloads")
        with pytest.raises(PySparkException):
            warc.read(spark, other).collect()
    with pytest.raises(ValueError):
        list(warc.split_records(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort\r\n\r\n"))


def test_archive_of_no_pages(spark, pages):
    path = fresh_path(spark, "archive")
    warc.write(spark, pages[0].limit(0), path)
    assert warc.read(spark, path).collect() == [] and warc.read_records(spark, path).collect() == []


def test_salted_join_splits_hot_keys(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    classes = common.cut(spark, rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("low")), "classes")
    joined = common.salted(rows, classes, "k")
    assert joined.count() == 3000 and joined.where("k = 0 and low = 0").count() == 1000
    assert common.salted(rows.limit(0), classes.limit(0), "k").collect() == []


def test_crcs_of_all_lengths():
    rng = random.Random(8)
    features = [rng.randbytes(rng.choice([0, 1, 2, 3, 9, 60, 1024, 1025, 5000])) for _ in range(400)]
    assert resampling.crc32s(features).tolist() == [zlib.crc32(x) for x in features]
    assert resampling.crc32s([]).tolist() == []


def brute_resample(docs, target, order, buckets, seed, least_words, percent):
    def features(text):
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        grams = [" ".join(words[i : i + k]) for k in range(1, order + 1) for i in range(len(words) - k + 1)]
        return len(words), [zlib.crc32(g.encode()) % buckets for g in grams]

    mine = [features(t) for _, t in docs]
    s, t = Counter(b for _, f in mine for b in f), Counter(b for x in target for b in features(x)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    rows = []
    for (doc_id, _), (n, found) in zip(docs, mine):
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, found))
        rows.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n])
    ready = sorted((r for r in rows if r[5] >= least_words), key=lambda r: (-r[3], r[0] is None, r[0]))
    for rank, row in enumerate(ready[: len(ready) * percent // 100], 1):
        row[4] = rank
    return Counter(tuple(r[:5]) for r in rows)


@pytest.mark.parametrize("order,least,percent", [(1, 20, 10), (2, 3, 50), (3, 0, 100)])
def test_resampling_equals_brute_force(spark, order, least, percent):
    rng = random.Random(9)
    vocabulary = [f"W{i}é" if i % 3 else f"w{i}" for i in range(300)] + ["don't", "x" * 70, "y" * 2000, " ", "ÀB"]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60)))) for i in range(200)]
    docs += [(7, docs[7][1]), (8, "other " * 30), (None, "w1 " * 25), (300, None), (301, ""), (302, "w1 w2 " * 9000)]
    target = [" ".join(rng.choice(vocabulary[:40]) for _ in range(30)) for _ in range(20)] + [None]
    items = spark.createDataFrame([(x,) for x in target], "text string")
    got = resampling.resample(spark, documents(spark, docs).repartition(7), items, order, 1000, 11, least, percent)
    assert Counter(map(tuple, got.collect())) == brute_resample(docs, target, order, 1000, 11, least, percent)
    assert resampling.resample(spark, documents(spark, []), items.limit(0)).collect() == []
