"""Sources, prompts, results, running totals, model calls and streams on small tables."""

import hashlib
import json
import os
import random
from functools import partial
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from gradelens import schemas, session, values as v
from gradelens.operators import fanout, inference, joins, prompts, results as rs, rows, running, scoring
from gradelens.operators.rejects import Rejects
from gradelens.plans import evaluate as ev
from gradelens.plans import run as grid
from gradelens.sources import results as stored_results
from gradelens.sources import tables as stored
from gradelens.streaming import gold, scores as streams, store
from tests.test_choices import START, answer, example, table
from workload import tables as t


def test_array_file_gives_places_as_ids(spark, tmp_path):
    fields = [{k: x for k, x in example(i, old=f" o{i}").items() if k != "example_id"} for i in range(5)]
    del fields[2]["summary"]
    path = tmp_path / "examples.json"
    path.write_text(json.dumps(fields), encoding="utf-8")
    got = stored.read_examples(spark, str(path), array_file=True)
    assert got.schema.simpleString() == schemas.EXAMPLES.simpleString()
    assert [(r.example_id, r.old) for r in got.orderBy("example_id").collect()] == [
        (i, f" o{i}") for i in range(5)
    ]


@pytest.mark.parametrize("form", ["parquet", "json"])
def test_enriched_examples_come_back(spark, tmp_path, form):
    examples = table(spark, example(1, summary="x"), example(2))
    path = str(tmp_path / form)
    stored.write_enriched(examples, path, form)
    back = spark.read.parquet(path) if form == "parquet" else stored.read_examples(spark, path)
    assert sorted(back.collect()) == sorted(examples.collect())


def test_slots_in_values_are_left_alone(spark):
    asked = prompts.refine_prompt(table(spark, example(1, summary="{code_review}")), "Java")
    got = {r.condition: r.prompt for r in asked.collect()}
    head = "\n### The following Java code snippet has received a code review.\n[Java]\n1 a\n2 b\n[/Java]\n"
    review = "[CODE REVIEW]\nr {summary} {lang}\n[/CODE REVIEW]\n"
    tail = (
        "### Please generate a revised version of the code snippet according to the code review. "
        "Do not add explanations.\n[Java]\n"
    )
    assert got["plain"] == head + review + tail
    assert got["summary"] == head + review + "[SUMMARY]\n{code_review}\n[/SUMMARY]\n" + tail


def test_missing_summary_is_an_empty_section(spark):
    asked = prompts.location_prompt(table(spark, example(1)), conditions=("summary",), modes=("easy",))
    first = asked.orderBy("perm_idx").first()
    assert "[SUMMARY]\n\n[/SUMMARY]\n### Possible answers:\nA. line numbers 7\nB. line numbers 8,9\n" in first.prompt
    assert "asking to modify the code?" in first.prompt and first.task == "CLE"
    assert asked.count() == 24


def test_solution_options_start_on_their_own_line(spark):
    asked = prompts.solution_prompt(table(spark, example(1)), conditions=("plain",), modes=("hard",))
    assert "A. \nsx\nB. \nsy\nC. \nsz\nD. \ns\n###" in asked.orderBy("perm_idx").first().prompt


CELLS = [
    ("m0", "summary", "ACR", 28.44, 450),
    ("m0", "summary", "CTR", 57.33, 450),
    ("m1", "summary", "ACR", 28.67, 450),
    ("m1", "summary", "CLE", None, None),
]


def test_pending_upsert_and_report(spark, tmp_path):
    path = str(tmp_path / "results")
    assert stored_results.read_results(spark, path).count() == 0
    stored_results.write_results(spark, spark.createDataFrame(CELLS, schemas.RESULTS), path)
    results = stored_results.read_results(spark, path)
    models = spark.createDataFrame([("m0",), ("m1",), ("m1",)], "model string")
    assert rs.pending_work(models, results, ("summary",)).count() == 9
    assert rs.pending_work(models, results).count() == 21
    fresh = spark.createDataFrame(
        [("m1", "summary", "ACR", 30.0, 450), ("m1", "summary", "CLE", 1.0, 450)], schemas.RESULTS
    )
    for _ in range(2):  # storing twice is storing once
        stored_results.write_results(spark, fresh, path)
        now = stored_results.read_results(spark, path)
        got = {(r.model, r.task): r.value for r in now.collect()}
        assert got == {
            ("m0", "ACR"): 28.44, ("m0", "CTR"): 57.33, ("m1", "ACR"): 30.0, ("m1", "CLE"): 1.0,
        }
    left = rs.pending_work(models, now, ("summary",)).collect()
    assert len(left) == 8 and ("m1", "CLE") not in {(r.model, r.task) for r in left}
    csv = str(tmp_path / "csv")
    stored_results.write_results_csv(now, csv)
    text = next((tmp_path / "csv").glob("*.csv")).read_text()
    assert text.splitlines() == [
        "Model,ACR,CTR,CLE,CLH,SIE,SIH", "m0,28.44,57.33,,,,", "m1,30.0,,1.0,,,"
    ]
    back = stored_results.read_results_csv(spark, csv)
    assert {(r.model, r.task): r.value for r in back.collect()} == got
    assert stored_results.read_results_csv(spark, str(tmp_path / "none")).count() == 0
    compared = {(r.model, r.task): r for r in rs.compare_conditions(now).collect()}
    assert compared["m0", "CTR"].plain is None and compared["m0", "CTR"].summary == 57.33


def test_empty_report_says_so(spark, capsys):
    rs.print_report(spark.createDataFrame([], schemas.RESULTS))
    assert capsys.readouterr().out == "No results yet.\n"


def test_scores_round_half_to_even_on_their_binary_value(spark):
    rng = random.Random(3)
    values = [0.0, 100.0, 0.125, 0.375, 2.675, 1.005, 0.005, 0.015, 62.5, 99.995, 0.625, 1e-9]
    values += [rng.randrange(n + 1) / n * 100 for n in (3, 7, 8, 16, 800, 1600, 4000, 20000) for _ in range(200)]
    values += [rng.uniform(0, 100) for _ in range(500)]
    values += [-x for x in values] + [1000.125, -1000.375, 123456.005, 2.0**45 + 0.125, 2.0**46, 1e300, float("inf")]
    frame = spark.createDataFrame(list(enumerate(values)), "i int, x double")
    got = frame.select("i", rs.round_score(F.col("x")).alias("y")).orderBy("i").collect()
    assert [r.y for r in got] == [round(x, 2) for x in values]


def test_progress_over_ranges_equals_plain_running_sums(spark):
    rng = random.Random(5)
    cells = [("m0", "plain", "CTR")] * 3 + [("m1", "plain", "SIE")]
    data = {(rng.choice(cells), rng.randrange(5000)): rng.randrange(2) for _ in range(2000)}
    frame = spark.createDataFrame(
        [(*cell, i, hit) for (cell, i), hit in data.items()],
        "model string, condition string, task string, example_id long, hit int",
    )
    got = running.progress(frame, ranges=7)
    want = {}
    for cell in set(cells):
        hits = 0
        for place, i in enumerate(sorted(i for c, i in data if c == cell), 1):
            hits += data[cell, i]
            want[cell, i] = (hits, place)
    rows_got = got.collect()
    assert {
        ((r.model, r.condition, r.task), r.example_id): (r.hits_so_far, r.rows_so_far) for r in rows_got
    } == want


def test_line_offsets(spark):
    frame = spark.createDataFrame([(1, "ab\n\ncde"), (2, "")], "id long, s string")
    got = running.line_offsets(frame, "id", F.col("s")).orderBy("id", "pos").collect()
    assert [(r.id, r.line_offset) for r in got] == [(1, 0), (1, 2), (1, 2), (1, 5), (2, 0), (2, 0)]


def client_factory():
    def make():
        class Client:
            def generate(self, prompt, **options):
                if prompt == "bad":
                    raise ValueError("no")
                return f"{prompt} {options.get('temperature')}"

            def choose(self, prompt, letters, **options):
                if prompt == "bad":
                    raise ValueError("no")
                return "{}", [(letters[-1], -1)]

        return Client()

    return make


def test_failed_calls(spark):
    asked = spark.createDataFrame([(1, "good"), (2, "bad")], "example_id long, prompt string")
    summaries = inference.infer_summary(asked, client_factory())
    assert {r.example_id: r.summary for r in summaries.collect()} == {1: "good 0.2", 2: "ERROR: no"}
    kept = inference.infer_generate(asked, client_factory(), record_errors=True)
    assert {r.example_id: (r.content, r.error) for r in kept.collect()} == {
        1: ("good 0.0", None), 2: (None, "no"),
    }
    chosen = inference.infer_choice(asked, client_factory(), "ABC", record_errors=True)
    assert {r.example_id: (r.logprobs and r.logprobs[0].token, r.error) for r in chosen.collect()} == {
        1: ("C", None), 2: (None, "no"),
    }
    with pytest.raises(Exception, match="no"):
        inference.infer_generate(asked, client_factory()).collect()
    batched = inference.infer_choice_batch(
        table(spark, *[example(i) for i in range(6)]),
        prompts.change_type_prompt,
        client_factory(),
        "ABC",
        calls_at_once=3,
        partitions=5,
    )
    # tasks do not depend on the calls that each may have in flight
    assert batched.rdd.getNumPartitions() == 5
    places = batched.select("condition", "example_id", "perm_idx").distinct().count()
    assert places == batched.count() == 6 * 6 * 2
    enriched = rows.add_summary_column(table(spark, example(1), example(2)), summaries)
    failed = rows.summary_status(enriched).select("example_id", "summary_failed").collect()
    assert {r.example_id: r.summary_failed for r in failed} == {1: False, 2: True}


def generated(i, content, seconds, model="m"):
    import datetime as dt

    return (model, "plain", i, content, None, START + dt.timedelta(seconds=seconds))


def test_streams_take_late_repeats_and_restart(spark, tmp_path):
    examples = table(spark, example(1), example(2))
    keys = fanout.answer_keys(examples)
    golds = str(tmp_path / "gold")
    gold.store_gold_forms(examples, golds)
    right = keys.first()["keys"]["CTR"]
    feed, slots, log = (str(tmp_path / n) for n in ("feed", "slots", "log"))
    texts, scores, text_log = (str(tmp_path / n) for n in ("texts", "scores", "text-log"))

    def deliver(answers, generations):
        spark.createDataFrame(answers, schemas.CHOICES).coalesce(1).write.mode("append").parquet(feed)
        spark.createDataFrame(generations, schemas.GENERATIONS).coalesce(1).write.mode("append").parquet(texts)
        streams.stream_choices(spark, feed, slots, log, 1).awaitTermination()
        streams.stream_generations(spark, texts, golds, scores, text_log, 1).awaitTermination()
        report = streams.choice_totals(spark, slots, keys).first()
        text_report = streams.generation_totals(spark, scores).first()
        return (report.n, report.invariant), (text_report.n, text_report.em)

    half = [answer(x, p, 9) for p, x in enumerate(right)][:3]
    assert deliver(half, [generated(1, "1 a\n2 c", 9), generated(2, "1 x", 1)]) == ((1, 0), (2, 1))
    rest = [answer(x, p, 9) for p, x in enumerate(right)][3:]
    stale = [answer("B", p, 2) for p in range(6)]
    # the rest arrives with an old repeat of everything; example 2's text is sent again, right
    assert deliver(rest + stale, [generated(1, "1 old", 2), generated(2, "1 a\n2 c", 5)]) == (
        (1, 1),
        (2, 2),
    )


def test_one_answer_with_a_third_of_all_copies(spark):
    many = spark.range(30000).select(
        F.lit("m").alias("model"),
        F.lit("plain").alias("condition"),
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).cast("long").alias("example_id"),
        F.col("id").cast("string").alias("content"),
        F.lit(None).cast("string").alias("error"),
        F.timestamp_seconds("id").alias("ingest_ts"),
    )
    latest = joins.latest_answers(many, joins.GENERATION_KEY)
    assert latest.where("example_id = 1").first().content == "29997"
    assert latest.count() == many.select("example_id").distinct().count()


def test_batch_and_parts_agree(spark, small):
    examples, choices = t.examples(spark, small), t.choices(spark, small, ("CTR", "CLE"))
    generations = joins.latest_answers(t.generations(spark, small), joins.GENERATION_KEY)
    scored = ev.scored_examples(examples, generations, choices, ("CTR", "CLE")).cache()
    by_part = scoring.by_ground_truth(scored).collect()
    for kind in ("type_correct", "lang"):
        whole = {(r.model, r.condition, r.task): (r.n, r.hits) for r in by_part if r.breakdown == "all"}
        parts = {}
        for r in by_part:
            if r.breakdown == kind:
                n, hits = parts.get((r.model, r.condition, r.task), (0, 0))
                parts[r.model, r.condition, r.task] = (n + r.n, hits + r.hits)
        assert parts == whole and len(whole) == 12
    scored.unpersist()


def test_wide_csv_is_read_by_column_name(spark, tmp_path):
    (tmp_path / "r.csv").write_text('ACR,Model,CTR\n1.5,"m""x",2.5\n,plain,3.5\n')
    got = {(r.model, r.task): r.value for r in stored_results.read_results_csv(spark, str(tmp_path)).collect()}
    assert {k: x for k, x in got.items() if x is not None} == {('m"x', "ACR"): 1.5, ('m"x', "CTR"): 2.5, ("plain", "CTR"): 3.5}


def test_malformed_examples_are_an_error(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"example_id": 1, "old": "a"}\n{"example_id": 2, "old": \n')
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        stored.read_examples(spark, str(tmp_path)).collect()


def test_upsert_reads_each_side_once_and_keeps_one_row_a_cell(spark):
    row = lambda model, value: (model, "plain", "ACR", value, 1)
    old = spark.createDataFrame([row("a", 1.0), row("b", 2.0)], schemas.RESULTS)
    fresh = spark.createDataFrame([row("b", 3.0), row("b", 4.0), row("c", 5.0)], schemas.RESULTS)
    merged = rs.upsert_results(old, fresh)
    assert {(r.model, r.value) for r in merged.collect()} == {("a", 1.0), ("b", 4.0), ("c", 5.0)}
    assert "Join" not in merged._jdf.queryExecution().optimizedPlan().toString()


# Digests of the prompt texts and phrases that published scores rest on.
PINS = {
    "CHANGE_PHRASES": "2cc2eb25901b087f3289e0f5b5592d6e",
    "CHANGE_TYPE_PROMPT": "ab840d86428663a2e1b98a19dc80af39",
    "LOCATION_PROMPT": "b6ae0a591d003b798df5ad98bac5bef5",
    "REFINE_PROMPT": "9096f527a4312bed04637311de1b3a01",
    "SOLUTION_PROMPT": "ba2a762b177228b7e9d087d3634b7fbb",
    "SUMMARY_REQUEST": "a3c3d263ee8c9d0929a6538646bb821c",
    "SUMMARY_SECTION": "587676722415da73e4a3cfc0b1f217f1",
}


def test_fixed_texts_are_unchanged():
    got = {name: hashlib.md5(str(getattr(v, name)).encode()).hexdigest() for name in PINS}
    assert got == PINS


def test_progress_of_sparse_ids(spark):
    rng = random.Random(6)
    ids = sorted({rng.randrange(-(2**63), 2**63) for _ in range(1500)} | {rng.randrange(-40, 40) for _ in range(40)})
    frame = spark.createDataFrame(
        [("m", "plain", "CTR", i, i % 3 == 0) for i in ids],
        "model string, condition string, task string, example_id long, hit boolean",
    )
    got = {r.example_id: (r.hits_so_far, r.rows_so_far) for r in running.progress(frame, ranges=50).collect()}
    hits, want = 0, {}
    for place, i in enumerate(ids, 1):
        hits += i % 3 == 0
        want[i] = (hits, place)
    assert got == want
    assert running.progress(frame.limit(0)).collect() == []
    many = running.progress(frame, ranges=16)
    sizes = many.sparkSession.read.parquet(many.inputFiles()[0].rsplit("/", 1)[0]).count()
    assert sizes == len(ids)


def test_deliveries_of_a_hot_example_are_split_and_ties_are_settled_alike(spark, monkeypatch):
    examples = table(spark, *[example(i) for i in range(50)])
    answers = [generated(1, "1 a\n2 c" if k == 299 else f"1 {k}", k) for k in range(300)]
    answers += [generated(i, text, 5) for i in range(2, 50) for text in ("1 a\n2 c", "1 x", f"1 {i}")]
    responses = spark.createDataFrame(answers, schemas.GENERATIONS).repartition(5)
    assert joins.hot_examples(responses) == []
    whole = sorted(map(tuple, scoring.score_deliveries(examples, responses).collect()))
    assert joins.hot_examples(responses, 3, 1) == [(1, 3)]
    monkeypatch.setattr(joins, "hot_examples", lambda given: hot(given, 100, 10))
    assert hot(responses, 100, 10) == [(1, 30)]
    assert sorted(map(tuple, scoring.score_deliveries(examples, responses).collect())) == whole
    latest = joins.latest_answers(responses, joins.GENERATION_KEY)
    assert sorted(map(tuple, scoring.score_generations(examples, latest).collect())) == whole
    assert len(whole) == 49 and {r[2]: r[5] for r in whole}[1] == 1 and {r[5] for r in whole} == {0, 1}
    tied = [answer("B", 0, 3), answer("A", 0, 3), answer("C", 0, 1)]
    latest = joins.latest_answers(spark.createDataFrame(tied, schemas.CHOICES), stored.CHOICE_KEY)
    slots = scoring.answers_by_example(joins.decode_answers(spark.createDataFrame(tied, schemas.CHOICES)))
    assert joins.decode_answers(latest).first().pick == 1 == slots.first().s0 % 4


hot = joins.hot_examples


def test_no_task_gets_a_hot_examples_answers_whole(spark, monkeypatch):
    monkeypatch.setattr(joins, "hot_examples", lambda given: hot(given, 1000, 100))
    examples = spark.range(20000).selectExpr("id AS example_id", "'java' AS lang", "'modify' AS type_correct", "'+a' AS new")
    responses = spark.range(60000).selectExpr(
        "concat('m', id) AS model", "'plain' AS condition", "CASE WHEN id % 3 = 0 THEN 7 ELSE id % 20000 END AS example_id",
        "'1 a' AS content", "CAST(NULL AS STRING) AS error", "timestamp_seconds(id) AS ingest_ts",
    )
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    for key, value in zip(before, ("40", "false", "-1")):
        spark.conf.set(key, value)
    try:
        joined = joins.attach_gold_forms(joins.gold_forms(examples), responses)
        sizes = [r.n for r in joined.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert sum(sizes) == 60000 and max(sizes) <= 3 * sorted(sizes)[len(sizes) // 2]
    assert [i for i, parts in hot(responses) if parts > 1] == [7]


def test_answers_without_a_place_are_counted(spark):
    keys = fanout.answer_keys(table(spark, example(1)))
    given = [answer("A", p) for p in (0, 5, 6, 23, 24, -1, None)] + [answer("A", 0, i=9)]
    decoded = joins.decode_answers(spark.createDataFrame(given, schemas.CHOICES))
    assert scoring.unplaced_answers(decoded, keys).first().unplaced == 6


def test_two_writers_keep_both_sets_of_cells(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "results")
    row = lambda model, value: spark.createDataFrame([(model, "plain", "ACR", value, 1)], schemas.RESULTS)
    stored_results.write_results(spark, row("a", 1.0), path)
    assert not stored_results._publish(spark, path, 1, "second")
    computed = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            computed.add(len(batch))
            yield batch

    # while the first writer merges, two others publish
    newest, others = stored_results._newest, [("b", 2.0), ("c", 3.0)]

    def interrupted(session, where):
        seen = newest(session, where)
        if others:
            other = others.pop()
            monkeypatch.setattr(stored_results, "_newest", newest)
            stored_results.write_results(spark, row(*other), path)
            monkeypatch.setattr(stored_results, "_newest", interrupted)
        return seen

    monkeypatch.setattr(stored_results, "_newest", interrupted)
    stored_results.write_results(spark, row("d", 4.0).mapInPandas(count, schemas.RESULTS), path)
    monkeypatch.undo()
    got = {(r.model, r.value) for r in stored_results.read_results(spark, path).collect()}
    assert got == {("a", 1.0), ("b", 2.0), ("c", 3.0), ("d", 4.0)}
    assert computed.value == 1 and stored_results._newest(spark, path)[0] == 4
    others.extend([("e", 5.0)] * 9)
    monkeypatch.setattr(stored_results, "_newest", interrupted)
    with pytest.raises(RuntimeError, match="published"):
        stored_results.write_results(spark, row("f", 1.0), path, tries=2)


def test_a_writer_that_died_does_not_stop_the_others(spark, tmp_path):
    path = str(tmp_path / "results")
    row = lambda model: spark.createDataFrame([(model, "plain", "ACR", 1.0, 1)], schemas.RESULTS)
    (tmp_path / "results" / "versions").mkdir(parents=True)
    for name in ("000000000001", "000000000003", ".half"):
        (tmp_path / "results" / "versions" / name).touch()
    assert stored_results.read_results(spark, path).count() == 0
    for model in "abc":
        stored_results.write_results(spark, row(model), path)
    assert {r.model for r in stored_results.read_results(spark, path).collect()} == set("abc")
    (tmp_path / "results" / "versions" / "000000000009").touch()
    assert stored_results.read_results(spark, path).count() == 3
    stored_results.write_results(spark, row("d"), path)
    assert stored_results._newest(spark, path)[0] == 10 and stored_results.read_results(spark, path).count() == 4


def test_a_folder_is_made_where_none_is_named():
    def named(folder, master):
        conf = SimpleNamespace(get=lambda key, default=None: folder)
        return session.shared_folder(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId="made-up")))

    assert named("/shared/x/", "spark://a") == "/shared/x"
    made = named(None, "local[2]")
    assert os.path.isdir(made) and named(None, "local[2]") == made
    with pytest.raises(ValueError):
        named(None, "spark://a")


def test_totals_before_the_first_batch_and_after_a_new_log(spark, tmp_path):
    examples = table(spark, example(1), example(2))
    feed, scores, slots = (str(tmp_path / n) for n in ("feed", "scores", "slots"))
    golds = str(tmp_path / "gold")
    gold.store_gold_forms(examples, golds)
    assert streams.generation_totals(spark, scores).count() == 0
    assert streams.choice_totals(spark, slots, fanout.answer_keys(examples)).count() == 0
    for log, given in (("one", generated(1, "1 a\n2 c", 9)), ("two", generated(2, "1 x", 9))):
        new = str(tmp_path / f"feed-{log}")
        spark.createDataFrame([given], schemas.GENERATIONS).coalesce(1).write.parquet(new)
        streams.stream_generations(spark, new, golds, scores, str(tmp_path / log)).awaitTermination()
    report = streams.generation_totals(spark, scores).first()
    assert (report.n, report.em) == (2, 1)


def test_a_grid_run_goes_on_where_it_was(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def client_for(model):
        def make():
            class Client:
                def generate(self, prompt, **options):
                    calls.add(1)
                    return "1 a\n2 c" if model == "good" else "1 x"

                def choose(self, prompt, letters, **options):
                    calls.add(1)
                    return '{"answer": "A"}', [("A", -0.1)]

            return Client()

        return make

    examples = table(spark, example(1), example(2, type_correct="remove_only", type_wrong=["add_only", "modify"]))
    paths = [str(tmp_path / n) for n in ("g", "c", "r")]
    run = lambda models, tasks: grid.run_grid(spark, examples, client_for, models, *paths, conditions=("plain",), tasks=tasks)
    first = {(r.model, r.task): (r.value, r.n) for r in run(("good",), ("ACR", "CTR")).collect()}
    assert first == {("good", "ACR"): (100.0, 2), ("good", "CTR"): (0.0, 2)} and calls.value == 2 + 12
    both = {(r.model, r.task): (r.value, r.n) for r in run(("good", "poor"), ("ACR", "CTR", "SIE")).collect()}
    assert both == first | {("good", "SIE"): (0.0, 1), ("poor", "ACR"): (0.0, 2), ("poor", "CTR"): (0.0, 2), ("poor", "SIE"): (0.0, 1)}
    assert calls.value == 14 + 24 + 2 + 12 + 24
    assert run(("good", "poor"), ("ACR", "CTR", "SIE")).count() == 6 and calls.value == 76


def test_a_broken_run_loses_one_portion_of_calls(spark, tmp_path):
    calls, broken = spark.sparkContext.accumulator(0), str(tmp_path / "broken")

    def client_for(model):
        def make():
            import os

            class Client:
                def generate(self, prompt, **options):
                    if "word35" in prompt and not os.path.exists(broken):
                        raise RuntimeError("the model is gone")
                    calls.add(1)
                    return "1 a\n2 c"

                def choose(self, prompt, letters, **options):
                    if "word35" in prompt and not os.path.exists(broken):
                        raise RuntimeError("the model is gone")
                    calls.add(1)
                    return '{"answer": "A"}', [("A", -0.1)]

            return Client()

        return make

    # an example of 40 cannot be asked at first; ids are sparse
    rows = [example(i * 10**15, review=f"word{i}") for i in range(40)]
    table(spark, *rows).repartitionByRange(4, "example_id").write.parquet(str(tmp_path / "examples"))
    examples = spark.read.parquet(str(tmp_path / "examples"))
    paths = [str(tmp_path / n) for n in ("g", "c", "r")]
    for task, questions in (("ACR", 40), ("CTR", 240)):
        run = lambda: grid.run_grid(spark, examples, client_for, ("m",), *paths, conditions=("plain",), tasks=(task,), calls_a_portion=questions // 4)  # noqa: B023, E731
        calls.value = 0
        with pytest.raises(Exception, match="the model is gone"):
            run()
        path = paths[0] if task == "ACR" else paths[1]
        held = spark.read.parquet(path).count()
        assert 0 < held < questions and stored_results.read_results(spark, paths[2]).where(F.col("task") == task).count() == 0
        # stored answers and ledger agree, and what was stored is not asked again
        noted = grid.read_ledger(spark, paths[2]).where(F.col("task") == task)
        assert noted.agg(F.sum("calls")).first()[0] == held and noted.count() == 3
        open(broken, "w").close()
        calls.value = 0
        assert [(r.task, r.n) for r in run().where(F.col("task") == task).collect()] == [(task, 40)]
        assert calls.value == questions - held and spark.read.parquet(path).count() == questions
        os.remove(broken)


def test_single_orderings_are_asked_again(spark):
    examples = table(spark, example(1), example(2), example(3, type_wrong=["modify"]))
    given = [answer("A", p) for p in (0, 2, 4, 5, 30, -1, None)] + [answer("A", p, i=2) for p in range(6)]
    failed = [(*answer("A", 5)[:7], "refused", None)]
    answers = spark.createDataFrame(given[:3] + given[4:], schemas.CHOICES).unionByName(spark.createDataFrame(failed, schemas.CHOICES))
    left = grid.unanswered(grid.questions(examples, "CTR", ("plain",)), answers, "m", "CTR")
    assert [tuple(r) for r in left.collect()] == [("plain", 1, 0b101010)]
    asked = grid.PROMPTS["CTR"](grid.asked_rows(examples, left, None, None))
    assert sorted(r.perm_idx for r in asked.collect()) == [1, 3, 5]


def ranks(spark, number, count=30):
    """What a batch stores: some keys come back in every batch."""
    return spark.range(count).selectExpr(
        "'m' AS model", "'plain' AS condition", f"CASE WHEN id < 5 THEN id ELSE id + {number * count} END AS example_id",
        "'java' AS lang", "'modify' AS type_correct", f"CAST({number} * 16 + 1 AS DECIMAL(38,0)) AS rank",
    ).coalesce(1)


def test_a_look_reads_few_files_however_many_batches_there_were(spark, tmp_path):
    folder, most = str(tmp_path / "scores"), 0
    for number in range(200):
        ranks(spark, number).write.parquet(store.batch_folder(folder, "s", number))
        store.compact(spark, folder, streams.STORED_RANKS, scoring.fold_ranks)
        if number % 40 == 39 or number in (0, 7, 8):
            look = store.read(spark, folder, streams.STORED_RANKS)
            most = max(most, len(look.inputFiles()))
            folded = scoring.fold_ranks(look)
            assert folded.count() == 5 + 25 * (number + 1)
            assert {r.rank for r in folded.where("example_id < 5").collect()} == {number * 16 + 1}
    assert most <= 4 * (store.FAN - 1)
    assert len(store._batches(spark, folder)) <= 2 * store.FAN
    # a batch that runs again after it was merged counts once
    before = streams.generation_totals(spark, folder).collect()
    ranks(spark, 3).write.mode("overwrite").parquet(store.batch_folder(folder, "s", 3))
    assert streams.generation_totals(spark, folder).collect() == before
    # and one that was not written to its end does not count
    ranks(spark, 500).write.parquet(store.batch_folder(folder, "s", 500))
    os.remove(f"{store.batch_folder(folder, 's', 500)}/_SUCCESS")
    assert streams.generation_totals(spark, folder).collect() == before


def test_of_two_compactions_one_is_published(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "scores")
    for stream in "ab":
        for number in range(4):
            ranks(spark, number if stream == "a" else 10 + number).write.parquet(store.batch_folder(folder, stream, number))
    publish, schema = store.markers.publish, streams.STORED_RANKS
    calls = []

    def late(*args):
        if not calls:
            calls.append(args)
            assert store.compact(spark, folder, schema, scoring.fold_ranks)
        return publish(*args)

    monkeypatch.setattr(store.markers, "publish", late)
    assert not store.compact(spark, folder, schema, scoring.fold_ranks)
    assert scoring.fold_ranks(store.read(spark, folder, schema)).count() == 5 + 25 * 8


def test_a_batch_reads_the_gold_texts_that_it_answers(spark, tmp_path):
    read = []
    for name, count in (("few", 2000), ("many", 20000)):
        examples = spark.range(count).selectExpr("id AS example_id", "'java' AS lang", "'modify' AS type_correct", "concat('+a ', id) AS new")
        gold.store_gold_forms(examples, str(tmp_path / name), rows_a_bucket=100)
        batch = spark.createDataFrame([(i, f"1 a {i}") for i in (3, 700, 1999)], "example_id long, content string")
        forms = gold.gold_forms_of(spark, str(tmp_path / name), batch)
        sizes = [os.path.getsize(f.removeprefix("file://")) for f in forms.inputFiles()]
        assert 1 <= len(sizes) <= 3
        read.append(sum(sizes) / len(sizes))
        got = {r.example_id: r._gold_spaced for r in forms.where("example_id IN (3, 700, 1999)").collect()}
        assert got == {i: f"a {i}" for i in (3, 700, 1999)}
    assert read[1] < 1.5 * read[0]
    assert gold.gold_forms_of(spark, str(tmp_path / "few"), batch.limit(0)).count() == 0


def test_nulls_are_rejected_with_their_count(spark):
    examples = table(spark, example(1), example(2, new=None), example(3, review=None), example(4, old=None), example(5, solution_wrong_easy=["x", None, "z"]))
    given = spark.createDataFrame([generated(i, "1 a\n2 c", 1) for i in range(1, 6)], schemas.GENERATIONS)
    seen = Rejects()
    report = scoring.refine_report(scoring.score_deliveries(examples, given, seen)).collect()
    assert [(r.n, r.em, r.em_pct) for r in report] == [(4, 4, 100.0)] and seen.counts() == {("examples", "null_gold"): 1}
    assert sorted({r.example_id for r in prompts.refine_prompt(examples).collect()}) == [1, 2, 5]
    for made in (prompts.change_type_prompt, prompts.location_prompt, prompts.solution_prompt):
        asked = made(examples)
        assert asked.where("prompt IS NULL").count() == 0
    assert asked.where("example_id = 5").count() == 2 * 24
    seen = Rejects()
    assert prompts.askable(examples, seen).count() == 3
    assert seen.counts() == {("prompts", "null_old"): 1, ("prompts", "null_review"): 1}


def test_counting_rejects_reads_nothing_twice(spark, tmp_path):
    table(spark, *[example(i) for i in range(8)]).write.parquet(str(tmp_path / "e"))
    spark.createDataFrame([generated(1, "1 a", 1)], schemas.GENERATIONS).write.parquet(str(tmp_path / "g"))
    spark.createDataFrame([answer("A", p) for p in (0, 7)], schemas.CHOICES).write.parquet(str(tmp_path / "c"))
    tables, seen = [spark.read.parquet(str(tmp_path / x)) for x in "egc"], Rejects()
    scans = [ev.evaluate(*tables, r)._jdf.queryExecution().executedPlan().toString().count("FileScan") for r in (None, Rejects())]
    assert scans[0] == scans[1]
    assert ev.evaluate(*tables, seen).count() == 2
    assert seen.counts()["choices", "unplaced"] == 1


def test_a_language_run_leaves_the_other_cells_alone(spark, tmp_path):
    def client_for(model):
        def make():
            class Client:
                def generate(self, prompt, **options):
                    return "1 a\n2 c" if "Java" in prompt else "1 x"

            return Client()

        return make

    examples = table(spark, example(1), example(2, lang="python"), example(3, review="r"))
    paths = [str(tmp_path / n) for n in ("g", "c", "r")]
    run = lambda lang: {(r.task, r.value, r.n) for r in grid.run_grid(spark, examples, client_for, ("m",), *paths, conditions=("plain",), tasks=("ACR",), lang=lang).collect()}
    assert run(None) == {("ACR", 0.0, 3)}
    assert run("Java") == {("ACR", 100.0, 2)} and run("C#") == set()
    assert run(None) == {("ACR", 0.0, 3)}
    assert spark.read.parquet(grid.of_language(paths[0], "JAVA")).count() == 2


def test_records_keep_the_scores_of_every_ordering(spark):
    keys = fanout.answer_keys(table(spark, example(1)))
    given = [answer("B", 0, 9), answer("C", 0, 1), answer("A", 3, 2), answer("A", 40, 2)]
    row = scoring.choice_records(spark.createDataFrame(given, schemas.CHOICES), keys).first()
    low = v.UNSEEN_LOGPROB
    assert row.model_answers == ["B", None, None, "A", None, None] and len(row.correct_answers) == 6
    assert row.symbol_scores == [[low, -0.1, low, low], None, None, [-0.1, low, low, low], None, None]
    assert row.ground_truth == "modify"


def exchanges(frame):
    """The lines of the plan that move rows by a hash."""
    return [x for x in frame._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning" in x]


def test_a_batch_moves_its_answers_and_no_gold_text(spark, tmp_path, monkeypatch):
    rows = "id AS example_id, 'java' AS lang, 'modify' AS type_correct"
    texts = F.when(F.col("example_id") % 5 == 0, "+a // note\n+\tb  c").when(F.col("example_id") % 5 < 4, F.concat(F.lit("+x y "), F.col("example_id")))
    examples = spark.range(400).selectExpr(*rows.split(", ")).withColumn("new", texts)
    golds = str(tmp_path / "gold")
    gold.store_gold_forms(examples, golds, rows_a_bucket=50)
    answers = spark.createDataFrame(
        [generated(i, ("1 a // other\n2 b c", "1 x  y 6", "1 b c", None)[i % 4], 9) for i in range(600)]
        + [generated(None, "1 a", 9)],
        schemas.GENERATIONS,
    )
    monkeypatch.setattr(joins, "hot_examples", lambda responses: [])
    wide = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        forms = gold.gold_forms_of(spark, golds, answers)
        scored = scoring.score_ranks(forms, answers)
        assert len(exchanges(scored)) == 1
        assert sorted(scored.collect()) == sorted(scoring.score_ranks(joins.gold_forms(examples), answers).collect())
        # the session that wrote the table is not the one that reads it
        name = spark.read.json(f"{golds}/about").first().name
        spark.sql(f"DROP TABLE {name}")
        assert sorted(gold.gold_forms_of(spark, golds, answers).collect(), key=str) == sorted(joins.gold_forms(examples).collect(), key=str)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", wide)


def test_neighbouring_answers_fold_without_a_shuffle(spark):
    import datetime as dt

    def row(i):
        time = None if i % 13 == 0 else START + dt.timedelta(seconds=i % 5)
        example_id, place = (None if i % 17 == 0 else i % 6), (None if i % 19 == 0 else i % 29 - 2)
        return ("m" if i % 3 else None, "plain", "CLE" if i % 2 else "SIE", example_id, place, None if i % 11 == 0 else i % 4, time)

    kinds = "model string, condition string, task string, example_id long, perm_idx int, pick int, ingest_ts timestamp"
    decoded = spark.createDataFrame([row(i) for i in range(1500)], kinds)
    near = scoring.answers_by_neighbours(decoded)
    assert not exchanges(near) and near.schema.simpleString() == streams.STORED_SLOTS.simpleString()
    want = sorted(scoring.answers_by_example(decoded).collect(), key=str)
    assert sorted(streams._fold_slots(near).collect(), key=str) == want
    together = scoring.answers_by_neighbours(decoded.orderBy("example_id").coalesce(1))
    assert together.count() == len(want)
    assert scoring.answers_by_neighbours(decoded.limit(0)).count() == 0


def test_prompts_in_parts_are_asked_as_whole_ones(spark):
    """Every text that a client gets is the same, and what goes to Python is one row for all orderings."""

    def client():
        class Client:
            def choose(self, prompt, letters, **options):
                if "word3" in prompt and "C. line numbers 7" in prompt:
                    raise ValueError("refused")
                return prompt, [] if "word4" in prompt else [("A", len(prompt)), (letters[-1], -1)]

        return Client()

    given = [example(i, review=f"wörd\u4e2d word{i} {{option_a}}", summary=("s", None, "ERROR: x")[i % 3]) for i in range(30)]
    given += [example(40, type_wrong=["modify"]), example(41, loc_wrong_easy=[[7], None, [8]]), example(42, type_correct="remove_only")]
    given += [example(43, old=None), example(44, review=None), example(45, solution_wrong_hard=None), example(3)]
    examples = table(spark, *given)
    for make in (prompts.change_type_prompt, prompts.location_prompt, prompts.solution_prompt):
        for at_once in (1, 3):
            ask = lambda whole: inference.infer_choice_batch(examples, partial(make, whole=whole), client, "ABCD", at_once, record_errors=True)  # noqa: B023, E731
            parts, whole = ask(False), ask(True)
            assert parts.columns == whole.columns and dict(parts.dtypes) == dict(whole.dtypes)
            assert sorted(map(str, parts.collect())) == sorted(map(str, whole.collect()))
            assert "posexplode" in plan_of(whole) and "posexplode" not in plan_of(parts)
    asked = examples.selectExpr("*", "'plain' AS condition", "CASE WHEN example_id % 4 > 0 THEN CAST(example_id % 4 * 5 AS INT) END AS missing")
    for task in v.CHOICE_TASKS:
        texts = grid.PROMPTS[task](asked).collect()
        parts = inference.infer_choice(grid.PROMPTS[task](asked, whole=False), client, "ABCD", record_errors=True).where("content IS NOT NULL")
        got = {(r.example_id, r.perm_idx, r.content) for r in parts.collect()}
        refused = {(r.example_id, r.perm_idx, r.prompt) for r in texts if "word3" in r.prompt and "C. line numbers 7" in r.prompt}
        assert got == {(r.example_id, r.perm_idx, r.prompt) for r in texts} - refused and got


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_records_are_shuffled_once_as_lists(spark):
    """Whatever lies apart, is repeated or tied: the last answer's scores, and one shuffle of folded lists."""
    import datetime as dt

    keys = fanout.answer_keys(table(spark, *[example(i) for i in range(5)]))
    dice = random.Random(4)

    def row(i):
        token = dice.choice("ABCD")
        tokens = dice.choice([None, [], [(token, -0.1)], [(f" {token}", -0.5), ("B", dice.choice([-0.5, -0.25, float("nan")]))]])
        content = dice.choice(['{"answer": "A"}', "", None, "[1]"])
        place, time = dice.choice([None, -1, 24, *range(24)]), START + dt.timedelta(seconds=dice.randrange(2))
        return ("m" if i % 9 else None, "plain", dice.choice(["CTR", "SIE"]), dice.choice([None, 9, *range(5)]), place, content, tokens, None, time if i % 7 else None)

    given = spark.createDataFrame([row(i) for i in range(4000)], schemas.CHOICES).repartition(3)
    wide = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        records = scoring.choice_records(given, keys)
        moved = exchanges(records)
        assert len(moved) == 2 and all("hashpartitioning(example_id" in x for x in moved)
        got = {(r.model, r.task, r.example_id): (r.model_answers, r.symbol_scores) for r in records.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", wide)
    best = {}
    scored = joins.task_scores(given).select("*", F.unix_micros("ingest_ts").alias("at"))
    for r in scored.where("perm_idx between 0 and 23 and example_id < 5").collect():
        pick = max(range(4), key=lambda i: (r.scores[i] != r.scores[i], r.scores[i], -i))
        order = ((r.at or 0) * 4 + pick, [(x != x, 0 if x != x else x) for x in r.scores], pick, r.scores)
        key = (r.model, r.task, r.example_id)
        best[key, r.perm_idx] = max(best.get((key, r.perm_idx), order), order)
    count = {"CTR": 6, "SIE": 24}
    assert set(got) == {key for key, _ in best}
    for key, (answers, scores) in got.items():
        want = [best.get((key, p)) for p in range(count[key[1]])]
        assert answers == [w and "ABCD"[w[2]] for w in want]
        assert str(scores) == str([w and w[3] for w in want])


def test_far_more_answers_than_fold_at_once(spark, monkeypatch):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"x": list(range(25))})
    monkeypatch.setattr(scoring, "ANSWERS_AT_ONCE", 10)
    parts = list(scoring._gathered([batch, batch.slice(0, 0), batch.slice(0, 3)]))
    assert [len(p) for p in parts] == [10, 10, 8]
    assert [x for p in parts for x in p.column("x").to_pylist()] == [*range(25), *range(3)]
    assert list(scoring._gathered([batch.slice(0, 0)])) == []
