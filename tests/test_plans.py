"""The shape of physical plans: what is shuffled, pushed down and shared."""

import datetime as dt
import re
import uuid

from pyspark.sql import functions as F

from gradelens import schemas
from gradelens.operators import fanout, inference, joins, prompts, results as rs, running, scoring
from gradelens.plans import evaluate as ev
from gradelens.plans import run as grid
from gradelens.sources import tables as stored
from tests.test_choices import answer, example, table
from workload import tables as t


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(text):
    return re.findall(r"(?<!Reused)Exchange (hashpartitioning\([^)]*\)|rangepartitioning|SinglePartition|Round\w+)", text)


def stored_examples(spark, tmp_path):
    path = str(tmp_path / "examples")
    stored.write_enriched(table(spark, *[example(i) for i in range(20)]), path)
    return spark.read.parquet(path)


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    text = plan(prompts.solution_prompt(stored_examples(spark, tmp_path), modes=("hard",)))
    assert "remove_only" in re.search(r"DataFilters: \[(.*?)\], Format", text)[1]
    assert "loc_correct" not in text and "solution_wrong_easy" not in text and '"new"' not in text
    assert not shuffles(text)
    keys = plan(fanout.answer_keys(stored_examples(spark, tmp_path / "more"), ("CTR",)))
    assert re.search(r"ReadSchema: (.*)", keys)[1].count(":") == 4


def test_only_ids_and_picks_are_shuffled(spark, tmp_path):
    given = spark.createDataFrame([answer("A", 0)], schemas.CHOICES)
    keys = fanout.answer_keys(stored_examples(spark, tmp_path))
    text = plan(scoring.choice_report(scoring.score_choices(given, keys)))
    before_shuffle = text[: text.index("content")]
    assert "partial_max" in before_shuffle
    assert "Cartesian" not in text and "NestedLoop" not in text


def test_tables_stored_by_example_are_scored_without_shuffling_them(spark, tmp_path):
    examples = table(spark, *[example(i) for i in range(20)])
    name = uuid.uuid4().hex
    answers = [answer("A", p, i=i) for i in range(20) for p in range(6)]
    stored.store_by_example(examples, f"e{name}", 4, str(tmp_path / "e"))
    stored.store_answers(
        spark.createDataFrame(answers, schemas.CHOICES), f"c{name}", 4, stored.CHOICE_KEY, str(tmp_path / "c")
    )
    generations = spark.createDataFrame(
        [("m", "plain", i, "1 a\n2 c", None, None) for i in range(20)], schemas.GENERATIONS
    )
    stored.store_answers(generations, f"g{name}", 4, joins.GENERATION_KEY, str(tmp_path / "g"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stored_tables = [spark.table(f"{x}{name}") for x in "egc"]
        texts = scoring.score_generations(stored_tables[0], stored_tables[1])
        assert not shuffles(plan(texts))
        assert {r.em for r in texts.collect()} == {1}
        scored = scoring.score_choices(stored_tables[2], fanout.answer_keys(stored_tables[0]))
        assert not shuffles(plan(scored))
        whole = ev.evaluate(*stored_tables)
        assert len(shuffles(plan(whole))) == 2  # one small final sum per kind of task
        assert {(r.task, r.n) for r in whole.collect()} == {("ACR", 20), ("CTR", 20)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        for x in "egc":
            spark.sql(f"DROP TABLE IF EXISTS {x}{name}")


def test_progress_computes_scores_once_and_shuffles_them_once(spark):
    asked = spark.sparkContext.accumulator(0)

    def score(batches):
        for batch in batches:
            asked.add(len(batch))
            yield batch.assign(hit=batch.example_id % 2)

    cells = "'m' as model, 'plain' as condition, 'CTR' as task, id as example_id"
    scored = spark.range(1000).selectExpr(*cells.split(", ")).mapInPandas(
        score, "model string, condition string, task string, example_id long, hit long"
    )
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = running.progress(scored, ranges=10)
        got = {r.example_id: (r.hits_so_far, r.rows_so_far) for r in df.collect()}
        final = plan(df).split("== Initial Plan ==")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert got == {i: ((i + 1) // 2, i + 1) for i in range(1000)}
    assert asked.value == 1000
    assert "ReusedExchange" in final and final.count("FileScan") == 1


def test_line_offsets_are_summed_inside_the_row(spark):
    frame = spark.sql("SELECT 1 AS id, repeat('ab\n', 1000000) AS s")
    df = running.line_offsets(frame, "id", F.col("s"))
    assert "Exchange" not in plan(df)
    last = df.agg(F.max("pos").alias("pos"), F.max("line_offset").alias("end"), F.sum("line_offset").alias("sum")).first()
    assert (last.pos, last.end, last.sum) == (1_000_001, 2_000_000, 2 * sum(range(1_000_000)) + 2 * 2_000_000)


def test_the_grid_is_not_a_cross_join(spark):
    models = spark.createDataFrame([("m",)], "model string")
    text = plan(rs.pending_work(models, spark.createDataFrame([], schemas.RESULTS)))
    assert "Cartesian" not in text and "NestedLoopJoin" not in text


def test_derived_answers_cover_all_documents(spark, small):
    documents = t.documents(spark, small).count()
    assert t.examples(spark, small).count() == documents
    asked = t.choices(spark, small, ("CLE",)).select("example_id").distinct()
    assert asked.count() == documents


def test_every_text_is_shuffled_once_and_numbers_fold_by_hash(spark, tmp_path):
    examples = stored_examples(spark, tmp_path)
    rows = [("m", "plain", i, "1 a\n2 c", None, None) for i in range(20)]
    spark.createDataFrame(rows, schemas.GENERATIONS).write.parquet(str(tmp_path / "g"))
    spark.createDataFrame([answer("A", 0)], schemas.CHOICES).write.parquet(str(tmp_path / "c"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        generations, choices = (spark.read.parquet(str(tmp_path / x)) for x in "gc")
        text = plan(ev.evaluate(examples, generations, choices))
        assert "SortAggregate" not in text
        # answers and gold texts meet by example; the key of the fold needs no shuffle of its own
        texts = plan(scoring.score_deliveries(examples, generations))
        assert shuffles(texts) and all("example_id" in s and "model" not in s for s in shuffles(texts))
        assert len(shuffles(texts)) == 2
        # an upsert of it reads what it reads
        old_results = spark.createDataFrame([], schemas.RESULTS)
        merged = plan(rs.upsert_results(old_results, ev.evaluate(examples, generations, choices)))
        assert merged.count("FileScan") == text.count("FileScan") == 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_prompts_are_rendered_behind_every_shuffle(spark, tmp_path):
    examples = stored_examples(spark, tmp_path)
    spark.createDataFrame([answer("A", 0)], schemas.CHOICES).write.parquet(str(tmp_path / "c"))
    answers = spark.read.parquet(str(tmp_path / "c"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        work = grid.unanswered(grid.questions(examples, "CLE", ("plain", "summary")), answers, "m", "CLE")
        asked = inference.infer_choice_batch(
            grid.asked_rows(examples, work, 3, None), grid.PROMPTS["CLE"], None, "ABCD", 4
        )
        text = plan(asked)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    # the plan is written from its end; the prompt is put together in front of the first shuffle there
    before, after = text.split("Exchange", 1)
    assert "AS prompt" in before and "AS prompt" not in after and "prompt#" not in after and "posexplode" not in after
    assert "content" not in after and "logprobs" not in after


def test_breakdowns_group_sums_and_not_rows(spark):
    row = [("m", "plain", "CTR", 1, "java", "modify", 1)]
    scored = spark.createDataFrame(row, "model string, condition string, task string, example_id long, lang string, type_correct string, hit int")
    text = plan(scoring.by_ground_truth(scored))
    assert text.index("Expand") < text.rindex("partial_count")


def test_tasks_are_not_bound_to_the_calls_at_once(spark):
    asked = inference.infer_choice_batch(
        table(spark, *[example(i) for i in range(40)]), prompts.location_prompt, None, "ABCD", 4, partitions=16
    )
    assert "RoundRobin" not in plan(asked) and "hashpartitioning(example_id" in plan(asked) and ", 16)" in plan(asked)


def test_calls_take_prompts_from_arrow_and_keep_their_order(spark):
    """Prompts become Python texts some at a time, and answers stay beside their keys."""

    def client():
        class Client:
            def generate(self, prompt, **options):
                return f"re {prompt}"

        return Client()

    asked = spark.range(0, 1300, 1, 1).selectExpr("id AS example_id", "concat('p', id) AS prompt")
    for at_once in (1, 3):
        answered = inference.infer_generate(asked, client, calls_at_once=at_once)
        assert "MapInArrow" in answered._jdf.queryExecution().analyzed().toString()
        got = answered.collect()
        assert [(r.example_id, r.content, r.error) for r in got] == [(i, f"re p{i}", None) for i in range(1300)]


def test_array_files_are_cut_by_ids_and_read_back_in_order(spark, tmp_path):
    """Several files, each one array; repeated ids stay in one file and get places of their own."""
    from workload import queries

    ids = [*range(40), 0, 39, 17]
    given = table(spark, *[example(i, new=f"+{i}") for i in ids]).repartition(3)
    for name, chars, files in (("many", 100, range(5, 41)), ("one", 10**9, range(1, 2))):
        path = str(tmp_path / name)
        queries.write_array_files(given, path, chars)
        assert len(list((tmp_path / name).glob("part=*/*.gz"))) in files
        read = stored.read_examples(spark, path, array_file=True).orderBy("example_id").collect()
        assert [r.example_id for r in read] == list(range(len(ids)))
        assert [r.new for r in read] == [f"+{i}" for i in sorted(ids)]


def test_json_lines_are_compressed(spark, tmp_path):
    path = tmp_path / "lines"
    stored.write_enriched(table(spark, *[example(i) for i in range(20)]), str(path), "json")
    assert not list(path.glob("*.json")) and list(path.glob("*.json.gz"))
    assert stored.read_examples(spark, str(path)).count() == 20


def test_decoded_answers_are_attached_without_their_texts(spark):
    """Picks alone are carried to the last delivery and to the keys, with the same outcome."""
    t0 = dt.datetime(2024, 1, 1)
    given = [
        ("m", "plain", "CLE", 1, 0, '{"answer": "B"}', [("B", -0.1)], None, t0),
        ("m", "plain", "CLE", 1, 0, '{"answer": "C"}', [("C", -0.1)], None, t0),
        ("m", "plain", "CLE", 1, 1, '{"answer": "D"}', [("D", -0.1)], None, t0),
        ("m", "plain", "CLE", 1, 1, "", [("D", -0.1)], None, t0 + dt.timedelta(seconds=1)),
        ("m", "plain", "CLE", 1, None, "", None, None, None),
        ("m", "plain", "CLE", 1, 30, "", None, None, t0),
        ("m", "plain", "CLE", None, 1, "", None, None, t0),
    ]
    raw = spark.createDataFrame(given, schemas.CHOICES)
    keys = fanout.answer_keys(table(spark, example(1)))
    latest = joins.latest_answers(joins.decode_answers(raw), stored.CHOICE_KEY)
    assert latest.columns == [*stored.CHOICE_KEY, "pick", "ingest_ts"]
    got = joins.attach_choice_answers(latest, keys).collect()
    whole = joins.attach_choice_answers(joins.latest_answers(raw, stored.CHOICE_KEY), keys).collect()
    assert sorted(map(str, got)) == sorted(map(str, whole)) and len(got) == 4
    assert {r.perm_idx: r.picked for r in got} == {0: "C", 1: "A", None: "A", 30: "A"}
