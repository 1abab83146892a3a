"""One query per operator, and the whole evaluation, over the driver's tables."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gradelens import schemas, session, values as v
from gradelens.functions import answers as an
from gradelens.functions import metrics as mx
from gradelens.functions import options as op
from gradelens.functions import text as tx
from gradelens.operators import (
    fanout,
    inference,
    joins,
    prompts,
    results as rs,
    rows,
    running,
    scoring,
)
from gradelens.operators.rejects import Rejects
from gradelens.plans import evaluate as ev
from gradelens.plans import run as grid
from gradelens.sources import results as stored_results
from gradelens.sources import tables as stored
from gradelens.streaming import gold, scores as streams
from workload import tables as t

KINDS = ("location", "solution")


def _md5(text: Column | str) -> Column:
    return F.md5(F.col(text) if isinstance(text, str) else text)


def _union(parts) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _shown(column: Column, task: str) -> Column:
    """Options as one text: words and numbers as they are, whole solutions as a digest."""
    if task == "CTR":
        return F.array_join(column, "|")
    if task in ("CLE", "CLH"):
        return F.array_join(
            F.transform(column, lambda o: F.array_join(o.cast("array<string>"), ",")), "|"
        )
    return F.md5(F.array_join(column, "|"))


# --- sources and sinks ---------------------------------------------------------------------


def _fingerprint(examples: DataFrame) -> DataFrame:
    return examples.select(
        "example_id",
        _md5("old").alias("old_md5"),
        _md5("new").alias("new_md5"),
        _md5("review").alias("review_md5"),
        "lang",
        "type_correct",
        F.array_join("type_wrong", "|").alias("type_wrong"),
        F.array_join(F.col("loc_correct").cast("array<string>"), ",").alias("loc_correct"),
        _shown(F.col("loc_wrong_easy"), "CLE").alias("loc_wrong_easy"),
        _shown(F.col("loc_wrong_hard"), "CLH").alias("loc_wrong_hard"),
        _md5("solution_correct").alias("solution_correct_md5"),
        _shown(F.col("solution_wrong_easy"), "SIE").alias("solution_wrong_easy_md5"),
        _shown(F.col("solution_wrong_hard"), "SIH").alias("solution_wrong_hard_md5"),
        _md5(F.coalesce("summary", F.lit("none"))).alias("summary_md5"),
    )


def read_examples(spark: SparkSession, sf: str) -> DataFrame:
    path = session.fresh_path(spark, "examples-json")
    stored.write_enriched(t.examples(spark, sf), path, "json")
    return _fingerprint(stored.read_examples(spark, path))


#: Characters of an array file, about: one task's share for a reader, so the files may be compressed.
ARRAY_FILE_CHARS = 128_000_000


def write_array_files(examples: DataFrame, path: str, chars_a_file: int = ARRAY_FILE_CHARS) -> None:
    """Examples as array files in order of id, one for each range of ids.

    An example holds its text about ten times. Ranges end at sampled quantiles of the ids, so no task
    sorts or writes more than a few files, whatever the table holds.
    """
    total = examples.agg(F.sum(F.length("new"))).first()[0] or 0
    files = -(-10 * total // chars_a_file)
    shares = [i / files for i in range(1, files)]
    cuts = examples.agg(F.percentile_approx("example_id", shares)).first()[0] if shares else None
    part = F.lpad(running.range_of(F.col("example_id"), sorted(set(cuts or []))).cast("string"), 6, "0")
    in_order = W.partitionBy("part").orderBy("example_id")
    fields = F.to_json(F.struct(*schemas.EXAMPLE_FIELDS.names))
    lines = examples.select("example_id", part.alias("part"), fields.alias("value"))
    marked = lines.repartition(max(files, 1), "part").withColumns(
        {
            "front": F.when(F.row_number().over(in_order) == 1, "[").otherwise(","),
            "back": F.when(F.lead(F.lit(True)).over(in_order).isNull(), "]").otherwise(""),
        }
    )
    ended = marked.sortWithinPartitions("part", "example_id", F.col("front").desc(), "back")
    whole = ended.select("part", F.concat("front", "value", "back").alias("value"))
    whole.write.partitionBy("part").option("compression", "gzip").text(path)


def read_examples_array(spark: SparkSession, sf: str) -> DataFrame:
    """Examples written as array files in order of id, and read back in parallel."""
    path = session.fresh_path(spark, "examples-array")
    write_array_files(t.examples(spark, sf), path)
    return _fingerprint(stored.read_examples(spark, path, array_file=True))


def read_benchmark_split(spark: SparkSession, sf: str) -> DataFrame:
    path = session.fresh_path(spark, "splits")
    split = F.when(F.col("lang") == "en", "Other").otherwise("Benchmark")
    t.examples(spark, sf).withColumn("split", split).write.partitionBy("split").parquet(path)
    return _union(
        stored.read_benchmark_split(spark, path, name)
        .groupBy("lang")
        .agg(F.count("*").alias("n"), F.sum(F.length("new")).alias("chars"))
        .withColumn("split", F.lit(name))
        for name in ("Benchmark", "Other")
    )


def write_enriched(spark: SparkSession, sf: str) -> DataFrame:
    path = session.fresh_path(spark, "enriched")
    stored.write_enriched(_enriched(spark, sf), path)
    return _fingerprint(spark.read.parquet(path))


def _results(spark: SparkSession, sf: str) -> DataFrame:
    return ev.evaluate(t.examples(spark, sf), t.generations(spark, sf), t.choices(spark, sf))


def _result_rows(results: DataFrame) -> DataFrame:
    return results.select(
        "model", "condition", "task", F.round("value", 6).alias("value"), "n"
    )


def read_results(spark: SparkSession, sf: str) -> DataFrame:
    """Two stores, one after the other; the second one's cells win."""
    path = session.fresh_path(spark, "results")
    stored_results.write_results(spark, _first_batch(spark, sf), path)
    stored_results.write_results(spark, _second_batch(spark, sf), path)
    return _result_rows(stored_results.read_results(spark, path))


def write_results_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = session.fresh_path(spark, "results-csv")
    stored_results.write_results_csv(_results(spark, sf), path, "summary")
    return stored_results.read_results_csv(spark, path, "summary").drop("n")


def final_report(spark: SparkSession, sf: str) -> DataFrame:
    return rs.final_report(_results(spark, sf))


# --- filters and projections ---------------------------------------------------------------


def filter_lang(spark: SparkSession, sf: str) -> DataFrame:
    examples = t.examples(spark, sf)
    return _union(
        rows.filter_lang(examples, asked).select(
            F.lit(asked or "all").alias("asked"), "example_id", "lang"
        )
        for asked in (None, "EN", "fr", "De", "es")
    )


def eligible_for_task(spark: SparkSession, sf: str) -> DataFrame:
    examples = t.examples(spark, sf)
    return _union(
        rows.eligible_for_task(examples, task)
        .groupBy("type_correct")
        .agg(F.count("*").alias("n"))
        .withColumn("task", F.lit(task))
        for task in v.TASKS
    )


def with_summary_condition(spark: SparkSession, sf: str) -> DataFrame:
    section = prompts.summary_section(F.col("condition"), F.col("summary"))
    return rows.with_summary_condition(t.examples(spark, sf)).select(
        "example_id", "condition", _md5(section).alias("section_md5")
    )


def language_label(spark: SparkSession, sf: str) -> DataFrame:
    examples = t.examples(spark, sf)
    return _union(
        prompts.refine_prompt(examples, asked, ("plain",)).select(
            "example_id", F.lit(asked or "none").alias("asked"), _md5("prompt").alias("prompt_md5")
        )
        for asked in (None, "Java")
    )


def option_mode(spark: SparkSession, sf: str) -> DataFrame:
    examples = t.examples(spark, sf)
    shown = {"location": "CLE", "solution": "SIE"}
    return _union(
        rows.option_mode(examples, kind).select(
            "example_id", "mode", "task", _shown(F.col("wrong"), shown[kind]).alias("wrong")
        )
        for kind in KINDS
    )


def task_code(spark: SparkSession, sf: str) -> DataFrame:
    examples = t.examples(spark, sf)
    return _union(
        rows.option_mode(examples, kind)
        .groupBy("mode", "task")
        .agg(F.count("*").alias("n"))
        .withColumn("kind", F.lit(kind))
        for kind in KINDS
    )


def _summary_client():
    def make():
        class Client:
            def generate(self, prompt, **options):
                if len(prompt) % 10 == 3:
                    raise ValueError(f"refused {len(prompt)}")
                return f"{len(prompt)} at {options['temperature']}"

        return Client()

    return make


def _text_client():
    def make():
        import hashlib

        class Client:
            def generate(self, prompt, **options):
                digest = hashlib.md5(prompt.encode()).hexdigest()
                return f"{digest} {options['max_tokens']} {options['stop'][0]}"

        return Client()

    return make


def _letter_client():
    def make():
        class Client:
            def choose(self, prompt, letters, **options):
                letter = letters[len(prompt) % len(letters)]
                score = -(len(prompt) % 7) / 8
                return f'{{"answer": "{letter}"}}', [("{", 0.0), (f" {letter}", score)]

        return Client()

    return make


def _asked_summaries(spark: SparkSession, sf: str) -> DataFrame:
    asked = prompts.summary_prompt(t.examples(spark, sf)).select("example_id", "prompt")
    return inference.infer_summary(asked, _summary_client())


def _enriched(spark: SparkSession, sf: str) -> DataFrame:
    return rows.add_summary_column(t.examples(spark, sf), _asked_summaries(spark, sf))


def add_summary_column(spark: SparkSession, sf: str) -> DataFrame:
    return _enriched(spark, sf).select("example_id", _md5("new").alias("new_md5"), "summary")


def summary_default(spark: SparkSession, sf: str) -> DataFrame:
    return t.examples(spark, sf).select(
        "example_id", _md5(rows.summary_default(F.col("summary"))).alias("summary_md5")
    )


def summary_status(spark: SparkSession, sf: str) -> DataFrame:
    marked = rows.summary_status(t.examples(spark, sf))
    return marked.groupBy("lang", "summary_failed").agg(F.count("*").alias("n"))


# --- prompts -------------------------------------------------------------------------------


def summary_prompt(spark: SparkSession, sf: str) -> DataFrame:
    return prompts.summary_prompt(t.examples(spark, sf)).select(
        "example_id", _md5("prompt").alias("prompt_md5")
    )


def _prompt_digests(asked: DataFrame) -> DataFrame:
    keys = [c for c in asked.columns if c != "prompt"]
    return asked.select(*keys, _md5("prompt").alias("prompt_md5"))


def refine_prompt(spark: SparkSession, sf: str) -> DataFrame:
    return _prompt_digests(prompts.refine_prompt(t.examples(spark, sf)))


def change_type_prompt(spark: SparkSession, sf: str) -> DataFrame:
    return _prompt_digests(prompts.change_type_prompt(t.examples(spark, sf)))


def location_prompt(spark: SparkSession, sf: str) -> DataFrame:
    return _prompt_digests(prompts.location_prompt(t.examples(spark, sf)))


def solution_prompt(spark: SparkSession, sf: str) -> DataFrame:
    return _prompt_digests(prompts.solution_prompt(t.examples(spark, sf)))


def change_type_phrase(spark: SparkSession, sf: str) -> DataFrame:
    return (
        t.examples(spark, sf)
        .groupBy("type_correct", op.change_type_phrase(F.col("type_correct")).alias("phrase"))
        .agg(F.count("*").alias("n"))
    )


# --- joins ---------------------------------------------------------------------------------


def _latest_generations(spark: SparkSession, sf: str) -> DataFrame:
    return joins.latest_answers(t.generations(spark, sf), joins.GENERATION_KEY)


def latest_answers(spark: SparkSession, sf: str) -> DataFrame:
    return _latest_generations(spark, sf).select(
        *joins.GENERATION_KEY,
        _md5("content").alias("content_md5"),
        F.unix_seconds("ingest_ts").alias("seconds"),
    )


def attach_generations(spark: SparkSession, sf: str) -> DataFrame:
    paired = joins.attach_generations(t.examples(spark, sf), _latest_generations(spark, sf))
    return paired.select(
        *joins.GENERATION_KEY,
        _md5("generation").alias("generation_md5"),
        _md5("gold").alias("gold_md5"),
    )


def attach_choice_answers(spark: SparkSession, sf: str) -> DataFrame:
    latest = joins.latest_answers(joins.decode_answers(t.choices(spark, sf)), stored.CHOICE_KEY)
    paired = joins.attach_choice_answers(latest, fanout.answer_keys(t.examples(spark, sf)))
    return paired.groupBy(
        "model", "condition", "task", "perm_idx", "picked", "correct_symbol"
    ).agg(F.count("*").alias("n"), F.sum("example_id").alias("id_sum"))


def _first_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Refinement scored without whitespace, and change types."""
    examples = t.examples(spark, sf)
    scored = scoring.score_deliveries(examples, t.generations(spark, sf))
    loose = scoring.refine_report(scored).select(
        "model", "condition", F.lit("ACR").alias("task"), F.col("em_no_space_pct").alias("value"), "n"
    )
    return rs.append_scores(loose, _choice_results(spark, sf, "CTR"))


def _second_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Refinement scored by words, and easy locations."""
    scored = scoring.score_deliveries(t.examples(spark, sf), t.generations(spark, sf))
    return rs.append_scores(ev.generation_results(scored), _choice_results(spark, sf, "CLE"))


def _choice_results(spark: SparkSession, sf: str, *tasks: str) -> DataFrame:
    return ev.choice_results(_scored_choices(spark, sf, tasks))


def pending_work(spark: SparkSession, sf: str) -> DataFrame:
    done = _choice_results(spark, sf, "CTR", "CLE").where(
        "model = 'm0' OR condition = 'summary'"
    )
    return rs.pending_work(t.generations(spark, sf), done)


def upsert_results(spark: SparkSession, sf: str) -> DataFrame:
    return _result_rows(rs.upsert_results(_first_batch(spark, sf), _second_batch(spark, sf)))


def compare_conditions(spark: SparkSession, sf: str) -> DataFrame:
    compared = rs.compare_conditions(_results(spark, sf))
    return compared.select(
        "model", "task", *[F.round(c, 6).alias(c) for c in ("plain", "summary", "delta")]
    )


# --- fan-out and arrays --------------------------------------------------------------------


def build_options(spark: SparkSession, sf: str) -> DataFrame:
    examples = t.examples(spark, sf)
    return _union(
        fanout.with_options(examples, task).select(
            "example_id", "task", _shown(F.col("options"), task).alias("options")
        )
        for task in v.CHOICE_TASKS
    )


def all_orderings(spark: SparkSession, sf: str) -> DataFrame:
    examples = t.examples(spark, sf)
    return _union(
        fanout.all_orderings(examples, task).select(
            "example_id", "task", "perm_idx", _shown(F.col("perm_options"), task).alias("perm_options")
        )
        for task in v.CHOICE_TASKS
    )


def correct_symbol(spark: SparkSession, sf: str) -> DataFrame:
    examples = t.examples(spark, sf)
    return _union(
        fanout.all_orderings(examples, task)
        .groupBy("task", "perm_idx", "correct_symbol")
        .agg(F.count("*").alias("n"), F.sum("example_id").alias("id_sum"))
        for task in v.CHOICE_TASKS
    )


def answer_keys(spark: SparkSession, sf: str) -> DataFrame:
    keys = fanout.answer_keys(t.examples(spark, sf))
    by_task = keys.select("example_id", F.explode("keys").alias("task", "key"))
    return by_task.where(F.col("key").isNotNull())


def option_count_check(spark: SparkSession, sf: str) -> DataFrame:
    """Examples of one language lack an option and those of another have one too many."""
    wrong = F.col("loc_wrong_easy")
    uneven = t.examples(spark, sf).withColumn(
        "loc_wrong_easy",
        F.when(F.col("lang") == "fr", F.slice(wrong, 1, 2))
        .when(F.col("lang") == "de", F.array_append(wrong, F.col("loc_correct")))
        .otherwise(wrong),
    )
    return _union(
        fanout.option_count_check(uneven, task)
        .groupBy("task", "lang", F.size("options").alias("options"), "accepted")
        .agg(F.count("*").alias("n"))
        for task in v.CHOICE_TASKS
    )


def combinations(spark: SparkSession, sf: str) -> DataFrame:
    examples = t.examples(spark, sf)
    return _union(
        fanout.combinations(examples, task).select(
            "example_id",
            "task",
            _md5(
                F.array_join(fanout.ordered_options(lambda ordered: _shown(ordered, task)), ";")
            ).alias("combinations_md5"),
        )
        for task in v.CHOICE_TASKS
    )


# --- answers -------------------------------------------------------------------------------


def clean_generation(spark: SparkSession, sf: str) -> DataFrame:
    cleaned = an.clean_generation(F.col("content"))
    return _latest_generations(spark, sf).select(
        *joins.GENERATION_KEY, _md5(cleaned).alias("cleaned_md5")
    )


def drop_line_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return t.documents(spark, sf).select(
        "doc_id",
        _md5(tx.drop_line_numbers(tx.number_lines(F.col("text")))).alias("text_md5"),
        _md5(tx.drop_line_numbers(F.col("text"))).alias("cut_md5"),
    )


def _score_patterns(answers: DataFrame, scores: Column) -> DataFrame:
    letters = {f"score_{x.lower()}": F.get(scores, F.lit(i)) for i, x in enumerate(v.LETTERS)}
    return (
        answers.withColumns(letters)
        .groupBy("task", *letters)
        .agg(F.count("*").alias("n"), F.sum("example_id").alias("id_sum"))
    )


def symbol_scores(spark: SparkSession, sf: str) -> DataFrame:
    scores = an.token_scores(F.col("logprobs"), v.LETTERS)
    return _score_patterns(t.choices(spark, sf), scores)


def fallback_first_choice(spark: SparkSession, sf: str) -> DataFrame:
    scores = an.symbol_scores(F.col("content"), F.col("logprobs"), v.LETTERS)
    return _score_patterns(t.choices(spark, sf), scores)


def pick_symbol(spark: SparkSession, sf: str) -> DataFrame:
    scored = joins.task_scores(t.choices(spark, sf))
    picked = scored.withColumn("picked", an.pick_symbol(F.col("scores")))
    return picked.groupBy("model", "condition", "task", "perm_idx", "picked").agg(
        F.count("*").alias("n"), F.sum("example_id").alias("id_sum")
    )


# --- text and metrics ----------------------------------------------------------------------


def number_lines(spark: SparkSession, sf: str) -> DataFrame:
    return t.examples(spark, sf).select(
        "example_id", _md5(tx.number_lines(F.col("old"))).alias("numbered_md5")
    )


def strip_markers(spark: SparkSession, sf: str) -> DataFrame:
    return t.examples(spark, sf).select(
        "example_id", _md5(tx.strip_markers(F.col("new"))).alias("gold_md5")
    )


def remove_comments(spark: SparkSession, sf: str) -> DataFrame:
    bare = tx.remove_comments(F.col("code"))
    return t.commented(spark, sf).select(
        "doc_id", F.length(bare).alias("chars"), _md5(bare).alias("bare_md5")
    )


def words(spark: SparkSession, sf: str) -> DataFrame:
    found = tx.words(F.col("generation"))
    return t.metric_pairs(spark, sf).select(
        "doc_id", F.size(found).alias("words"), _md5(F.array_join(found, "|")).alias("words_md5")
    )


def squash(spark: SparkSession, sf: str) -> DataFrame:
    squashed = tx.squash(F.col("generation"))
    return t.metric_pairs(spark, sf).select("doc_id", _md5(squashed).alias("squashed_md5"))


def line_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return running.line_offsets(t.documents(spark, sf), "doc_id", F.col("text"))


def _one_metric(name: str, metric):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        score = metric(F.col("gold"), F.col("generation"))
        return t.metric_pairs(spark, sf).select("doc_id", score.alias(name))

    return query


def score_generation(spark: SparkSession, sf: str) -> DataFrame:
    return mx.score_generation(t.metric_pairs(spark, sf)).select("doc_id", *mx.METRICS)


def jaccard(spark: SparkSession, sf: str) -> DataFrame:
    similarity = mx.jaccard(F.col("gold"), F.col("generation"))
    return t.metric_pairs(spark, sf).select("doc_id", F.round(similarity, 6).alias("jaccard"))


def _answer_lists(spark: SparkSession, sf: str) -> DataFrame:
    decoded = joins.decode_answers(t.choices(spark, sf))
    return scoring.orderings_by_position(decoded, fanout.answer_keys(t.examples(spark, sf)))


def matching_answers(spark: SparkSession, sf: str) -> DataFrame:
    same = mx.matching_answers(F.col("model_answers"), F.col("correct_answers"))
    return _answer_lists(spark, sf).select(*scoring.CELL, "example_id", same.alias("matches"))


def orderings_by_position(spark: SparkSession, sf: str) -> DataFrame:
    return _answer_lists(spark, sf).select(
        *scoring.CELL,
        "example_id",
        F.array_join("model_answers", "").alias("model_answers"),
        F.array_join("correct_answers", "").alias("correct_answers"),
    )


def choice_records(spark: SparkSession, sf: str) -> DataFrame:
    """Scores are shown in millionths, one after the other."""
    keys = fanout.answer_keys(t.examples(spark, sf))
    shown = F.transform(F.flatten("symbol_scores"), lambda x: F.round(x * 1_000_000).cast("bigint").cast("string"))
    return scoring.choice_records(t.choices(spark, sf), keys).select(
        *scoring.CELL,
        "example_id",
        "ground_truth",
        F.array_join("correct_answers", "").alias("correct_answers"),
        F.array_join("model_answers", "").alias("model_answers"),
        _md5(F.array_join(shown, ",")).alias("scores_md5"),
    )


# --- reports -------------------------------------------------------------------------------


def _scored_choices(spark: SparkSession, sf: str, tasks=v.CHOICE_TASKS) -> DataFrame:
    keys = fanout.answer_keys(t.examples(spark, sf), tasks)
    return scoring.score_choices(t.choices(spark, sf, tasks), keys)


def refine_report(spark: SparkSession, sf: str) -> DataFrame:
    scored = scoring.score_deliveries(t.examples(spark, sf), t.generations(spark, sf))
    report = scoring.refine_report(scored)
    return report.select(
        "model",
        "condition",
        "n",
        *mx.METRICS,
        *[F.round(f"{m}_pct", 6).alias(f"{m}_pct") for m in mx.METRICS],
    )


def invariant_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    report = scoring.invariant_accuracy(_scored_choices(spark, sf))
    return report.withColumn("value", F.round("value", 6))


def _invariant_of(*tasks: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        report = scoring.choice_report(_scored_choices(spark, sf, tasks))
        return report.withColumns(
            {c: F.round(c, 6) for c in ("value", "avg_correct")}
        )

    return query


def avg_correct(spark: SparkSession, sf: str) -> DataFrame:
    report = scoring.avg_correct(_scored_choices(spark, sf))
    return report.withColumn("avg_correct", F.round("avg_correct", 6))


def round_score(spark: SparkSession, sf: str) -> DataFrame:
    """Rounded share of every document's length in its language's total, over all documents."""
    docs = t.documents(spark, sf).select("doc_id", "lang", F.length("text").alias("chars"))
    longest = docs.groupBy("lang").agg(F.max("chars").alias("most"))
    value = F.col("chars") / F.col("most") * 100
    return docs.join(longest, "lang").select("doc_id", rs.round_score(value).alias("score"))


def results_pivot(spark: SparkSession, sf: str) -> DataFrame:
    wide = rs.results_pivot(_results(spark, sf))
    return wide.select("model", "condition", *[F.round(c, 6).alias(c) for c in v.TASKS])


def results_unpivot(spark: SparkSession, sf: str) -> DataFrame:
    wide = rs.results_pivot(_first_batch(spark, sf))
    return rs.results_unpivot(wide).drop("n").withColumn("value", F.round("value", 6))


def progress(spark: SparkSession, sf: str) -> DataFrame:
    scored = ev.scored_examples(
        t.examples(spark, sf), t.generations(spark, sf), t.choices(spark, sf)
    )
    return running.progress(scored)


def answer_positions(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.answer_positions(_answer_lists(spark, sf))


def by_ground_truth(spark: SparkSession, sf: str) -> DataFrame:
    scored = ev.scored_examples(
        t.examples(spark, sf), t.generations(spark, sf), t.choices(spark, sf)
    )
    return scoring.by_ground_truth(scored).withColumn("value", F.round("value", 6))


def append_scores(spark: SparkSession, sf: str) -> DataFrame:
    examples = t.examples(spark, sf)
    scored = scoring.score_deliveries(examples, t.generations(spark, sf))
    parts = [ev.generation_results(scored), *[_choice_results(spark, sf, c) for c in ("CTR", "SIE")]]
    return _result_rows(rs.append_scores(*parts))


def evaluate(spark: SparkSession, sf: str) -> DataFrame:
    return _result_rows(_results(spark, sf))


# --- model calls ---------------------------------------------------------------------------


def infer_generate(spark: SparkSession, sf: str) -> DataFrame:
    asked = prompts.refine_prompt(t.examples(spark, sf))
    return inference.infer_generate(asked, _text_client())


def _choice_answers(answered: DataFrame) -> DataFrame:
    return joins.letter_scores(answered).select(
        "task",
        "condition",
        "example_id",
        "perm_idx",
        "content",
        an.pick_symbol(F.col("scores")).alias("picked"),
        F.array_max("scores").alias("score"),
    )


def infer_choice(spark: SparkSession, sf: str) -> DataFrame:
    asked = prompts.change_type_prompt(t.examples(spark, sf))
    return _choice_answers(inference.infer_choice(asked, _letter_client(), v.LETTERS[:3]))


def infer_choice_batch(spark: SparkSession, sf: str) -> DataFrame:
    examples = t.examples(spark, sf)
    return _union(
        _choice_answers(
            inference.infer_choice_batch(
                examples, partial(make_prompts, whole=False), _letter_client(), v.LETTERS, calls_at_once=4
            )
        )
        for make_prompts in (prompts.location_prompt, prompts.solution_prompt)
    )


def _both_clients():
    texts, letters = _text_client(), _letter_client()

    def make():
        client = texts()
        client.choose = letters().choose
        return client

    return make


def run_grid(spark: SparkSession, sf: str) -> DataFrame:
    """All six tasks: one cell is recorded, right texts are stored for every third example of another.

    Of the first task's choices some orderings are stored, as right or as failed answers.
    """
    base = session.fresh_path(spark, "grid")
    stored.write_enriched(t.examples(spark, sf), f"{base}/examples")
    examples = spark.read.parquet(f"{base}/examples")
    done = [("m0", "summary", "ACR", 12.5, 8)]
    stored_results.write_results(spark, spark.createDataFrame(done, schemas.RESULTS), f"{base}/results")
    held = examples.where("example_id % 3 = 0").select(
        F.lit("m1").alias("model"),
        F.lit("plain").alias("condition"),
        "example_id",
        tx.number_lines(F.col("new")).alias("content"),
        F.lit(None).cast("string").alias("error"),
        F.lit(None).cast("timestamp").alias("ingest_ts"),
    )
    held.write.parquet(f"{base}/generations")
    right = F.concat(F.lit('{"answer": "'), F.col("correct_symbol"), F.lit('"}'))
    token = F.struct(F.col("correct_symbol").alias("token"), F.lit(-0.1).alias("logprob"))
    some = fanout.all_orderings(examples, "CTR").where("example_id % 2 = 0 and perm_idx % 2 = 0").select(
        F.lit("m1").alias("model"),
        F.lit("plain").alias("condition"),
        "task",
        "example_id",
        "perm_idx",
        F.when(F.col("perm_idx") > 0, right).alias("content"),
        F.when(F.col("perm_idx") > 0, F.array(token)).alias("logprobs"),
        F.when(F.col("perm_idx") == 0, "refused").alias("error"),
        F.lit(None).cast("timestamp").alias("ingest_ts"),
    )
    some.write.parquet(f"{base}/choices")
    total = examples.count()
    results = grid.run_grid(
        spark, examples, lambda model: _both_clients(), ("m0", "m1"), f"{base}/generations", f"{base}/choices",
        f"{base}/results", calls_at_once=2, calls_a_portion=30 * max(total, 1),
    )
    return _result_rows(results)


def rejects(spark: SparkSession, sf: str) -> DataFrame:
    """What an evaluation and a set of prompts turn away, as counted while they run.

    Some examples have no gold text, no review or too few options, and some answers no place.
    """
    i = F.col("example_id")
    uneven = t.examples(spark, sf).withColumns(
        {
            "new": F.when(i % 13 != 0, F.col("new")),
            "review": F.when(i % 17 != 0, F.col("review")),
            "old": F.when(i % 34 != 1, F.col("old")),
            "loc_wrong_easy": F.when(F.col("lang") == "fr", F.slice("loc_wrong_easy", 1, 2)).otherwise(F.col("loc_wrong_easy")),
            "solution_wrong_hard": F.when(i % 11 != 0, F.col("solution_wrong_hard")),
        }
    )
    astray = t.choices(spark, sf).withColumns(
        {
            "perm_idx": F.when(i % 19 == 0, F.col("perm_idx") + 30).otherwise(F.col("perm_idx")),
            "example_id": F.when(i % 23 == 0, -1 - i).otherwise(i),
        }
    )
    path, seen = session.fresh_path(spark, "rejects"), Rejects()
    evaluated = ev.evaluate(uneven, t.generations(spark, sf), astray, seen)
    evaluated.write.parquet(f"{path}/results")
    prompts.askable(uneven, seen).select("example_id").write.parquet(f"{path}/asked")
    counted = [(step, reason, n) for (step, reason), n in seen.counts().items()]
    return spark.createDataFrame(counted, "step string, reason string, n long")


def infer_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _asked_summaries(spark, sf)


# --- streaming -----------------------------------------------------------------------------


def _feed(answers: DataFrame, by: list[str], path: str) -> int:
    """Answers as files of two deliveries, half of the values of ``by`` in each; the files of the first.

    Every task writes what it derives, so no answer is shuffled on its way into the feed.
    """
    spark, half = answers.sparkSession, F.pmod(F.xxhash64(*by), F.lit(2))
    for delivery in (0, 1):
        answers.where(half == delivery).write.mode("append").parquet(path, compression="zstd")
        if delivery == 0:
            first = len(spark.read.schema(answers.schema).parquet(path).inputFiles())
    return max(first, 1)


def stream_scores(spark: SparkSession, sf: str) -> DataFrame:
    """All answers arrive as files in several micro-batches; totals of both kinds of tasks."""
    base = session.fresh_path(spark, "stream")
    stored.write_enriched(t.examples(spark, sf), f"{base}/examples", "json", "lz4")
    examples = spark.read.schema(schemas.EXAMPLES).json(f"{base}/examples")
    gold.store_gold_forms(examples, f"{base}/gold", rows_a_bucket=5000)
    texts = _feed(t.generations(spark, sf), ["ingest_ts"], f"{base}/texts")
    # the orderings of one example are spread over the files, and so over the batches
    choices = _feed(t.choices(spark, sf), ["perm_idx", "task"], f"{base}/choices")
    feeds = [
        streams.stream_generations(
            spark, f"{base}/texts", f"{base}/gold", f"{base}/text-scores", f"{base}/text-log", texts
        ),
        streams.stream_choices(
            spark, f"{base}/choices", f"{base}/slots", f"{base}/choice-log", choices
        ),
    ]
    for feed in feeds:
        feed.awaitTermination()
    texts = streams.generation_totals(spark, f"{base}/text-scores")
    keys = fanout.answer_keys(examples)
    choices = streams.choice_totals(spark, f"{base}/slots", keys)
    return rs.append_scores(
        texts.select("model", "condition", F.lit("ACR").alias("task"), "n", F.col("em").alias("hits")),
        choices.select("model", "condition", "task", "n", F.col("invariant").alias("hits")),
    )


QUERIES = {
    "read_examples": read_examples,
    "read_examples_array": read_examples_array,
    "read_benchmark_split": read_benchmark_split,
    "write_enriched": write_enriched,
    "read_results": read_results,
    "write_results_csv": write_results_csv,
    "final_report": final_report,
    "filter_lang": filter_lang,
    "eligible_for_task": eligible_for_task,
    "with_summary_condition": with_summary_condition,
    "language_label": language_label,
    "option_mode": option_mode,
    "task_code": task_code,
    "add_summary_column": add_summary_column,
    "summary_default": summary_default,
    "summary_status": summary_status,
    "summary_prompt": summary_prompt,
    "refine_prompt": refine_prompt,
    "change_type_prompt": change_type_prompt,
    "location_prompt": location_prompt,
    "solution_prompt": solution_prompt,
    "change_type_phrase": change_type_phrase,
    "latest_answers": latest_answers,
    "attach_generations": attach_generations,
    "attach_choice_answers": attach_choice_answers,
    "pending_work": pending_work,
    "upsert_results": upsert_results,
    "compare_conditions": compare_conditions,
    "build_options": build_options,
    "all_orderings": all_orderings,
    "correct_symbol": correct_symbol,
    "answer_keys": answer_keys,
    "option_count_check": option_count_check,
    "combinations": combinations,
    "clean_generation": clean_generation,
    "drop_line_numbers": drop_line_numbers,
    "symbol_scores": symbol_scores,
    "fallback_first_choice": fallback_first_choice,
    "pick_symbol": pick_symbol,
    "number_lines": number_lines,
    "strip_markers": strip_markers,
    "remove_comments": remove_comments,
    "words": words,
    "squash": squash,
    "line_offsets": line_offsets,
    "em": _one_metric("em", mx.em),
    "em_trim": _one_metric("em_trim", mx.em_trim),
    "em_no_space": _one_metric("em_no_space", mx.em_no_space),
    "em_no_comment": _one_metric("em_no_comment", mx.em_no_comment),
    "score_generation": score_generation,
    "jaccard": jaccard,
    "matching_answers": matching_answers,
    "orderings_by_position": orderings_by_position,
    "choice_records": choice_records,
    "refine_report": refine_report,
    "invariant_accuracy": invariant_accuracy,
    "invariant_change_type": _invariant_of("CTR"),
    "invariant_location": _invariant_of("CLE", "CLH"),
    "invariant_solution": _invariant_of("SIE", "SIH"),
    "avg_correct": avg_correct,
    "round_score": round_score,
    "results_pivot": results_pivot,
    "results_unpivot": results_unpivot,
    "progress": progress,
    "answer_positions": answer_positions,
    "by_ground_truth": by_ground_truth,
    "append_scores": append_scores,
    "evaluate": evaluate,
    "infer_generate": infer_generate,
    "infer_choice": infer_choice,
    "infer_choice_batch": infer_choice_batch,
    "infer_summary": infer_summary,
    "run_grid": run_grid,
    "rejects": rejects,
    "stream_scores": stream_scores,
}
