"""Options, orderings, answer decoding and choice scores."""

import datetime as dt
import itertools
import json

import pytest
from pyspark.sql import functions as F

from gradelens import schemas, values as v
from gradelens.functions import answers as an
from gradelens.functions import options as op
from gradelens.operators import fanout, joins, rows, scoring


def example(i, **changed):
    base = {
        "example_id": i,
        "old": " a\n b",
        "new": "+a\n+c",
        "review": "r {summary} {lang}",
        "lang": "java",
        "type_correct": "modify",
        "type_wrong": ["add_only", "remove_only"],
        "loc_correct": [1, 2],
        "loc_wrong_easy": [[7], [8, 9], [10]],
        "loc_wrong_hard": [[1], [2], [2, 3]],
        "solution_correct": "s",
        "solution_wrong_easy": ["x", "y", "z"],
        "solution_wrong_hard": ["sx", "sy", "sz"],
        "summary": None,
    }
    return base | changed


def table(spark, *examples):
    names = [f.name for f in schemas.EXAMPLES]
    return spark.createDataFrame([tuple(e[n] for n in names) for e in examples], schemas.EXAMPLES)


@pytest.mark.parametrize("k", [3, 4])
def test_orderings_are_lexicographic_by_position(spark, k):
    got = spark.range(1).select(op.orderings(k).alias("o")).first().o
    assert [tuple(o) for o in got] == list(itertools.permutations(range(k)))


def test_first_equal_slot_gives_the_letter(spark):
    doubled = example(1, loc_wrong_easy=[[7], [1, 2], [10]])
    got = fanout.all_orderings(table(spark, doubled), "CLE").orderBy("perm_idx").collect()
    options = [[7], [1, 2], [10], [1, 2]]
    want = [
        "ABCD"[[options[i] for i in order].index([1, 2])]
        for order in itertools.permutations(range(4))
    ]
    assert [r.correct_symbol for r in got] == want
    assert [r.perm_options for r in got] == [
        [options[i] for i in order] for order in itertools.permutations(range(4))
    ]


def test_keys_agree_with_built_orderings_for_every_pattern(spark):
    wrongs = itertools.product("cw", repeat=3)
    examples = table(
        spark,
        *[
            example(i, solution_correct="c", solution_wrong_easy=list(w))
            for i, w in enumerate(wrongs)
        ],
    )
    keys = {r.example_id: r["keys"]["SIE"] for r in fanout.answer_keys(examples).collect()}
    built = fanout.all_orderings(examples, "SIE").orderBy("example_id", "perm_idx").collect()
    for i, group in itertools.groupby(built, key=lambda r: r.example_id):
        assert keys[i] == "".join(r.correct_symbol for r in group)


def test_every_letter_is_right_equally_often(spark):
    key = fanout.answer_keys(table(spark, example(1))).first()["keys"]
    assert all(key["CTR"].count(x) == 2 for x in "ABC")
    assert all(key["CLH"].count(x) == 6 for x in "ABCD")


def test_wrong_option_counts_and_removals_have_no_question(spark):
    examples = table(
        spark,
        example(1, loc_wrong_easy=[[7]]),
        example(2, type_correct="remove_only", solution_correct=None),
    )
    keys = {r.example_id: r["keys"] for r in fanout.answer_keys(examples).collect()}
    assert keys[1]["CLE"] is None and keys[1]["CLH"] is not None
    assert keys[2]["SIE"] is None and keys[2]["SIH"] is None and keys[2]["CLE"] is not None
    checked = fanout.option_count_check(examples, "CLE").select("example_id", "accepted").collect()
    assert {r.example_id: r.accepted for r in checked} == {1: False, 2: True}


JSON_TEXTS = [
    '{"answer": "A"}', '{"answer":"A"} x', '{"answer":', "1,2", "1],[2", '1,"w":2', "1}{", "NaN",
    '{"a":NaN}', '{"a":1,"a":2}', '"x"', "null", "[1,2]", "{}", "01", "{'a':1}", '{"a":1,}', "tru",
    "-Infinity", "-INF", "+INF", "+Infinity", "[INF]", '"INF +Infinity"', "NaN x", "+1", ".5", "// c\n1", '{"v":{"a":[1,{"b":null}]}}', "true", "nul", "[]",
]


def test_json_check_agrees_with_a_strict_parser(spark):
    def parses(text):
        try:
            json.loads(text)
        except ValueError:
            return False
        return True

    table = spark.createDataFrame([(i, c) for i, c in enumerate(JSON_TEXTS)], "i int, c string")
    got = table.select("i", an.is_json(F.col("c")).alias("ok")).orderBy("i").collect()
    assert [r.ok for r in got] == [parses(c) for c in JSON_TEXTS]


GOOD = '{"answer": "B"}'


@pytest.mark.parametrize(
    "content, tokens, scores, picked",
    [
        (GOOD, [("{", -1.0), (" B\n", -0.5)], [-9999, -0.5, -9999], "B"),
        (GOOD, [("B", -0.1), ("B", -5.0), ("A", -3.0)], [-3.0, -5.0, -9999], "A"),
        (GOOD, [("C", -1.0), ("B", -1.0)], [-9999, -1.0, -1.0], "B"),
        (GOOD, [("\xa0C\x1f", -1.0)], [-9999, -9999, -1.0], "C"),
        (GOOD, [], [-9999, -9999, -9999], "A"),
        (GOOD, None, [-9999, -9999, -9999], "A"),
        (" \n", [("C", -1.0)], [0, -9999, -9999], "A"),
        (None, [("C", -1.0)], [0, -9999, -9999], "A"),
        ('{"answer":', [("C", -1.0)], [0, -9999, -9999], "A"),
    ],
)
def test_symbol_scores(spark, content, tokens, scores, picked):
    given = spark.createDataFrame(
        [(content, tokens)], "content string, logprobs array<struct<token:string,logprob:double>>"
    )
    got = an.symbol_scores(F.col("content"), F.col("logprobs"), v.LETTERS[:3])
    row = given.select(got.alias("s"), an.pick_symbol(got).alias("p")).first()
    assert (row.s, row.p) == (scores, picked)


START = dt.datetime(2024, 1, 1)


def answer(letter, perm_idx, seconds=0, task="CTR", i=1, model="m"):
    return (
        model, "plain", task, i, perm_idx, GOOD, [(letter, -0.1)], None,
        START + dt.timedelta(seconds=seconds),
    )


def test_last_delivery_counts_and_missing_orderings_do_not_pass(spark):
    key = fanout.answer_keys(table(spark, example(1), example(2)))
    right = key.first()["keys"]["CTR"]
    wrong = "".join("B" if x == "A" else "A" for x in right)
    answers = [answer(x, p, 5) for p, x in enumerate(right)]
    answers += [answer(x, p, 1) for p, x in enumerate(wrong)]  # delivered earlier
    answers += [answer(x, p, 1, i=2) for p, x in enumerate(right[:5])]  # one is missing
    scored = scoring.score_choices(spark.createDataFrame(answers, schemas.CHOICES), key)
    got = {r.example_id: (r.matches, r.hit) for r in scored.collect()}
    assert got == {1: (6, 1), 2: (5, 0)}
    report = scoring.choice_report(scored).first()
    assert (report.n, report.invariant, report.value, report.avg_correct) == (2, 1, 50.0, 5.5)
    latest = joins.latest_answers(
        spark.createDataFrame(answers, schemas.CHOICES),
        ("model", "condition", "task", "example_id", "perm_idx"),
    )
    long = joins.attach_choice_answers(latest, key).collect()
    assert len(long) == 11 and all(r.picked == r.correct_symbol for r in long)


def test_letters_that_a_task_does_not_offer_are_not_picked(spark):
    given = spark.createDataFrame([answer("D", 0), answer("D", 0, task="CLE")], schemas.CHOICES)
    got = {r.task: r.pick for r in joins.decode_answers(given).collect()}
    assert got == {"CTR": 0, "CLE": 3}


def test_unknown_names_are_refused(spark):
    examples = table(spark, example(1))
    with pytest.raises(ValueError):
        rows.option_mode(examples, "location", ("medium",))
    with pytest.raises(ValueError):
        rows.eligible_for_task(examples, "XYZ")
    with pytest.raises(ValueError):
        rows.with_summary_condition(examples, ("none",))
    odd = table(spark, example(1, type_correct="rename"))
    with pytest.raises(Exception, match="unknown change type"):
        odd.select(op.change_type_phrase(F.col("type_correct"))).collect()
    with pytest.raises(Exception, match="unknown mode"):
        odd.select(rows.task_code("location", F.col("lang"))).collect()


def test_picks_of_padded_tokens_and_odd_contents(spark):
    """A token with whitespace counts as its letter; content is read as before, with any whitespace around it."""
    usual = '{"answer": "A"}'
    cases = [
        (usual, [("A", -3.0), ("B", -1.0)], "B"),
        (usual, [(" A", -0.2), ("B", -1.0)], "A"),
        (usual, [("x\x00", -0.1), ("　C\n", -0.5), ("B", -1.0)], "C"),
        (usual, [("x\x00 A", -0.1), ("B", -1.0)], "B"),
        (usual, [(None, -0.1), (" D ", -0.4), ("B", -1.0)], "D"),
        ("\x85" + usual + " ", [("B", -1.0)], "B"),
        ('　{"answer"\x0b: "A"}', [("B", -1.0)], "B"),
        (usual + "\n", [("B", -1.0)], "B"),
        (usual + " x", [("B", -1.0)], "A"),
        ("[1, NaN]", [("B", -1.0)], "B"),
        (None, [("B", -1.0)], "A"),
        (usual, None, "A"),
        (usual, [], "A"),
    ]
    rows_ = [("m", "plain", "CLE", i, 0, c, t, None, None) for i, (c, t, _) in enumerate(cases)]
    scored = joins.task_scores(spark.createDataFrame(rows_, schemas.CHOICES))
    assert scored.columns == [*schemas.CHOICES.names, "scores"]
    got = scored.select("example_id", an.pick_symbol(F.col("scores")).alias("p")).orderBy("example_id").collect()
    assert [r.p for r in got] == [p for _, _, p in cases]


def test_usual_answers_are_built_and_read_without_a_step_per_entry(spark, small):
    """Answers come out of a literal table, and tokens are walked only where whitespace pads a letter."""
    from workload import tables

    plan = tables.choices(spark, small)._jdf.queryExecution().analyzed().toString()
    assert "lambdafunction" not in plan
    tokens = F.array(F.lit("{"), F.raise_error(F.lit("walked")).cast("string"))
    quick = F.when(F.lit(True), F.array(F.lit("{"), F.lit("A"))).otherwise(tokens)
    assert spark.range(1).select(an.stripped_tokens(quick).alias("t")).first().t == ["{", "A"]


def test_content_cut_short_is_turned_away_without_a_parser(spark):
    """What the first and last characters settle is what the parser says, for every kind of value."""
    values = ["{}", '{"a": [1, "}"]}', "[]", "[{}]", '"x"', '"\\""', "1", "-2.5e3", "true", "null", "NaN", "x", "'a'"]
    ends = ["", " x", ",", "}", "]", '"', "\x00", "//c", ", 1", ', "k": 1', " {}", "\\"]
    texts = [*(value + end for value in values for end in ends), *(v[:i] for v in values for i in range(1, len(v)))]
    frame = spark.createDataFrame([(x,) for x in dict.fromkeys(x.strip() for x in texts)], "x string").where("x <> ''")
    rows = frame.select("x", an.is_json(F.col("x")).alias("want"), an.valid_content(F.lit(False), F.col("x")).alias("got"), an._closed(F.col("x")).alias("closed")).collect()
    assert [(r.x, r.got) for r in rows] == [(r.x, r.want) for r in rows]
    assert sum(not r.closed for r in rows) > 40 and {"{}", '"x"', "null"} <= {r.x for r in rows if r.want}
