"""Text normalisers and metrics against plain Python over awkward texts."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from gradelens.functions import answers as an
from gradelens.functions import metrics as mx
from gradelens.functions import text as tx

TOYS = [
    "",
    " ",
    "\n",
    "\n\n a",
    "a//x\r\nb",
    "a//x\rb",
    "a//x\u2028b\nc",
    "/* un",
    "/* a\n b */c/**/d",
    "http://u/v",
    "#include <x>\nint a;",
    "x\n\n\n  # note\ny",
    "a\xa0b\x1fc\u3000d\x85e",
    "tail\n\n",
    "\U0001f600x\n\U0001f600y",
    "a b\n12 c\n123 d",
    "x # not first\n\t#first",
]


def random_texts(count, seed):
    rng = random.Random(seed)
    alphabet = ["a", "b", "ab", " ", "  ", "\n", "\t", "\r", "\xa0", "\u2028", "#", "//", "/*", "*/", "\xe9", "\U0001f600"]
    return ["".join(rng.choices(alphabet, k=rng.randrange(0, 14))) for _ in range(count)]


TEXTS = TOYS + random_texts(300, 1)


def applied(spark, texts, expression):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    return [r.x for r in rows.select("i", expression(F.col("s")).alias("x")).orderBy("i").collect()]


def numbered(s):
    return "\n".join(f"{i} {line[1:]}" for i, line in enumerate(s.split("\n"), 1))


def bare(s):
    s = re.sub(r"/\*(?:.|\n)*?\*/|//[^\n]*", "", s)
    return re.sub(r"(?m)^\s*#[^\n]*", "", s)


@pytest.mark.parametrize(
    "column, plain",
    [
        (tx.strip, str.strip),
        (tx.words, str.split),
        (tx.squash, lambda s: "".join(s.split())),
        (tx.spaced, lambda s: " ".join(s.split())),
        (tx.number_lines, numbered),
        (tx.strip_markers, lambda s: "\n".join(x[1:] for x in s.split("\n"))),
        (tx.drop_line_numbers, lambda s: "\n".join(x[2:] for x in s.split("\n"))),
        (tx.remove_comments, bare),
    ],
)
def test_normalisers(spark, column, plain):
    assert applied(spark, TEXTS, column) == [plain(s) for s in TEXTS]


def starts_of(lengths):
    return [0, *itertools.accumulate(lengths)]


def plain_trim(gold, pred):
    want, have = gold.split(), pred.split()
    starts = starts_of(len(x) for x in pred.split("\n"))
    return int(any(j + len(want) <= len(have) and have[j : j + len(want)] == want for j in starts))


def plain_no_space(gold, pred):
    want, have = "".join(gold.split()), "".join(pred.split())
    starts = starts_of(len("".join(x.split())) for x in pred.split("\n"))
    return int(any(have[j : j + len(want)] == want for j in starts))


def plain_jaccard(left, right):
    a, b = ({*x.split(), *re.findall("[a-zA-Z]+", x)} for x in (left, right))
    return len(a & b) / len(a | b) if a | b else 0.0


PLAIN = {
    "em": lambda g, p: int(g.split() == p.split()),
    "em_trim": plain_trim,
    "em_no_space": plain_no_space,
    "em_no_comment": lambda g, p: plain_no_space(bare(g), bare(p)),
}


def metric_pairs():
    rng = random.Random(7)
    golds = TOYS + random_texts(250, 2)
    pairs = [(g, p) for g in golds for p in (g, g + "\nt", "ab\nq " + g, "x" + g, "i\n" + g, g[1:])]
    pairs += [(rng.choice(golds), rng.choice(golds)) for _ in range(500)]
    return pairs + [("", ""), ("a", "")]


def test_metrics(spark):
    pairs = metric_pairs()
    rows = spark.createDataFrame(
        [(i, g, p) for i, (g, p) in enumerate(pairs)], "i int, gold string, generation string"
    )
    columns = [
        getattr(mx, name)(F.col("gold"), F.col("generation")).alias(f"{name}_column")
        for name in mx.METRICS
    ]
    got = mx.score_generation(rows.select("*", *columns)).orderBy("i").collect()
    for (gold, pred), row in zip(pairs, got, strict=True):
        for name, plain in PLAIN.items():
            want = plain(gold, pred)
            assert (row[name], row[f"{name}_column"]) == (want, want), (name, gold, pred)
    hits = {name: sum(r[name] for r in got) for name in mx.METRICS}
    assert all(0 < n < len(pairs) for n in hits.values())


def test_equal_words_imply_the_looser_metrics(spark):
    rows = spark.createDataFrame(metric_pairs(), "gold string, generation string")
    broken = mx.score_generation(rows).where("em = 1 AND (em_trim = 0 OR em_no_space = 0)")
    assert broken.count() == 0


def test_jaccard(spark):
    pairs = metric_pairs()
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = rows.select("i", mx.jaccard(F.col("a"), F.col("b")).alias("x")).orderBy("i").collect()
    assert [r.x for r in got] == pytest.approx([plain_jaccard(*p) for p in pairs])


def test_matching_answers_stops_at_the_shorter_list(spark):
    rows = spark.createDataFrame(
        [(["A", "B"], ["A", "B", "C"]), ([], ["A"]), (["C", "B", "A"], ["A", "B"])],
        "a array<string>, b array<string>",
    )
    got = rows.select(mx.matching_answers(F.col("a"), F.col("b")).alias("x")).collect()
    assert [r.x for r in got] == [2, 0, 1]


@pytest.mark.parametrize(
    "content, cleaned",
    [
        ("```python\n1 a\n```", "1 a"),
        ("```\n[code]\n1 a\n[/code]\n```\n", "1 a"),
        ("[code]\n1 a\n[/code]", "1 a"),
        ("``````", ""),
        ("1 a\n\n```", "1 a\n"),
        ("x[/a]\n```", "x"),
        ("  1 a\xa0", "1 a"),
        ("1 a ``` b", "1 a ``` b"),
        ("[a][b]", "[b]"),
    ],
)
def test_clean_generation(spark, content, cleaned):
    assert applied(spark, [content], an.clean_generation) == [cleaned]


def test_two_characters_are_cut_from_long_line_numbers_too(spark):
    assert applied(spark, ["9 a\n10 b\n100 c"], tx.drop_line_numbers) == ["a\n b\n0 c"]
