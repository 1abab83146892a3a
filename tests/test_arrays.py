"""One JSON array file, cut into byte ranges of a few bytes, against a plain JSON reader."""

import json
import random

import pytest
from pyspark.sql import types as T

from gradelens.sources import arrays

TEXT = T.StringType()
PAIRS = T.ArrayType(T.StructType([T.StructField("f", TEXT)]))
SCHEMA = T.StructType(
    [
        T.StructField("a", TEXT),
        T.StructField("b", T.ArrayType(T.ArrayType(T.IntegerType()))),
        T.StructField("c", T.StructType([T.StructField("d", TEXT), T.StructField("e", PAIRS)])),
    ]
)
NASTY = ['"', "\\", "}", "{", "[", "]", ",", "\n", "\\\"", "é", "😀", "x", " ", " ", "}{", "]}", "\\}"]


@pytest.fixture(scope="module")
def small_ranges(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for key, value in zip(old, ("97", "1")):
        spark.conf.set(key, value)
    yield spark
    for key, value in old.items():
        spark.conf.set(key, value)


def element(rng):
    text = lambda: "".join(rng.choice(NASTY) for _ in range(rng.randrange(12)))
    out = {}
    if rng.random() < 0.9:
        out["a"] = text()
    if rng.random() < 0.6:
        out["b"] = [[rng.randrange(9) for _ in range(rng.randrange(3))] for _ in range(rng.randrange(3))]
    if rng.random() < 0.6:
        out["c"] = {"d": text(), "e": [{"f": text()} for _ in range(rng.randrange(3))]}
    return out


def plain(row):
    out = row.asDict(True)
    out.pop("place")
    return out


def wanted(e):
    c = e.get("c")
    return {"a": e.get("a"), "b": e.get("b"), "c": c and {"d": c["d"], "e": [{"f": x["f"]} for x in c["e"]]}}


@pytest.mark.parametrize("form", [{}, {"indent": 2}, {"ensure_ascii": False}, {"separators": (",", ":")}])
def test_objects_are_those_of_a_plain_reader(small_ranges, tmp_path, form):
    rng = random.Random(len(form) + 4)
    elements = [element(rng) for _ in range(60)]
    (tmp_path / "x.json").write_text(" \n" * ("indent" in form) + json.dumps(elements, **form) + "\n" * ("indent" in form))
    frame = arrays.read_array(small_ranges, str(tmp_path / "x.json"), SCHEMA)
    assert arrays._pieces(small_ranges, str(tmp_path / "x.json")).select("range").distinct().count() > 20
    got = {r.place: plain(r) for r in frame.collect()}
    assert got == {i: wanted(e) for i, e in enumerate(elements)}


def test_files_follow_each_other_by_name(small_ranges, tmp_path):
    rng = random.Random(3)
    parts = [[element(rng) for _ in range(n)] for n in (7, 0, 1, 12)]
    for i, part in enumerate(parts):
        (tmp_path / f"{i}.json").write_text(json.dumps(part))
    got = {r.place: plain(r) for r in arrays.read_array(small_ranges, str(tmp_path), SCHEMA).collect()}
    assert got == {i: wanted(e) for i, e in enumerate(e for part in parts for e in part)}


@pytest.mark.parametrize("text", ['[{"a": "x"}', '[{"a": "x"}] {', '{"a": "x"}', '[{"a": "x"} {"a": "y"}]', '[{"a": "x"}, 3]', '[{"a": "x}]', '[{"a": }]', "[1, 2]", '[{"a": "x"}]]', "x"])
def test_anything_else_is_an_error(small_ranges, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(Exception, match="no array of objects|MALFORMED|FAILFAST"):
        arrays.read_array(small_ranges, str(tmp_path / "x.json"), SCHEMA).collect()
