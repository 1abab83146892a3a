"""Registered queries against their SQL on the smallest tables.

``python -m workload.check DIR`` compares all of them; here is one of every family.
"""

import pytest

import __spark_entry__ as driver
from workload.check import connect, difference
from workload.oracle import ORACLE
from workload.queries import QUERIES

FAMILIES = [
    "filter_lang",
    "change_type_prompt",
    "solution_prompt",
    "attach_generations",
    "answer_keys",
    "fallback_first_choice",
    "score_generation",
    "jaccard",
    "infer_summary",
    "round_score",
    "evaluate",
]


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLE.keys()
    assert QUERIES.keys() | driver.oracle_sql().keys() <= driver.queries().keys()


@pytest.mark.parametrize("name", FAMILIES)
def test_query_equals_sql(spark, small, name):
    assert difference(spark, connect(small), name, small) is None


def test_entry(spark):
    assert driver.entry(spark).count() == 24
