"""The labelled sample that classifiers are fitted on.

At most ``SAMPLE`` labelled documents are used, chosen by a hash of doc_id: a documented bound, so
the sample can be broadcast and its features can go to the driver whatever the corpus's size.
Documents in the held-out fold are never among them. Texts of any length are fitted on and scored
whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import crc_fold

SAMPLE = 8_000


def sample(labels: DataFrame, column: str, bound: int = SAMPLE) -> DataFrame:
    """doc_id, label: at most ``bound`` rows outside the held-out fold. Repeated rows: the greater label."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & (crc_fold() != 0))
    known = known.groupBy("doc_id").agg(F.max(F.col(column).cast("int")).alias("label"))
    return known.orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(bound)


def fitting_rows(docs: DataFrame, labels: DataFrame, column: str, bound: int = SAMPLE) -> DataFrame:
    """doc_id, text, lang, label of the sample; the sample is broadcast, as its size is bounded."""
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    docs = docs.select("doc_id", "text", lang.alias("lang"))
    return docs.join(F.broadcast(sample(labels, column, bound)), "doc_id")
