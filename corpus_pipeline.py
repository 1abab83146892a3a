"""From raw documents to packed training sequences: five stages, each one of the operators in llm/.

Every stage reads what the one before it wrote, works on all of it, and, but for the last, returns
the columns of documents. Documents are dropped by toxicity (its language's threshold), near-copies
(one document of each group stays, five-word shingles at 0.8) and benchmark passages; personal data
are masked in place; what remains is packed.

Cases: each stage keeps the cases of its operator. Rows with a null doc_id are not judged as copies
or by benchmark passages and stay; rows that share a doc_id stay or go together; null texts stay null
until packing, where they are an end token. Extra columns pass through the first four stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import decontamination, minhash, packing, pii, toxicity
from llm.common import cut, read
from llm.queries import tokenizer_path

#: Some stages cannot be written in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(spark, docs, read(spark, sf_dir, "labels"))
    name = "toxic_score"
    while name in map(str.lower, docs.columns):
        name += "_"
    return toxicity.score(spark, docs, model, name).where(F.col(name) < toxicity.threshold(model)).drop(name)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = minhash.near_duplicates(spark, docs).where("not kept").select(F.col("doc_id").alias("gone"))
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(spark, docs, read(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_passages),
    ("pii", mask_personal_data),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(spark, stage(spark, docs, sf_dir), name)
    return docs
