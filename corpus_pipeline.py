"""Toxic documents go, one of each group of near-duplicates stays, secrets are masked, and what is left is packed.

Every stage takes (spark, docs, sf_dir); docs is what the stage before kept, as a written table. All but the last return the
columns of documents. Null ids, null and empty texts, ties, repeated rows and empty tables behave as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinweave.llm import minhash, packing, secret_scan, toxicity
from kinweave.llm.common import documents
from kinweave.operators.tables import written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity model, learnt from the labels of these documents, doesn't reject."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of exact and near copies: the one with the smallest doc_id."""
    return minhash.drop_near_duplicates(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with secrets in their texts masked."""
    return secret_scan.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and offsets."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("minhash_near_dedup", one_of_each_group),
    ("secret_scan", without_secrets),
    ("best_fit_packing", packed),
]
#: Learnt weights, signatures and token ids are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
