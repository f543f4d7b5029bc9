"""A training corpus from raw documents, in five stages; each is written as Parquet and read again by the next.

toxicity: documents that score 0.5 or more go. near_duplicates: one document of
each component stays. personal_data: base spans and disclosing terms are
replaced. mixing: sources are replicated to equal weights in a global random
order. encoding: ids of every text.

Every stage takes null and empty texts (nothing to find; they pass), null ids
(rows of their own in the first three stages, alike in their draws in mixing),
repeated rows (near_duplicates keeps one of each id and text), very long texts
(whole), empty tables (no rows) and further columns, which it passes on as they
are, whatever their names; encoding returns its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.llm.common import cut, ship, table
from lexigrove.llm.op4_toxicity import keep_clean
from lexigrove.llm.op5_mixing import mix
from lexigrove.llm.op6_minhash import keep_first
from lexigrove.llm.op7_pieces import encoded, model_path
from lexigrove.llm.op9_pii import redacted


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_clean(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return keep_first(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redacted(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs, marks=False)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return encoded(docs, model_path()).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixing", mixing), ("encoding", encoding)]

#: SQL cannot express the fitted field, the signatures or the merge rounds; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
