"""A corpus pipeline of five stages, each one of the llm operators over all that its predecessor kept.

Stages take (spark, docs, sf_dir) and return a DataFrame, which is written as
Parquet and read again as the next one's docs.  All but the last return the
columns of documents, extra ones included, whatever their names.

Null and empty texts, very long texts, ties, repeated rows and empty tables have in each
stage the result that its operator states; documents without text pass all stages and end
as one separator id.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidal.llm import decontamination, jaccard_join, queries, secrets, toxicity
from tidal.llm.store import shared_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar doesn't reject (score under 0.5)."""
    return toxicity.accepted(docs, toxicity.fit(docs, queries.table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 or more over five-word shingles."""
    return jaccard_join.one_of_each_group(docs, k=5, percent=80)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontamination.without_leaks(docs, queries.table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark."""
    return secrets.redact(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 1024 tokens."""
    return queries.packed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("secrets", redact_secrets),
    ("packing", pack_windows),
]

#: Learned scores and tokenisation can't be written in SQL; tests hold stages and run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline over the documents table."""
    docs = queries.table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
