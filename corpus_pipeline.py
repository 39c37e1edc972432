"""The corpus pipeline: documents through the stages of a training-data clean-up.

Each stage takes the documents that its predecessor kept and returns those it
keeps, with the columns of documents; the last one returns the packed pieces.
SQL cannot express the stages, so there is no oracle; tests hold them against
brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logloom.llm import decontam, langid, neardup, packing, secret_scan
from logloom.llm.common import table
from logloom.llm.queries import tokenizer_path
from logloom.plans.durable import scratch

ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have letters and are not random letters or in a script without a labelled language."""
    sample = langid.fit_sample(docs.select("doc_id", "text", "lang"))
    return langid.in_known_language(docs, sample) if sample else docs


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return neardup.one_of_each_class(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontam.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets_redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, live-looking secrets replaced."""
    return secret_scan.redact(docs, "source")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language_id", language),
    ("near_dedup", near_duplicates),
    ("decontaminate", benchmark_free),
    ("secrets", secrets_redacted),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another on documents; each but the last is written as Parquet into the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
