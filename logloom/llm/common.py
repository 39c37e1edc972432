"""Helpers shared by the corpus operators: durable cuts, batches, keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.plans.durable import cut

__all__ = ["arrow_map", "cut", "doc_crc", "small_batches", "table"]

#: Rows of an Arrow batch handed to Python: with texts of a few KB a batch stays at some MB.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH_ROWS`` rows, so that long texts cannot fill a Python worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def arrow_map(
    df: DataFrame,
    fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: str,
) -> DataFrame:
    """``mapInArrow`` with small batches."""
    small_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


def doc_crc(doc_id: str = "doc_id") -> Column:
    """crc32 of the decimal text of an id."""
    return F.crc32(F.col(doc_id).cast("string"))
