"""Synthetic logs as a data source of Spark's own kind, for batches and streams.

    register(spark)
    spark.read.format("synthetic_logs").option("rows", 1_000_000).load().where("row_id >= 500000")
    spark.readStream.format("synthetic_logs").option("rowsPerBatch", 1000).load()

Rows are those of ``synth.synthetic_logs``: a row is a function of its number, so partitions are ranges of numbers, made
where they are read, and the offset of a stream is the number of its next row: a restarted
stream goes on there. Bounds on row_id narrow the ranges before any row is made.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from logloom.model import ERROR, INFO, VERBOSE, WARNING
from logloom.sources.synth import HASH_MULTIPLIER, NEEDLE_EVERY, WORDS

SCHEMA = "row_id long, log_time timestamp_ntz, level int, message string"
#: Rows of an Arrow batch; of a partition at least.
BATCH, PARTITION_ROWS = 10_000, 100_000


@dataclass
class Range(InputPartition):
    low: int
    high: int


def ranges(low: int, high: int, partitions: int) -> list[Range]:
    """About equal ranges of row numbers."""
    n = max(1, min(partitions, high - low))
    cuts = [low + (high - low) * i // n for i in range(n + 1)]
    return [Range(a, b) for a, b in zip(cuts, cuts[1:]) if a < b]


def batches(part: Range) -> Iterator:
    """The rows of a range as Arrow batches."""
    import numpy as np
    import pyarrow as pa

    kinds = pa.schema([("row_id", pa.int64()), ("log_time", pa.timestamp("us")), ("level", pa.int32()), ("message", pa.string())])
    start = np.datetime64("2025-01-01T00:00:00", "us").astype(np.int64)
    for first in range(part.low, part.high, BATCH):
        i = np.arange(first, min(first + BATCH, part.high), dtype=np.int64)
        level = np.select([i % 20 == 0, i % 7 == 0, i % 13 == 0], [ERROR, WARNING, VERBOSE], INFO).astype(np.int32)
        mixed = (i.astype(np.uint64) * np.uint64(HASH_MULTIPLIER)) % np.uint64(1 << 32)
        words = [(mixed >> np.uint64(4 * k)) % np.uint64(len(WORDS)) for k in range(3)]
        messages = [
            f"entry {WORDS[a]} {WORDS[b]} {WORDS[c]} line {n}" + (f" NEEDLE_{n // NEEDLE_EVERY}" if n % NEEDLE_EVERY == 0 else "")
            for n, a, b, c in zip(i.tolist(), *(w.astype(np.int64).tolist() for w in words))
        ]
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(start + i * 1_000_000).cast(pa.timestamp("us")), pa.array(level), pa.array(messages)], schema=kinds)


class _Batch(DataSourceReader):
    def __init__(self, rows: int, partitions: int):
        self.low, self.high, self.parts = 0, rows, partitions

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds on row_id are taken; the others stay Spark's."""
        for f in filters:
            own = getattr(f, "attribute", None) == ("row_id",) and isinstance(getattr(f, "value", None), int)
            if own and isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            if own and isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                self.high = min(self.high, f.value + (not isinstance(f, LessThan)))
            if not (own and isinstance(f, (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, EqualTo))):
                yield f

    def partitions(self) -> list[Range]:
        return ranges(self.low, self.high, self.parts) or [Range(0, 0)]

    def read(self, partition: Range) -> Iterator:
        return batches(partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, rows: int, partitions: int, rows_per_batch: int):
        self.rows, self.parts, self.step, self.at = rows, partitions, rows_per_batch, None

    def initialOffset(self) -> dict:
        return {"row": 0}

    def latestOffset(self) -> dict:
        """One batch further than the last time; a restarted stream repeats the batch that was planned and goes on behind it."""
        self.at = min(self.rows, (self.at or 0) + self.step)
        return {"row": self.at}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        self.at = max(self.at or 0, end["row"])
        return ranges(start["row"], end["row"], self.parts)

    def read(self, partition: Range) -> Iterator:
        return batches(partition)

    def commit(self, end: dict) -> None:
        self.at = max(self.at or 0, end["row"])


class SyntheticLogs(DataSource):
    """Options: rows (the end of the data, for batches and streams), partitions (one for each 100 000 rows if not given), rowsPerBatch (of streams)."""

    @classmethod
    def name(cls) -> str:
        return "synthetic_logs"

    def schema(self) -> str:
        return SCHEMA

    def _rows(self) -> int:
        return int(self.options.get("rows", 1000))

    def _parts(self, rows: int) -> int:
        return int(self.options.get("partitions", 0)) or -(-rows // PARTITION_ROWS) or 1

    def reader(self, schema) -> _Batch:
        return _Batch(self._rows(), self._parts(self._rows()))

    def streamReader(self, schema) -> _Stream:
        step = int(self.options.get("rowsPerBatch", 1000))
        return _Stream(self._rows(), self._parts(step), step)


def register(spark: SparkSession) -> None:
    """Makes ``synthetic_logs`` a format of the session, and lets filters reach sources of its kind, which Spark asks for."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SyntheticLogs)
