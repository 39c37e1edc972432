"""Counts, facets, histograms, templates: grouped aggregates with map-side combine."""

from __future__ import annotations

import time
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from logloom.functions.text import EXAMPLE_LENGTH, cut_text, template
from logloom.model import LEVELS, level_name
from logloom.plans.spec import FilterSpec, apply_filters, with_hit

FACET_FIELDS = {
    "provider": "provider", "source": "source", "level": "level", "taskname": "task_name", "task": "task_name", "processname": "process_name",
    "processid": "process_id", "pid": "process_id", "channel": "channel", "eventid": "event_id", "machinename": "machine_name", "username": "username",
}


def counts(df: DataFrame, spec: FilterSpec) -> DataFrame:
    """total, filtered: one row."""
    return with_hit(df, spec).agg(F.count(F.lit(1)).alias("total"), F.count_if("_hit").alias("filtered"))


def level_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("level").agg(F.count(F.lit(1)).alias("n")).select("level", level_name(F.col("level")).alias("level_name"), "n").orderBy("level")


def distinct_levels(df: DataFrame) -> DataFrame:
    return df.select("level").distinct().orderBy("level")


def source_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source")


def source_type_counts(df: DataFrame) -> DataFrame:
    from logloom.sources.folder import source_type

    return df.groupBy(source_type(F.col("source")).alias("source_type")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source_type")


def _grouped_ci(df: DataFrame, value: Column) -> DataFrame:
    """key, value, n: rows per value ignoring case; each group shows the spelling of its first row.

    Spellings are counted first, by hash aggregation with buffers of fixed size; only distinct ones are put together.
    """
    spelled = df.select(value.alias("value"), "row_id").groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first"))
    return spelled.groupBy(F.lower("value").alias("key")).agg(F.min_by("value", "first").alias("value"), F.sum("n").alias("n"))


def field_counts(df: DataFrame, column: str) -> DataFrame:
    """value, n: rows per value of a column, ignoring case."""
    return _grouped_ci(df, F.col(column)).select("value", "n").orderBy(F.desc("n"), "value")


def facet_excluding_self(df: DataFrame, spec: FilterSpec, column: str, cap: int = 100) -> DataFrame:
    """Values of a field under all filters but its own: the most common ones, shown in alphabetical order."""
    return field_counts(apply_filters(df, spec.without(column)), column).limit(cap).orderBy(F.lower("value"), "value")


def facets(df: DataFrame, field: str, limit: int = 20) -> DataFrame:
    """value, n: most common values of a field, ``(none)`` for empty ones."""
    column = FACET_FIELDS.get((field or "").strip().lower())
    if column is None:
        raise ValueError(f"unknown facet field '{field}', try one of {', '.join(sorted(set(FACET_FIELDS)))}")
    text = level_name(F.col("level")) if column == "level" else F.col(column)
    value = F.when(F.coalesce(text, F.lit("")) == "", "(none)").otherwise(text)
    return _grouped_ci(df, value).orderBy(F.desc("n"), "key").limit(limit if limit > 0 else 20).select("value", "n")


def top_patterns(df: DataFrame, limit: int = 20) -> DataFrame:
    """template, n, example: what the messages mostly say.

    Templates are counted with buffers of fixed size; the messages of the few first rows are looked up afterwards.
    """
    rows = df.where(F.trim("message") != "")
    grouped = rows.groupBy(template(F.col("message")).alias("template")).agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("row_id"))
    top = grouped.orderBy(F.desc("n"), "template").limit(limit if limit > 0 else 20)
    found = rows.select("row_id", "message").join(F.broadcast(top), "row_id")  # at most ``limit`` rows
    return found.select("template", "n", cut_text(F.col("message"), EXAMPLE_LENGTH).alias("example")).orderBy(F.desc("n"), "template")


def time_range(df: DataFrame) -> DataFrame:
    return df.agg(F.min("log_time").alias("first_time"), F.max("log_time").alias("last_time"))


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def _bucketed(df: DataFrame, buckets: int, group: list[str]) -> DataFrame:
    """lo, hi, bucket, group, n; bucket edges are whole microseconds. The range is a scalar subquery."""
    if not 1 <= buckets <= 200:
        raise ValueError("buckets must be from 1 to 200")
    rows = df.where("log_time is not null").select(_micros(F.col("log_time")).alias("t"), *group)
    placed = rows.withColumns({"lo": rows.agg(F.min("t").alias("lo")).scalar(), "hi": rows.agg(F.max("t").alias("hi")).scalar()})
    bucket = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.expr(f"((t - lo) * {buckets}) div (hi - lo)"), F.lit(buckets - 1)))
    return placed.withColumn("bucket", bucket.cast("int")).groupBy("lo", "hi", "bucket", *group).agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, buckets: int = 20) -> DataFrame:
    """bucket, from_micros, to_micros, n over the time range of the rows; buckets are half-open, the last one closed.

    Empty buckets are there with 0; one bucket if all rows have one time; none without times.
    """
    found = _bucketed(df, buckets, [])
    every = found.select("lo", "hi").distinct().withColumn("bucket", F.explode(F.sequence(F.lit(0), F.when(F.col("hi") == F.col("lo"), 0).otherwise(buckets - 1))))
    edge = lambda k: F.col("lo") + F.expr(f"({k} * (hi - lo)) div {buckets}")
    return (
        every.join(found.select("bucket", "n"), "bucket", "left")
        .select("bucket", edge("bucket").alias("from_micros"), F.when(F.col("hi") == F.col("lo"), F.col("hi")).otherwise(edge("(bucket + 1)")).alias("to_micros"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))
        .orderBy("bucket")
    )


def density(df: DataFrame, buckets: int = 48) -> DataFrame:
    """bucket, level, n of the buckets and levels that have rows."""
    return _bucketed(df, buckets, ["level"]).select("bucket", "level", "n").orderBy("bucket", "level")


def density_wide(df: DataFrame, buckets: int = 48) -> DataFrame:
    """One row per bucket, one column per level."""
    return density(df, buckets).groupBy("bucket").pivot("level", list(range(len(LEVELS)))).agg(F.sum("n")).na.fill(0).orderBy("bucket")


def summary(df: DataFrame, spec: FilterSpec) -> DataFrame:
    """One row: totals, rows per level, time range and number of sources of the filtered rows, in one pass."""
    return with_hit(df, spec).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("_hit").alias("filtered"),
        *[F.count_if(F.col("_hit") & (F.col("level") == i)).alias(name.lower()) for i, name in enumerate(LEVELS)],
        F.min(F.when(F.col("_hit"), F.col("log_time"))).alias("first_time"), F.max(F.when(F.col("_hit"), F.col("log_time"))).alias("last_time"),
        F.count_distinct(F.when(F.col("_hit"), F.col("source"))).alias("sources"),
    )


def provider_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("provider").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "provider")


def provider_by_source(df: DataFrame) -> DataFrame:
    """Load report: rows per provider and source."""
    return df.groupBy("provider", "source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "provider", "source")


def files_per_reader(df: DataFrame) -> DataFrame:
    """Load report: distinct sources and rows per source type."""
    from logloom.sources.folder import source_type

    return df.groupBy(source_type(F.col("source")).alias("reader")).agg(F.count_distinct("source").alias("files"), F.count(F.lit(1)).alias("rows")).orderBy("reader")


def inventory(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row of totals, one row per provider) of a trace: events, lost, kernel and self-describing, times, GUIDs."""
    lost = F.coalesce(F.try_element_at("fields", F.lit("EventsLost")).try_cast("long"), F.lit(0))
    kernel = F.lower("provider").contains("kernel")
    totals = df.agg(
        F.count(F.lit(1)).alias("events"), F.sum(lost).alias("lost"), F.count_if(kernel).alias("kernel"), F.count_if(~kernel & (F.col("provider_guid") == "")).alias("self_describing"),
        F.min("log_time").alias("first_time"), F.max("log_time").alias("last_time"), (F.max(_micros(F.col("log_time"))) - F.min(_micros(F.col("log_time")))).alias("duration_micros"),
        F.count_distinct("provider").alias("providers"),
    )
    each = df.groupBy("provider").agg(F.count(F.lit(1)).alias("n"), F.max("provider_guid").alias("guid")).orderBy(F.desc("n"), "provider")
    return totals, each


def has_two_values(df: DataFrame, column: str) -> bool:
    return df.select(column).distinct().limit(2).count() == 2


def run_report(timings: dict[str, tuple[float, int]]):
    """step, seconds, records, per_second rows of a run's steps."""
    return [{"step": k, "seconds": s, "records": n, "per_second": n / s if s else None} for k, (s, n) in timings.items()]


class RunReport:
    """Seconds and records of the steps of a run. Records are counted while a step's own job runs, by Spark's observed metrics: no job counts them."""

    def __init__(self):
        self._seen: dict[str, Observation] = {}
        self._seconds: dict[str, float] = {}

    def observed(self, df: DataFrame, step: str) -> DataFrame:
        """``df`` whose rows count as the step's records when the first action on it runs."""
        self._seen[step] = Observation(step)
        return df.observe(self._seen[step], F.count(F.lit(1)).alias("records"))

    @contextmanager
    def timed(self, step: str):
        began = time.perf_counter()
        try:
            yield
        finally:
            self._seconds[step] = self._seconds.get(step, 0.0) + time.perf_counter() - began

    def rows(self) -> list[dict]:
        """One row for each step that was timed; records are 0 for a step whose rows were not observed."""
        return run_report({step: (s, self._seen[step].get["records"] if step in self._seen else 0) for step, s in self._seconds.items()})
