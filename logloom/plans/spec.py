"""Active filters and sorts as values, compiled to one condition or ordering."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.parse import time_literal
from logloom.functions.text import contains_ci, isin_ci
from logloom.model import level_to_int
from logloom.plans.search import any_contains, looks_structured, where_query

#: Sort names and their columns; no sort is load order.
SORTS = {"Index": "row_id", "Time": "log_time", "Provider": "provider", "TaskName": "task_name", "Message": "message", "Source": "source", "Level": "level"}
#: Values of an exact OR-set from which on a semi-join takes the place of a list in the plan.
LARGE_SET = 1000
#: Relative time presets, minutes.
PRESETS = {"15m": 15, "1h": 60, "6h": 360, "24h": 1440, "7d": 10080}


@dataclass(frozen=True)
class SortSpec:
    column: str | None = None
    descending: bool = False

    def ordering(self, reverse: bool = False) -> list[Column]:
        """Sort columns with the row id last, so that every order is total."""
        desc = self.descending != reverse
        out = []
        if self.column and self.column != "Index":
            c = F.col(SORTS[self.column])
            out.append(c.desc_nulls_last() if desc else c.asc_nulls_first())
        id_desc = desc if self.column == "Index" else reverse
        return [*out, F.col("row_id").desc() if id_desc else F.col("row_id").asc()]


@dataclass(frozen=True)
class FilterSpec:
    """Empty parts filter nothing. OR-sets are exact, ignore case, and beat the substring of their field."""

    search: str = ""
    provider: str = ""
    task_name: str = ""
    message: str = ""
    source: str = ""
    providers: frozenset[str] = frozenset()
    task_names: frozenset[str] = frozenset()
    sources: frozenset[str] = frozenset()
    level: str = ""
    levels: frozenset[str] = frozenset()
    time_from: dt.datetime | None = None
    time_to: dt.datetime | None = None

    def without(self, field: str) -> FilterSpec:
        """The spec without any filter on a field (provider, task_name, source, level)."""
        sets = {"provider": "providers", "task_name": "task_names", "source": "sources", "level": "levels"}
        return replace(self, **{field: "", sets[field]: frozenset()})

    @property
    def is_empty(self) -> bool:
        return self == FilterSpec()

    def conditions(self) -> list[Column]:
        out = []
        if self.time_from:
            out.append(F.col("log_time") >= time_literal(self.time_from))
        if self.time_to:
            out.append(F.col("log_time") <= time_literal(self.time_to))
        names = self.levels or ({self.level} if self.level else frozenset())
        if names:
            out.append(F.col("level").isin(sorted({level_to_int(x) for x in names})))
        for c, text, values in (("provider", self.provider, self.providers), ("task_name", self.task_name, self.task_names), ("source", self.source, self.sources)):
            if values and len(values) < LARGE_SET:
                out.append(isin_ci(F.col(c), sorted(values)))
            elif text and not values:
                out.append(contains_ci(F.col(c), text))
        if self.message:
            out.append(contains_ci(F.col("message"), self.message))
        if self.search.strip():
            out.append(where_query(self.search) if looks_structured(self.search) else any_contains(self.search))
        return out


def _large_sets(df: DataFrame, spec: FilterSpec) -> list[tuple[str, DataFrame]]:
    """Column and table (value, lower case, each once) of the OR-sets that are too large for the plan."""
    named = (("provider", spec.providers), ("task_name", spec.task_names), ("source", spec.sources))
    return [(c, df.sparkSession.createDataFrame([(v.lower(),) for v in sorted(values)], "value string").distinct()) for c, values in named if len(values) >= LARGE_SET]


def apply_filters(df: DataFrame, spec: FilterSpec) -> DataFrame:
    """Rows that pass every part of the spec; large OR-sets are semi-joined."""
    conditions = spec.conditions()
    out = df.where(reduce(lambda a, b: a & b, conditions)) if conditions else df
    for c, table in _large_sets(df, spec):
        out = out.join(table, F.lower(c) == F.col("value"), "left_semi")
    return out


def with_hit(df: DataFrame, spec: FilterSpec, name: str = "_hit") -> DataFrame:
    """All rows with a boolean that tells those that ``apply_filters`` would keep."""
    conditions = spec.conditions()
    hit, out = F.coalesce(reduce(lambda a, b: a & b, conditions), F.lit(False)) if conditions else F.lit(True), df
    for i, (c, table) in enumerate(_large_sets(df, spec)):
        mark = f"_in_set{i}"
        out = out.join(table.select(F.col("value").alias(mark)), F.lower(c) == F.col(mark), "left")
        hit = hit & F.col(mark).isNotNull()
    return out.select(*[F.col(f"`{c}`") for c in df.columns], hit.alias(name))


def filter_all(df: DataFrame, conditions: list[Column]) -> DataFrame:
    """Conditions of a user, applied in order."""
    return reduce(lambda d, c: d.where(c), conditions, df)


def last_minutes(df: DataFrame, minutes: int) -> DataFrame:
    """Rows from so many minutes before the newest event on; rows without a time go."""
    start = df.agg((F.max("log_time") - F.expr(f"INTERVAL {int(minutes)} MINUTES")).alias("start"))
    return df.where(F.col("log_time") >= start.scalar())


def preset(df: DataFrame, name: str) -> DataFrame:
    """A relative time preset such as ``24h``."""
    return last_minutes(df, PRESETS[name])
