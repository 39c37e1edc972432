"""Sorting, paging and row lookup without numbering the whole set.

Orders are total (the row id breaks ties), so a page is a top-k and a
position is a count; no window runs over all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.operators.rewrite import with_number
from logloom.plans.spec import SORTS, SortSpec

#: Rows up to which a page is taken as the top of the order.
TOP_ROWS = 100_000


def sort_events(df: DataFrame, sort: SortSpec = SortSpec()) -> DataFrame:
    return df.orderBy(*sort.ordering())


def page(df: DataFrame, sort: SortSpec, offset: int, limit: int) -> DataFrame:
    """Rows [offset, offset + limit) of the order: a top-k near its start, beyond that the rows with these places of the numbered order."""
    offset, limit = max(0, offset), max(0, limit)
    if offset + limit <= TOP_ROWS:
        return df.orderBy(*sort.ordering()).offset(offset).limit(limit)
    at = F.col("position")
    return with_position(df, sort).where((at >= offset) & (at < offset + limit)).drop("position").orderBy(*sort.ordering())


def last_page(df: DataFrame, sort: SortSpec, size: int) -> DataFrame:
    """The last, possibly partial, page: the first rows of the reversed order, turned round."""
    n = df.count()
    k = n % size or min(n, size)
    return df.orderBy(*sort.ordering(reverse=True)).limit(k).orderBy(*sort.ordering())


def get_row(df: DataFrame, row_id: int) -> DataFrame:
    return df.where(F.col("row_id") == row_id)


def _before(sort: SortSpec, key, row_id: int, after: bool = False) -> Column:
    """Rows before (or after) the row with this sort key and id."""
    if not sort.column or sort.column == "Index":
        desc = sort.column == "Index" and sort.descending
        return F.col("row_id") > row_id if desc != after else F.col("row_id") < row_id
    c = F.col(SORTS[sort.column])
    value = F.lit(None if key is None else str(key)).cast("timestamp_ntz") if sort.column == "Time" else F.lit(key)
    # NULL keys stand first in ascending order and last in descending order.
    ahead = sort.descending == after
    if key is None:
        less = F.lit(False) if ahead else c.isNotNull()
    else:
        less = (c < value) | c.isNull() if ahead else c > value
    ties = F.col("row_id") > row_id if after else F.col("row_id") < row_id
    return F.coalesce(less, F.lit(False)) | (c.eqNullSafe(value) & ties)


def _anchor(df: DataFrame, sort: SortSpec, row_id: int):
    column = SORTS[sort.column] if sort.column else "row_id"
    return get_row(df, row_id).select(F.col(column).alias("key")).first()


def row_position(df: DataFrame, sort: SortSpec, row_id: int) -> int:
    """Place of a row in the order, from 0; -1 if it is not there."""
    anchor = _anchor(df, sort, row_id)
    return df.where(_before(sort, anchor["key"], row_id)).count() if anchor else -1


def page_of(position: int, size: int) -> int:
    return position // size if position >= 0 else -1


def context(df: DataFrame, sort: SortSpec, row_id: int, before: int, after: int) -> DataFrame:
    """Up to 100 rows before and after a row in the order, and the row itself; no row if it is not there."""
    before, after = (max(0, min(100, n)) for n in (before, after))
    anchor = _anchor(df, sort, row_id)
    if not anchor:
        return df.limit(0)
    head = df.where(_before(sort, anchor["key"], row_id)).orderBy(*sort.ordering(reverse=True)).limit(before)
    tail = df.where(_before(sort, anchor["key"], row_id, after=True)).orderBy(*sort.ordering()).limit(after)
    return head.unionByName(get_row(df, row_id)).unionByName(tail).orderBy(*sort.ordering())


def follow_activity(df: DataFrame, activity_id: str, cap: int = 500) -> DataFrame:
    """Rows of one activity in the order of time."""
    return df.where(F.lower("activity_id") == activity_id.lower()).orderBy(F.col("log_time").asc_nulls_first(), "row_id").limit(cap)


def with_position(df: DataFrame, sort: SortSpec) -> DataFrame:
    """Adds ``position`` from 0: rows are sorted by ranges and numbered from the sizes of the ranges before; ``row_position`` answers for one row without a sort."""
    return with_number(df, sort.ordering(), "position")


def cap_rows(df: DataFrame, n: int = 0, default: int = 500_000) -> tuple[DataFrame, bool]:
    """At most n rows (0: the default, -1: all) and whether there were more."""
    if n < 0:
        return df, False
    n = n or default
    return df.limit(n), df.limit(n + 1).count() > n


def sample_cap(df: DataFrame, cap: int) -> tuple[DataFrame, dict]:
    """A bounded sample on request, and how much of the whole it is."""
    total = df.count()
    return df.limit(cap), {"scanned": min(total, cap), "total": total, "truncated": total > cap}
