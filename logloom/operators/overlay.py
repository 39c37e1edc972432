"""Row tags: a small table of (row_id, tag, note) laid over the events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _latest(tags: DataFrame) -> DataFrame:
    """One tag for each row: the smallest, if there are several."""
    first = F.row_number().over(W.partitionBy("row_id").orderBy("tag", "note"))
    return tags.select("row_id", "tag", "note", first.alias("_no")).where("_no = 1").drop("_no")


def with_tags(df: DataFrame, tags: DataFrame) -> DataFrame:
    """Events with the columns tag and note, NULL where there is none. Spark broadcasts the tags if they are small."""
    return df.join(_latest(tags), "row_id", "left")


def tag_overlay_counts(df: DataFrame, tags: DataFrame) -> DataFrame:
    """tag, n over the rows of df."""
    return tagged_rows(df, tags).groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tag")


def tagged_rows(df: DataFrame, tags: DataFrame, tag: str | None = None) -> DataFrame:
    own = _latest(tags)
    return df.join(own if tag is None else own.where(F.col("tag") == tag), "row_id")
