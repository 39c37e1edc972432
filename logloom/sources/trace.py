"""Formatted trace text: ``[cpu]PID.TID::time [provider]json``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.parse import flexible_time, trace_level
from logloom.functions.text import first_non_empty
from logloom.model import as_events
from logloom.sources.text import text_lines

HEADER = r"^\s*\[(\d+)\]\s*([0-9A-Fa-f]+)\.([0-9A-Fa-f]+)::\s*(\S+(?:\s\d[\d:.]+)?)\s*\[([^\]]*)\]\s*(.*)$"


def trace_lines_to_events(lines: DataFrame) -> DataFrame:
    """Events of lines (value, path) with a trace header; process and thread ids are hexadecimal. Other lines go."""
    rows = lines.where(F.col("value").rlike(HEADER))
    g = lambda i: F.regexp_extract("value", HEADER, i)
    pairs = F.coalesce(F.from_json(F.regexp_extract(g(6), r"(\{.*\})", 1), "map<string,string>"), F.create_map().cast("map<string,string>"))
    at = lambda k: F.try_element_at("p", F.lit(k))
    stamp = F.regexp_replace(F.regexp_replace(g(4), r"^(\d{2})/(\d{2})/(\d{4})-", "$3-$1-$2T"), r"(\.\d{6})\d+$", "$1")
    split = rows.select("value", "path", g(2).alias("pid"), g(3).alias("tid"), stamp.alias("stamp"), g(5).alias("provider"), g(6).alias("rest"), pairs.alias("p"))
    decimal = lambda c: F.conv(c, 16, 10)
    return as_events(
        split.select(
            flexible_time(F.col("stamp")).alias("log_time"), trace_level(F.coalesce(at("Level"), at("level"))).alias("level"), "provider", first_non_empty(at("TaskName"), at("task")).alias("task_name"),
            first_non_empty(at("Message"), at("message"), F.col("rest")).alias("message"), F.col("value").alias("searchable"), F.col("path").alias("source"), decimal(F.col("pid")).alias("process_id"), decimal(F.col("tid")).alias("thread_id"),
            first_non_empty(at("EventId"), at("Id")).alias("event_id"), first_non_empty(at("ActivityID"), at("ActivityId")).alias("activity_id"), first_non_empty(at("ProviderGuid")).alias("provider_guid"), F.col("p").alias("fields"),
        )
    )


def read_trace_text(spark: SparkSession, path) -> DataFrame:
    return trace_lines_to_events(text_lines(spark, path))
