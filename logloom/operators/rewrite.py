"""Row rewrites: ids, message clean-up, payload formats, reformat catalogue."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.parse import flexible_time
from logloom.model import STRING_COLUMNS
from logloom.plans.rules import compiles, java_groups, regex_or_contains

FORMATS = ("key_value_quoted", "key_value", "json", "pipe", "custom")
CUSTOM_TEMPLATE = '{name}="{value}" '


def with_row_id(df: DataFrame, order: list[str]) -> DataFrame:
    """Stable ids from 0 in the order of ``order`` (such as file path, block start, place in it).

    Rows are sorted by range partitions; each partition's offset is the
    number of rows in those before it, so ids are gapless and no task sees all rows.
    """
    return with_number(df, [F.col(c) for c in order], "row_id")


def with_number(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds the place of each row, from 0, in a total order, without a window over all rows."""
    from logloom.plans.durable import cut

    spark = df.sparkSession
    ordered = df.orderBy(*order)

    numbered = cut(ordered.withColumn("_part", F.spark_partition_id()).withColumn("_in", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = sorted((r["_part"], r["n"]) for r in numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, total = [], 0
    for part, n in sizes:
        offsets.append((part, total))
        total += n
    table = spark.createDataFrame(offsets or [(0, 0)], "_part int, _offset long")
    out = numbered.join(F.broadcast(table), "_part", "left")
    return out.withColumn(name, F.col("_offset") + F.col("_in")).drop("_part", "_in", "_offset")


def clean_message(df: DataFrame) -> DataFrame:
    """Drops a leading ``[time]`` that is the row's own time within a second, then a leading level word and colon."""
    message = F.col("message")
    stamp = F.regexp_extract(message, r"^\s*\[([^\]]{1,40})\]", 1)
    same = F.abs(F.unix_micros(flexible_time(stamp).cast("timestamp")) - F.unix_micros(F.col("log_time").cast("timestamp"))) < 1_000_000
    no_time = F.when(F.coalesce(same, F.lit(False)), F.regexp_replace(message, r"^\s*\[[^\]]{1,40}\]\s*", "")).otherwise(message)
    return df.withColumn("message", F.regexp_replace(no_time, r"(?i)^\s*(?:critical|fatal|error|warning|warn|information|info|debug|verbose|trace):\s*", ""))


def _quoted(v: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('\\"')), F.lit('"'))


def render_payload(fields: Column, fmt: str = "key_value_quoted", template: str = "") -> Column:
    """Name-value pairs as text in one of FORMATS; '' without pairs."""
    pairs = F.transform_keys(F.transform_values(fields, lambda _, v: F.coalesce(v, F.lit(""))), lambda k, _: k)
    entries = F.map_entries(pairs)
    if fmt == "json":
        out = F.to_json(pairs)
    elif fmt == "pipe":
        out = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(": "), e["value"], F.lit(" | "))), "")
    elif fmt == "custom":
        parts = re.split(r"(\{name\}|\{value\})", template or CUSTOM_TEMPLATE)
        part = lambda e, p: e["key"] if p == "{name}" else e["value"] if p == "{value}" else F.lit(p)
        out = F.array_join(F.transform(entries, lambda e: F.concat(*[part(e, p) for p in parts])), "")
    elif fmt == "key_value":
        bare = lambda v: F.when((v == "") | v.rlike(r'[ \t"=|]'), _quoted(v)).otherwise(v)
        out = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), bare(e["value"]))), " ")
    elif fmt == "key_value_quoted":
        out = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), _quoted(e["value"]))), " ")
    else:
        raise ValueError(f"unknown format '{fmt}', try one of {', '.join(FORMATS)}")
    return F.when(F.coalesce(F.size(fields), F.lit(0)) > 0, out).otherwise("")


def reformat_payload(df: DataFrame, old: str, new: str, template: str = "") -> DataFrame:
    """The payload at the end of the message in another format; other messages stay."""
    a, b = render_payload(F.col("fields"), old), render_payload(F.col("fields"), new, template)
    head = F.substring(F.col("message"), F.lit(1), F.char_length("message") - F.char_length(a))
    return df.withColumn("message", F.when((a != "") & F.endswith("message", a), F.concat(head, b)).otherwise(F.col("message")))


def validate_pattern(pattern: str) -> str | None:
    """What is wrong with a reformat pattern: it must compile and name a group."""
    if not re.search(r"\(\?P?<([A-Za-z_]\w*)>", pattern or ""):
        return "the pattern names no group"
    return None if compiles(java_groups(pattern)) else "the pattern does not compile"


def reformat_message(df: DataFrame, rules: list[dict], out: str = "parsed") -> DataFrame:
    """Named groups of the first enabled rule whose gate and pattern match, empty ones dropped, as a map column.

    A rule has pattern and, if it wants, gate (a regular expression) and enabled.
    """
    from logloom.operators.rules import _group_value, _groups

    value = None
    message = F.col("message")
    for r in rules:
        if not r.get("enabled", True) or validate_pattern(r["pattern"]):
            continue
        hit = message.rlike(java_groups(r["pattern"]))
        if r.get("gate"):
            hit = regex_or_contains(message, r["gate"]) & hit
        pairs = [x for g in _groups(r["pattern"]) for x in (F.lit(g), _group_value(message, r["pattern"], g))]
        named = F.map_filter(F.create_map(*pairs), lambda _, v: v != "")
        value = F.when(hit, named) if value is None else value.when(hit, named)
    return df.withColumn(out, F.lit(None).cast("map<string,string>") if value is None else value)


def empty_columns(df: DataFrame) -> DataFrame:
    """column, is_empty of every string column, in one pass."""
    columns = [c for c in STRING_COLUMNS if c in df.columns]
    one = df.agg(*[F.coalesce(F.bool_or(F.col(c) != ""), F.lit(False)).alias(c) for c in columns])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), (~F.col(c)).alias("is_empty")) for c in columns])))
