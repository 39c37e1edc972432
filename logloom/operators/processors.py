"""Result processors: what is made of a whole set of events, as numbered lines of text, by name.

A processor takes events and returns a DataFrame of ``no`` and ``value``: the lines of its output. Add your own with ``processor``.
Rules send rows to processors by name (``rules.route``); a row may go to several.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.operators.rules import rule_matches_long

Processor = Callable[[DataFrame], DataFrame]
PROCESSORS: dict[str, Processor] = {}
LINES = "processor string, no int, value string"


def processor(name: str) -> Callable[[Processor], Processor]:
    """Registers a processor under a name, which must be free."""

    def add(fn: Processor) -> Processor:
        if name in PROCESSORS:
            raise ValueError(f"there is a processor {name!r} already")
        PROCESSORS[name] = fn
        return fn

    return add


@processor("count")
def count_lines(df: DataFrame) -> DataFrame:
    """One line that says how many events there are."""
    return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(0).alias("no"), F.format_string("There were: %d results.", "n").alias("value"))


def tag_report(rules: dict, purposes: set[str] | None = None) -> Processor:
    """A processor of how many actions rules have on the events, and of their tags by count, most frequent first.

    The counts by tag are one aggregate; its rows are as many as the rules have tags.
    """

    def lines(df: DataFrame) -> DataFrame:
        hits = rule_matches_long(df, rules, purposes)
        tag = F.when((F.col("action") == "tag") & (F.col("value") != ""), F.col("value"))
        counts = hits.groupBy(tag.alias("tag")).agg(F.count(F.lit(1)).alias("n"))
        whole = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.array_sort(F.collect_list(F.when(F.col("tag").isNotNull(), F.struct((-F.col("n")).alias("minus"), "tag")))).alias("tags"))
        head = F.format_string("Found %d result%s", F.col("total"), F.when(F.col("total") == 1, "").otherwise("s"))
        tagged = F.when(F.size("tags") > 0, F.concat(F.array(F.lit("Tags found:")), F.transform("tags", lambda x: F.format_string("  %s: %d", x["tag"], -x["minus"])))).otherwise(F.array().cast("array<string>"))
        return whole.select(F.posexplode(F.concat(F.array(head), tagged)).alias("no", "value"))

    return lines


def process(df: DataFrame, names: Iterable[str], own: dict[str, Processor] | None = None) -> DataFrame:
    """processor, no, value: the lines that the named processors make of all events. ``own`` are processors beside the registered ones; an unknown name fails."""
    known = PROCESSORS | (own or {})
    names = list(dict.fromkeys(names))
    if missing := [n for n in names if n not in known]:
        raise ValueError(f"no such processor: {', '.join(missing)}")
    parts = [known[n](df).select(F.lit(n).alias("processor"), F.col("no").cast("int").alias("no"), "value") for n in names]
    return reduce(DataFrame.unionByName, parts) if parts else df.sparkSession.createDataFrame([], LINES)


def process_routes(df: DataFrame, own: dict[str, Processor] | None = None) -> DataFrame:
    """processor, no, value: each processor's lines of the rows whose ``routes`` name it; names that are no processor's are left out."""
    known = PROCESSORS | (own or {})
    parts = [process(df.where(F.array_contains("routes", n)), [n], own) for n in known]
    return reduce(DataFrame.unionByName, parts)


def write_processed(lines: DataFrame, path: str) -> None:
    """The lines as text, in a folder for each processor, in order."""
    lines.repartition("processor").sortWithinPartitions("processor", "no").select("processor", "value").write.mode("overwrite").partitionBy("processor").text(path)
