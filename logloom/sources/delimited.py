"""CSV and TSV logs, and tab-separated telemetry exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.parse import parse_time, trace_level
from logloom.model import as_events
from logloom.plans.durable import cut
from logloom.sources.mapper import columns_to_events, map_to_events, mapping_for
from logloom.sources.text import text_lines

DELIMITERS = ",;\t"
#: Columns that a telemetry export must have.
EXPORT_COLUMNS = ("PreciseTimeStamp", "ProviderName")


def sniff(header: str) -> str:
    """The delimiter that the header line has most of."""
    return max(DELIMITERS, key=header.count)


def headers(line: str, delimiter: str) -> list[str]:
    """Column names of a header line; blank ones are colN, repeated ones get a number."""
    out: list[str] = []
    for i, h in enumerate(line.lstrip("﻿").split(delimiter), 1):
        name = h.strip().strip('"').strip() or f"col{i}"
        out.append(name if name not in out else f"{name}_{i}")
    return out


def read_csv_logs(spark: SparkSession, path: str, delimiter: str | None = None, overrides: dict[str, str] | None = None, saved: dict | None = None) -> DataFrame:
    """Events of CSV files with one header. Malformed quoting is tolerated; missing cells are empty."""
    first = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    if not first:
        return as_events(spark.createDataFrame([], "message string"))
    sep = delimiter or sniff(first[0]["value"])
    names = headers(first[0]["value"], sep)
    if overrides is None and saved:
        overrides = mapping_for(names, saved)
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    rows = (
        spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("sep", sep).option("mode", "PERMISSIVE").option("escape", '"')
        .option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).option("multiLine", False).csv(path)
    )
    return columns_to_events(rows, names, F.col("_metadata.file_path"), overrides)


def first_lines(lines: DataFrame) -> DataFrame:
    """path, line, block, place of the first line of each file; ``lines`` as of ``text_lines``."""
    first = lines.groupBy("path").agg(F.min_by(F.struct("value", "block", "place"), F.struct("block", "place")).alias("f"))
    return first.select("path", F.col("f.value").alias("line"), F.col("f.block").alias("block"), F.col("f.place").alias("place"))


def read_csv_files(spark: SparkSession, path, overrides: dict[str, str] | None = None, recursive: bool = False) -> DataFrame:
    """Events of many CSV or TSV files, each with a header of its own.

    Files are grouped by their header line: each different header, of which there are few, is one way to cut a line
    (``from_csv``), and all files are one scan, whatever their number. Cells are those of ``read_csv_logs``; a line is a record.
    """
    lines = text_lines(spark, path, recursive)
    heads = cut(first_lines(lines).withColumn("sign", F.xxhash64("line")))
    kinds = sorted({(r["sign"], r["line"]) for r in heads.select("sign", "line").distinct().toLocalIterator()})
    if not kinds:
        return as_events(spark.createDataFrame([], "message string"))
    record = F.lit(None).cast("map<string,string>")
    options = {"mode": "PERMISSIVE", "escape": '"', "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
    for sign, header in kinds:
        sep = sniff(header)
        names = headers(header, sep)
        cells = F.from_csv("value", ", ".join(f"`{n.replace('`', '``')}` string" for n in names), options | {"sep": sep})
        pairs = F.map_from_arrays(F.array(*map(F.lit, names)), F.transform(F.array(*[cells.getField(n) for n in names]), lambda c: F.coalesce(c, F.lit(""))))
        record = F.when(F.col("sign") == sign, pairs).otherwise(record)
    marks = heads.select(F.col("path").alias("_path"), "sign", F.col("block").alias("_block"), F.col("place").alias("_place"))
    body = lines.join(marks, (F.col("path") == F.col("_path")) & ~((F.col("block") == F.col("_block")) & (F.col("place") == F.col("_place"))))
    return map_to_events(body.select("path", record.alias("record")), "record", F.col("path"), overrides)


def read_tsv_export(spark: SparkSession, path: str) -> DataFrame:
    """Telemetry export: tab-separated without quoting; rows with a wrong number of fields are dropped.

    Needs PreciseTimeStamp and ProviderName; levels are trace levels 1 to 5.
    """
    first = spark.read.text(path).limit(1).collect()
    names = headers(first[0]["value"], "\t") if first else []
    if missing := [c for c in EXPORT_COLUMNS if c not in names]:
        raise ValueError(f"not a telemetry export, no column {', '.join(missing)}")
    lines = spark.read.text(path).select(F.split("value", "\t").alias("c"), F.col("value"), F.col("_metadata.file_path").alias("source"))
    rows = lines.where((F.size("c") == len(names)) & (F.col("c")[names.index("ProviderName")] != "ProviderName"))
    cell = lambda *of: F.coalesce(*[F.nullif(F.trim(F.col("c")[names.index(n)]), F.lit("")) for n in of if n in names], F.lit(""))
    message = cell("EventMessage", "Message", "TaskName")
    return as_events(
        rows.select(
            parse_time(cell("PreciseTimeStamp")).alias("log_time"), trace_level(cell("Level")).alias("level"), cell("ProviderName").alias("provider"), cell("TaskName").alias("task_name"),
            message.alias("message"), F.replace("value", F.lit("\t"), F.lit(" ")).alias("searchable"), "source", cell("HostInstance", "MachineName").alias("machine_name"),
            cell("Pid").alias("process_id"), cell("Tid").alias("thread_id"), cell("ActivityId").alias("activity_id"), cell("RelatedActivityId").alias("related_activity_id"),
            cell("ProviderGuid").alias("provider_guid"), cell("EventId").alias("event_id"), cell("OpcodeName", "Opcode").alias("op_code"),
            F.map_from_arrays(F.array(*map(F.lit, names)), F.col("c")).alias("fields"),
        )
    )
