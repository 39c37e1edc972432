"""Folders of mixed logs, source kinds, rule-file inputs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.model import as_events
from logloom.plans.durable import running_total, scratch
from logloom.sources.delimited import read_csv_files, read_csv_logs, read_tsv_export
from logloom.sources.eventxml import read_event_xml
from logloom.sources.jsonlogs import read_json_doc, read_json_lines
from logloom.sources.text import read_text_logs
from logloom.sources.trace import read_trace_text

#: Reader of each file extension; add your own.
READERS = {
    "txt": read_text_logs, "log": read_text_logs, "csv": read_csv_logs, "tsv": read_csv_logs, "json": read_json_doc, "jsonl": read_json_lines, "ndjson": read_json_lines,
    "xml": read_event_xml, "trace": read_trace_text,
}
# Kinds of sources by extension.
SOURCE_TYPES = {
    "etl": "ETL", "evtx": "EventLog", "evt": "EventLog", "txt": "Text", "log": "Text", "csv": "CSV", "tsv": "CSV", "json": "JSON", "jsonl": "JSON", "ndjson": "JSON",
    "zip": "Archive", "cab": "Archive", "pcap": "Network", "pcapng": "Network", "dmp": "Dump", "xml": "XML", "html": "HTML", "htm": "HTML", "kusto": "Query", "db": "Database", "sqlite": "Database",
}


def extension(path: Column) -> Column:
    """Extension in lower case; a number behind a known one (``trace.etl.001``) is no extension."""
    name = F.lower(F.element_at(F.split(path, r"[/\\]"), -1))
    return F.regexp_extract(F.regexp_replace(name, r"\.\d{1,4}$", ""), r"\.([a-z0-9]+)$", 1)


def source_type(path: Column) -> Column:
    """Kind of a source by its extension, ``Other`` without a known one."""
    table = F.create_map(*[F.lit(x) for pair in SOURCE_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, extension(path)), F.lit("Other"))


def filter_source_types(df: DataFrame, kinds: list[str]) -> DataFrame:
    return df.where(source_type(F.col("source")).isin(kinds))


def rebase_source(df: DataFrame, root: str, label: str) -> DataFrame:
    """Sources below a root (a temporary folder) shown below a label instead; local paths fit with and without their scheme."""
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    start = plain(F.lit(root.rstrip("/") + "/"))
    rest = F.substring(plain(F.col("source")), F.char_length(start), F.lit(2**31 - 1))
    return df.withColumn("source", F.when(F.startswith(plain(F.col("source")), start), F.concat(F.lit(label), rest)).otherwise(F.col("source")))


def union_sources(parts: list[DataFrame]) -> DataFrame:
    """All events of several sources. Ids stay unique: the part's number stands in the bits above the ids that its rows have.

    A part's own ids must be from 0 to 2 ** (63 - bits) - 1 for as many bits as number the parts, as those of text loads and
    streamed stores are, or NULL. An id beyond fails the job: give that part new ids first (``renumbered``). One part alone keeps its ids.
    """
    bits = (len(parts) - 1).bit_length()
    top = 1 << (63 - bits)

    def shifted(part: DataFrame, i: int) -> DataFrame:
        own = F.col("row_id")
        beyond = F.raise_error(F.concat(F.lit(f"row_id of part {i} is not from 0 to {top - 1}: "), own.cast("string"))).cast("long")
        return as_events(part).withColumn("row_id", F.when(own.isNull() | ((own >= 0) & (own < top)), own + F.lit(i * top)).otherwise(beyond))

    out = [shifted(p, i) for i, p in enumerate(parts)] if bits else [as_events(parts[0])]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out)


def renumbered(part: DataFrame) -> DataFrame:
    """The events with ids from 0 on, as they come: written once, as Parquet, so that a reader of few columns reads no others, and counted by task."""
    spark, path = part.sparkSession, scratch(part.sparkSession, "renumbered")
    as_events(part).withColumn("_task", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).write.parquet(path)
    rows = spark.read.parquet(path)
    tasks = running_total(rows.groupBy("_task").agg(F.count(F.lit(1)).alias("n")), ["_task"], "n", "_before").drop("n")
    return rows.join(F.broadcast(tasks), "_task").withColumn("row_id", F.col("_before") + F.col("_place")).select(rows.drop("_task", "_place").columns)


def list_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """path, length, modificationTime of a folder's files; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path).select("path", "length", "modificationTime")


def read_folder(spark: SparkSession, path: str, depth: str = "deep", readers: dict | None = None) -> DataFrame:
    """Events of all files with a known extension; ``shallow`` takes the folder's own files alone.

    Files of one kind are one read; CSV and TSV files are one read together, grouped by their headers.
    """
    readers = readers or READERS
    files = list_files(spark, path, depth.lower() != "shallow").select("path", extension(F.col("path")).alias("kind")).where(F.col("kind").isin(list(readers)))
    by_kind: dict[str, list[str]] = {}
    for r in files.orderBy("path").toLocalIterator():
        by_kind.setdefault(r["kind"], []).append(r["path"])
    tables = [p for kind, paths in sorted(by_kind.items()) if readers[kind] is read_csv_logs for p in paths]
    parts = [read_csv_files(spark, tables)] if tables else []
    for kind, paths in sorted(by_kind.items()):
        if readers[kind] is read_tsv_export:
            parts += [readers[kind](spark, p) for p in paths]
        elif readers[kind] is not read_csv_logs:
            parts.append(readers[kind](spark, paths))
    return union_sources(parts) if parts else as_events(spark.createDataFrame([], "message string"))


def read_inputs(spark: SparkSession, rules: dict) -> DataFrame:
    """Events of a rule file's enabled inputs (type, path, depth)."""
    parts = []
    for i in rules.get("inputs", []):
        if not i.get("enabled", True):
            continue
        kind = str(i.get("type", "folder")).lower()
        parts.append(read_folder(spark, i["path"], i.get("depth", "deep")) if kind == "folder" or kind not in READERS else READERS[kind](spark, i["path"]))
    return union_sources(parts) if parts else as_events(spark.createDataFrame([], "message string"))
