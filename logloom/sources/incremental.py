"""Incremental ingest into a versioned store.

A load has a number that grows. Its events are a folder of the store, and its entries in the manifest say which
files it read, under which rules and schema, and which files it found gone. Of each file the entry of the
latest load counts. Superseded loads stay until ``compact`` writes what counts as one load and removes the others.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.model import EVENT_SCHEMA
from logloom.plans.durable import cut, remove
from logloom.sources.folder import list_files, union_sources

#: Changes of the event schema make stored loads unusable.
SCHEMA_VERSION = 1
_MANIFEST = "path string, length long, modified timestamp, version int, rules string, gone boolean, load long"
_SIGNATURE = ["path", "length", "modified", "version", "rules"]


def manifest(spark: SparkSession, store: str) -> DataFrame:
    """All entries: path, length, modified, version, rules, gone, load."""
    try:
        return spark.read.schema(_MANIFEST).parquet(f"{store}/manifest")
    except AnalysisException:
        return spark.createDataFrame([], _MANIFEST)


def current(entries: DataFrame) -> DataFrame:
    """The entry of the latest load of each file that is not gone."""
    latest = entries.groupBy("path").agg(F.max_by(F.struct(*entries.columns), "load").alias("e"))
    return latest.select("e.*").where("NOT gone")


def new_files(files: DataFrame, held: DataFrame) -> DataFrame:
    """Files of ``files`` (path, length, modified, version, rules) without an equal entry in ``held``."""
    return files.join(held, _SIGNATURE, "left_anti")


def _written(store: str, entries: DataFrame, load: int) -> None:
    entries.select(*_SIGNATURE, "gone").write.mode("overwrite").parquet(f"{store}/manifest/load={load}")


def ingest_incremental(spark: SparkSession, path: str, store: str, reader, rules_key: str = "") -> int:
    """Adds a load with the events of new and changed files to ``store``, and returns how many files that were.

    Under another ``rules_key`` or schema version all files count as changed. Files that are no longer there are noted as gone. The
    events are written before the manifest, each over what a load of the same number has left: a failure between them leaves neither gaps nor doubles. To
    the driver come the paths of the new files alone, which Spark's own readers list there too.
    """
    files = list_files(spark, path).select("path", "length", F.col("modificationTime").alias("modified"), F.lit(SCHEMA_VERSION).alias("version"), F.lit(rules_key).alias("rules"))
    now, entries = cut(files), manifest(spark, store)
    held = cut(current(entries))
    fresh = new_files(now, held)
    gone = held.join(now, "path", "left_anti").select(*_SIGNATURE, F.lit(True).alias("gone"))
    changes = cut(fresh.withColumn("gone", F.lit(False)).unionByName(gone))
    if not changes.limit(1).count():
        return 0
    load = (entries.agg(F.max("load")).first()[0] or 0) + 1
    paths = sorted(r["path"] for r in changes.where("NOT gone").select("path").toLocalIterator())
    if paths:
        union_sources([reader(spark, paths)]).write.mode("overwrite").parquet(f"{store}/events/load={load}")
    _written(store, changes, load)
    return len(paths)


def read_store(spark: SparkSession, store: str, rules_key: str | None = None) -> DataFrame:
    """Stored events of the latest load of every file that is there, or of its latest load under some rules."""
    entries = manifest(spark, store)
    counted = current(entries if rules_key is None else entries.where(F.col("gone") | (F.col("rules") == rules_key)))
    latest = counted.select(F.col("path").alias("source"), "load")
    try:
        return spark.read.parquet(f"{store}/events").join(latest, ["source", "load"], "left_semi").select(EVENT_SCHEMA.names)
    except AnalysisException:  # no load had files
        return spark.createDataFrame([], EVENT_SCHEMA)


def compact(spark: SparkSession, store: str) -> int:
    """Writes what counts as one new load, then removes the loads before it; returns the load's number.

    Readers that began before may lose files: compact when none runs. A failure before the removal leaves both, which read alike.
    """
    entries = cut(manifest(spark, store))
    load = (entries.agg(F.max("load")).first()[0] or 0) + 1
    read_store(spark, store).write.mode("overwrite").parquet(f"{store}/events/load={load}")
    _written(store, current(entries), load)
    for old in [r["load"] for r in entries.select("load").distinct().collect()]:  # one row a load
        remove(spark, f"{store}/manifest/load={old}")
        remove(spark, f"{store}/events/load={old}")
    return load
