"""The same column functions over Structured Streaming."""

from __future__ import annotations

import threading
import time

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from logloom.functions.parse import line_level, line_time
from logloom.functions.text import base_name
from logloom.model import EVENT_SCHEMA, as_events
from logloom.plans.durable import running_total


def stream_events(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Events of a growing folder of text logs, and ``_block``, the place of the line's block in its file. ``ingest`` gives them ids."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", True).text(path)
    lines = lines.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block")).where(F.trim("value") != "")
    v = F.col("value")
    events = lines.select(line_time(v).alias("log_time"), line_level(v).alias("level"), base_name(F.col("path")).alias("provider"), F.col("path").alias("source"), v.alias("message"), v.alias("searchable"), "_block")
    return as_events(events, "_block")


def held_rows(spark: SparkSession, store: str, before: int | None = None) -> int:
    """Events of a store that is filled by ``ingest``, or of its batches below a number."""
    try:
        loads = spark.read.schema("first long, n long, batch long").parquet(f"{store}/_loads/rows")
    except AnalysisException:
        return 0
    return loads.where(F.lit(True) if before is None else F.col("batch") < before).agg(F.coalesce(F.max(F.col("first") + F.col("n")), F.lit(0))).first()[0]


def number_batch(batch: DataFrame, first: int) -> tuple[DataFrame, int]:
    """The rows of a batch of ``stream_events`` with ids from ``first`` on in load order (path, block, line), and their number.

    A block is read by one task from start to end, so a line's place in it is a difference of task counters, and
    one row for each block says how many lines come before: no event is shuffled or sorted, however often a line repeats.
    """
    places = batch.withColumn("_place", F.monotonically_increasing_id())
    blocks = places.groupBy(F.col("source").alias("_path"), F.col("_block").alias("_of")).agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("n"))
    blocks = running_total(blocks, ["_path", "_of"], "n", "_before")
    n = blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = places.join(F.broadcast(blocks.drop("n")), (F.col("source") == F.col("_path")) & (F.col("_block") == F.col("_of")))
    return found.withColumn("row_id", F.col("_before") + F.col("_place") - F.col("_first") + first).select([c for c in batch.columns if c != "_block"]), n


def ingest(events: DataFrame, store: str, checkpoint: str, enrich=None, available_now: bool = True, most: int | None = None, full: threading.Event | None = None):
    """Starts appending a stream to a Parquet store, each batch through ``enrich``; batch queries over the store see what has arrived.

    Events of ``stream_events`` get ids from 0 on in the order in which they arrive: a batch begins where those before it
    ended, which the store notes with the batch. Other streams keep their own ids. A batch writes into a folder of its own and overwrites it when it is repeated, so a
    restart leaves neither gaps nor doubles. Of more than ``most`` events the first ``most`` are stored, and ``full`` is set.
    """
    numbered = "_block" in events.columns
    spark = events.sparkSession
    _totals(spark)

    def batch(df: DataFrame, no: int) -> None:
        df = df.persist(StorageLevel.DISK_ONLY)  # read twice; rows of a large batch do not fill a task's memory
        try:
            first = held_rows(spark, store, no)
            rows, n = number_batch(df, first) if numbered else (df, df.count())
            if most is not None and first + n > most:
                n = max(0, most - first)
                rows = rows.where(F.col("row_id") < most) if numbered else rows.limit(n)
            spark.createDataFrame([(first, n)], "first long, n long").coalesce(1).write.mode("overwrite").parquet(f"{store}/_loads/rows/batch={no}")
            (enrich(rows) if enrich else rows).write.mode("overwrite").parquet(f"{store}/batch={no}")
            if full and most is not None and first + n >= most:
                full.set()
        finally:
            df.unpersist()

    writer = events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stream_level_counts(events: DataFrame) -> DataFrame:
    """Running rows per level; six keys of state."""
    return events.groupBy("level").agg(F.count(F.lit(1)).alias("n"))


def stream_density(events: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Rows per window and level; windows close when the watermark has passed them."""
    timed = events.where("log_time is not null").withColumn("event_time", F.col("log_time").cast("timestamp"))
    counts = timed.withWatermark("event_time", late).groupBy(F.window("event_time", width), "level").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("window.start").alias("from_time"), F.col("window.end").alias("to_time"), "level", "n")


def collect_bounded(events: DataFrame, store: str, checkpoint: str, seconds: float | None = None, most: int | None = None) -> DataFrame:
    """Takes what is there, or what comes within some seconds, into a store, ``most`` events at most, and returns it.

    The time ends the collection while data keeps coming: a batch that is under way then is given up, and taken again by
    a later run with the same checkpoint. Without ``seconds`` it ends with what is there, or with ``most`` events.
    """
    full = threading.Event()
    query = ingest(events, store, checkpoint, available_now=seconds is None, most=most, full=full)
    end = None if seconds is None else time.monotonic() + seconds
    while query.isActive and not full.is_set() and (end is None or time.monotonic() < end):
        query.awaitTermination(0.2 if end is None else max(0.01, min(0.2, end - time.monotonic())))
    failed = query.exception()
    query.stop()
    if failed:
        raise failed
    spark = events.sparkSession
    try:
        return spark.read.parquet(store).drop("batch")
    except AnalysisException:  # nothing has been stored
        return spark.createDataFrame([], EVENT_SCHEMA)


class Totals(StreamingQueryListener):
    """Sums over all batches of every query of a session; a query itself remembers its last hundred."""

    def __init__(self):
        self.of: dict[str, dict] = {}

    def onQueryStarted(self, event) -> None:
        self.of.setdefault(str(event.runId), {"batches": 0, "rows": 0, "rows_per_second": 0.0, "last": -1, "ended": False})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        mine = self.of.setdefault(str(p.runId), {"batches": 0, "rows": 0, "rows_per_second": 0.0, "last": -1, "ended": False})
        if p.batchId > mine["last"]:  # an idle query reports its last batch again
            mine["batches"] += 1
            mine["rows"] += p.numInputRows
            mine["last"] = p.batchId
            mine["rows_per_second"] = p.processedRowsPerSecond

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if str(event.runId) in self.of:
            self.of[str(event.runId)]["ended"] = True


_LISTENERS: dict[int, Totals] = {}


def _totals(spark: SparkSession) -> Totals:
    """The session's sums, counted from the first call on."""
    key = id(spark._jsparkSession)
    if key not in _LISTENERS:
        _LISTENERS[key] = Totals()
        spark.streams.addListener(_LISTENERS[key])
    return _LISTENERS[key]


def progress(query, wait: float = 10.0) -> dict:
    """Batches and rows of a query that ``ingest`` started, over all its batches, and its rate now. Reports come a little later than the batches: at most ``wait`` seconds are spent on those already run."""
    mine = _totals(SparkSession.active()).of.get(str(query.runId), {})
    done = query.recentProgress
    last, end = done[-1]["batchId"] if done else -1, time.monotonic() + wait
    while time.monotonic() < end and (mine.get("last", -1) < last or (not query.isActive and not mine.get("ended", True))):
        time.sleep(0.02)
    return {"batches": mine.get("batches", 0), "rows": mine.get("rows", 0), "rows_per_second": mine.get("rows_per_second", 0.0), "active": query.isActive}
