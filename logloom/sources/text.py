"""Plain-text logs: one event per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.functions.parse import line_level, line_time
from logloom.functions.text import base_name
from logloom.model import as_events
from logloom.plans.durable import running_total

#: Characters of a line within which a NUL marks a file as binary.
BINARY_HEAD = 1024


def lines_to_events(lines: DataFrame) -> DataFrame:
    """Events of lines (value, path): blank lines go, the provider is the file's base name."""
    rows = lines.where(F.trim("value") != "")
    ids = [F.col("row_id")] if "row_id" in lines.columns else []
    return as_events(
        rows.select(
            *ids, line_time(F.col("value")).alias("log_time"), line_level(F.col("value")).alias("level"), base_name(F.col("path")).alias("provider"),
            F.col("path").alias("source"), F.col("value").alias("message"), F.col("value").alias("searchable"),
        )
    )


def text_lines(spark: SparkSession, path, recursive: bool = False, glob: str | None = None) -> DataFrame:
    """value, path, block, place of every line that is not blank; the last two order the lines of a file.

    A block of a file is read by one task from its start to its end, and ``place`` counts the lines of a task: lines
    of a block have places without gaps.
    """
    reader = spark.read.option("recursiveFileLookup", recursive)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    lines = reader.text(path).where(F.trim("value") != "")
    return lines.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))


def block_table(lines: DataFrame) -> DataFrame:
    """path, block, place, before of the blocks of text files: the place of a block's first line, and the lines in all blocks before it.

    Files in which some line has a NUL near its head are binary and left out; contents are never
    loaded as a whole. One row for each block, cut.
    """
    binary = F.bool_or(F.instr(F.substring("value", 1, BINARY_HEAD), "\0") > 0)
    blocks = lines.groupBy("path", "block").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("n"), binary.alias("binary"))
    whole = W.partitionBy("path")
    text = blocks.withColumn("binary", F.bool_or("binary").over(whole)).where("NOT binary").drop("binary")
    return running_total(text, ["path", "block"], "n", "before").drop("n")


def number_lines(lines: DataFrame) -> DataFrame:
    """Lines of text files with ids in load order: by path, place of the block in the file, place of the line in the block.

    The files are read twice, once to count the lines of each block; no line is sorted or shuffled for its id.
    """
    blocks = block_table(lines).withColumnRenamed("place", "_first")
    found = lines.join(F.broadcast(blocks), ["path", "block"])
    return found.withColumn("row_id", F.col("before") + F.col("place") - F.col("_first")).drop("block", "place", "_first", "before")


def drop_binary(lines: DataFrame) -> DataFrame:
    """Lines of files in which no line has a NUL near its head; the content is never loaded as a whole."""
    head = F.substring("value", 1, BINARY_HEAD)
    binary = lines.where(F.instr(head, "\0") > 0).select("path").distinct()
    return lines.join(binary, "path", "left_anti")


def read_text_logs(spark: SparkSession, path, recursive: bool = False, glob: str | None = None, ids: bool = False) -> DataFrame:
    """Events of text files; with ``ids`` they have stable ids in load order, for stores."""
    lines = text_lines(spark, path, recursive, glob)
    return lines_to_events(number_lines(lines) if ids else drop_binary(lines).drop("block", "place"))
