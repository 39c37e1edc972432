"""JSON logs: one object per line, or documents with an array of objects."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.plans.durable import cut, running_total
from logloom.sources.mapper import map_to_events

_RECORD = "map<string,string>"


def read_json_lines(spark: SparkSession, path: str, overrides: dict[str, str] | None = None) -> DataFrame:
    """Events of JSON lines; malformed lines are skipped, nested values stay JSON text."""
    lines = spark.read.text(path).select(F.from_json("value", _RECORD).alias("record"), F.col("_metadata.file_path").alias("path"))
    return map_to_events(lines.where(F.col("record").isNotNull() & (F.size("record") > 0)), "record", F.col("path"), overrides)


def read_json_doc(spark: SparkSession, path: str, overrides: dict[str, str] | None = None) -> DataFrame:
    """Events of JSON documents: a top-level array, an object that holds an array, or one object.

    Files that are neither are read as JSON lines. Each file is one value, so
    this reader is for documents; ``read_json_array`` is for large ones.
    """
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    body = F.trim(F.regexp_replace("value", "^﻿", ""))
    top = F.when(F.startswith(body, F.lit("[")), F.from_json(body, f"array<{_RECORD}>"))
    obj = F.when(F.startswith(body, F.lit("{")), F.from_json(body, _RECORD))
    inner = F.get(F.filter(F.transform(F.map_values(obj), lambda v: F.when(F.ltrim(v).startswith("["), F.from_json(v, f"array<{_RECORD}>"))), lambda a: a.isNotNull() & (F.size(a) > 0)), F.lit(0))
    one_line = ~F.trim(F.col("value")).rlike(r"(?s)^\{.*\}\s*\n\s*\{")
    records = F.coalesce(top, F.when(one_line, F.coalesce(inner, F.when(F.size(obj) > 0, F.array(obj)))))
    lines = F.filter(F.transform(F.split("value", "\r?\n"), lambda x: F.from_json(x, _RECORD)), lambda r: r.isNotNull() & (F.size(r) > 0))
    rows = files.select(F.explode(F.coalesce(records, lines)).alias("record"), "path").where("record is not null")
    return map_to_events(rows, "record", F.col("path"), overrides)


#: Bytes of ranges that a task reads, if each has less.
TASK_BYTES = 16 << 20
#: Steps of depth by byte.
_STEP = np.zeros(256, np.int64)
_STEP[[ord("["), ord("{")]], _STEP[[ord("]"), ord("}")]] = 1, -1


def _structure(values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of pieces in their order: quotes before each piece and behind the last one, and the depth there if the first begins outside a string or within one."""
    at = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1]
    text = np.frombuffer(values.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    quotes, back = np.flatnonzero(text == ord('"')), np.flatnonzero(text == ord("\\"))
    if len(back):  # a quote behind an odd number of backslashes is none
        opens = np.isin(back, at) | (np.diff(back, prepend=-2) != 1)
        nth = back - back[np.maximum.accumulate(np.where(opens, np.arange(len(back)), 0))]
        quotes = np.setdiff1d(quotes, np.setdiff1d(back[nth % 2 == 0] + 1, at), assume_unique=True)
    signs = np.flatnonzero(_STEP[text])
    within, steps, upto = np.searchsorted(quotes, signs) % 2, _STEP[text[signs]], np.searchsorted(signs, at)
    depths = [np.concatenate([[0], np.cumsum(np.where(within == side, steps, 0))])[upto] for side in (0, 1)]
    return np.searchsorted(quotes, at), *depths


def _runs(b: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], pa.RecordBatch]]:
    """The parts of a batch that are of one block, and the block."""
    file, block = b.column("file").to_numpy(), b.column("block").to_numpy()
    ends = [*(np.flatnonzero((np.diff(file) != 0) | (np.diff(block) != 0)) + 1), len(file)]
    for low, high in zip([0, *ends], ends):
        if high > low:
            yield (int(file[low]), int(block[low])), b.slice(low, high - low)


def _block_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each block: its quotes, and for a block that begins outside a string and one that begins within, its steps and how many pieces begin outside at each depth."""

    def row(key, path, quotes, steps, levels):
        levels = [pa.array([list(x.items())], pa.map_(pa.int64(), pa.int64())) for x in levels]
        return pa.RecordBatch.from_arrays([*[pa.array([x], pa.int64()) for x in key], pa.array([path], pa.string()), *[pa.array([int(x)], pa.int64()) for x in (quotes, *steps)], *levels], names=["file", "block", "path", "quotes", "steps0", "steps1", "levels0", "levels1"])

    held = None
    for b in batches:
        for key, part in _runs(b):
            if held is None or held[0] != key:
                if held:
                    yield row(*held)
                held = (key, part.column("path")[0].as_py(), 0, (0, 0), (Counter(), Counter()))
            _, path, quotes, steps, levels = held
            before, *depths = _structure(part.column("value").cast(pa.string()))
            for side in (0, 1):
                outside = (before[:-1] + quotes) % 2 == side
                for level, n in zip(*np.unique(depths[(quotes + side) % 2][:-1][outside] + steps[side], return_counts=True)):
                    levels[side][int(level)] += int(n)
            held = (key, path, quotes + before[-1], tuple(steps[side] + depths[(quotes + side) % 2][-1] for side in (0, 1)), levels)
    if held:
        yield row(*held)


def _elements_of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """file, block, no, whole, text of the elements in each block; of the one that is open where a block begins and the one that is open where it ends, the part in the block."""

    def rows(key, first, texts, whole):
        n = len(texts)
        return pa.RecordBatch.from_arrays([pa.array([key[0]] * n, pa.int64()), pa.array([key[1]] * n, pa.int64()), pa.array(range(first, first + n), pa.int64()), pa.array([whole] * n, pa.bool_()), pa.array(texts, pa.string())], names=["file", "block", "no", "whole", "text"])

    key, quotes, depth, no, begun, held = None, 0, 0, 0, False, []
    for b in batches:
        for now, part in _runs(b):
            if now != key:
                if held:
                    yield rows(key, no, [",".join(held)], False)
                key, held, begun = now, [], False
                quotes, depth, no = (int(part.column(c)[0].as_py()) for c in ("within", "depth", "no"))
            values = part.column("value").cast(pa.string())
            before, *depths = _structure(values)
            outside, depths = (before + quotes) % 2 == 0, depth + depths[quotes % 2]
            begins = np.flatnonzero(outside[:-1] & ((depths[:-1] == 0) | (depths[:-1] == 1)))  # depth 0: the file's first piece
            bounds = np.unique([0, *begins, len(values)]).astype(np.int32)
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds), values), ",").to_pylist()
            if not len(begins) or begins[0] > 0:
                held.append(texts.pop(0))
            if texts:
                if held:
                    yield rows(key, no, [",".join(held)], begun)
                if len(texts) > 1:
                    yield rows(key, no + 1, texts[:-1], True)
                no, begun, held = no + len(texts), True, [texts[-1]]
            quotes, depth = quotes + int(before[-1]), int(depths[-1])
    if held:
        yield rows(key, no, [",".join(held)], False)


def _before(blocks: DataFrame, value: str, out: str) -> DataFrame:
    """Adds the sum of ``value`` over a file's blocks before this one."""
    summed = running_total(blocks, ["file", "block"], value, out)
    first = summed.groupBy("file").agg(F.min(F.struct("block", out)).alias("_first"))
    return summed.join(first, "file").withColumn(out, F.col(out) - F.col(f"_first.{out}")).drop("_first")


def _together(pieces: DataFrame) -> DataFrame:
    """The pieces in fewer tasks where the session's byte ranges are small; a task reads its ranges one after another."""
    spark, n = pieces.sparkSession, pieces.rdd.getNumPartitions()
    ranges = max(1, TASK_BYTES // spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return pieces.coalesce(max(1, -(-n // ranges), min(n, 2 * spark.sparkContext.defaultParallelism)))


def array_elements(spark: SparkSession, path) -> DataFrame:
    """path, no, element: the elements of JSON files that are one array each, as text.

    Spark cuts the files in byte ranges, and those at commas. Whether a piece begins within a string is the parity of the quotes
    before it, its depth the sum of brackets outside strings before it; a piece at depth 1 outside strings begins an element. A first reading of
    the files sums up each range, for both ways in which it can begin; running sums over the ranges say how each does begin, and a second reading cuts the elements out.
    A range is read by one task from start to end: what is shuffled are sums of ranges, and the elements that lie across borders.
    """
    m = F.col("_metadata.file_block_start")
    pieces = spark.read.option("lineSep", ",").text(path).select("value", F.xxhash64("_metadata.file_path").alias("file"), m.alias("block"), F.when(m == 0, F.col("_metadata.file_path")).alias("path"))
    pieces = _together(pieces)
    sums = pieces.mapInArrow(_block_sums, "file long, block long, path string, quotes long, steps0 long, steps1 long, levels0 map<long,long>, levels1 map<long,long>")
    quoted = _before(cut(sums), "quotes", "quotes_before").withColumn("within", F.col("quotes_before") % 2 == 1)
    side = lambda c: F.when(F.col("within"), F.col(f"{c}1")).otherwise(F.col(f"{c}0"))
    deep = _before(quoted.select("file", "block", "path", "within", side("steps").alias("steps"), side("levels").alias("levels")), "steps", "depth")
    level = lambda at: F.coalesce(F.try_element_at("levels", at - F.col("depth")), F.lit(0))
    begins = deep.select("file", "block", "path", "within", "depth", (level(F.lit(0)) + level(F.lit(1))).alias("begins"))
    blocks = cut(_before(begins, "begins", "no"))
    # Both readings take place here: the ranges are those of the session's settings now.
    placed = pieces.drop("path").join(F.broadcast(blocks.select("file", "block", "within", "depth", "no")), ["file", "block"])
    found = cut(placed.mapInArrow(_elements_of_blocks, "file long, block long, no long, whole boolean, text string"))
    across = found.where("NOT whole").groupBy("file", "no").agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("p"))
    texts = found.where("whole").select("file", "no", "text").unionByName(across.select("file", "no", F.array_join(F.transform("p", lambda x: x["text"]), ",").alias("text")))
    files = blocks.groupBy("file").agg(F.max("path").alias("path"), F.max(F.col("no") + F.col("begins")).alias("last"))
    head = F.when(F.col("no") == 1, F.regexp_replace("text", r"^[\s\ufeff]*\[", "")).otherwise(F.col("text"))
    # What stands behind the last element's end is the array's own bracket.
    element = F.trim(F.when(F.col("no") == F.col("last"), F.regexp_replace(head, r"\]\s*$", "")).otherwise(head))
    return texts.join(F.broadcast(files), "file").withColumn("element", element).where("element <> ''").select("path", "no", "element")


def read_json_array(spark: SparkSession, path, overrides: dict[str, str] | None = None) -> DataFrame:
    """Events of JSON files that are one array of objects each, of any size and on any number of lines; elements that are no objects are skipped."""
    records = array_elements(spark, path).select(F.from_json("element", _RECORD).alias("record"), "path")
    return map_to_events(records.where(F.col("record").isNotNull() & (F.size("record") > 0)), "record", F.col("path"), overrides)
