"""Line dedup with levelled sorted runs of line hashes.

A line's key is the line without ASCII white space at both ends, A-Z lower-cased; its
digest has 128 bits. Documents come in batches. A batch counts in how many of its
documents each digest occurs, drops by an anti-join the digests that earlier runs have settled
already (those found in enough documents), and adds what is left as a run
of its own on level 0. Two runs of one level are merged into one of the next, counts
added, so after n batches there are about log2(n) runs, and the merge of all of them has every
digest's count.

A run is a table in buckets of its digests, sorted within: merges and anti-joins read
bucket by bucket, without a shuffle of what is stored. A line that a third of all documents have is one row per task
before the shuffle and no row at all once it is settled.

The frequent digests then drop lines. Those in the most documents, KNOWN at most, go to all
tasks, so no hot line takes part in a join. A Bloom filter of the others, of bounded size, passes
most texts through at once; the digests that it lets pass meet the frequent ones in a join, and
the texts concerned are written again without the lines dropped.

Defined results: null and empty texts have one empty line; every row is a
document, rows with equal or null ids too; a key counts once per document; of a key
that is dropped all lines go, in every document; a key shorter than ``min_chars`` code points is
never dropped; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.chunk_dedup import HASHES, digest_filter, places_in_filter
from logloom.llm.common import arrow_map
from logloom.plans.durable import scratch

#: Code points of a key and documents that have it from which on a line is dropped.
MIN_CHARS, MIN_DOCS = 1, 10
#: Frequent digests that all tasks hold at most (16 bytes each).
KNOWN = 50_000
#: Batches that a table is dealt into where it comes as a whole.
BATCHES = 4

_SPACE = b" \t\n\x0b\x0c\r"


def digests(text: bytes | None, min_chars: int = MIN_CHARS) -> list[bytes | None]:
    """Digest of the key of each line; None for keys that are never dropped."""
    known: dict[bytes, bytes | None] = {}
    out = []
    for line in (text or b"").split(b"\n"):
        key = line.strip(_SPACE).lower()  # of bytes: A-Z alone
        if key not in known:
            long = len(key) >= min_chars and (min_chars < 2 or len(key.decode("utf-8", "replace")) >= min_chars)
            known[key] = hashlib.blake2b(key, digest_size=16).digest() if long else None
        out.append(known[key])
    return out


def _halves(found: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(found), dtype=np.int64).reshape(-1, 2)


def line_digests(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """high, low: the distinct digests of each document, a row for each."""

    def run(batches):
        for b in batches:
            found: list[bytes] = []
            for t in b.column("text").to_pylist():
                found += {d for d in digests(t, min_chars) if d}
            halves = _halves(found)
            yield pa.RecordBatch.from_arrays([pa.array(halves[:, 0]), pa.array(halves[:, 1])], names=["high", "low"])

    return arrow_map(docs.select(F.col("text").cast("string").cast("binary").alias("text")), run, "high long, low long")


class LineRuns:
    """Counts of line digests over the batches added so far, in levelled sorted runs under a shared folder."""

    def __init__(self, spark: SparkSession, path: str | None = None, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS):
        self.spark, self.min_docs, self.min_chars = spark, min_docs, min_chars
        self.path = path or scratch(spark, "line_runs")
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[str | None] = []  # the run of each level, by table name

    def _written(self, run: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        # One file a bucket, sorted: the same partitioning as the buckets.
        (
            run.select("high", "low", "n").repartition(self.buckets, "high", "low")
            .write.bucketBy(self.buckets, "high", "low").sortBy("high", "low").option("path", f"{self.path}/{name}").saveAsTable(name)
        )
        return name

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for name in self.levels if name]

    def _merged(self, one: str, two: str) -> str:
        """Both runs as one, counts added, bucket by bucket."""
        a, b = self.spark.table(one), self.spark.table(two)
        zero = F.lit(0).cast("long")
        both = a.withColumnRenamed("n", "n_a").join(b.withColumnRenamed("n", "n_b"), ["high", "low"], "full")
        name = self._written(both.select("high", "low", (F.coalesce("n_a", zero) + F.coalesce("n_b", zero)).alias("n")))
        for old in (one, two):
            self.spark.sql(f"DROP TABLE {old}")  # its files stay in the folder until that is cleared: a lost task may read them again
        return name

    def add(self, docs: DataFrame) -> None:
        """One batch of documents: its digests that are not settled yet become a run; equal levels are merged."""
        batch = line_digests(docs, self.min_chars).groupBy("high", "low").agg(F.count(F.lit(1)).alias("n"))
        for run in self.runs():
            settled = run.where(F.col("n") >= self.min_docs).select("high", "low")
            batch = batch.join(settled, ["high", "low"], "left_anti")
        name, level = self._written(batch), 0
        while level < len(self.levels) and self.levels[level]:
            name, self.levels[level] = self._merged(self.levels[level], name), None
            level += 1
        if level == len(self.levels):
            self.levels.append(None)
        self.levels[level] = name

    def compact(self) -> None:
        """All runs into one."""
        names = [name for name in self.levels if name]
        if len(names) > 1:
            self.levels = [None] * (len(self.levels) - 1) + [reduce(self._merged, names)]

    def frequent(self) -> DataFrame:
        """high, low, n of the digests found in ``min_docs`` documents or more; n ends growing at the batch that settles it."""
        self.compact()
        found = [run.where(F.col("n") >= self.min_docs) for run in self.runs()]
        return found[0] if found else self.spark.createDataFrame([], "high long, low long, n long")


def _kept_lines(text: bytes | None, found: list[bytes | None], gone: set[bytes]) -> tuple[bytes | None, int]:
    """The text without the lines whose digest is in ``gone``, and how many those are; a text without any stays as it is."""
    n = sum(d in gone for d in found)
    return (b"\n".join(line for line, d in zip((text or b"").split(b"\n"), found) if d not in gone), n) if n else (text, 0)


def _judged(rows: DataFrame, kept: list[str], known: set[bytes], words: np.ndarray, bits: int, min_chars: int) -> DataFrame:
    """``kept``, text without the known lines, n_lines, n_dropped, and the other digests (highs, lows) that the filter of frequent ones lets pass; empty arrays: nothing more to drop."""
    shared = rows.sparkSession.sparkContext.broadcast((known, words))
    longs = pa.list_(pa.int64())

    def run(batches):
        known, held = shared.value[0], shared.value[1].view(np.uint64)
        for b in batches:
            texts, highs, lows, n_lines, n_dropped = [], [], [], [], []
            for t in b.column("text").to_pylist():
                found = digests(t, min_chars)
                halves = _halves([d for d in set(found) if d and d not in known])
                passes = np.ones(len(halves), dtype=bool)
                for i in range(HASHES):
                    at = places_in_filter(halves[:, 0], halves[:, 1], i, bits)
                    passes &= (held[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
                highs.append(halves[passes, 0])
                lows.append(halves[passes, 1])
                n_lines.append(len(found))
                t, n = _kept_lines(t, found, known)
                texts.append(t)
                n_dropped.append(n)
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in kept], pa.array(texts, pa.binary()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(highs, longs), pa.array(lows, longs)],
                names=[*kept, "text", "n_lines", "n_dropped", "highs", "lows"],
            )

    kinds = dict(rows.dtypes)
    return arrow_map(rows.select(*kept, "text"), run, ", ".join([*(f"{c} {kinds[c]}" for c in kept), "text binary, n_lines long, n_dropped long, highs array<long>, lows array<long>"]))


def _without(rows: DataFrame, kept: list[str], min_chars: int) -> DataFrame:
    """``kept``, text without the lines whose digests are in ``gone`` (high, low), n_lines, n_dropped."""

    def run(batches):
        for b in batches:
            texts, dropped = [], []
            for t, gone, n in zip(*(b.column(c).to_pylist() for c in ("text", "gone", "n_dropped"))):
                t, more = _kept_lines(t, digests(t, min_chars), {np.array([g["high"], g["low"]], dtype=np.int64).tobytes() for g in gone or []})
                texts.append(t)
                dropped.append(n + more)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(texts, pa.binary()), b.column("n_lines"), pa.array(dropped, pa.int64())], names=[*kept, "text", "n_lines", "n_dropped"])

    kinds = dict(rows.dtypes)
    return arrow_map(rows.select(*kept, "text", "n_lines", "n_dropped", "gone"), run, ", ".join([*(f"{c} {kinds[c]}" for c in kept), "text binary, n_lines long, n_dropped long"]))


def _drop(docs: DataFrame, frequent: DataFrame, kept: list[str], text: str, min_chars: int) -> DataFrame:
    """``kept`` columns, text (binary), n_lines, n_dropped of every row."""
    spark = docs.sparkSession
    rows = docs.select(*kept, F.col(text).cast("string").cast("binary").alias("text"))
    path = scratch(spark, "line_dedup")
    top = frequent.orderBy(F.col("n").desc(), "high", "low").limit(KNOWN).select("high", "low").collect()
    known = {np.array([r["high"], r["low"]], dtype=np.int64).tobytes() for r in top}
    # Written: rows get numbers that stay the same whatever is computed again.
    judged = _judged(rows, kept, known, *digest_filter(frequent), min_chars)
    judged.withColumn("row", F.when(F.size("highs") > 0, F.monotonically_increasing_id())).write.parquet(path)
    judged = spark.read.parquet(path)
    fine = judged.where("row IS NULL").select(*kept, "text", "n_lines", "n_dropped")
    if len(known) < KNOWN:  # all frequent digests are known: what passed the filter is not frequent
        return judged.select(fine.columns)
    open_rows = judged.where("row IS NOT NULL")
    single = open_rows.select("row", F.explode(F.arrays_zip("highs", "lows")).alias("d")).select("row", F.col("d.highs").alias("high"), F.col("d.lows").alias("low"))
    gone = single.join(frequent, ["high", "low"]).groupBy("row").agg(F.collect_list(F.struct("high", "low")).alias("gone"))
    # A row's list is bounded by its own lines; the lists are the build side, so texts are not sorted.
    settled = open_rows.drop("highs", "lows").join(gone.hint("shuffle_hash"), "row", "left")
    return fine.unionByName(_without(settled, kept, min_chars))


def batches(docs: DataFrame, n: int) -> Iterator[DataFrame]:
    """The table in n parts by a hash of all but the text: each row is in one of them."""
    keys: list[Column] = [F.col(c).cast("string") for c, kind in docs.dtypes if c != "text" and kind in ("bigint", "int", "string")]
    for i in range(n):
        yield docs.where(F.pmod(F.xxhash64(*keys), F.lit(n)) == i) if keys else docs.where(F.lit(i == 0))


def _frequent(docs: DataFrame, min_docs: int, min_chars: int, n_batches: int) -> DataFrame:
    runs = LineRuns(docs.sparkSession, None, min_docs, min_chars)
    for batch in batches(docs, n_batches):
        runs.add(batch)
    return runs.frequent()


def dedup(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, n_batches: int = BATCHES) -> DataFrame:
    """doc_id, text (null if it was null and nothing is dropped), n_lines, n_dropped of every row."""
    out = _drop(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("_text")), _frequent(docs, min_docs, min_chars, n_batches), ["doc_id"], "_text", min_chars)
    return out.withColumn("text", F.col("text").cast("string"))


def deduped_docs(docs: DataFrame, runs: LineRuns) -> DataFrame:
    """``docs``, all rows and columns, without the lines that ``runs`` found in enough documents; n_chars follows where it is a column."""
    numbered = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    kinds = dict(docs.dtypes)
    out = _drop(docs.withColumnsRenamed(numbered), runs.frequent(), list(numbered.values()), numbered["text"], runs.min_chars)
    changed, new = F.col("n_dropped") > 0, F.col("text").cast("string")
    return out.select(
        *[
            F.when(changed, new).otherwise(F.col(v)).alias(c) if c == "text"
            else F.when(changed, F.char_length(new).cast(kinds[c])).otherwise(F.col(v)).alias(c) if c == "n_chars"
            else F.col(v).alias(c)
            for c, v in numbered.items()
        ]
    )
