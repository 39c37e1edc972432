"""Trigram index for substring search: bitmaps of ids for trigrams of texts, and for the distinct values of columns that repeat.

The index is one table (kind, key, value, word, bits). A posting is a word of 64 ids: ``word``
is the id without its lower six bits, which are a place in ``bits``; ids that follow one another share postings, any 64-bit id
has one. Kinds:

* TEXT: ``key`` is a trigram of message or searchable, three code points in one number.
* VALUE: ``key`` is the hash of a value of provider, task or source; such columns are indexed once a value, not once a row.
* NAME: ``key`` and the ``value`` itself, lower-cased.

A search meets the bitmaps of its trigrams word by word, adds those of the values that hold
the term, and verifies the rows that are left. Times are not indexed: a term of digits is compared with them in the scan.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.plans.durable import cut
from logloom.plans.search import TIME_TEXT, any_contains

TEXT, VALUE, NAME = 0, 1, 2
REPEATING = ("provider", "task_name", "source")
#: Characters of a term from which on the index helps; trigrams of a term that are looked up; words of hits that are broadcast at most (16 bytes each).
MIN_TERM, MOST_TRIGRAMS, MOST_WORDS = 3, 16, 2_000_000
#: Stands between the texts of a row; its trigrams are left out.
_BREAK = "\u0001"
_BITS = 21


def _code(text: str) -> int:
    a, b, c = map(ord, text)
    return a << 2 * _BITS | b << _BITS | c


def word_of(row_id: Column) -> Column:
    return F.shiftright(row_id, 6)


def bit_of(row_id: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), row_id.bitwiseAND(F.lit(63)).cast("int"))


def build_trigrams(df: DataFrame) -> DataFrame:
    """The index of all rows with an id. Texts are cut into code points once, so long texts cost linear time."""
    rows = df.where(F.col("row_id").isNotNull())
    text = F.lower(F.concat_ws(_BREAK, F.col("message"), F.when(~F.col("searchable").eqNullSafe(F.col("message")), F.col("searchable"))))
    points = rows.where(F.char_length(text) >= MIN_TERM).select("row_id", F.transform(F.split(text, ""), F.ascii).alias("points"))
    at = lambda i: F.get("points", i).cast("long")
    i = F.col("i")
    # One row a place, compiled; a trigram that repeats in a text sets the same bit again.
    places = points.select("row_id", "points", F.explode(F.sequence(F.lit(0), F.size("points") - MIN_TERM)).alias("i"))
    pieces = places.select("row_id", (at(i) * (1 << 2 * _BITS) + at(i + 1) * (1 << _BITS) + at(i + 2)).alias("key"))
    mask = (1 << _BITS) - 1
    whole = pieces.where(reduce(lambda a, b: a & b, [F.shiftright("key", k * _BITS).bitwiseAND(F.lit(mask)) != ord(_BREAK) for k in range(3)]))
    postings = lambda x: x.groupBy("key", word_of(F.col("row_id")).alias("word")).agg(F.bit_or(bit_of(F.col("row_id"))).alias("bits"))
    values = rows.select("row_id", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lower(c).alias("value")) for c in REPEATING])).alias("v")).where("v.value <> ''")
    values = values.select("row_id", F.xxhash64("v.column", "v.value").alias("key"), "v.value")
    none = lambda kind: F.lit(None).cast(kind)
    columns = lambda kind, value, word, bits: [F.lit(kind).alias("kind"), "key", value.alias("value"), word.alias("word"), bits.alias("bits")]
    return (
        postings(whole).select(columns(TEXT, none("string"), F.col("word"), F.col("bits")))
        .unionByName(postings(values).select(columns(VALUE, none("string"), F.col("word"), F.col("bits"))))
        .unionByName(values.select("key", "value").distinct().select(columns(NAME, F.col("value"), none("long"), none("long"))))
    )


#: Buckets of a saved index, and tasks that share the postings of a bucket: a common trigram is in nearly every word.
BUCKETS, SALTS = 64, 16


def _bucket(key: int) -> int:
    """Of a trigram: its middle and last letter, in a prime number of steps."""
    return key % 8191 % BUCKETS


def save_trigrams(df: DataFrame, path: str, from_id: int | None = None, to_id: int | None = None) -> None:
    """The index of the rows with ids in [from_id, to_id), without bounds of all, as Parquet, partitioned by kind and a bucket of the trigram: a search reads the buckets of its trigrams.

    Each range of ids is a folder that is written over when the range is built
    again, so building goes on where it stopped (see ``indexed_ranges``).
    """
    rows = df
    if from_id is not None:
        rows = rows.where(F.col("row_id") >= from_id)
    if to_id is not None:
        rows = rows.where(F.col("row_id") < to_id)
    name = "all" if from_id is None and to_id is None else f"{'' if from_id is None else from_id}..{'' if to_id is None else to_id}"
    index = build_trigrams(rows).withColumn("bucket", F.when(F.col("kind") == TEXT, F.pmod(F.pmod("key", F.lit(8191)), F.lit(BUCKETS))).otherwise(0).cast("int"))
    dealt = index.repartition("kind", "bucket", F.pmod(F.xxhash64("word"), F.lit(SALTS))).sortWithinPartitions("kind", "bucket", "key", "word")
    dealt.write.mode("overwrite").partitionBy("kind", "bucket").parquet(f"{path}/ids={name}")
    df.sparkSession.createDataFrame([(name,)], "ids string").coalesce(1).write.mode("append").parquet(f"{path}/_ranges/names")


def load_trigrams(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def indexed_ranges(spark: SparkSession, path: str) -> list[str]:
    """Ranges of ids (``all``, or ``low..high``) whose index is complete: noted when it is written."""
    return sorted(r["ids"] for r in spark.read.parquet(f"{path}/_ranges/names").distinct().collect())  # one row a range


def _hits(index: DataFrame, term: str) -> DataFrame:
    """word, bits of the ids that may hold the term in an indexed column."""
    codes = sorted({_code(term[i : i + 3]) for i in range(len(term) - 2)})
    codes = codes[:: -(-len(codes) // MOST_TRIGRAMS)]
    texts = index.where((F.col("kind") == TEXT) & F.col("key").isin(codes))
    if "bucket" in index.columns:
        texts = texts.where(F.col("bucket").isin(sorted({_bucket(c) for c in codes})))
    each = texts.groupBy("word").agg(*[F.bit_or(F.when(F.col("key") == c, F.col("bits"))).alias(f"t{i}") for i, c in enumerate(codes)])
    met = each.select("word", reduce(lambda a, b: a.bitwiseAND(b), [F.col(f"t{i}") for i in range(len(codes))]).alias("bits"))
    named = index.where((F.col("kind") == NAME) & F.contains("value", F.lit(term))).select("key")
    valued = index.where(F.col("kind") == VALUE).join(named, "key", "left_semi").select("word", "bits")
    return met.where("bits <> 0").unionByName(valued).groupBy("word").agg(F.bit_or("bits").alias("bits"))


def search_indexed(df: DataFrame, trigrams: DataFrame, term: str) -> DataFrame:
    """Rows that hold the term, as a scan finds them: those that the index names, verified, and rows without an id.

    A term under three characters is scanned, and so is one that is in so many words of ids that their table would not be small:
    the index saves nothing there. Else the words are broadcast, and their least and largest id bound the scan.
    """
    low = term.lower()
    if len(low) < MIN_TERM or _BREAK in low:
        return df.where(any_contains(term))
    hits = cut(_hits(trigrams, low))
    n, first, last = hits.agg(F.count(F.lit(1)), F.min("word"), F.max("word")).first()
    if n > MOST_WORDS:
        return df.where(any_contains(term))
    row_id = F.col("row_id")
    wanted = row_id.isNull()
    if n:
        wanted = wanted | ((row_id >= first * 64) & (row_id <= last * 64 + 63))
    timed = F.contains(F.date_format("log_time", TIME_TEXT), F.lit(low)) if re.fullmatch("[0-9: -]+", low) else None
    if timed is not None:
        wanted = wanted | timed
    words = F.broadcast(hits.select(F.col("word").alias("_word"), F.col("bits").alias("_bits")))
    found = df.where(wanted).join(words, word_of(row_id) == F.col("_word"), "left")
    named = F.coalesce(F.col("_bits").bitwiseAND(bit_of(row_id)) != 0, F.lit(False)) | row_id.isNull()
    return found.where(named if timed is None else named | timed).where(any_contains(term)).select(df.columns)


def index_stats(trigrams: DataFrame) -> DataFrame:
    """Of the texts: postings (id and trigram), trigrams, rows."""
    texts = trigrams.where(F.col("kind") == TEXT)
    rows = texts.groupBy("word").agg(F.bit_or("bits").alias("bits")).agg(F.coalesce(F.sum(F.bit_count("bits")), F.lit(0)).alias("rows"))
    return texts.agg(F.coalesce(F.sum(F.bit_count("bits")), F.lit(0)).alias("postings"), F.count_distinct("key").alias("trigrams")).crossJoin(rows)
