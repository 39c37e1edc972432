"""Deterministic synthetic logs of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.model import ERROR, INFO, VERBOSE, WARNING, as_events

# Multiplier and words of the generator.
HASH_MULTIPLIER = 2_654_435_761
WORDS = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa".split()
NEEDLE_EVERY = 50_000


def synthetic_logs(spark: SparkSession, rows: int, partitions: int | None = None) -> DataFrame:
    """Row i is a second after the one before; level by i modulo 20, 7 and 13; a rare token every 50 000 rows."""
    i = F.col("id")
    base = spark.range(0, rows, 1, partitions) if partitions else spark.range(rows)
    word = lambda k: F.element_at(F.array(*map(F.lit, WORDS)), (F.pmod(F.shiftright(F.pmod(i * HASH_MULTIPLIER, F.lit(2**32)), 4 * k), F.lit(len(WORDS))) + 1).cast("int"))
    level = F.when(i % 20 == 0, ERROR).when(i % 7 == 0, WARNING).when(i % 13 == 0, VERBOSE).otherwise(INFO)
    needle = F.when(i % NEEDLE_EVERY == 0, F.concat(F.lit(" NEEDLE_"), F.expr(f"id div {NEEDLE_EVERY}").cast("string"))).otherwise("")
    message = F.concat(F.lit("entry "), word(0), F.lit(" "), word(1), F.lit(" "), word(2), F.lit(" line "), i.cast("string"), needle)
    time = F.to_timestamp_ntz(F.lit("2025-01-01 00:00:00")) + F.make_dt_interval(secs=i.cast("decimal(18,6)"))
    return as_events(base.select(i.alias("row_id"), time.alias("log_time"), level.alias("level"), F.lit("synthetic").alias("provider"), F.lit("synthetic.log").alias("source"), message.alias("message"), message.alias("searchable")))
