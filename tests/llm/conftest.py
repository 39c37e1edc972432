"""Odd documents that every operator must take: nulls, empty and long texts, repeats, ties, clashing extra columns."""

import pytest

LONG = " ".join(f"word{i % 977} of the long text" for i in range(6000))
ODD = [
    (1, "The quick brown fox jumps over the lazy dog and runs away.", "en", "s1", 1, "x"),
    (1, "The quick brown fox jumps over the lazy dog and runs away.", "en", "s1", 1, "x"),
    (2, "The quick brown fox jumps over the lazy dog and runs away.", "en", None, 1, None),
    (3, "", "en", "s1", 0, "y"),
    (4, None, None, "s1", None, "y"),
    (None, "no id here but some words", "en", "s2", 5, "z"),
    (None, None, None, None, None, None),
    (5, LONG, "en", "s1", len(LONG), "x"),
    (6, "12345 67890 !!!", None, "s3", 1, "x"),
    (7, "日本語のテキスト \U0001f600 naïve ÀÉ", "fr", "s3", 1, "x"),
    (8, "one", "de", "s3", 3, "x"),
    (9, "a\x00b\x1cc \u0130stanbul \u03a3", "de", "s3", 3, "x"),
]
# row, digest, sequence_id and others are names that operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()
