import hashlib
from collections import Counter

import pytest

from logloom.llm import line_dedup, queries
from tests.llm.conftest import ODD
from tests.oracle import assert_same, tables

UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(UPPER)


def by_brute_force(rows, min_docs=10, min_chars=1):
    """(doc_id, n_lines, n_dropped, kept text) of (doc_id, text) rows."""
    found = Counter(k for _, text in rows for k in {key(x) for x in (text or "").split("\n")})
    gone = {k for k, n in found.items() if n >= min_docs and len(k) >= min_chars}
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in gone]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


LINED = [(i, f"Share this!\n\tline {i} of one\nline {i % 3} É\r\n\n SHARE THIS! ", "en", "s", 1, "x") for i in range(20)]
LINED += [(100 + i, "É common", "en", "s", 1, "x") for i in range(9)] + [(109, "é common\nShare this", "en", "s", 1, "x")]
LINED += [(None, "no id", "en", "s", 1, "x")] * 12 + [(7, "same row\n\n", "en", "s", 1, "x")] * 11


def as_rows(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in df.collect()), key=repr)


def test_oracle(spark, sf_dir):
    assert_same(tables(sf_dir), queries.ORACLE["op12_line_dedup"], queries.op12_line_dedup(spark, sf_dir))


def test_brute_force(spark, odd, empty):
    docs = odd.unionByName(spark.createDataFrame(LINED, odd.schema)).repartition(5)
    rows = [(r[0], r[1]) for r in [*ODD, *LINED]]
    for n in (1, 3, 4):
        assert as_rows(line_dedup.dedup(docs, n_batches=n)) == by_brute_force(rows)
    for min_docs, min_chars in ((1, 1), (3, 0), (2, 12), (1000, 1)):
        assert as_rows(line_dedup.dedup(docs, min_docs, min_chars)) == by_brute_force(rows, min_docs, min_chars)
    assert line_dedup.dedup(empty).count() == 0


def test_query_on_odd_rows(spark, odd, tmp_path):
    docs = odd.unionByName(spark.createDataFrame(LINED, odd.schema))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op12_line_dedup(spark, str(tmp_path)).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()), key=repr)
    rows = [(r[0], r[1]) for r in [*ODD, *LINED]]
    assert got == sorted(((*r[:3], hashlib.sha256(r[3].encode()).hexdigest()) for r in by_brute_force(rows)), key=repr)


@pytest.mark.parametrize("known", [0, 2, 1000])
def test_full_filter_and_few_known(spark, odd, monkeypatch, known):
    """A filter too small for its digests lets more lines pass, digests that tasks do not hold are joined, and results stay."""
    from logloom.llm import chunk_dedup

    monkeypatch.setattr(chunk_dedup, "FILTER_BITS", 64)
    monkeypatch.setattr(line_dedup, "KNOWN", known)
    docs = odd.unionByName(spark.createDataFrame(LINED, odd.schema))
    assert as_rows(line_dedup.dedup(docs, min_docs=2)) == by_brute_force([(r[0], r[1]) for r in [*ODD, *LINED]], 2)


def test_runs_level_and_settle(spark, empty):
    schema = empty.schema
    runs = line_dedup.LineRuns(spark, min_docs=3)
    sizes = []
    for i in range(7):
        runs.add(spark.createDataFrame([(2 * i + j, f"common\nown {i} {j}", "en", "s", 1, "x") for j in range(2)], schema))
        sizes.append([bool(x) for x in runs.levels])
    assert sizes[:4] == [[True], [False, True], [True, True], [False, False, True]] and sizes[6] == [True, True, True]
    counts = [r.n for run in runs.runs() for r in run.collect()]
    # "common" is settled after the second batch: the later ones add nothing for it.
    assert sum(counts) == 14 + 4
    # The join of a batch with a run reads the run as it lies, sorted and in buckets.
    batch = line_dedup.line_digests(spark.createDataFrame(LINED, schema)).groupBy("high", "low").count()
    plan = batch.hint("merge").join(runs.runs()[0], ["high", "low"], "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and plan.count("Exchange") == 1
    docs = spark.createDataFrame([(50, "x\ncommon\ny", "en", "s", 10, "r")], schema).withColumnRenamed("row", "n_lines")
    out = line_dedup.deduped_docs(docs, runs)
    assert out.columns == docs.columns
    assert tuple(out.first()) == (50, "x\ny", "en", "s", 3, "r")
