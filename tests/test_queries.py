"""Every registered query of the library against its SQL."""

import pytest

import logloom.queries_files  # noqa: F401
from logloom.queries import ORACLE, QUERIES
from tests.oracle import assert_same, tables


@pytest.fixture(scope="module")
def con(sf_dir):
    return tables(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, sf_dir, con, name):
    assert_same(con, ORACLE[name], QUERIES[name](spark, sf_dir))


def test_capped_sequence(spark, sf_dir):
    whole = {(r.activity_id, r.seq): r for r in QUERIES["interactions"](spark, sf_dir).collect()}
    capped = QUERIES["capped_sequence"](spark, sf_dir).collect()
    by_id = {}
    for (a, _), r in whole.items():
        by_id.setdefault(a, []).append(r)
    for r in capped:
        if r.seq <= 2:
            assert r.label == whole[r.activity_id, r.seq].label
        else:
            left = sum(x.n for x in by_id[r.activity_id] if x.seq > 2)
            assert (r.kind, r.label) == ("note", f"… {left} more events (truncated)")
    assert len(capped) == sum(min(3, len(x)) for x in by_id.values())


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
