import hashlib
import zlib
from collections import defaultdict

import pytest

from logloom.llm import merkle, queries
from tests.llm.conftest import ODD, SCHEMA
from tests.oracle import assert_same, tables

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def by_brute_force(rows):
    """Result rows of (doc_id, source, lang, n_chars, text) rows."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {name: levels([x[2] for x in sorted(groups[name], key=lambda x: x[:3])]) for name in names}
    top = levels([trees[name][-1][0] for name in names])
    out = []
    for k, name in enumerate(names):
        for i, (_, _, digest, r) in enumerate(sorted(groups[name], key=lambda x: x[:3])):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None
            now, proof = leaf([*r[:4], r[4].translate(UPPER)]) if tampered else digest, []
            for tree, place in ((trees[name], i), (top, k)):
                for nodes in tree[:-1]:
                    a = place - place % 8
                    proof += nodes[a:place] + nodes[place + 1 : a + 8]
                    now = h(*nodes[a:place], now, *nodes[place + 1 : a + 8])
                    place //= 8
            out.append((r[0], digest, trees[name][-1][0], top[-1][0], h(*proof), now, now == top[-1][0]))
    return sorted(out, key=repr)


def result(df):
    return sorted(map(tuple, df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


def values(rows):
    return [(r[0], r[3], r[2], r[4], r[1]) for r in rows]


def test_query_is_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(COLUMNS).collect()
    got = result(queries.op13_merkle_manifest(spark, sf_dir))
    assert got == by_brute_force([tuple(r) for r in docs])
    assert {r[-1] for r in got} == {True, False}


def test_oracle(spark, sf_dir):
    assert_same(tables(sf_dir), queries.ORACLE["op13_merkle_manifest"], queries.op13_merkle_manifest(spark, sf_dir))


MANY = [(i * i * 37 - 90_000, f"Text {i}", "en" if i % 7 else None, "s", i, "x") for i in range(1500)]
TIES = [(7, f"Tie {i % 40}", "en", "s", 1, "x") for i in range(700)] + [(None, "N", "en", "s", 1, "x")] * 600 + [(-1, "A", "é", None, None, "x"), (2**63 - 1, "B", "z", "s", 1, "x"), (-(2**63), "C", "z", "s", 1, "x")]


@pytest.mark.parametrize("rows", [ODD, MANY, ODD + MANY + TIES, TIES[:1], MANY[1:3]])
def test_brute_force(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    assert result(queries.op13_merkle_manifest(spark, str(tmp_path))) == by_brute_force(values(rows))


def test_many_groups(spark):
    rows = [(i, "Aa", f"l{i % 700}", "s", 1, "x") for i in range(1400)]
    from logloom.llm.common import doc_crc

    docs = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("row", "slot")
    out = merkle.manifest(docs, "lang", COLUMNS, doc_crc() % 3 == 0)
    assert result(out) == by_brute_force(values(rows))
    assert {(r.grp, r.slot) for r in out.collect()} == {(f"l{i}", j) for i in range(700) for j in range(2)}


def test_empty(spark, empty):
    from logloom.llm.common import doc_crc

    assert merkle.manifest(empty, "lang", COLUMNS, doc_crc() % 3 == 0).count() == 0
