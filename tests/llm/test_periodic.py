import hashlib
import random
import time
import zlib
from fractions import Fraction

import pytest

from logloom.llm import periodic, queries
from tests.llm.conftest import ODD


def runs_by_brute_force(words):
    best = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(24, 3 * q):
                best.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, b - a, q) for (a, b), q in best.items())


def collapsed(words, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


def random_words(rng):
    out = []
    for _ in range(rng.randint(0, 6)):
        kind = rng.random()
        if kind < 0.5:
            period = [rng.choice("abcd"[: rng.randint(1, 4)]) for _ in range(rng.randint(1, 40))]
            out += [period[i % len(period)] for i in range(rng.randint(1, 200))]
        elif kind < 0.6:
            x, y = ["a"], ["a", "b"]
            for _ in range(rng.randint(3, 9)):
                x, y = y, y + x
            out += y
        elif kind < 0.7:
            x = [0]
            for _ in range(7):
                x += [1 - v for v in x]
            out += ["ab"[v] for v in x]
        else:
            out += [rng.choice("abcdefgh") for _ in range(rng.randint(1, 60))]
    return [w.encode() for w in out]


def test_brute_force():
    rng = random.Random(1)
    for _ in range(400):
        texts = [random_words(rng) for _ in range(rng.randint(1, 4))]
        for words, (runs, text) in zip(texts, periodic.scan_texts([b" ".join(t) for t in texts])):
            expected = runs_by_brute_force(words)
            assert runs == expected
            assert text == collapsed(words, expected)


@pytest.mark.parametrize("text", [b"the " * 250_000, b"de la " * 160_000, b" ".join(b"w%d" % (i % 1000) for i in range(200_000)), b" ".join(b"a b c d %d" % (i * i) for i in range(60_000))])
def test_long_texts_are_quick(text):
    began = time.process_time()
    runs, _ = periodic.scan_texts([text])[0]
    assert time.process_time() - began < 6
    words = text.split()
    assert runs == ([] if len(set(words)) > 1000 else [(0, len(words), len(set(words)))])


def planted(doc_id, text):
    """The words of a document of the query."""
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return words


def expected_row(doc_id, text):
    words = planted(doc_id, text)
    runs = runs_by_brute_force(words)
    a, n, q = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    lines = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
    return (doc_id, len(runs), a, n, q, n and 1000 * n // q, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(words, runs)).hexdigest())


def test_query_is_brute_force(spark, sf_dir):
    got = queries.op11_periodic_runs(spark, sf_dir)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    rows = {tuple(r) for r in got.collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert rows == {expected_row(r.doc_id, r.text) for r in docs} and any(r[1] for r in rows)


def test_odd(spark, odd, empty, tmp_path):
    repeats = [(10, " ".join(["spam and eggs"] * 20) + "\x1c\x85x", "en", "s", 1, "z"), (0, "\t\n ", "en", "s", 1, "z"), (11, "a b " * 30, "en", "s", 1, "z")]
    docs = odd.unionByName(spark.createDataFrame(repeats, odd.schema))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op11_periodic_runs(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted((expected_row(r[0], r[1]) for r in [*ODD, *repeats]), key=repr)
    assert periodic.scan(empty).count() == 0
    clash = docs.withColumnsRenamed({"lang": "runs", "source": "collapsed", "row": "_text", "n_chars": "best"})
    out = periodic.collapsed_docs(clash)
    assert out.columns == clash.columns and out.count() == clash.count()
    assert out.where("doc_id = 11").first().text == "a b"
    assert out.where("doc_id = 0").first().text == "\t\n "
