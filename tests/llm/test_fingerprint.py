import hashlib
import random

from pyspark.sql import functions as F

from logloom.llm import fingerprint
from logloom.llm.queries import op6_fingerprints


def test_query(spark, sf_dir, documents):
    docs = sorted(((d.doc_id, d.text) for d in documents.collect()), reverse=True)
    got = {r.doc_id: r for r in op6_fingerprints(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    by_text = {}
    for i, (k, text) in enumerate(docs):
        after, half = docs[(i + 1) % len(docs)], len(text) // 2
        edited = text[: len(text) - half] + after[1][:half]
        r = got[k]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if text == after[1]:
            assert r.near_next == 1
    long = [r for r in got.values() if r.n_chars > 500]
    assert sum(r.near_edited for r in long) / len(long) > 0.35 > 0.1 > sum(r.near_next for r in long) / len(long)


def prints(spark, texts):
    df = fingerprint.with_fingerprint(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), fingerprint.packed_kmers(F.col("t")), "fp")
    return [r.fp for r in df.orderBy("i").collect()]


def test_order_and_edits(spark):
    words = [f"token{i * 7919 % 1009}" for i in range(400)]
    base, moved, edited, other = " ".join(words), " ".join(words[200:] + words[:200]), " ".join(words[:50] + ["new"] + words[51:]), " ".join(w[::-1] for w in words)
    a, b, c, d, e, f = prints(spark, [base, moved, edited, other, base, "ab" * 4000])
    like = lambda x, y: len(set(x) & set(y)) / max(len(x), len(y))
    assert a == e and like(a, c) > 0.8 > like(a, b) > like(a, d)
    # The text is two k-mers with thousands of copies: these are elements of their own.
    assert len(f) == fingerprint.BINS
    assert prints(spark, ["", "a", "abcdefg"])[0] == [] and all(len(x) == 1 for x in prints(spark, ["a", "abcdefg", "abcdefgh"]))


def _sign(x, bits):
    return x - (1 << bits) if x >> (bits - 1) & 1 else x


def brute_force(spark, text):
    """Bins, smallest elements and their order, from the k-mers' hashes themselves; all k-mers are elements."""
    k, mask = fingerprint.K, (1 << 64) - 1
    kmers = [text[i : i + k] for i in range(len(text) - k + 1)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(kmers)], "i long, x string")
    seen, elements = {}, []
    for r in df.select("i", F.xxhash64("x").alias("h")).orderBy("i").collect():
        short = _sign(r.h & ((1 << 34) - 1), 34)
        number = seen.get(short, 0)
        seen[short] = number + 1
        elements.append((r.i, short, number))
    hashes = spark.createDataFrame(elements, "i long, h long, n int").select("i", F.when(F.col("n") == 0, F.col("h")).otherwise(F.xxhash64("h", "n")).alias("g")).collect()
    bins = {}
    for r in hashes:
        g = r.g << 30 & mask
        bins.setdefault((_sign(g >> 58, 6)) + 32, []).append((g >> 30 & ((1 << 28) - 1), r.i))
    tuples = []
    for b, found in sorted(bins.items()):
        chosen = sorted(sorted(found)[: fingerprint.TUPLE], key=lambda x: x[1])
        tuples.append((b, *[h for h, _ in chosen], *[None] * (fingerprint.TUPLE - len(chosen))))
    expected = spark.createDataFrame(tuples, "b long, h0 long, h1 long").select("b", F.xxhash64("h0", "h1").alias("t")).orderBy("b").collect()
    return [((r.b << 26) | (r.t & ((1 << 26) - 1))) - (1 << 31) for r in expected]


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n // 4 + 2))[:n]


def test_brute_force(spark):
    rng = random.Random(9)
    texts = [
        "the rain in spain stays mainly in the plain, the rain in spain " * 9, words(rng, 500), words(rng, 777), words(rng, 3079), words(rng, 20_000),
        ("to be or not to be that is the question " * 90)[:3500], "ab" * 4000, "a" * 6000, " ".join(f"{i % 70} bottles" for i in range(2500)), "one word",
        words(rng, 40), "naïve 日本語のテキスト \U0001f600\U0001f601 " * 30,
    ]
    for text, got in zip(texts, prints(spark, texts)):
        assert got == brute_force(spark, text), text[:40]


def test_one_more_character(spark):
    """A character at the end changes few tuples at every length."""
    rng, sizes = random.Random(4), [*range(760, 781, 4), *range(1530, 1546, 3), *range(3070, 3086, 3)]
    texts = [words(rng, n) for n in sizes]
    df = spark.createDataFrame([(i, t, t + "z") for i, t in enumerate(texts)], "i int, t string, u string")
    df = fingerprint.with_fingerprint(fingerprint.with_fingerprint(df, fingerprint.packed_kmers(F.col("t")), "one"), fingerprint.packed_kmers(F.col("u")), "two")
    assert all(r.like > 0.95 for r in df.select(fingerprint.likeness(F.col("one"), F.col("two")).alias("like")).collect())


def test_next_of_equal_ids(spark):
    """Rows that share an id or have none are dealt by the hash of the text; every row has the next in the whole order."""
    rows = [(i if i % 3 == 0 else 7 if i % 3 == 1 else None, f"text {i}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    tie = F.xxhash64("text")
    ordered = [r.text for r in df.orderBy(F.desc_nulls_last("doc_id"), tie).collect()]
    got = {r.text: r.next_text for r in fingerprint.with_next(df, ["text"], tie).collect()}
    assert got == dict(zip(ordered, ordered[1:] + ordered[:1]))


def test_edited_text_has_its_own_fingerprint(spark, sf_dir, odd):
    """The k-mers put together from the text's own and the rest's are those of the edited text, at all lengths."""
    short = spark.createDataFrame([(i, ("abcdefghijklmnopqrstuvwxyz" * 2)[i : i + n]) for i, n in enumerate([*range(0, 24), 40, 3, 0, 30, 0, 9])], "doc_id long, text string")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").where("doc_id < 60")
    for df in (short, docs):
        rows = sorted(((r.doc_id, r.text) for r in df.collect()), reverse=True)
        edits = [t[: len(t) - len(t) // 2] + rows[(i + 1) % len(rows)][1][: len(t) // 2] for i, (_, t) in enumerate(rows)]
        direct = prints(spark, [t for _, t in rows] + edits)
        expected = {k: [fingerprint_text(direct[i]), fingerprint_text(direct[len(rows) + i])] for i, (k, _) in enumerate(rows)}
        assert {r.doc_id: [r.fingerprint, r.edited_fingerprint] for r in fingerprint.fingerprints(df).collect()} == expected


def fingerprint_text(fp):
    return "".join(f"{v + (1 << 31):08X}" for v in fp)


def test_odd(odd, empty):
    rows = fingerprint.fingerprints(odd).collect()
    assert len(rows) == odd.count()
    assert all(r.fingerprint == "" for r in rows if r.n_chars == 0)
    assert len({r.fingerprint for r in rows if r.doc_id in (1, 2)}) == 1
    assert fingerprint.fingerprints(empty).count() == 0
    one = fingerprint.fingerprints(odd.where("doc_id = 8")).collect()
    assert one[0].near_next == 1.0


def test_native(spark, sf_dir):
    plan = op6_fingerprints(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
