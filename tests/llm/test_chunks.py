import itertools
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from logloom.llm import chunk_dedup
from logloom.llm.queries import op10_substring_dedup


def brute_cuts(low):
    """Places whose hash is larger than RADIUS before and no smaller than RADIUS behind."""
    n, w = len(low), chunk_dedup.WINDOW
    h = []
    for i in range(n):
        x = sum(int(chunk_dedup.GEAR[low[i - j] & 1023]) << j for j in range(min(w, i + 1)))
        h.append((x & 0xFFFFFFFF) | 1)
    r = chunk_dedup.RADIUS
    return [i + 1 for i in range(n) if h[i] > max(h[max(0, i - r) : i], default=0) and h[i] >= max(h[i + 1 : i + 1 + r], default=0)]


def test_cuts():
    rng = random.Random(1)
    for n in (0, 1, 5, 41, 700):
        low = np.array([rng.choice([97, 98, 99, 32]) for _ in range(n)], dtype=np.uint32)
        ends = chunk_dedup.cuts(low)
        assert ends == sorted(set(brute_cuts(low)) | ({n} if n else set()))
    assert chunk_dedup.cuts(np.full(3000, 97, dtype=np.uint32))[-1] == 3000
    assert max(np.diff([0, *chunk_dedup.cuts(np.full(3000, 97, dtype=np.uint32))])) <= chunk_dedup.MAX_CHARS


def test_chunks_tile_the_text():
    text = "  The cat,\n\n sat — ON the Mat!! " * 40
    c = chunk_dedup.chunks(text)
    assert c[0][1] == 0 and c[-1][2] == len(text) and all(a[2] == b[1] for a, b in zip(c, c[1:]))
    assert chunk_dedup.chunks(None) == [] == chunk_dedup.chunks("")


def test_insertions_change_few_chunks():
    rng = random.Random(2)
    words = [f"w{rng.randrange(10**6)}" for _ in range(1000)]
    a = {x[0] for x in chunk_dedup.chunks(" ".join(words))}
    words.insert(500, "inserted")
    b = {x[0] for x in chunk_dedup.chunks(" ".join(words))}
    assert len(a ^ b) <= 8


def planted(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    passages = [" ".join(word() for _ in range(rng.randint(55, 90))) for _ in range(20)]
    rows, expected = [], set()
    for i in range(300):
        words = [word() for _ in range(rng.randint(60, 300))]
        if i % 5 == 0:
            at = rng.randrange(len(words))
            words[at:at] = passages[i // 5 % 20].upper().split() if i % 2 else passages[i // 5 % 20].split()
            expected.add(i)
        rows.append((i, " ".join(words) + (" the same short line at the end" if i % 3 == 0 else "")))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4), expected


def test_planted_passages(spark):
    docs, expected = planted(spark)
    got = chunk_dedup.repeated_passages(docs).collect()
    assert {r.doc_id for r in got} <= expected and len({r.doc_id for r in got}) >= 0.95 * len(expected)
    assert all(r.is_first == (r.doc_id == r.first_doc) for r in got)
    out = {r.doc_id: r.text for r in chunk_dedup.dedup_text(docs, chunk_dedup.repeated_passages(docs)).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for k, t in texts.items():
        cut = sum(r.end - r.start for r in got if r.doc_id == k and not r.is_first)
        assert len(out[k]) == len(t) - cut


def kept_places(docs, passages):
    """Places of each repeated chunk that stay in the text and lie in a passage, by digest."""
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = {}
    for r in passages:
        for digest, start, end, _ in chunk_dedup.chunks(texts[r.doc_id]):
            if r.start <= start and end <= r.end:
                kept[digest] = kept.get(digest, 0) + r.is_first
    return kept


def test_every_chunk_keeps_one_place(spark):
    rng = random.Random(5)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n))
    a, b, c, d = (prose(80) for _ in range(4))
    line = prose(14)
    overlap = [(1, a), (5, f"{a} {b}"), (9, f"{a} {b}")]
    common = [(1, f"{prose(40)} {line} {prose(40)}"), (5, f"{c} {line} {d}"), (9, f"{c} {line} {d}")]
    within = [(5, f"{a} {b} {a}"), (9, f"{a} {b} {a}")]
    for rows, whole in ((overlap, b), (common, f"{c} {line} {d}"), (within, f"{a} {b}")):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
        got = chunk_dedup.repeated_passages(docs).cache()
        kept = kept_places(docs, got.collect())
        assert kept and set(kept.values()) == {1}
        out = {r.doc_id: r.text for r in chunk_dedup.dedup_text(docs, got).collect()}
        # All but the chunks at a passage's ends are still there, once.
        assert " ".join(whole.split()[12:-12]) in out[5] and len(out[9]) < 150
    assert out[5].count(" ".join(a.split()[12:-12])) == 1


def test_repeats_within_a_text_and_among_rows_without_ids(spark):
    rng = random.Random(12)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n))
    a, b = prose(100), prose(100)
    docs = spark.createDataFrame([(1, f"{a} {prose(90)} {a}"), (None, b), (None, b), (2, prose(200))], "doc_id long, text string")
    got = chunk_dedup.repeated_passages(docs).collect()
    assert {r.doc_id for r in got} == {1, None} and len(got) == 4
    assert {r.doc_id for r in chunk_dedup.repeated_passages(docs, within=False).collect()} == {None}
    assert sorted(r.is_first for r in got if r.doc_id == 1) == [False, True] == sorted(r.is_first for r in got if r.doc_id is None)


def passages_by_brute_force(texts, min_words):
    """(doc_id, start, end, is_first): chunks that occur twice, their runs of enough words, one keeper of each."""
    chunks = {k: chunk_dedup.chunks(t) for k, t in texts.items()}
    counts = Counter(x[0] for c in chunks.values() for x in c)
    runs, keepers = {}, {}
    for k, c in chunks.items():
        flags = [counts[x[0]] > 1 for x in c]
        for flag, group in itertools.groupby(range(len(c)), key=flags.__getitem__):
            group = list(group)
            if flag and sum(c[i][3] for i in group) >= min_words:
                runs.setdefault(k, []).append(group)
                for i in group:
                    keepers[c[i][0]] = min(keepers.get(c[i][0], (k, i)), (k, i))
    expected = []
    for k, groups in runs.items():
        for group in groups:
            for mine, part in itertools.groupby(group, key=lambda i: keepers[chunks[k][i][0]] == (k, i)):
                part = list(part)
                expected.append((k, chunks[k][part[0]][1], chunks[k][part[-1]][2], mine))
    return sorted(expected)


def test_query_is_brute_force(spark, sf_dir, documents):
    got = sorted((r.doc_id, r.start, r.end, r.is_first) for r in op10_substring_dedup(spark, sf_dir).collect())
    assert got == passages_by_brute_force({d.doc_id: d.text for d in documents.collect()}, chunk_dedup.MIN_WORDS) and got


def test_passages_are_those_of_all_chunks(spark):
    """Brute force on a small alphabet: chunks that occur twice, their runs of enough words, one keeper of each."""
    rng = random.Random(13)
    words = ["ab", "ba", "abba", "aab", "bbb", "a"]
    texts = {i: " ".join(rng.choice(words) for _ in range(rng.randint(0, 160))) for i in range(12)}
    texts |= {12: texts[3], 13: f"{texts[4]} {texts[5]}", 14: ""}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    got = [(r.doc_id, r.start, r.end, r.is_first) for r in chunk_dedup.repeated_passages(docs, 8).collect()]
    assert sorted(got) == passages_by_brute_force(texts, 8) and got


def test_query_covers_exact_copies(spark, sf_dir, documents):
    rows = op10_substring_dedup(spark, sf_dir).collect()
    docs = {d.doc_id: d.text for d in documents.collect()}
    seen = {}
    for k, t in sorted(docs.items()):
        if len(t.split()) > 60 and t in seen.values():
            assert any(r.doc_id == k for r in rows), k
        seen[k] = t
    assert all(0 <= r.start < r.end <= len(docs[r.doc_id]) and r.n_copies > 1 for r in rows)


def test_odd(odd, empty):
    # The long text repeats itself every 977 words.
    assert {r.doc_id for r in chunk_dedup.repeated_passages(odd, 5).collect()} == {1, 2, 5}
    assert chunk_dedup.repeated_passages(empty).count() == 0
    assert chunk_dedup.dedup_text(odd.where("doc_id > 4"), chunk_dedup.repeated_passages(empty)).count() == 5


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    docs, _ = planted(spark)
    expected = sorted(map(repr, chunk_dedup.repeated_passages(docs).collect()))
    monkeypatch.setattr(chunk_dedup, "FILTER_BITS", 64)
    assert sorted(map(repr, chunk_dedup.repeated_passages(docs).collect())) == expected


def test_clashing_names_and_large_ids(spark):
    rng = random.Random(14)
    prose = " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(90))
    top = 2**63 - 1
    docs = spark.createDataFrame([(top, prose, "a"), (5, prose, "b"), (None, prose, "c")], "doc_id long, text string, _spans string").withColumn("start", F.lit(1)).withColumn("_id", F.lit(2))
    got = chunk_dedup.repeated_passages(docs)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.is_first, r.first_doc) for r in got.collect()) == [(False, 5, True, 5), (False, top, False, 5), (True, 0, False, 5)]
    out = chunk_dedup.dedup_text(docs, got)
    assert out.columns == docs.columns and {r.doc_id: len(r.text) > 0 for r in out.collect()} == {top: False, 5: True, None: True}
