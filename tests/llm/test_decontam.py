import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from logloom.llm import decontam
from logloom.llm.queries import op2_decontaminate


def semi_global(pattern, text):
    """Least edits of the pattern against any part of the text, by the plain recurrence."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.text("abc ", min_size=1, max_size=80), st.text("abc ", max_size=120))
def test_myers(pattern, text):
    assert decontam.myers(pattern, text)[0] == semi_global(pattern, text)


def test_matches_are_complete():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    items = tuple((i, decontam.fold(" ".join(word() for _ in range(rng.randint(5, 40))))) for i in range(12))
    m = decontam.Matcher(items)
    for _ in range(150):
        item = rng.choice(items)[1]
        text = list(" ".join(word() for _ in range(20)) + item + " ".join(word() for _ in range(20)))
        for _ in range(rng.randint(0, 14)):
            at = rng.randrange(len(text))
            text[at : at + 1] = rng.choice(["", "x", "xy"])
        text = "".join(text)
        expected = {i: d for i, t in items if (d := semi_global(t, decontam.fold(text))) <= decontam.budget(len(t))}
        assert {i: d for i, d, *_ in m.matches(text)} == expected


OPENING = "Answer the following question about the history of the city and explain each step of your answer: "


def openings(rng, n, words):
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7)))
    return [(i, decontam.fold(OPENING + " ".join(word() for _ in range(rng.randint(*words))) + " choose one of the answers below")) for i in range(n)]


def test_hot_pieces_lose_nothing(monkeypatch):
    """Items with one opening and one closing, pieces hot from the second item on: the matches are those of the plain recurrence."""
    rng = random.Random(8)
    monkeypatch.setattr(decontam, "HOT", 1)
    items = tuple([*openings(rng, 12, (0, 3)), *((100 + i, x) for i, x in openings(rng, 12, (6, 40))), *((200 + i, decontam.fold(OPENING * 2 + str(i))) for i in range(5))])
    m = decontam.Matcher(items)
    for _ in range(60):
        item = rng.choice(items)[1]
        text = list(f"some words {OPENING} before {item} and behind it")
        for _ in range(rng.randint(0, 14)):
            at = rng.randrange(len(text))
            text[at : at + 1] = rng.choice(["", "x", "xy"])
        text = "".join(text)
        expected = {i: d for i, t in items if (d := decontam.myers(t, decontam.fold(text))[0]) <= decontam.budget(len(t))}
        assert {i: d for i, d, *_ in m.matches(text)} == expected


def test_common_opening_is_quick():
    rng = random.Random(9)
    items = openings(rng, 10_000, (10, 30))
    m = decontam.Matcher(tuple(items))
    text = " ".join(f"{OPENING} {x}" for _, x in openings(rng, 450, (5, 20)))
    assert len(text) > 100_000
    began = time.process_time()
    assert {i for i, *_ in m.matches(text + items[77][1])} == {77}
    assert time.process_time() - began < 10


def test_query_with_a_common_opening(spark, tmp_path, monkeypatch):
    rng = random.Random(10)
    monkeypatch.setattr(decontam, "HOT", 2)
    items = openings(rng, 40, (10, 30))
    spark.createDataFrame([(i, t) for i, t in items], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [(i, f"before {OPENING} then {items[i % 40][1].replace('a', 'A', 3) if i % 3 else OPENING} behind") for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.item_id) for r in op2_decontaminate(spark, str(tmp_path)).collect()}
    assert got == {(k, i) for k, text in docs for i, t in items if decontam.myers(t, decontam.fold(text))[0] <= decontam.budget(len(t))} and got


def test_query_is_brute_force(spark, sf_dir, documents):
    """The query against Myers' distance of every item over every whole text, without pieces."""
    items = [(r.item_id, decontam.fold(r.text)) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    texts = {r.doc_id: decontam.fold(r.text) for r in documents.collect() if r.text and len(r.text) < 3000}
    expected = {(k, i): d for k, t in texts.items() for i, x in items if len(x) <= len(t) + decontam.budget(len(x)) and (d := decontam.myers(x, t)[0]) <= decontam.budget(len(x))}
    got = {(r.doc_id, r.item_id): r.distance for r in op2_decontaminate(spark, sf_dir).collect() if r.doc_id in texts}
    assert got == expected and got


@pytest.mark.parametrize(("rate", "recall"), [(0.0, 1.0), (0.02, 1.0), (0.05, 0.9), (0.1, 0.0)])
def test_recall_by_edit_rate(spark, sf_dir, rate, recall):
    """Random substitutions of so many of an item's characters: within the budget all are found, at 10 % none need be."""
    rng = random.Random(11)
    items = [(r.item_id, decontam.fold(r.text)) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    m, hits = decontam.Matcher(tuple(items)), 0
    for i, item in items:
        text = list(item)
        for at in rng.sample(range(1, len(text) - 1), int(rate * len(text))):
            text[at] = "#"
        hits += i in {x[0] for x in m.matches("before " + "".join(text).replace("#", "q") + " after")}
    assert hits >= recall * len(items)


def test_odd(spark, odd, empty):
    items = spark.createDataFrame([(1, "quick brown fox JUMPS over the, lazy dog"), (2, None), (3, ""), (None, "lazy dog"), (4, "one"), (5, "quick brown fox jumps over the lazy dog")], "item_id long, text string")
    got = decontam.contaminated(odd, items).collect()
    assert sorted((r.doc_id, r.item_id, r.distance) for r in got) == [(1, 1, 0), (1, 1, 0), (1, 5, 0), (1, 5, 0), (2, 1, 0), (2, 5, 0), (8, 4, 0)]
    # Blocks of items change nothing.
    assert sorted((r.doc_id, r.item_id, r.distance) for r in decontam.contaminated(odd, items, block_chars=10).collect()) == sorted((r.doc_id, r.item_id, r.distance) for r in got)
    clean = decontam.without_contaminated(odd, items, block_chars=10)
    assert clean.columns == odd.columns and clean.count() == odd.count() - 4
    assert decontam.contaminated(odd, items.limit(0)).count() == 0 and decontam.contaminated(empty, items).count() == 0


@pytest.mark.parametrize(("n", "edits"), [(10, 0), (31, 0), (32, 1), (200, 11), (1000, 61)])
def test_budget(n, edits):
    assert decontam.budget(n) == edits
    assert len(decontam.pieces("x" * n, edits)) == edits + 1
