import random
from collections import defaultdict

import numpy as np

from pyspark.sql import functions as F

from logloom.llm import bagminhash as bm
from logloom.llm import neardup
from logloom.llm.queries import op5_near_dedup


def brute_classes(docs, threshold=0.8):
    """Components of all pairs of at least the threshold, over every pair that shares a shingle."""
    bags = {k: bm.bag(bm.word_hashes(t)) for k, t in docs.items()}
    at, parent = defaultdict(list), {k: k for k in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (h, _) in bags.items():
        for x in h.tolist():
            at[x].append(k)
    empty = [k for k, b in bags.items() if not len(b[0])]
    for a, b in {(v[i], v[j]) for v in at.values() for j in range(len(v)) for i in range(j)} | {(empty[0], k) for k in empty[1:]}:
        inter, union = bm.overlap(bags[a], bags[b])
        if inter >= threshold * union:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in docs}


def test_query_is_brute_force(spark, sf_dir, documents):
    expected = brute_classes({d.doc_id: d.text for d in documents.collect()})
    rows = op5_near_dedup(spark, sf_dir).collect()
    assert {r.doc_id: r.class_id for r in rows} == expected
    sizes = defaultdict(int)
    for c in expected.values():
        sizes[c] += 1
    assert all(r.class_size == sizes[r.class_id] and r.is_kept == (r.doc_id == r.class_id) for r in rows)


def test_signature_is_unbiased():
    rng = np.random.default_rng(1)
    h = rng.integers(1, 1 << 62, 400).astype(np.uint64)
    h.sort()
    one = (h[:300], rng.integers(1, 12, 300))
    two = (h[100:], rng.integers(1, 12, 300))
    inter, union = bm.overlap(one, two)
    sig = bm.signatures([one, two], 4096)
    assert abs((sig[0] == sig[1]).mean() - inter / union) < 0.03
    again = bm.signatures([two, one], 4096)
    assert (again[1] == sig[0]).all() and np.isfinite(sig).all()
    assert np.isinf(bm.signatures([(h[:0], np.zeros(0, np.int64))], 64)).all()


def test_large_group_of_near_copies(spark):
    """Copies of a base differ from each other about twice as much as from it, so most centres miss some."""
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    docs = {0: " ".join(base)}
    for i in range(1, 320):
        words = list(base)
        for _ in range(rng.randint(1, 3)):
            words[rng.randrange(len(words))] = f"n{rng.random()}"
        docs[i] = " ".join(words)
    docs |= {1000 + i: docs[0] for i in range(50)} | {2000 + i: " ".join(rng.choice(vocabulary) for _ in range(60)) for i in range(30)}
    expected = brute_classes(docs)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.class_id for r in neardup.classes(df).collect()}
    same = sum(got[k] == expected[k] for k in docs)
    assert same >= 0.99 * len(docs)
    assert all(got[k] == got[0] for k in got if 1000 <= k < 2000)


def test_tiles_find_what_centres_miss():
    a, b = (bm.bag(bm.word_hashes(" ".join(f"w{i}" for i in range(s, s + 100)))) for s in (0, 5))
    c = bm.bag(bm.word_hashes(" ".join(f"v{i}" for i in range(100))))
    bags = [neardup._bag_bytes(x) for x in (a, b, c)]
    signatures = [neardup._slots(s) for s in bm.signatures([a, b, c])]
    assert neardup._tile_links([1, 2, 3], [0, 0, 0], [1, 2, 3], bags, signatures, 0.8) == [(1, 2)]
    assert neardup._tile_links([1, 2, 3], [0, 1, 1], [1, 2, 3], bags, signatures, 0.8) == [(1, 2)]
    assert neardup._tile_links([1, 2, 3], [0, 0, 0], [7, 7, 3], bags, signatures, 0.8) == []


def test_blocks_of_a_large_component(spark, monkeypatch):
    """All pairs of different components meet in a tile; a large component's members are not copied against each other."""
    monkeypatch.setattr(neardup, "TILE", 8)
    monkeypatch.setattr(neardup, "MAX_TILE", 8)
    texts = {i: " ".join(f"g{i // 10 if i < 60 else i}w{k}" for k in range(40)) for i in range(80)}
    bags = [bm.bag(bm.word_hashes(t)) for t in texts.values()]
    held = [(i, bytearray(neardup._bag_bytes(b)), bytearray(neardup._slots(s))) for i, b, s in zip(texts, bags, bm.signatures(bags))]
    stored = spark.createDataFrame(held, "node long, bag binary, signature binary")

    def links(labels, main):
        n_main = sum(x == main for x in labels.values())
        rows = [(5, len(labels), node, label, main if n_main else None, n_main or None) for node, label in labels.items()]
        return neardup.tile_links(spark.createDataFrame(rows, "band long, n long, node long, label long, main long, n_main long"), stored)

    def joined(labels, found):
        parent = {x: x for x in labels.values()}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for r in found:
            x, y = sorted((find(labels[r.a]), find(labels[r.b])))
            parent[y] = x
        groups = defaultdict(set)
        for node, label in labels.items():
            groups[find(label)].add(node)
        return sorted(map(sorted, groups.values()))

    # Nodes 0-29 are one component though their texts are three groups; 30-59 are still apart, 60-79 are strangers.
    labels = {i: 0 if i < 25 else i for i in range(80)}
    want = sorted([list(range(30)), *[list(range(k, k + 10)) for k in (30, 40, 50)], *[[i] for i in range(60, 80)]])
    assert joined(labels, links(labels, 0).collect()) == want
    assert joined(labels, links(labels, -1).collect()) == want
    assert links({i: 0 for i in range(25)} | {70: 70}, 0).count() == 0


def test_bag_bytes():
    for text in ("a b c d e f g", "a a a a a a a a a", "", "x y", "a b a b a b a b a b " * 5):
        b = bm.bag(bm.word_hashes(text))
        again = neardup._bag_of(neardup._bag_bytes(b))
        assert (again[0] == b[0]).all() and (again[1] == b[1]).all()


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (4, 5), (10, 9), (9, 8), (20, 20), (5, 1), (30, 31), (31, 30)]
    got = {r.node: r.label for r in neardup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8, 10: 8, 30: 30, 31: 30}
    assert neardup.components(spark.createDataFrame([], "a long, b long")).count() == 0
    hub = spark.range(5, 3000).selectExpr("7 AS a", "id AS b").union(spark.range(4000, 4050).selectExpr("id AS a", "id + 1 AS b"))
    assert {(r.label, r.n) for r in neardup.components(hub).groupBy("label").agg(F.count("*").alias("n")).collect()} == {(5, 2995), (4000, 51)}


def test_odd(odd, empty):
    rows = neardup.classes(odd).collect()
    assert len(rows) == odd.count()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert {r.class_id for r in by[1] + by[2]} == {1} and sum(r.is_kept for r in by[1] + by[2]) == 1
    assert {r.class_id for r in by[3] + by[4]} == {3}
    assert all(sum(r.is_kept for r in rows if r.class_id == c) == 1 for c in {r.class_id for r in rows if r.class_id is not None})
    kept = neardup.one_of_each_class(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 1").count() == 1 and kept.where("doc_id = 2").count() == 0
    assert neardup.classes(empty).count() == 0 and neardup.one_of_each_class(empty).count() == 0
    clash = odd.withColumnsRenamed({"row": "_text_key", "lang": "text_key", "source": "kept"})
    assert neardup.one_of_each_class(clash).columns == clash.columns


def test_merged_components(spark, monkeypatch):
    """Links of tiles join components, nodes of none and each other; without one nothing is computed again."""
    links = [(5, 9), (9, 12), (20, 21), (30, 31)]
    more = [(12, 21), (40, 31), (51, 50)]
    frame = lambda x: spark.createDataFrame(x, "a long, b long")
    labels = neardup.components(frame(links)).cache()
    got = sorted(map(tuple, neardup.merged(labels, frame(more)).collect()))
    assert got == sorted(map(tuple, neardup.components(frame(links + more)).collect()))
    monkeypatch.setattr(neardup, "components", None)
    assert neardup.merged(labels, frame(more).limit(0)) is labels
