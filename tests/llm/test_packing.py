import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from logloom.llm import packing
from logloom.llm.queries import op4_best_fit_packing, tokenizer_path


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=120))
def test_best_fit(sizes):
    got = packing.best_fit(sizes, 50)
    rooms, expected = [], []
    for s in sizes:
        fits = [(r, i) for i, r in enumerate(rooms) if r >= s]
        room = min(fits)[0] if fits else None
        expected.append(room)
        i = got[len(expected) - 1]
        if room is None:
            assert i == len(rooms)
            rooms.append(50 - s)
        else:
            assert rooms[i] == room
            rooms[i] -= s


def reference(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], dtype="<u4").tobytes() for x in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_encoder(texts):
    assert [e + b"\1\0\0\0" for e in packing.encoder(tokenizer_path()).encode(texts)] == reference(texts)


def check(rows, docs, capacity):
    """Every id of every document stands in one place, and sequences have no gaps."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    ids = dict(zip([d[0] for d in docs], reference([d[1] for d in docs])))
    assert set(by_doc) == set(ids)
    for k, pieces in by_doc.items():
        pieces.sort(key=lambda r: r.piece)
        raw = ids[k]
        assert [p.piece for p in pieces] == list(range(-(-len(raw) // 4 // capacity)))
        assert [p.start for p in pieces] == list(range(0, len(raw) // 4, capacity))
        for p in pieces:
            part = raw[4 * p.start : 4 * (p.start + p.length)]
            assert len(part) == 4 * p.length and zlib.crc32(part) == p.ids_crc32
        assert sum(p.length for p in pieces) == len(raw) // 4
    for s in by_sequence.values():
        s.sort(key=lambda r: r.offset)
        at = 0
        for r in s:
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_sequence)


def test_query(spark, sf_dir, documents):
    docs = [(d.doc_id, d.text) for d in documents.collect()]
    rows = op4_best_fit_packing(spark, sf_dir).collect()
    n = check(rows, docs, packing.CAPACITY)
    total = sum(r.length for r in rows)
    assert n <= 1.03 * -(-total // packing.CAPACITY) + 1


@pytest.mark.parametrize("capacity", [16, 300])
def test_rounds(spark, documents, capacity):
    docs = documents.where("doc_id < 60").select("doc_id", "text").repartition(7)
    check(packing.pack(docs, tokenizer_path(), capacity).collect(), [(d.doc_id, d.text) for d in docs.collect()], capacity)


def test_odd(odd, empty):
    rows = packing.pack(odd, tokenizer_path(), 64).collect()
    assert sum(r.piece == 0 for r in rows) == odd.count()
    assert packing.pack(empty, tokenizer_path()).count() == 0
    spots = [(r.sequence_id, r.offset) for r in rows]
    assert len(set(spots)) == len(spots)
