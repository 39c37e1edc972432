"""Best-fit packing of tokenised documents into sequences, by hierarchical residual packing.

Every partition tokenises its texts, cuts those longer than the capacity and
packs its pieces best-fit decreasing. Bins that are nearly full are done. The
others go on as items of their own: fewer partitions each take the underfull
bins of several, pack them best-fit again, and so on, until a round has one
partition or merges nothing any more. A bin carries its members with it, at
most ``capacity`` of them as every piece has a token at least, so no join puts
the result together.

The number of underfull bins that one task takes is bounded by
``ITEMS_PER_TASK``: a round that still has more keeps more partitions. Each
round is cut into the checkpoint folder, so a lost executor costs one round.

A document's ids are its tokens and one separator id. Only documents over
the capacity are cut, into pieces of the whole capacity and a rest.

Defined results: null and empty texts are the separator alone; ties in
length are packed in the order of doc_id and piece; repeated rows are packed
each by itself; null ids are packed like others; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import arrow_map, cut

#: Tokens of a sequence; a bin is done from this share of it; bins merged by one task of a later round; partitions that a round joins.
CAPACITY, FULL, ITEMS_PER_TASK, FAN_IN = 4096, 0.999, 100_000, 8
#: Id after each document.
SEPARATOR = 1
#: Words of which a worker remembers the ids.
CACHE_WORDS = 250_000

_MEMBERS = "array<struct<doc_id: bigint, piece: int, start: bigint, length: bigint, ids_crc32: bigint, offset: bigint>>"
_BIN = f"sequence_id long, total long, members {_MEMBERS}"
_MEMBER_TYPE = pa.list_(
    pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())])
)

# Characters for which splitting at white space and lower-casing in Python agree with the tokenizer's normalizer; others take its own path.
_PLAIN = re.compile(r"[^\x00-\x1b\x20-įı-Ɂ]|<\|")
# Fixed value: the tokenizer's own split pattern.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_letters() -> dict[int, int]:
    """Byte-level alphabet: printable Latin-1 stands for itself, the other bytes for code points from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: 256 + i for i, b in enumerate(others)}


class Encoder:
    """Token ids of texts as little-endian uint32 bytes, with a bounded memory of words.

    White space always splits this kind of tokenizer, so the ids of a text are
    those of its words put together; words are encoded once and remembered.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_words = '"end_of_word_suffix":"</w>"' in self.tokenizer.to_str() and _PIECES.replace("\\", "\\\\") in self.tokenizer.to_str()
        self.model = self.tokenizer.model
        self.split = regex.compile(_PIECES).findall
        self.letters = _byte_letters()
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            letters = part if part.isascii() and part.isprintable() else part.encode("utf-8").decode("latin-1").translate(self.letters)
            ids = [t.id for t in self.model.tokenize(letters)]
            ids = self.parts[part] = struct.pack(f"<{len(ids)}I", *ids)
        return ids

    def _word(self, word: str) -> bytes:
        """Ids of a word: letters alone or with one sign behind them need no pattern."""
        if word.isalpha():
            return self._part(word)
        if word[:-1].isalpha():
            return self._part(word[:-1]) + self._part(word[-1])
        return b"".join(map(self._part, self.split(word)))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        if len(self.parts) > CACHE_WORDS:
            self.parts.clear()
        out: list[bytes | None] = [None] * len(texts)
        slow = []
        for i, text in enumerate(texts):
            if not text:
                out[i] = b""
            elif not self.by_words or _PLAIN.search(text):
                slow.append(i)
            else:
                words = text.lower().split()
                for w in set(words).difference(self.words):
                    self.words[w] = self._word(w)
                out[i] = b"".join(map(self.words.__getitem__, words))
        for i in slow:
            ids = self.tokenizer.encode(texts[i], add_special_tokens=False).ids
            out[i] = np.array(ids, dtype="<u4").tobytes()
        return out


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def best_fit(sizes: Iterable[int], capacity: int) -> list[int]:
    """Bin of each size, taken in the given order, in the open bin with the least room that suffices.

    Open bins are kept by their room; one integer has a bit for each room that some bin has.
    """
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, n, out = 0, 0, []
    for size in sizes:
        at = mask >> size
        if at:
            room = size + (at & -at).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                mask ^= 1 << room
        else:
            b, room = n, capacity
            n += 1
        out.append(b)
        left = room - size
        if left:
            if not rooms[left]:
                mask |= 1 << left
            rooms[left].append(b)
    return out


def _pack(items: list[tuple[int, list[dict]]], capacity: int) -> list[list[dict]]:
    """Members of each bin; items are (total, members), members keep their order and get new offsets."""
    key = lambda x: (-x[0], x[1][0]["doc_id"] is None, x[1][0]["doc_id"] or 0, x[1][0]["piece"], x[1][0]["start"])
    items = sorted(items, key=key)
    bins: list[list[dict]] = []
    fill: list[int] = []
    for (total, members), b in zip(items, best_fit((t for t, _ in items), capacity)):
        if b == len(bins):
            bins.append([])
            fill.append(0)
        for m in members:
            bins[b].append(m | {"offset": fill[b] + m["offset"]})
        fill[b] += total
    return bins


def _batch(bins: list[list[dict]], first: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(range(first, first + len(bins)), pa.int64()),
            pa.array([sum(m["length"] for m in b) for b in bins], pa.int64()),
            pa.array(bins, _MEMBER_TYPE),
        ],
        names=["sequence_id", "total", "members"],
    )


def _emit(bins: list[list[dict]], round_no: int) -> Iterable[pa.RecordBatch]:
    """Bins numbered by round, partition and place."""
    first = (round_no << 56) + (TaskContext.get().partitionId() << 32)
    for i in range(0, len(bins), 500):
        yield _batch(bins[i : i + 500], first + i)


def tokenise_and_pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Round 0: bins (sequence_id, total, members) of each partition's documents."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    separator = np.array([SEPARATOR], dtype="<u4").tobytes()

    def run(batches):
        items: list[tuple[int, list[dict]]] = []
        e = encoder(tokenizer)
        for b in batches:
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), e.encode(b.column("text").to_pylist())):
                ids += separator
                for piece, a in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[a : a + 4 * capacity]
                    n = len(part) // 4
                    items.append((n, [{"doc_id": doc_id, "piece": piece, "start": a // 4, "length": n, "ids_crc32": zlib.crc32(part), "offset": 0}]))
        yield from _emit(_pack(items, capacity), 0)

    return arrow_map(rows, run, _BIN)


def repack(bins: DataFrame, round_no: int, capacity: int = CAPACITY) -> DataFrame:
    """A later round: each partition packs its underfull bins as items."""

    def run(batches):
        items = []
        for b in batches:
            items += [(t, m) for t, m in zip(b.column("total").to_pylist(), b.column("members").to_pylist())]
        yield from _emit(_pack(items, capacity), round_no)

    return arrow_map(bins, run, _BIN)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    done_from = int(capacity * FULL)
    now = cut(tokenise_and_pack(docs, tokenizer, capacity))
    parts = now.rdd.getNumPartitions()
    finished = []
    round_no, before = 0, None
    while True:
        open_bins = now.where(F.col("total") < done_from)
        n = open_bins.count()
        if n <= 1 or (round_no and parts == 1):
            break
        fewer = max(1, -(-n // ITEMS_PER_TASK), parts // FAN_IN)
        if fewer >= parts and before is not None and n >= before:
            break  # nothing merges any more
        finished.append(now.where(F.col("total") >= done_from))
        before, parts, round_no = n, fewer, round_no + 1
        # Underfull bins are dealt out at random by their number: each task sees all sizes.
        now = cut(repack(open_bins.repartition(parts, F.xxhash64("sequence_id")), round_no, capacity))
    for part in finished:
        now = now.unionByName(part)
    return now.select("sequence_id", F.explode("members").alias("m")).select(
        "m.doc_id", "m.piece", "m.start", "m.length", "m.ids_crc32", "sequence_id", "m.offset"
    )
