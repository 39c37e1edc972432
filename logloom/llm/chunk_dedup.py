"""Substring dedup by content-defined chunking with a gear rolling hash.

A gear hash runs over the folded characters of a text, and a chunk ends where the
hash is larger than all others within RADIUS characters. A cut thus depends on
the characters near it alone: after an insertion, or where a copied passage
begins, the next cuts are those of the original again. Chunks are keyed by
a 128-bit digest. A digest that occurs twice, in two texts or in one, is a repeat; neighbouring
repeated chunks of a text join to runs, and runs of MIN_WORDS words or more
are passages that repeat. A passage loses about 16 words at its ends, which lie
in chunks with other text: MIN_WORDS = 28 is for passages of over 50 words.

Digests are counted with map-side partial aggregates of fixed size (a count, first and last row), so a chunk in a third of all texts is one partial
row per task; only repeated digests go back to their chunks: a Bloom filter of them, of
bounded size, keeps most others from being shuffled, and a join whose hot digests AQE splits decides. A text's hits are put together by the text's own row
key: their number is bounded by its length. The keeper of each digest is found the
same way, among the chunks that lie in passages: overlapping passages and common lines
inside them leave every chunk exactly one kept place.

Texts are chunked folded: lower case, runs of characters that are neither letters
nor digits one space. Places are reported in the original text, code points,
end exclusive.

Defined results: null and empty texts have no chunks; equal texts of different
documents repeat as wholes; of a chunk's places in passages the one in the
document with the smallest doc_id is the first, and within it the first place; repeats within a text and among
rows of one doc_id or without one are repeats like others; rows without a doc_id come last.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import arrow_map, cut

#: Characters that the rolling hash sees; the distance within which a cut has the largest hash (41 characters a chunk on average); most characters of a chunk.
WINDOW, RADIUS, MAX_CHARS = 16, 20, 1024
#: Most bits of the filter of repeated digests (16 MB), bits and hash functions of a digest.
FILTER_BITS, BITS_PER_DIGEST, HASHES = 1 << 27, 10, 4
#: Words of a run from which on a passage counts as repeated.
MIN_WORDS = 28

#: Gear table: a fixed pseudo-random 32-bit number for each code point modulo 1024.
GEAR = np.random.RandomState(20_240_101).randint(0, 1 << 32, size=1024, dtype=np.uint32)


@functools.lru_cache(maxsize=1)
def _folding() -> np.ndarray:
    """Folded code point of each code point: the small form where that is one character; a space for all but letters and digits."""
    table = np.arange(0x110000, dtype=np.uint32)
    for i in range(0x30000):
        c = chr(i)
        table[i] = 32 if not c.isalnum() else ord(c.lower()) if len(c.lower()) == 1 else i
    return table


def fold(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points and, for each of them, the place in the original."""
    codes = _folding()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    keep = codes != 32
    keep[1:] |= codes[:-1] != 32
    keep[:1] = True
    places = np.flatnonzero(keep)
    return codes[places], places


def _sliding_max(h: np.ndarray, size: int) -> np.ndarray:
    """Maximum of each run of ``size`` values."""
    span, m = 1, h
    while span * 2 <= size:
        m = np.maximum(m[:-span], m[span:])
        span *= 2
    return np.maximum(m[: len(h) - size + 1], m[size - span :]) if size > span else m


def cuts(low: np.ndarray) -> list[int]:
    """Ends of the chunks of a folded text."""
    n = len(low)
    if not n:
        return []
    h = GEAR[low & 1023]
    span = 1
    while span < WINDOW:  # the hash of 2s characters from two hashes of s
        h2 = h.copy()
        h2[span:] += h[:-span] << np.uint32(span)
        h, span = h2, span * 2
    h |= np.uint32(1)
    zeros = np.zeros(RADIUS, dtype=np.uint32)
    padded = np.concatenate([zeros, h, zeros])
    left = _sliding_max(padded, RADIUS)[:n]  # of the RADIUS values before each
    right = _sliding_max(padded, RADIUS)[RADIUS + 1 : RADIUS + 1 + n]  # and behind it
    ends, last = [], 0
    # Equal values: the first of a run of repeats is the cut, so repetitive text has few.
    for e in (np.flatnonzero((h > left) & (h >= right)) + 1).tolist():
        while e - last > MAX_CHARS:
            last += MAX_CHARS
            ends.append(last)
        if e > last:
            ends.append(e)
            last = e
    while n - last > MAX_CHARS:
        last += MAX_CHARS
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def chunks(text: str | None) -> list[tuple[bytes, int, int, int]]:
    """(digest, start, end, words) of each chunk; places in the original text."""
    if not text:
        return []
    low, places = fold(text)
    ends = cuts(low)
    spaces = np.concatenate([[0], np.cumsum(low == 32)])
    starts = [0, *ends[:-1]]
    places = np.append(places, len(text))
    raw = low.tobytes()
    return [
        (hashlib.blake2b(raw[4 * a : 4 * b], digest_size=16).digest(), start, end, words)
        for a, b, start, end, words in zip(starts, ends, places[starts].tolist(), places[ends].tolist(), (spaces[ends] - spaces[starts]).tolist())
    ]


def chunk_table(docs: DataFrame) -> DataFrame:
    """row, doc_id, high, low (halves of the digests), starts (one more than chunks), words: one row per text."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches):
        for b in batches:
            high, low, starts, words = [], [], [], []
            for t in b.column("text").to_pylist():
                c = chunks(t)
                halves = np.frombuffer(b"".join(x[0] for x in c), dtype=np.int64).reshape(-1, 2)
                high.append(halves[:, 0])
                low.append(halves[:, 1])
                starts.append([x[1] for x in c] + [c[-1][2]] if c else [])
                words.append([x[3] for x in c])
            longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), b.column("doc_id"), pa.array(high, longs), pa.array(low, longs), pa.array(starts, ints), pa.array(words, ints)],
                names=["row", "doc_id", "high", "low", "starts", "words"],
            )

    return arrow_map(rows, run, "row long, doc_id long, high array<long>, low array<long>, starts array<int>, words array<int>")


def places_in_filter(high, low, i: int, bits: int):
    """The i-th place of digests in a filter, of columns as of arrays: the halves of a digest are hashes already."""
    mask = (1 << 31) - 1
    one, two = (x.bitwiseAND(F.lit(mask)) if isinstance(x, Column) else x & mask for x in (low, high))
    return (one + i * two) % bits


def digest_filter(repeated: DataFrame) -> tuple[np.ndarray, int]:
    """Words and size of a Bloom filter of the repeated digests, of FILTER_BITS at most; a full one lets more chunks pass to the join, which decides."""
    bits = min(FILTER_BITS, max(64, -(-repeated.count() * BITS_PER_DIGEST // 64) * 64))
    places = repeated.select(F.explode(F.array(*[places_in_filter(F.col("high"), F.col("low"), i, bits) for i in range(HASHES)])).alias("place"))
    found = places.groupBy(F.shiftrightunsigned("place", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(place & 63 AS INT))")).alias("bits")).toArrow()  # bits / 64 rows at most
    words = np.zeros(bits // 64, dtype=np.int64)
    words[found["word"].to_numpy()] = found["bits"].to_numpy()
    return words, bits


def _may_repeat(table: DataFrame, words: np.ndarray, bits: int) -> DataFrame:
    """row, no, high, low of the chunks that pass the filter: few but the repeated ones are shuffled."""
    shared = table.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        held = shared.value.view(np.uint64)
        for b in batches:
            high, low = (pc.list_flatten(b.column(c)).to_numpy(zero_copy_only=False) for c in ("high", "low"))
            owner = pc.list_parent_indices(b.column("high")).to_numpy(zero_copy_only=False)
            sizes = np.bincount(owner, minlength=b.num_rows)
            no = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            passes = np.ones(len(owner), dtype=bool)
            for i in range(HASHES):
                at = places_in_filter(high, low, i, bits)
                passes &= (held[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            row = b.column("row").to_numpy(zero_copy_only=False)[owner[passes]]
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(no[passes], pa.int32()), pa.array(high[passes], pa.int64()), pa.array(low[passes], pa.int64())], names=["row", "no", "high", "low"])

    return arrow_map(table.select("row", "high", "low"), run, "row long, no int, high long, low long")


def _in_passages(nos: list[int], highs: list[int], lows: list[int], counts: list[int], starts: list[int], words: list[int], min_words: int) -> list[tuple]:
    """(no, high, low, n, start, end, words) of the hits of one text that lie in runs of ``min_words`` or more."""
    out, run, n_words = [], [], 0
    hits = sorted(zip(nos, highs, lows, counts))
    for i, (no, high, low, n) in enumerate(hits):
        run.append((no, high, low, n, starts[no], starts[no + 1], words[no]))
        n_words += words[no]
        if i + 1 == len(hits) or hits[i + 1][0] != no + 1:
            if n_words >= min_words:
                out += run
            run, n_words = [], 0
    return out


def _spans(hits: list[dict]) -> list[tuple]:
    """(start, end, n_words, n_chunks, n_copies, first_doc, is_first) of one text's passages, split where kept chunks meet others."""
    out, span = [], []
    hits = sorted(hits, key=lambda x: x["no"])
    for i, x in enumerate(hits):
        span.append(x)
        after = hits[i + 1] if i + 1 < len(hits) else None
        if not after or after["no"] != x["no"] + 1 or after["mine"] != x["mine"]:
            out.append((span[0]["start"], x["end"], sum(y["words"] for y in span), len(span), max(y["n"] for y in span), min((y["first"] for y in span), key=lambda d: (d is None, d or 0)), x["mine"]))
            span = []
    return out


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, within: bool = True) -> DataFrame:
    """Passages that occur more than once, within or across texts: doc_id, start, end, n_words, n_chunks, n_copies, first_doc, is_first.

    Without ``within`` a chunk must occur in two rows to be a repeat.
    Of each chunk in a passage the first occurrence that lies in a passage is kept;
    occurrences outside passages stay anyway. A passage is split where
    kept chunks meet others: ``is_first`` marks the parts to keep, and each part of
    a passage is a row, if need be of less than ``min_words``. n_copies is the number of
    occurrences of the part's most frequent chunk, first_doc the smallest
    doc_id that keeps one of its chunks.
    """
    table = cut(chunk_table(docs))
    single = table.select("row", "doc_id", F.posexplode(F.arrays_zip("high", "low")).alias("no", "d")).select("row", "doc_id", "no", "d.high", "d.low")
    counted = single.groupBy("high", "low").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"), F.max("row").alias("last"))
    repeated = counted.where("n > 1" if within else "first < last").select("high", "low", "n")
    repeated = cut(repeated)
    hits = _may_repeat(table, *digest_filter(repeated)).join(repeated, ["high", "low"]).select("row", F.struct("no", "high", "low", "n").alias("hit"))
    per_row = hits.groupBy("row").agg(F.collect_list("hit").alias("hits"))
    whole = per_row.join(table.select("row", "doc_id", "starts", "words"), "row").select(
        "row", "doc_id", F.col("hits.no").alias("nos"), F.col("hits.high").alias("highs"), F.col("hits.low").alias("lows"), F.col("hits.n").alias("counts"), "starts", "words"
    )

    def passages(batches):
        for b in batches:
            found = [
                (row[0], row[1], *x)
                for row in zip(*[b.column(c).to_pylist() for c in ("row", "doc_id", "nos", "highs", "lows", "counts", "starts", "words")])
                for x in _in_passages(*row[2:], min_words)
            ]
            if found:
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=["row", "doc_id", "no", "high", "low", "n", "start", "end", "words"]
                )

    found = cut(arrow_map(whole, passages, "row long, doc_id long, no int, high long, low long, n long, start int, end int, words int"))
    keepers = found.groupBy("high", "low").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "no")).alias("keeper"))  # rows without an id last
    mine = (F.col("keeper.row") == F.col("row")) & (F.col("keeper.no") == F.col("no"))
    judged = found.join(keepers, ["high", "low"]).select("row", "doc_id", F.struct("no", "n", "start", "end", "words", F.col("keeper.doc_id").alias("first"), mine.alias("mine")).alias("hit"))
    texts = judged.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.collect_list("hit").alias("hits")).select("doc_id", "hits")
    names = ["start", "end", "n_words", "n_chunks", "n_copies", "first_doc", "is_first"]
    kinds = [pa.int64()] * 6 + [pa.bool_()]

    def run(batches):
        for b in batches:
            found = [(doc_id, *r) for doc_id, hits in zip(b.column("doc_id").to_pylist(), b.column("hits").to_pylist()) for r in _spans(hits)]
            if found:
                columns = list(zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64(), *kinds])], names=["doc_id", *names])

    return arrow_map(texts, run, "doc_id long, start long, end long, n_words long, n_chunks long, n_copies long, first_doc long, is_first boolean")


def dedup_text(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """``docs`` (doc_id unique, text) with all but the first occurrence of the chunks of repeated passages cut out."""
    numbered = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    spans = passages.where(~F.col("is_first")).groupBy(F.col("doc_id").alias("_id")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_spans"))
    text, tail = F.col(numbered["text"]), F.lit(2**31 - 1)
    done = F.aggregate(
        "_spans",
        F.struct(F.lit("").alias("text"), F.lit(0).alias("at")),
        lambda acc, s: F.struct(
            F.concat(acc["text"], F.substring(text, acc["at"] + 1, (s["start"] - acc["at"]).cast("int"))).alias("text"),
            s["end"].cast("int").alias("at"),
        ),
        lambda acc: F.concat(acc["text"], F.substring(text, acc["at"] + 1, tail)),
    )
    joined = docs.withColumnsRenamed(numbered).join(spans, F.col(numbered["doc_id"]).cast("long") == F.col("_id"), "left")
    new = F.when(F.col("_spans").isNull(), text).otherwise(done)
    return joined.select(*[(new if c == "text" else F.col(v)).alias(c) for c, v in numbered.items()])
