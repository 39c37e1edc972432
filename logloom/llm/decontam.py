"""Benchmark decontamination by pigeonhole edit matching.

A benchmark item may occur in a text with up to ``e`` edits. Split the item
into ``e + 1`` pieces: each edit spoils at most one piece, so an occurrence
holds at least one piece unchanged. All pieces of a block of items form one
Aho-Corasick automaton; every piece hit names an item and the place where the
item would lie, and Myers' bit-parallel distance of the item against the
window there (free ends in the text) decides.

Items that begin alike share their first pieces, and a text with that opening would
be held against all of them. A piece of more than HOT items is hot. Behind a hot piece
an item must show its cells: the part of the item that is in no hot piece is cut into short cells, and by the pigeonhole again
all but as many as the budget stand unchanged in every occurrence, each within the budget of the place that the hot piece
implies. Cells that more than HOT items have are left out where the others suffice. The cells of a hot piece's items are one table, so an opening costs
look-ups of the text beside it, not items. Only items whose own part is too short for cells are verified at each hot piece.

Both sides are compared folded: letters lower-cased, every run of characters
that are neither letters nor digits one space, so that casing, line breaks and
punctuation cost no edits.

The budget of an item of n folded characters is n // 16 - 1 edits, a little
under 6 % of its length: an occurrence within it is always found, one beyond it never.

The item set is a stated query set. It is read in blocks of at most
``BLOCK_CHARS`` folded characters, each broadcast by itself; more items mean
more passes over the texts, never a larger broadcast. Of several blocks each
writes its result into the shared folder and is freed before the next is read.

Defined results: null or empty texts and items match nothing; repeated rows
give repeated matches; each item_id of equal items is reported; a document
has one row per item, with the least distance, then the first place. Short
items have a budget of no edits and match as whole words (the fold puts a
space at both ends).
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.common import arrow_map
from logloom.plans.durable import scratch

#: Folded characters for each edit of an item's budget, which is also the length of its pieces.
PIECE = 16
#: Folded characters of the items of one broadcast block.
BLOCK_CHARS = 4_000_000

#: Items that share a piece at most before it is hot; characters of a cell at most and at least.
HOT, CELL, LEAST_CELL = 32, 8, 4

SCHEMA = "doc_id long, item_id long, distance int, start long, end long, item_chars int"
_GAPS = regex.compile(r"[^\p{L}\p{N}]+")


def fold(text: str | None) -> str:
    """Lower case, runs of other characters one space, a space at both ends."""
    return " " + _GAPS.sub(" ", text.lower()).strip(" ") + " " if text else " "


def budget(n: int, piece: int = PIECE) -> int:
    """Edits allowed for an item of n folded characters: one less than its pieces, which are ``piece`` long at least."""
    return max(0, n // piece - 1)


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """(offset, piece) of edits + 1 pieces of PIECE characters, the last one longer: items that begin alike share pieces, whatever their length."""
    cuts = [*(i * PIECE for i in range(edits + 1)), len(item)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """(distance, end) of the best occurrence of the pattern in the text; the first end on ties."""
    m = len(pattern)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best, end = score, j + 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
    return best, end


def own_parts(n: int, hot: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(start, end) of the parts of an item of n characters outside its hot pieces."""
    out, at = [], 0
    for a, b in [*sorted(hot), (n, n)]:
        if a > at:
            out.append((at, a))
        at = max(at, b)
    return out


def cells(item: str, parts: list[tuple[int, int]], edits: int) -> Iterator[list[tuple[int, str]]]:
    """(offset, cell) of disjoint cells of one size in the parts, more than ``edits`` of them; a list for each size that gives so many."""
    for size in range(CELL, LEAST_CELL - 1, -1):
        if sum((b - a) // size for a, b in parts) > edits:
            # Cells of the last part lie at its end, so that equal closings have equal cells.
            begins = [x for a, b in parts for x in (range(b - (b - a) // size * size, b, size) if b == len(item) else range(a, b - size + 1, size))]
            yield [(x, item[x : x + size]) for x in begins]


class Group:
    """The items that have one hot piece: their cells, and those without any."""

    def __init__(self):
        self.before, self.behind, self.sizes = 0, 0, set()
        self.cells: dict[str, list[tuple[tuple[int, int], int, int]]] = {}
        self.needed: dict[tuple[int, int], int] = {}
        self.covered_by: Group | None = None  # a group that has all these items, whose piece lies PIECE characters before this one's
        self.last = -1  # where the piece was found last in the text at hand
        self.bare: list[tuple[int, int]] = []

    def add(self, no: int, at: int, edits: int, cells: list[tuple[int, str]]) -> None:
        """An item that has the piece at ``at``, with cells at offsets of their own."""
        if not cells:
            self.bare.append((no, at))
        self.needed[no, at] = len(cells) - edits
        for offset, cell in cells:
            self.cells.setdefault(cell, []).append(((no, at), offset - at, edits))
            self.sizes.add(len(cell))
            self.before = min(self.before, offset - at - edits)
            self.behind = max(self.behind, offset - at + edits)

    def candidates(self, text: str, place: int) -> Iterator[tuple[int, int]]:
        """(item, where it may begin) for the piece at ``place``."""
        shown: dict[tuple[int, int], set[int]] = {}
        for size in self.sizes:
            for x in range(max(0, place + self.before), min(len(text) - size, place + self.behind) + 1):
                for no, offset, edits in self.cells.get(text[x : x + size], ()):
                    if -edits <= x - place - offset <= edits:
                        shown.setdefault(no, set()).add(offset)
        yield from ((no[0], place - no[1]) for no, offsets in shown.items() if len(offsets) >= self.needed[no])
        yield from ((no, place - at) for no, at in self.bare)


class Matcher:
    """The automaton of one block of items."""

    def __init__(self, items: tuple[tuple[int, str], ...]):
        by_text: dict[str, list[int]] = {}
        for item_id, text in items:
            by_text.setdefault(text, []).append(item_id)
        self.items = [(ids, text, budget(len(text))) for text, ids in by_text.items()]
        found: dict[str, list[tuple[int, int]]] = {}
        for no, (_, text, edits) in enumerate(self.items):
            for at, piece in pieces(text, edits):
                found.setdefault(piece, []).append((no, at))
        groups = self._groups({piece: where for piece, where in found.items() if len(where) > HOT})
        self.groups = list(groups.values())
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), [] if piece in groups else where, groups.get(piece)))
        if found:
            self.automaton.make_automaton()
        self.empty = not found

    def _groups(self, hot: dict[str, list[tuple[int, int]]]) -> dict[str, Group]:
        spans: dict[int, list[tuple[int, int]]] = {}
        for piece, where in hot.items():
            for no, at in where:
                spans.setdefault(no, []).append((at, at + len(piece)))
        choices = {no: list(cells(self.items[no][1], own_parts(len(self.items[no][1]), mine), self.items[no][2])) for no, mine in spans.items()}
        often = Counter(cell for found in choices.values() for one in found for _, cell in one)
        chosen = {no: self._chosen(found, often, self.items[no][2]) for no, found in choices.items()}
        out = {piece: Group() for piece in hot}
        for piece, where in hot.items():
            for no, at in where:
                out[piece].add(no, at, self.items[no][2], chosen[no])
            before = {self.items[no][1][at - PIECE : at] if at else "" for no, at in where}
            if len(before) == 1:
                out[piece].covered_by = out.get(before.pop())
        return out

    @staticmethod
    def _chosen(choices: list[list[tuple[int, str]]], often: Counter, edits: int) -> list[tuple[int, str]]:
        """Of the sizes the cells of which the most characters must stand; cells of few items alone, if some size has enough of them, else the rarest."""
        rare = [[x for x in found if often[x[1]] <= HOT] for found in choices]
        rare = [found for found in rare if len(found) > edits]
        if rare:
            return max(rare, key=lambda found: (len(found) - edits) * len(found[0][1]))
        every = [sorted(found, key=lambda x: (often[x[1]], x[0]))[: edits + 1] for found in choices]
        return min(every, key=lambda found: sum(often[cell] for _, cell in found), default=[])

    def matches(self, raw: str | None) -> Iterator[tuple[int, int, int, int, int]]:
        """(item_id, distance, start, end, item length); places in the folded text."""
        if self.empty or not raw:
            return
        text = fold(raw)
        candidates: dict[int, set[int]] = {}
        for group in self.groups:
            group.last = -1
        for last, (size, where, group) in self.automaton.iter(text):
            for no, at in where:
                candidates.setdefault(no, set()).add(last + 1 - size - at)
            if group:
                group.last = last + 1 - size
                if not group.covered_by or group.covered_by.last != group.last - PIECE:  # else found with the piece before
                    for no, start in group.candidates(text, group.last):
                        candidates.setdefault(no, set()).add(start)
        for no, starts in sorted(candidates.items()):
            ids, item, edits = self.items[no]
            n, best = len(item), None
            # Neighbouring starts share a window: windows that overlap are merged.
            spans: list[list[int]] = []
            for s in sorted(starts):
                a, b = max(0, s - edits), min(len(text), s + n + edits)
                if spans and a <= spans[-1][1] and b - spans[-1][0] <= 4 * n:
                    spans[-1][1] = max(spans[-1][1], b)
                else:
                    spans.append([a, b])
            for a, b in spans:
                window = text[a:b]
                at = window.find(item)
                distance, end = (0, at + n) if at >= 0 else myers(item, window)
                if distance <= edits and (best is None or distance < best[0]):
                    best = (distance, max(0, a + end - n), a + end)
                    if not distance:
                        break
            if best:
                for item_id in ids:
                    yield (item_id, *best, n)


@functools.lru_cache(maxsize=4)
def matcher(items: tuple[tuple[int, str], ...]) -> Matcher:
    return Matcher(items)


def item_blocks(items: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[tuple[tuple[int, str], ...]]:
    """The query set, folded, in blocks of bounded size."""
    block, size = [], 0
    for row in items.select(F.col("item_id").cast("long").alias("item_id"), "text").orderBy("item_id", "text").toLocalIterator():
        text = fold(row["text"])
        if not text.strip() or row["item_id"] is None:
            continue
        if block and size + len(text) > block_chars:
            yield tuple(block)
            block, size = [], 0
        block.append((row["item_id"], text))
        size += len(text)
    if block:
        yield tuple(block)


def contaminated(docs: DataFrame, items: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document and benchmark item that occurs in it within the item's edit budget."""
    spark = docs.sparkSession
    rows = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    path, blocks = scratch(spark, "contaminated"), 0

    def found_by(shared) -> DataFrame:
        def run(batches):
            m = matcher(shared.value)
            for b in batches:
                ids, found = b.column("doc_id").to_pylist(), []
                for doc_id, text in zip(ids, b.column("text").to_pylist()):
                    found += [(doc_id, i, d, s, e, n) for i, d, s, e, n in m.matches(text)]
                if found:
                    doc, item, dist, start, end, n = zip(*found)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc, pa.int64()), pa.array(item, pa.int64()), pa.array(dist, pa.int32()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(n, pa.int32())],
                        names=["doc_id", "item_id", "distance", "start", "end", "item_chars"],
                    )

        return arrow_map(rows, run, SCHEMA)

    for shared, last in _broadcast_blocks(spark, items, block_chars):
        if last and not blocks:
            return found_by(shared)
        found_by(shared).write.parquet(f"{path}/block={blocks}")
        blocks += 1
    return spark.read.parquet(path).drop("block") if blocks else spark.createDataFrame([], SCHEMA)


def _broadcast_blocks(spark: SparkSession, items: DataFrame, block_chars: int):
    """(broadcast, whether it is the last) of each block; all but the last are freed when the next one is asked for."""
    blocks = item_blocks(items, block_chars)
    block = next(blocks, None)
    while block is not None:
        after = next(blocks, None)
        shared = spark.sparkContext.broadcast(block)
        yield shared, after is None
        if after is not None:
            shared.destroy()
        block = after


def without_contaminated(docs: DataFrame, items: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs``, all columns, in whose text no item occurs; no join and no shuffle."""
    spark, columns = docs.sparkSession, docs.columns
    numbered = {c: f"_c{i}" for i, c in enumerate(columns)}
    text = numbered[next(c for c in columns if c == "text")]
    out = docs.withColumnsRenamed(numbered)
    kinds = ", ".join(f"{c} {kind}" for c, kind in out.dtypes)
    for shared, last in _broadcast_blocks(spark, items, block_chars):

        def run(batches, shared=shared):
            m = matcher(shared.value)
            for b in batches:
                clean = [next(m.matches(t), None) is None for t in b.column(text).to_pylist()]
                yield b.filter(pa.array(clean, pa.bool_()))

        out = arrow_map(out, run, kinds)
        if not last:
            path = scratch(spark, "decontaminated")
            out.write.parquet(path)
            out = spark.read.schema(kinds).parquet(path)
    return out.withColumnsRenamed({v: k for k, v in numbered.items()})
