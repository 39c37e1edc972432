"""Periodic runs of words, by grammar compression.

A run is a stretch of words with smallest period q, ``MIN_PERIODS`` periods and
``MIN_LENGTH`` words long at least, that no neighbouring word extends. The words of a
text become numbers. Re-Pair replaces the most frequent neighbours by a new symbol again and
again; here a round replaces, at every place at once, the pair that is more frequent
than the pairs that overlap it, until no pair occurs twice, and what is left is paired up evenly. Every
symbol X = AB then gets the runs that cross the boundary of A and B, once, whatever the number of its
occurrences: a longest run lies in some smallest X, and crosses its boundary. Runs of X are
carried to all places where X is derived, and intervals of one period that overlap by the period
become one.

Crossing runs: one half of a run, beside the boundary m, holds MIN_PERIODS / 2 periods, so a stretch of known
length g at m comes again q words further on (or ends at m and came q words before). Substrings
of 1, 2, 4, ... words have exact names (pairs of names of the half size); the places of the name at m, within
a third of X, are the candidates for q, and longest common extensions, by the same names, are the run.

Only stretches can hold a run whose every word lies in a repeated substring of MIN_LENGTH - MIN_LENGTH / MIN_PERIODS words;
texts without one are done at once. Stretches of many texts are compressed together, with a separator
of its own behind each. A text is one record and is worked on whole.

Defined results: null and empty texts have no words and no runs; repeated rows give repeated
results; null ids are kept; an empty table gives no rows; other columns cannot clash, as the output has columns of its own
(``collapsed_docs`` numbers the input's columns first). Words are split at the white space of ASCII alone.
"""

from __future__ import annotations

from collections import defaultdict
from fractions import Fraction
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import arrow_map

#: Words and periods of a run at least.
MIN_LENGTH, MIN_PERIODS = 24, 3
#: Words that are compressed together at most, but for a longer text; candidates measured at a time; size of the longest named substrings (longer ones are compared in steps of it).
GROUP_WORDS, CANDIDATES, TOP = 200_000, 1 << 20, 14

#: Words that a stretch of a run must share with the stretch a period later: MIN_LENGTH - q, or (MIN_PERIODS - 1) * q if that is more.
_SHARED = MIN_LENGTH - MIN_LENGTH // MIN_PERIODS

Run = tuple[int, int, int]


def _mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit mix of 64-bit numbers (wraps around)."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def stretches(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(start, end) of the stretches of texts, which end at ``ends``, that can hold a run: all words lie in substrings of _SHARED words that repeat in the text.

    Substrings are told apart by a hash; equal hashes of different ones only make more stretches.
    """
    n = len(words)
    if n < MIN_LENGTH:
        return np.zeros((0, 2), dtype=np.int64)
    h, span = _mixed(words.astype(np.uint64) + np.uint64(1)), 1
    while span < _SHARED:
        step = min(span, _SHARED - span)
        h = _mixed(h[: len(h) - step] * np.uint64(0xD6E8FEB86659FD93) + h[step:])
        span += step
    text = np.searchsorted(ends, np.arange(len(h)), side="right")
    inside = np.flatnonzero(np.arange(len(h)) + _SHARED <= ends[text])
    keys = _mixed(h[inside] + text[inside].astype(np.uint64))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    again = inside[order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]] if len(order) else inside
    depth = np.zeros(n + 1, dtype=np.int64)
    np.add.at(depth, again, 1)
    np.add.at(depth, again + _SHARED, -1)
    covered = np.cumsum(depth)[:n] > 0
    # A stretch also ends where its text does.
    edge = np.zeros(n + 1, dtype=bool)
    edge[ends[ends < n]] = True
    before = np.concatenate([[False], covered[:-1]])
    starts = np.flatnonzero(covered & (~before | edge[:n]))
    stops = np.flatnonzero(covered & (~np.concatenate([covered[1:], [False]]) | edge[1:] | (np.arange(n) == n - 1))) + 1
    return np.stack([starts, stops], axis=1)[stops - starts >= MIN_LENGTH]


class Names:
    """Exact names of all substrings of 1, 2, 4, ... words: equal names mean equal substrings."""

    def __init__(self, words: np.ndarray):
        self.levels = [np.unique(words, return_inverse=True)[1].astype(np.int64)]
        self.n = len(words)
        while len(self.levels) <= TOP and self.n >= 2 << (len(self.levels) - 1):
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            pairs = last[:-half] * (int(last.max()) + 1) + last[half:]
            self.levels.append(np.unique(pairs, return_inverse=True)[1].astype(np.int64))
        self._places: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def places(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in the order of name and place, and their sorted keys name * n + place."""
        if level not in self._places:
            order = np.argsort(self.levels[level], kind="stable")
            self._places[level] = order, self.levels[level][order] * self.n + order
        return self._places[level]

    def _extended(self, i: np.ndarray, j: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        done = np.zeros(len(i), dtype=np.int64)
        top = len(self.levels) - 1
        for level in range(top, -1, -1):
            names, size = self.levels[level], 1 << level
            todo = np.flatnonzero(done + size <= most)
            while len(todo):
                shift = -done[todo] - size if back else done[todo]
                todo = todo[names[i[todo] + shift] == names[j[todo] + shift]]
                done[todo] += size
                todo = todo[done[todo] + size <= most[todo]] if level == top else todo[:0]
        return done

    def forward(self, i, j, most):
        """Words from i and from j on that are equal, ``most`` at most."""
        return self._extended(i, j, most, False)

    def backward(self, i, j, most):
        """Words before i and before j that are equal, ``most`` at most."""
        return self._extended(i, j, most, True)


def grammar(words: np.ndarray) -> np.ndarray:
    """symbol, start, middle, end of each place where a symbol of MIN_LENGTH words or more is derived."""
    seq, edges = np.unique(words, return_inverse=True)[1].astype(np.int64), np.arange(len(words) + 1)
    fresh, out = int(seq.max(initial=0)) + 1, []

    def replace(at: np.ndarray, symbols: np.ndarray) -> None:
        nonlocal seq, edges
        place = np.stack([symbols, edges[at], edges[at + 1], edges[at + 2]])
        out.append(place[:, place[3] - place[1] >= MIN_LENGTH])
        seq[at] = symbols
        gone = np.ones(len(seq), dtype=bool)
        gone[at + 1] = False
        seq, edges = seq[gone], np.append(edges[:-1][gone], edges[-1])

    while len(seq) > 1:
        pairs = seq[:-1] * fresh + seq[1:]
        kinds, kind, often = np.unique(pairs, return_inverse=True, return_counts=True)
        if often.max() < 2:
            break
        # Frequency first, ties by a mix of the pair: no two pairs have the same rank.
        rank = np.empty(len(kinds), dtype=np.int64)
        rank[np.lexsort((_mixed(kinds.astype(np.uint64)), often))] = np.arange(len(kinds))
        ranks = rank[kind]
        first = np.concatenate([[True], kind[1:] != kind[:-1]])
        offset = np.arange(len(kind)) - np.maximum.accumulate(np.where(first, np.arange(len(kind)), 0))
        best = (ranks >= np.append(-1, ranks[:-1])) & (ranks >= np.append(ranks[1:], -1))
        at = np.flatnonzero((often[kind] > 1) & best & (offset % 2 == 0))  # of a repeated symbol every second pair
        replaced, symbols = np.unique(kind[at], return_inverse=True)
        replace(at, fresh + symbols)
        fresh += len(replaced)
    while len(seq) > 1:
        at = np.arange(0, len(seq) - 1, 2)
        replace(at, fresh + np.arange(len(at)))
        fresh += len(at)
    return np.concatenate(out, axis=1) if out else np.zeros((4, 0), dtype=np.int64)


def _level(low: int) -> int:
    """Level of the names that half a run of a period from ``low`` to 2 * low - 1 shares with its copy a period away."""
    shared = min(max(MIN_LENGTH / 2 - q, (MIN_PERIODS / 2 - 1) * q) for q in range(low, min(2 * low, MIN_LENGTH) if low < MIN_LENGTH else low + 1))
    return int(shared).bit_length() - 1


def crossing(names: Names, start: np.ndarray, middle: np.ndarray, end: np.ndarray) -> np.ndarray:
    """symbol's number, start, end, period of the runs within [start, end) found from its boundary; of one interval the smallest period."""
    found, third, k = [], (end - start) // MIN_PERIODS, 0
    while 1 << k <= int(third.max(initial=0)):
        low = 1 << k
        level = min(_level(low), len(names.levels) - 1)
        g, (order, keys), named = 1 << level, names.places(level), names.levels[level]
        for right in (True, False):
            x = np.flatnonzero((third >= low) & ((middle + low + g <= end) if right else (middle - low - g >= start)))
            here = middle[x] if right else middle[x] - g
            far = np.minimum(2 * low - 1, third[x])
            a, b = (here + low, np.minimum(here + far, end[x] - g)) if right else (np.maximum(here - far, start[x]), here - low)
            base = named[here] * names.n
            first, last = np.searchsorted(keys, base + a, "left"), np.searchsorted(keys, base + b, "right")
            sizes = np.maximum(last - first, 0)
            before = np.concatenate([[0], np.cumsum(sizes)])
            lo = 0
            while lo < len(x):  # some symbols at a time
                hi = max(lo + 1, int(np.searchsorted(before, before[lo] + CANDIDATES, "right")) - 1)
                n, own = sizes[lo:hi], np.repeat(np.arange(lo, hi), sizes[lo:hi])
                place = order[np.repeat(first[lo:hi], n) + np.arange(len(own)) - np.repeat(before[lo:hi] - before[lo], n)]
                symbol, q = x[own], np.abs(place - here[own])
                m = middle[symbol]
                i = m if right else m - q
                ends = i + q + names.forward(i, i + q, end[symbol] - i - q)
                starts = i - names.backward(i, i + q, i - start[symbol])
                ok = ends - starts >= np.maximum(MIN_LENGTH, MIN_PERIODS * q)
                found.append(np.stack([symbol[ok], starts[ok], ends[ok], q[ok]]))
                lo = hi
        k += 1
    rows = np.concatenate(found, axis=1) if found else np.zeros((4, 0), dtype=np.int64)
    rows = rows[:, np.lexsort((rows[3], rows[2], rows[1], rows[0]))]
    new = np.ones(rows.shape[1], dtype=bool)
    new[1:] = (rows[:3, 1:] != rows[:3, :-1]).any(axis=0)
    return rows[:, new]


def merged(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> np.ndarray:
    """start, end, period of the longest intervals: those of one period that overlap by it are one; of one interval the smallest period."""
    order = np.lexsort((start, period))
    start, end, period = start[order], end[order], period[order]
    if len(start):
        size = int(end.max()) + 1
        group = np.cumsum(np.concatenate([[0], period[1:] != period[:-1]])) * size
        reach = np.maximum.accumulate(group + end) - group  # furthest end so far, of this period
        new = np.concatenate([[True], (period[1:] != period[:-1]) | (start[1:] > reach[:-1] - period[1:])])
        first = np.flatnonzero(new)
        start, end, period = start[first], np.maximum.reduceat(end, first), period[first]
    order = np.lexsort((period, end, start))
    rows = np.stack([start, end, period])[:, order]
    new = np.ones(rows.shape[1], dtype=bool)
    new[1:] = (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)
    return rows[:, new]


def runs_of(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """start, end, period of all runs of texts that stand one behind another and end at ``ends``, ascending."""
    spans = stretches(words, ends)
    if not len(spans):
        return np.zeros((3, 0), dtype=np.int64)
    sizes = spans[:, 1] - spans[:, 0]
    joined_at = np.concatenate([[0], np.cumsum(sizes + 1)])  # one separator behind each
    joined = np.empty(joined_at[-1], dtype=np.int64)
    origin = np.repeat(spans[:, 0] - joined_at[:-1], sizes + 1) + np.arange(len(joined))
    last = joined_at[1:] - 1
    joined[:] = words[np.minimum(origin, len(words) - 1)]
    joined[last] = int(words.max()) + 1 + np.arange(len(last))
    symbol, start, middle, end = grammar(joined)
    if not len(symbol):
        return np.zeros((3, 0), dtype=np.int64)
    order = np.argsort(symbol, kind="stable")
    symbol, start, middle, end = symbol[order], start[order], middle[order], end[order]
    first = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1]]))
    times = np.diff(np.append(first, len(symbol)))
    # A symbol with separators in it occurs once; its boundary lies in one stretch.
    stretch = np.searchsorted(last, middle[first], side="right")
    stretch = np.minimum(stretch, len(last) - 1)
    low, high = np.maximum(start[first], joined_at[stretch]), np.minimum(end[first], last[stretch])
    wide = high - low >= MIN_LENGTH
    kept = np.flatnonzero(wide)
    no, a, b, q = crossing(Names(joined), low[kept], middle[first][kept], high[kept])
    own = kept[no]
    # To every place of the symbol.
    n = times[own]
    each = np.repeat(np.arange(len(own)), n)
    place = np.repeat(first[own], n) + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
    shift = start[place] - start[first][own][each]
    a, b, q = merged(a[each] + shift, b[each] + shift, q[each])
    move = origin[a] - a
    return np.stack([a + move, b + move, q])


def scan_texts(texts: list[bytes | None]) -> list[tuple[list[Run], bytes]]:
    """(runs as (start, length, period), words joined by one space without those that repeat a run's first period) of each text."""
    split = [t.split() if t else [] for t in texts]  # bytes split at ASCII white space alone
    numbers: dict[bytes, int] = defaultdict(count().__next__)
    words = np.fromiter((numbers[w] for t in split for w in t), dtype=np.int64, count=sum(map(len, split)))
    ends = np.cumsum([len(t) for t in split])
    found = runs_of(words, ends)
    owner = np.searchsorted(ends, found[0], side="right")
    runs: list[list[Run]] = [[] for _ in texts]
    for text, a, b, q in zip(owner.tolist(), *found.tolist()):
        begin = int(ends[text]) - len(split[text])
        runs[text].append((a - begin, b - a, q))
    out = []
    for mine, t in zip(runs, split):
        if mine:
            gone = np.zeros(len(t) + 1, dtype=np.int64)
            for a, length, q in mine:
                gone[a + q] += 1
                gone[a + length] -= 1
            t = [w for w, g in zip(t, np.cumsum(gone).tolist()) if not g]
        out.append((mine, b" ".join(t)))
    return out


def strongest(runs: list[Run]) -> Run | None:
    """The run with the most periods, exactly; then the smallest start, then the smallest period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_RUN_SQL = "struct<start: bigint, length: bigint, period: bigint>"


def _groups(texts: list[bytes | None]):
    """Ranges of rows with about GROUP_WORDS words (taken as six bytes each)."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t or b"") > 6 * GROUP_WORDS:
            yield first, i
            first, size = i, 0
        size += len(t or b"")
    yield first, len(texts)


def _scan(docs: DataFrame, kept: list[str], text: str) -> DataFrame:
    """``kept`` columns, and runs, best and collapsed of the text."""
    rows = docs.select(*kept, F.col(text).cast("string").cast("binary").alias("_text"))
    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in kept), f"runs array<{_RUN_SQL}>, best {_RUN_SQL}, collapsed binary"])

    def run(batches):
        for b in batches:
            texts = b.column("_text").to_pylist()
            for first, last in _groups(texts):
                if first == last:
                    continue
                found = scan_texts(texts[first:last])
                as_run = lambda r: r and dict(zip(("start", "length", "period"), r))
                yield pa.RecordBatch.from_arrays(
                    [
                        *[b.column(c).slice(first, last - first) for c in kept],
                        pa.array([[as_run(r) for r in runs] for runs, _ in found], pa.list_(_RUN)),
                        pa.array([as_run(strongest(runs)) for runs, _ in found], _RUN),
                        pa.array([c for _, c in found], pa.binary()),
                    ],
                    names=[*kept, "runs", "best", "collapsed"],
                )

    return arrow_map(rows, run, schema)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, runs (start, length, period, in words, ascending), best (the run with the most periods), collapsed (the text's kept words joined by one space)."""
    out = _scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), ["doc_id"], "text")
    return out.withColumn("collapsed", F.col("collapsed").cast("string"))


def collapsed_docs(docs: DataFrame) -> DataFrame:
    """``docs``, all rows and columns, the text of those with runs without the repeated periods; others keep theirs as it is."""
    numbered = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    text = numbered["text"]
    found = _scan(docs.withColumnsRenamed(numbered), list(numbered.values()), text)
    new = F.when(F.size("runs") > 0, F.col("collapsed").cast("string")).otherwise(F.col(text))
    return found.withColumn(text, new).select(*[F.col(v).alias(k) for k, v in numbered.items()])
