"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built from a bounded sample of
labelled text. A text is parsed greedily against it: follow transitions as
long as the automaton has them (the longest match), then start a new phrase.
A language in which the text is "at home" needs few, long phrases. Phrase
rates are divided by the rate that held-back text of the language itself
needs; the smallest normalised rate wins.

Texts are folded before the parse: letters to lower case, each run of
other characters to one separator. The OWN_LETTERS most frequent letters of the samples are
symbols of their own; any other letter is a pair of symbols, the upper and
the lower bits of its code point, so that large scripts keep their letters apart. Whole texts
are parsed from end to end: a batch of texts is a matrix of blocks that numpy
steps through column by column, and a block is parsed again from the state in which the block
before it ended until all states agree, which is the parse of the whole text. In prose that takes
a few rounds; what has not settled after ROUNDS of them (repetitive texts) is walked from
there on symbol by symbol, so time is linear in every text.

Defined results: a null text or one without letters is ``und`` with score 0;
ties go to the language first in alphabetical order; repeated rows give
repeated results; with no labelled row every text is ``und``; a row without a
doc_id is in no fold: it is not held out; the output has only the id and the result
columns, so columns of the input cannot clash.
"""

from __future__ import annotations

import functools
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import arrow_map

#: Folded characters of a block, a column of the matrix; times that blocks are parsed again side by side before the rest is walked.
BLOCK, ROUNDS = 256, 4
#: Bounds of the fitted sample of a language: characters of its automaton, of the text that calibrates it, of one sampled text.
SAMPLE_CHARS, CALIBRATION_CHARS, SAMPLE_TEXT_CHARS = 20_000, 10_000, 6_000
#: Letters that are one symbol; symbols for either half of the others.
OWN_LETTERS, HALF = 160, 64

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, cost double, n_letters long"


def fit_sample(labelled: DataFrame) -> dict[str, list[str]]:
    """A bounded sample of texts per language, in the order of a hash of the id.

    ``labelled`` has doc_id, text, lang. Of every language about SAMPLE_CHARS +
    CALIBRATION_CHARS characters come to the driver; of a text over
    SAMPLE_TEXT_CHARS a span of that size.
    """
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    size = F.length("text")
    counts = (
        rows.groupBy("lang")
        .agg(F.count(F.lit(1)).alias("n"), F.avg(F.least(size, F.lit(SAMPLE_TEXT_CHARS))).alias("chars"))
        .collect()
    )
    if not counts:
        return {}
    budget = SAMPLE_CHARS + CALIBRATION_CHARS
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # Of a long text a span at a hashed place; where that has no letters, the span from the first letter on.
    at = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("span")), F.greatest(size - SAMPLE_TEXT_CHARS, F.lit(0)) + 1) + 1
    span = F.substring("text", at.cast("int"), F.lit(SAMPLE_TEXT_CHARS))
    lettered = F.when(span.rlike(r"\p{L}"), span).otherwise(F.regexp_extract("text", rf"(?s)\p{{L}}.{{0,{SAMPLE_TEXT_CHARS - 1}}}", 0))
    piece = F.when(size <= SAMPLE_TEXT_CHARS, F.col("text")).otherwise(lettered)
    shares = {r["lang"]: min(1.0, 3.0 * max(budget / max(r["chars"], 1), 8) / r["n"]) for r in counts}
    taken: dict[str, list[str]] = {}
    while shares:
        share = F.create_map(*[x for lang, v in shares.items() for x in (F.lit(lang), F.lit(v))])
        picked = (
            rows.where(F.col("lang").isin(list(shares)) & (draw < share[F.col("lang")]))
            .select("lang", draw.alias("draw"), piece.alias("text"), F.col("doc_id").cast("string").alias("id"))
            .orderBy("draw", "id")
        )
        taken |= {lang: [] for lang in shares}
        chars: Counter = Counter()
        for row in picked.toLocalIterator():
            if chars[row["lang"]] < budget:
                taken[row["lang"]].append(row["text"])
                chars[row["lang"]] += len(row["text"])
            if all(chars[lang] >= budget for lang in shares):
                break
        # Languages that the draw left under the budget draw again, from more of their rows.
        shares = {lang: min(1.0, 8 * v) for lang, v in shares.items() if chars[lang] < budget and v < 1.0}
    return {lang: texts for lang, texts in taken.items() if texts}


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence; state 0 is the root."""
    nexts: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        cur = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nexts


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([not 0xD800 <= i < 0xE000 and chr(i).isalpha() for i in range(0x110000)])


class CrossParser:
    """Automata of all languages as dense tables, and the parse of batches."""

    def __init__(self, sample: tuple[tuple[str, tuple[str, ...]], ...]):
        self.languages = [lang for lang, _ in sample]
        letters = Counter(c for _, texts in sample for t in texts for c in t.lower() if c.isalpha())
        own = [c for c, _ in sorted(letters.items(), key=lambda x: (-x[1], x[0]))[:OWN_LETTERS]]
        # Symbol 0 is the separator, the last one pads blocks.
        high = 1 + len(own)
        self.low = high + HALF
        self.pad = self.low + HALF
        points, alpha = np.arange(0x110000), _letters()
        self.first = np.where(alpha, high + (points >> 6) % HALF, 0).astype(np.uint16)
        self.second = np.where(alpha, self.low + points % HALF, 0).astype(np.uint16)
        for i, c in enumerate(own):
            for x in {c, c.upper()}:
                if len(x) == 1:
                    self.first[ord(x)], self.second[ord(x)] = 1 + i, 0
        self.tables, self.roots, self.symbols, self.rates = [], [], [], []
        for _, texts in sample:
            folded = [self.fold(t) for t in texts]
            total, head, tail = 0, [], []
            for f in folded:
                (head if total < SAMPLE_CHARS or len(folded) == 1 else tail).append(f)
                total += len(f)
            codes = np.concatenate(head)[:SAMPLE_CHARS]
            # A table has columns for the symbols of its sample, one for all others, and one that keeps the state.
            used = np.unique(codes)
            symbols = np.full(self.pad + 1, len(used), dtype=np.int32)
            symbols[used] = np.arange(len(used))
            symbols[self.pad], k = len(used) + 1, len(used) + 2
            nexts = suffix_automaton(symbols[codes].tolist())
            table = np.full((len(nexts), k), -1, dtype=np.int32)
            for s, arcs in enumerate(nexts):
                for c, to in arcs.items():
                    table[s, c] = to * k
            table[:, k - 1] = np.arange(len(nexts)) * k
            self.tables.append(table.reshape(-1))
            self.roots.append(np.maximum(table[0], 0))
            self.symbols.append(symbols)
            own_text = tail or [np.concatenate(head)]
            phrases = self.phrases(own_text, [len(self.tables) - 1])[0].sum()
            self.rates.append(max(phrases / max(1, sum(map(len, own_text))), 1e-6) if tail else None)
        known = [r for r in self.rates if r] or [0.1]
        self.rates = np.array([r or float(np.mean(known)) for r in self.rates])

    def fold(self, text: str) -> np.ndarray:
        """Symbols of a text; no separator at its start."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        first = self.first[points]
        keep = first != 0
        keep[1:] |= first[:-1] != 0
        first, second = first[keep], self.second[points[keep]]
        if not second.any():
            return first
        both = np.stack([first, second], axis=1).reshape(-1)
        keep = both != 0
        keep[::2] = True
        return both[keep]

    @staticmethod
    def _walk(table, root, local, begun, ends, failures, todo, starts) -> None:
        """Parses the texts that have blocks in ``todo`` from the first of them on, symbol by symbol; a block already parsed from the state at hand is taken as it is. Every block is walked once at most."""
        arcs, roots = memoryview(table), memoryview(np.ascontiguousarray(root))
        text = np.searchsorted(starts, todo, side="right") - 1
        for first in todo[np.concatenate([[True], text[1:] != text[:-1]])].tolist():
            last = int(starts[np.searchsorted(starts, first, side="right")])
            state = int(ends[first - 1])
            for b in range(first, last):
                if state != begun[b]:
                    begun[b], phrases = state, 0
                    for c in local[:, b].tolist():
                        state = arcs[state + c]
                        if state < 0:
                            state = roots[c]
                            phrases += 1
                    ends[b], failures[b] = state, phrases
                state = int(ends[b])

    def phrases(self, folded: list[np.ndarray], which: list[int] | None = None) -> np.ndarray:
        """Phrases of each text in each language: [language, text]."""
        which = list(range(len(self.tables))) if which is None else which
        blocks = np.array([-(-len(f) // BLOCK) for f in folded], dtype=np.int64)
        starts = np.concatenate([[0], np.cumsum(blocks)])
        n = int(starts[-1])
        matrix = np.full(n * BLOCK, self.pad, dtype=np.uint16)
        for f, s in zip(folded, starts):
            matrix[s * BLOCK : s * BLOCK + len(f)] = f
        columns = np.ascontiguousarray(matrix.reshape(-1, BLOCK).T)
        begins = np.zeros(n, dtype=bool)
        begins[starts[:-1][blocks > 0]] = True
        out = np.zeros((len(which), len(folded)), dtype=np.int64)
        for row, lang in enumerate(which):
            table, root = self.tables[lang], self.roots[lang]
            local = self.symbols[lang][columns]
            ends, failures, begun = np.zeros(n, dtype=np.int32), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int32)
            todo, wanted = np.arange(n), begun
            for _ in range(ROUNDS):
                begun = wanted
                state, ended = begun[todo], np.zeros(len(todo), dtype=np.int32)
                for c in local if len(todo) == n else np.ascontiguousarray(local[:, todo]):
                    state = table.take(state + c)
                    failed = state < 0
                    np.copyto(state, root.take(c), where=failed)
                    ended += failed
                ends[todo], failures[todo] = state, ended
                wanted = np.where(begins, 0, np.concatenate([[0], ends[:-1]])).astype(np.int32)
                todo = np.flatnonzero(wanted != begun)
                if not len(todo):
                    break
            else:
                self._walk(table, root, local, begun, ends, failures, todo, starts)
            sums = np.concatenate([[0], np.cumsum(failures)])
            out[row] = sums[starts[1:]] - sums[starts[:-1]] + (blocks > 0)
        return out

    def judge(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float], list[int]]:
        """Language, score, normalised phrase rate and letters of each text."""
        folded = [self.fold(t or "") for t in texts]
        letters = [int(np.count_nonzero(f) - np.count_nonzero(f >= self.low)) for f in folded]
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts), [None] * len(texts), letters
        sizes = np.array([max(1, len(f)) for f in folded])
        cost = self.phrases(folded) / sizes / self.rates[:, None]
        order = np.argsort(cost, axis=0, kind="stable")
        best = np.take_along_axis(cost, order[:1], 0)[0]
        second = np.take_along_axis(cost, order[1:2], 0)[0] if len(cost) > 1 else np.full(len(texts), np.inf)
        lang, score, costs = [], [], []
        for i, n in enumerate(letters):
            lang.append(self.languages[order[0, i]] if n else "und")
            score.append((float(1 / (1 + best[i] / second[i])) if np.isfinite(second[i]) else 1.0) if n else 0.0)
            costs.append(float(best[i]) if n else None)
        return lang, score, costs, letters


@functools.lru_cache(maxsize=2)
def parser(sample: tuple[tuple[str, tuple[str, ...]], ...]) -> CrossParser:
    """One parser per Python worker and sample."""
    return CrossParser(sample)


def identify(docs: DataFrame, sample: dict[str, list[str]], keep: list[str] | None = None, held_out: Column | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, cost, n_letters per row of ``docs`` (doc_id, text).

    ``keep`` returns these columns of ``docs`` too, in front (for filters).
    """
    frozen = tuple((lang, tuple(texts)) for lang, texts in sorted(sample.items()))
    keep = keep or []
    held = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))
    rows = docs.select(
        *[F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)],
        F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text"),
    )
    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"_keep{i} {kinds[c]}" for i, c in enumerate(keep)), SCHEMA])

    def run(batches):
        p = parser(frozen)
        for b in batches:
            texts = b.column("text").to_pylist()
            lang, score, cost, letters = p.judge(texts)
            kept = [b.column(f"_keep{i}") for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays(
                [*kept, b.column("doc_id"), b.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(cost, pa.float64()), pa.array(letters, pa.int64())],
                names=[*(f"_keep{i}" for i in range(len(keep))), "doc_id", "held_out", "lang_pred", "score", "cost", "n_letters"],
            )

    return arrow_map(rows, run, schema)


#: A text whose best normalised phrase rate is above this is random letters or in another script; unlearned languages of the same script mostly stay below.
MAX_COST = 3.0


def in_known_language(docs: DataFrame, sample: dict[str, list[str]], max_cost: float = MAX_COST) -> DataFrame:
    """The rows of ``docs``, all columns, whose text has letters and costs at most ``max_cost``; only random letters and other scripts cost more."""
    judged = identify(docs, sample, keep=docs.columns)
    fits = (F.col("lang_pred") != "und") & (F.col("cost") <= max_cost)
    return judged.where(fits).select(*[F.col(f"_keep{i}").alias(c) for i, c in enumerate(docs.columns)])
