"""Toxicity by a weighted finite-state pattern grammar.

Texts are read clause by clause. Five transducers, each a table of arcs over
few symbols, are composed into one machine that a clause is run through:

* insult: words of the lexicon become insults that carry their weight;
* negation: an insult within REACH words of one is marked, a threat there is none;
* reported speech: insults and threats within REPORT_REACH words of it are marked;
* threat: one threat of a clause counts, if the clause has a target;
* target: an insult counts more behind a target, or if one follows.

What comes out of the machine weighs by a table of (factor of the insult's own weight,
constant); a text's score is the logistic of the sum over its clauses.

Insults and their weights are learned from labelled rows: whole words, and word
stems (prefixes of STEM letters), by smoothed log-odds of the distinct places
they have in toxic and in other texts, kept where a likelihood-ratio test
rules out chance. A stem stands only if it is the shortest that carries the signal, so
inflected and compounded forms match too. The other symbols are short word
lists in several languages, below.

The sample is bounded: at most ``SAMPLE_DOCS`` labelled rows (by a hash of
the id) are counted, whole texts each; counting is a Spark aggregation, and at
most ``MAX_ENTRIES`` lexicon entries come to the driver.

Defined results: a null text counts as empty; texts without matches have
the base score (that of the grammar's bias), below the threshold; repeated
rows get equal scores; conflicting labels of a doc_id count as separate rows;
with no labelled rows or one label alone the lexicon is empty; a row without a
doc_id is in no fold: it is not held out and has no label to learn from.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Hashable, Iterable
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import arrow_map, cut

#: Bounds of the fitted sample and of what it yields.
SAMPLE_DOCS, MAX_ENTRIES = 20_000, 5_000
#: Lengths of stems; least places with an entry; least share of toxic ones among them (smoothed); margin of significance, a log.
STEM, MIN_PLACES, MIN_SHARE, MARGIN = range(4, 8), 5, 0.8, 2.0
#: A clause is cut at these.
_CLAUSE = re.compile(r"[.!?;:\n]+")
_WORD = re.compile(r"[^\W\d_]+")

# Word lists of the grammar's own symbols.
THREATS = "kill hurt destroy burn shoot stab beat smash töten umbringen schlagen verprügeln tuer tuez frapper brûler matar golpear quemar destruir".split()
TARGETS = "you your yours he she they them him her this these du dich dir ihr euch sie tu toi vous ils elle él ella tú usted ustedes ellos".split()
NEGATIONS = "not never no nobody nicht kein keine niemals pas jamais aucun nunca ningún jamás".split()
REPORTS = "said says wrote quoted reported called claimed sagte schrieb zitierte dit écrivait cité dijo escribió citó".split()

#: Weights of the clause grammar: bias of a text, of a target near an insult, of a threat with a target; factors under negation and report.
BIAS, WITH_TARGET, THREAT, NEGATED, REPORTED = -2.2, 0.5, 1.5, 0.3, 0.5
#: Words that a negation reaches; weight of an entry's log-odds, and its most: one doubtful entry alone does not make a text toxic.
REACH, ODDS_WEIGHT, MAX_WEIGHT = 3, 0.55, 3.0
#: Words that reported speech reaches.
REPORT_REACH = 12

SCHEMA = "doc_id long, held_out boolean, score double, predicted int, n_clauses long"


def fit_lexicon(labelled: DataFrame) -> dict[str, float]:
    """Weighted insults: entries ending in ``*`` are stems. ``labelled`` has doc_id, text, toxic."""
    rows = labelled.where(F.col("toxic").isin(0, 1))
    draw = F.xxhash64(F.col("doc_id").cast("string"), F.lit("toxic"))
    n = rows.count()
    if n > SAMPLE_DOCS:  # a share of the hash range, not a sort of all rows
        rows = rows.where(F.pmod(draw, F.lit(1 << 30)) < int((1 << 30) * SAMPLE_DOCS / n))
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return {}
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"([\p{L}]+)"), F.lit(1))
    # Copies of one text repeat words in the same place, so distinct preceding words are counted, not occurrences.
    pair = F.explode(F.transform(F.col("w"), lambda x, i: F.struct(x.alias("word"), F.get(F.col("w"), i - 1).alias("before"))))
    places = rows.select("toxic", words.alias("w")).select("toxic", pair.alias("p")).select("toxic", "p.word", F.xxhash64("p.before").alias("before"))
    per_word = (
        places.groupBy("word", "before").agg(F.bool_or(F.col("toxic") == 1).alias("pos"), F.bool_or(F.col("toxic") == 0).alias("neg"))
        .groupBy("word").agg(F.count_if("pos").alias("pos"), F.count_if("neg").alias("neg"))
    )
    per_word = cut(per_word)
    total = per_word.agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.count(F.lit(1)).alias("n")).first()
    if not total["n"]:
        return {}
    base = (total["pos"] + 1) / (total["pos"] + total["neg"] + 2)
    marks = [F.when(F.length("word") > k, F.concat(F.substring("word", 1, k), F.lit("*"))) for k in STEM]
    pos, neg = F.col("pos"), F.col("neg")
    share = (pos + 0.1) / (pos + neg + 0.2)
    # Log-likelihood ratio against the base share; a chance entry among all those tested must not pass.
    surprise = pos * F.log(share / base) + neg * F.log((1 - share) / (1 - base))
    counts = (
        per_word.select("pos", "neg", F.explode(F.array_compact(F.array(F.col("word"), *marks))).alias("entry"))
        .groupBy("entry").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        .where((pos >= MIN_PLACES) & (share >= MIN_SHARE))
        .where(surprise >= math.log(5 * total["n"]) + MARGIN)
        .select("entry", "pos", F.log(share / (1 - share)).alias("odds"))
        .orderBy(F.desc("odds"), F.desc("pos"), "entry")
        .limit(MAX_ENTRIES)
        .collect()
    )
    lexicon: dict[str, float] = {}
    for r in sorted(counts, key=lambda r: (len(r["entry"].rstrip("*")), r["entry"])):
        word = r["entry"].rstrip("*")
        if any(word[:k] + "*" in lexicon for k in STEM if k <= len(word) - (r["entry"][-1] == "*")):
            continue  # a shorter stem stands for it
        lexicon[r["entry"]] = round(min(MAX_WEIGHT, ODDS_WEIGHT * r["odds"]), 4)
    return lexicon


@dataclass(frozen=True)
class Transducer:
    """Arcs (state, symbol) to (output, next state); without an arc a symbol passes and the state stays."""

    start: Hashable
    arcs: dict

    def step(self, state: Hashable, symbol: str) -> tuple[str, Hashable]:
        return self.arcs.get((state, symbol), (symbol, state))


#: Symbols that words become: insult, threat, target, negation, report, another word.
SYMBOLS = ("I", "T", "Y", "N", "R", "W")
#: Marks of an insult: negated, reported.
_INSULTS = ("I", "I~", 'I"', 'I~"')
_TARGETS = ("Y", "Y!", 'Y!"')

NEGATION = Transducer(
    0,
    {(k, "N"): ("W", REACH) for k in range(REACH + 1)}
    | {(k, x): (x, max(0, k - 1)) for k in range(REACH + 1) for x in "YRW"}
    | {(k, "I"): ("I~" if k else "I", max(0, k - 1)) for k in range(REACH + 1)}
    | {(k, "T"): ("W" if k else "T", max(0, k - 1)) for k in range(REACH + 1)},
)
REPORT = Transducer(
    0,
    {(k, "R"): ("W", REPORT_REACH) for k in range(REPORT_REACH + 1)}
    | {(k, x): (x, max(0, k - 1)) for k in range(REPORT_REACH + 1) for x in "YW"}
    | {(k, x): (x + '"' if k else x, max(0, k - 1)) for k in range(REPORT_REACH + 1) for x in ("I", "I~", "T")},
)
THREAT_OF = Transducer(
    "none",
    {("none", "Y"): ("Y", "target"), ("none", "T"): ("W", "T"), ("none", 'T"'): ("W", 'T"')}
    | {("target", "T"): ("!", "done"), ("target", 'T"'): ('!"', "done")}
    | {("T", "Y"): ("Y!", "done"), ('T"', "Y"): ('Y!"', "done")}
    | {(a, b): ("W", "T" if "T" in (a, b) else 'T"') for a in ("T", 'T"') for b in ("T", 'T"')}
    | {("done", x): ("W", "done") for x in ("T", 'T"')},
)
TARGET = Transducer(
    "none",
    {("seen", x): (x + "+", "seen") for x in _INSULTS}
    | {(before, x): (x, x) for before in ("none", *_INSULTS) for x in _INSULTS}
    | {("none", y): (y, "seen") for y in _TARGETS}
    | {(before, y): (y + before, "seen") for before in _INSULTS for y in _TARGETS},
)


def factor(insult: str) -> float:
    return (NEGATED if "~" in insult else 1.0) * (REPORTED if '"' in insult else 1.0)


#: What an output weighs: factor of the insult's own weight, and a constant. Other outputs weigh nothing.
_THREATS = {"Y": 0.0, "Y!": THREAT, 'Y!"': THREAT * REPORTED}
OUTPUT_WEIGHTS = (
    {x: (factor(x), 0.0) for x in _INSULTS}
    | {x + "+": (factor(x), factor(x) * WITH_TARGET) for x in _INSULTS}
    | {"!": (0.0, THREAT), '!"': (0.0, THREAT * REPORTED)}
    | {y: (0.0, w) for y, w in _THREATS.items()}
    | {y + x: (0.0, w + factor(x) * WITH_TARGET) for y, w in _THREATS.items() for x in _INSULTS}
)


def compose(one: Transducer, two: Transducer, symbols: Iterable[str] = SYMBOLS) -> Transducer:
    """The transducer that feeds the outputs of ``one`` to ``two``; its states are the pairs that can be reached."""
    start = (one.start, two.start)
    arcs, todo, known = {}, [start], {start}
    while todo:
        a, b = state = todo.pop()
        for x in symbols:
            middle, a2 = one.step(a, x)
            out, b2 = two.step(b, middle)
            arcs[state, x] = (out, (a2, b2))
            if (a2, b2) not in known:
                known.add((a2, b2))
                todo.append((a2, b2))
    return Transducer(start, arcs)


@functools.lru_cache(maxsize=1)
def machine() -> tuple[int, list[dict[str, tuple[float, float, int]]]]:
    """The composed grammar with numbered states: start, and per state symbol to (factor, constant, next state)."""
    whole = functools.reduce(compose, (NEGATION, REPORT, THREAT_OF, TARGET))
    numbers = {s: i for i, s in enumerate(dict.fromkeys(s for s, _ in whole.arcs))}
    table: list[dict[str, tuple[float, float, int]]] = [{} for _ in numbers]
    for (state, x), (out, after) in whole.arcs.items():
        table[numbers[state]][x] = (*OUTPUT_WEIGHTS.get(out, (0.0, 0.0)), numbers[after])
    return numbers[whole.start], table


class Grammar:
    """The insult transducer of a lexicon, words to symbols, in front of the composed machine."""

    def __init__(self, lexicon: tuple[tuple[str, float], ...]):
        self.words = {w: x for w, x in lexicon if not w.endswith("*")}
        self.stems = {w[:-1]: x for w, x in lexicon if w.endswith("*")}
        self.lengths = sorted({len(s) for s in self.stems})
        self.own = {**dict.fromkeys(TARGETS, "Y"), **dict.fromkeys(THREATS, "T"), **dict.fromkeys(NEGATIONS, "N"), **dict.fromkeys(REPORTS, "R")}
        self.start, self.table = machine()
        self.seeds = ahocorasick.Automaton()
        for w in {*self.words, *THREATS, *self.stems}:
            self.seeds.add_word(w, (len(w), w not in self.stems))
        self.seeds.make_automaton()

    def seeded(self, low: str) -> bool:
        """Whether a word of the text is, or begins with, something that weighs."""
        for last, (n, whole) in self.seeds.iter(low):
            if (last < n or not low[last - n].isalpha()) and not (whole and last + 1 < len(low) and low[last + 1].isalpha()):
                return True
        return False

    def insult(self, word: str) -> float:
        weight = self.words.get(word, 0.0)
        for k in self.lengths:
            if len(word) >= k:
                weight = max(weight, self.stems.get(word[:k], 0.0))
        return weight

    def clause(self, words: list[str]) -> float:
        """Weight of one clause: one run of the machine."""
        weight, state = 0.0, self.start
        for w in words:
            x = self.insult(w)
            factor_, constant, state = self.table[state]["I" if x else self.own.get(w, "W")]
            weight += factor_ * x + constant
        return weight

    def judge(self, text: str | None) -> tuple[float, int]:
        """(score, matched clauses)."""
        low = (text or "").lower()
        total, matched = BIAS, 0
        if self.seeded(low):
            for clause in _CLAUSE.split(low):
                x = self.clause(_WORD.findall(clause))
                if x > 0:
                    matched += 1
                    total += x
        return 1 / (1 + math.exp(-min(total, 30.0))), matched


@functools.lru_cache(maxsize=2)
def grammar(lexicon: tuple[tuple[str, float], ...]) -> Grammar:
    return Grammar(lexicon)


def score(docs: DataFrame, lexicon: dict[str, float], held_out: Column, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted, n_clauses of every row of ``docs`` (doc_id, text)."""
    frozen = tuple(sorted(lexicon.items()))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))

    def run(batches):
        g = grammar(frozen)
        for b in batches:
            judged = [g.judge(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array([s for s, _ in judged], pa.float64()), pa.array([int(s >= threshold) for s, _ in judged], pa.int32()), pa.array([c for _, c in judged], pa.int64())],
                names=["doc_id", "held_out", "score", "predicted", "n_clauses"],
            )

    return arrow_map(rows, run, SCHEMA)
