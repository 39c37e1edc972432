import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import regex
from pyspark.sql import functions as F

from logloom.llm import toxicity
from logloom.llm.queries import op8_toxicity


def test_held_out(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    rows = op8_toxicity(spark, sf).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    hits = held.count((1, 1))
    assert hits >= 0.6 * sum(t for _, t in held) and hits >= 0.7 * sum(p for p, _ in held)


def corpus(spark):
    rng = random.Random(4)
    plain = ["".join(rng.choice("aeiou") + rng.choice("bcdfg") for _ in range(3)) for _ in range(300)]
    rows = []
    for i in range(300):
        words = [rng.choice(plain) for _ in range(30)]
        toxic = int(i % 5 == 0)
        if toxic:
            words[5], words[20] = "zork" + rng.choice(plain), "blurp"
        rows.append((i, " ".join(words), toxic))
    copy = "unusual wording that many copies of one toxic text repeat zorkling"
    rows += [(1000 + i, copy, 1) for i in range(40)]
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_lexicon_has_stems_and_no_copies(spark):
    lexicon = toxicity.fit_lexicon(corpus(spark))
    assert "zork*" in lexicon and any(w.startswith("blur") for w in lexicon)
    assert not any(w.startswith(("unus", "wordi", "repe")) for w in lexicon)
    assert toxicity.fit_lexicon(corpus(spark).limit(0)) == {} and toxicity.fit_lexicon(corpus(spark).where("toxic = 0")) == {}


def test_grammar():
    g = toxicity.grammar((("idiot", 3.0), ("zork*", 2.0)))
    s = lambda t: g.judge(t)[0]
    assert s("You idiot!") > s("an idiot") > s("he said an idiot came") > s("never an idiot")
    assert s("zorkling") == s("zork") > s("xzork") == s("") == s(None) == s("nothing")
    assert s("I will kill you") > s("I will kill time") == s("")
    assert s("idiots") == s("")  # a whole word, not a stem
    assert g.judge("idiot. idiot; fine")[1] == 2


def clause_weight(symbols, x):
    """What a clause weighs, from its words' roles and places, without machines; an insult at place i weighs ``x[i]``."""
    T = toxicity
    within = lambda mark, i, reach: any(symbols[j] == mark for j in range(max(0, i - reach), i))
    factor = lambda i: (T.NEGATED if within("N", i, T.REACH) else 1) * (T.REPORTED if within("R", i, T.REPORT_REACH) else 1)
    targets = [i for i, s in enumerate(symbols) if s == "Y"]
    insults = [i for i, s in enumerate(symbols) if s == "I"]
    weight = 0.0
    for i in insults:
        weight += factor(i) * x[i]
        behind = any(t < i for t in targets)
        followed = any(t > i and not any(i < j < t for j in insults) for t in targets)
        weight += T.WITH_TARGET * factor(i) * (behind or followed)
    threats = [i for i, s in enumerate(symbols) if s == "T" and not within("N", i, T.REACH)]
    if threats and targets:
        before = [i for i in threats if i < targets[0]]
        # Threats before the first target are one threat, reported if all of them are.
        own = before or threats[:1]
        weight += T.THREAT * (T.REPORTED if all(within("R", i, T.REPORT_REACH) for i in own) else 1)
    return weight


def run(symbols, x):
    """The composed machine, and the transducers one after another."""
    start, table = toxicity.machine()
    weight, state = 0.0, start
    for s in symbols:
        f, c, state = table[state][s]
        weight += f * x + c
    chain, out = (toxicity.NEGATION, toxicity.REPORT, toxicity.THREAT_OF, toxicity.TARGET), list(symbols)
    for t in chain:
        at, passed = t.start, []
        for s in out:
            o, at = t.step(at, s)
            passed.append(o)
        out = passed
    singly = sum(f * x + c for f, c in (toxicity.OUTPUT_WEIGHTS.get(o, (0.0, 0.0)) for o in out))
    return weight, singly


def test_composition():
    """All clauses of up to five words, and long random ones: the machine, its parts in turn, and the plain reading agree."""
    rng = random.Random(8)
    clauses = [c for n in range(6) for c in itertools.product(toxicity.SYMBOLS, repeat=n)]
    clauses += [tuple(rng.choice("ITYNRWWWWW") for _ in range(40)) for _ in range(500)]
    for c in clauses:
        weight, singly = run(c, 2.0)
        assert abs(weight - singly) < 1e-9 and abs(weight - clause_weight(c, [2.0] * len(c))) < 1e-9, c


def brute_lexicon(rows):
    """The lexicon of (text, toxic) rows, counted in plain Python."""
    seen = defaultdict(set)
    for text, toxic in rows:
        words = regex.findall(r"\p{L}+", (text or "").lower())
        for before, word in zip([None, *words], words):
            seen[word, before].add(toxic)
    per_word = defaultdict(Counter)
    for (word, _), sides in seen.items():
        per_word[word].update(sides)
    pos, neg = sum(c[1] for c in per_word.values()), sum(c[0] for c in per_word.values())
    base, entries = (pos + 1) / (pos + neg + 2), defaultdict(Counter)
    for word, c in per_word.items():
        for entry in [word, *(word[:k] + "*" for k in toxicity.STEM if len(word) > k)]:
            entries[entry].update(c)
    found = {}
    for entry, c in entries.items():
        share = (c[1] + 0.1) / (c[1] + c[0] + 0.2)
        surprise = c[1] * math.log(share / base) + c[0] * math.log((1 - share) / (1 - base))
        if c[1] >= toxicity.MIN_PLACES and share >= toxicity.MIN_SHARE and surprise >= math.log(5 * len(per_word)) + toxicity.MARGIN:
            found[entry] = min(toxicity.MAX_WEIGHT, toxicity.ODDS_WEIGHT * math.log(share / (1 - share)))
    # A stem that begins another entry stands for it.
    stems = [e[:-1] for e in found if e.endswith("*")]
    return {e: x for e, x in found.items() if not any(e.rstrip("*").startswith(s) and e != s + "*" for s in stems)}


def test_query_is_brute_force(spark, sf_dir):
    """Every score of the query, from a lexicon counted in plain Python and a plain reading of all clauses."""
    sf = sf_dir.replace("sf0.001", "sf0.01")
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    labels = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    lexicon = brute_lexicon([(docs[i], toxic) for i, toxic in labels if i in docs and zlib.crc32(str(i).encode()) % 4 != 2])
    assert lexicon

    def insult(word):
        return max((x for e, x in lexicon.items() if (word.startswith(e[:-1]) if e.endswith("*") else word == e)), default=0.0)

    own = dict.fromkeys(toxicity.TARGETS, "Y") | dict.fromkeys(toxicity.THREATS, "T") | dict.fromkeys(toxicity.NEGATIONS, "N") | dict.fromkeys(toxicity.REPORTS, "R")
    known = {}
    for r in op8_toxicity(spark, sf).collect():
        total = toxicity.BIAS
        for clause in regex.split(r"[.!?;:\n]+", (docs[r.doc_id] or "").lower()):
            words = regex.findall(r"[^\W\d_]+", clause)
            x = [known[w] if w in known else known.setdefault(w, insult(w)) for w in words]
            total += clause_weight(["I" if v else own.get(w, "W") for w, v in zip(words, x)], x)
        assert abs(r.score - 1 / (1 + math.exp(-min(total, 30)))) < 1e-3, (r, total)


def test_odd(odd, empty):
    rows = toxicity.score(odd, {"lazy": 3.0}, F.lit(False)).collect()
    assert len(rows) == odd.count() and sorted(r.doc_id for r in rows if r.predicted) == [1, 1, 2]
    assert toxicity.score(empty, {}, F.lit(False)).count() == 0
    assert all(r.predicted == 0 for r in toxicity.score(odd, {}, F.lit(True)).collect())
