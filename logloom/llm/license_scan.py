"""Licence scan: Aho-Corasick for tags and notice phrases, shunting-yard for expressions.

Two automata run over each text. One finds notice phrases as consecutive words of
the lower-cased text (base phrases and phrases of this operator's own), the
other finds identifier tags such as ``SPDX-License-Identifier:``. The
expression after a tag is parsed with the shunting-yard algorithm (``with``
binds tightest, then ``and``, then ``or``) and evaluated twice: which
licences it names, and whether one may choose a permissive way through it.

Words are runs of ``[0-9a-z]`` and of characters beyond ASCII after A-Z are
lower-cased; all other ASCII characters separate.

An expression ends where prose, another line or another sign begins: its
operands are known licences or look like identifiers.

Defined results: a null text counts as empty: no words, empty labels, score
0; malformed expressions give the labels of their known identifiers and
are not permissive; repeated rows give repeated results.

The score says how sure a licence stands on the document: 1 minus the product of
(1 - weight) over distinct kinds of evidence.
"""

from __future__ import annotations

import bisect
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import arrow_map

# Base phrases and labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Further notice phrases, as words, and labels.
OWN_PHRASES = {
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by 4 0": "cc-by",
    "cc by 3 0": "cc-by",
    "cc0 1 0": "cc0",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "bsd license": "bsd",
    "bsd 2 clause": "bsd",
    "bsd 3 clause": "bsd",
    "isc license": "isc",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "boost software license": "bsl",
    "zlib license": "zlib",
    "the unlicense": "unlicense",
    "all rights reserved": "proprietary",
    "public domain": "public-domain",
}
# SPDX identifier prefixes, labels, and whether the licence is permissive.
SPDX = {
    "mit": ("mit", True),
    "apache": ("apache", True),
    "bsd": ("bsd", True),
    "isc": ("isc", True),
    "zlib": ("zlib", True),
    "bsl": ("bsl", True),
    "unlicense": ("unlicense", True),
    "cc0": ("cc0", True),
    "cc-by-nc": ("cc-by-nc", False),
    "cc-by-sa": ("cc-by-sa", False),
    "cc-by-nd": ("cc-by-nd", False),
    "cc-by": ("cc-by", True),
    "mpl": ("mpl", False),
    "epl": ("epl", False),
    "lgpl": ("lgpl", False),
    "agpl": ("agpl", False),
    "gpl": ("gpl", False),
}
TAGS = ["spdx-license-identifier:", "license-expression:", "@license"]
WEIGHTS = {"base": 0.9, "own": 0.8, "tag": 0.95}

_ASCII_LOWER = {i: i + 32 for i in range(65, 91)}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+-]*")
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}


def _automaton(phrases) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for x in phrases:
        a.add_word(x, x)
    a.make_automaton()
    return a


#: Phrases stand between single spaces, so a hit is a run of whole words.
_PHRASES = _automaton([f" {p} " for p in (*BASE_PHRASES, *OWN_PHRASES)])
_TAGS = _automaton(TAGS)
#: Each phrase and tag holds one of these; texts without them need only the count of words.
_HINTS = re.compile(r"licen[sc]e|cc|creative|bsd|reserved|domain|@lic", re.IGNORECASE)


def to_rpn(expression: str) -> list[str] | None:
    """Shunting-yard: the expression in reverse Polish order, None if it is malformed."""
    out: list[str] = []
    stack: list[str] = []
    operand_next = True
    for token in _TOKEN.findall(expression):
        low = token.lower()
        if low in _PRECEDENCE:
            if operand_next:
                return None
            while stack and stack[-1] != "(" and _PRECEDENCE[stack[-1]] >= _PRECEDENCE[low]:
                out.append(stack.pop())
            stack.append(low)
            operand_next = True
        elif token == "(":
            if not operand_next:
                return None
            stack.append(token)
        elif token == ")":
            if operand_next:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        else:
            if not operand_next:
                return None
            out.append(token)
            operand_next = False
    if operand_next or "(" in stack:
        return None
    return out + stack[::-1]


def spdx(identifier: str) -> tuple[str, bool] | None:
    low = identifier.lower().rstrip("+")
    best = max((k for k in SPDX if low == k or low.startswith(k + "-")), key=len, default=None)
    return SPDX[best] if best else None


def evaluate(expression: str) -> tuple[set[str], bool]:
    """(labels named, whether a permissive choice exists)."""
    rpn = to_rpn(expression)
    if rpn is None:
        return {x[0] for t in _TOKEN.findall(expression) if (x := spdx(t))}, False
    stack: list[tuple[set[str], bool]] = []
    for token in rpn:
        if token in _PRECEDENCE:
            (right, r), (left, l) = stack.pop(), stack.pop()
            if token == "with":  # the right side names an exception, not a licence
                stack.append((left, l))
            else:
                stack.append((left | right, (l or r) if token == "or" else (l and r)))
        else:
            known = spdx(token)
            stack.append(({known[0]}, known[1]) if known else (set(), False))
    return stack[0]


_LEAD = re.compile(r"""[ \t"':=]*""")
_STEP = re.compile(r"[ \t]*([()]|[A-Za-z0-9][A-Za-z0-9.+-]*)")
#: An operand that is no known licence must look like an identifier: a digit or an inner sign.
_IDENTIFIER = re.compile(r".*[0-9].*|[^.+-]+[.+-].+", re.DOTALL)


def expression_at(text: str, at: int) -> str:
    """The expression at a place: identifiers joined by operators, up to where prose, another sign or the line's end begins.

    Reading stops at the first token that does not continue the expression,
    so the tags of a line are read once each, however many there are.
    """
    out: list[str] = []
    operand_next = True
    at = _LEAD.match(text, at).end()
    while m := _STEP.match(text, at):
        token = m[1].rstrip(".-") if m[1] not in "()" else m[1]
        low = token.lower()
        if low in _PRECEDENCE:
            if operand_next:
                break
            operand_next = True
        elif token == "(":
            if not operand_next:
                break
        elif token == ")":
            if operand_next:
                break
        else:
            if not operand_next or not (spdx(token) or _IDENTIFIER.fullmatch(token)):
                break
            operand_next = False
        out.append(token)
        if len(token) < len(m[1]) or text[m.end() : m.end() + 1] in (":", "="):
            at = m.end()
            break
        at = m.end()
    while out and (out[-1].lower() in _PRECEDENCE or out[-1] == "("):
        out.pop()
    return " ".join(out)


def judge(text: str | None) -> tuple[int, int, int | None, int | None, str, str, float, bool | None]:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, permissive."""
    low = (text or "").translate(_ASCII_LOWER) if text and not text.islower() else text or ""
    words = WORD.findall(low)
    n_base, first, last = 0, None, None
    base: set[str] = set()
    labels: set[str] = set()
    evidence: set[str] = set()
    permissive = None
    if _HINTS.search(low):
        joined, gaps = f" {' '.join(words)} ", None
        for end, phrase in _PHRASES.iter(joined):
            name = phrase.strip()
            if name in BASE_PHRASES:
                gaps = gaps or [m.start() for m in re.finditer(" ", joined)]
                at = bisect.bisect_left(gaps, end + 1 - len(phrase))
                n_base += 1
                first = at if first is None else min(first, at)
                last = at if last is None else max(last, at)
                base.add(BASE_PHRASES[name])
                evidence.add("base")
            else:
                labels.add(OWN_PHRASES[name])
                evidence.add("own")
        for end, _ in _TAGS.iter(low):
            expression = expression_at(text, end + 1)
            if expression:
                named, free = evaluate(expression)
                labels |= named
                permissive = free if permissive is None else permissive and free
                if named:
                    evidence.add("tag")
    score = 1.0
    for e in sorted(evidence):
        score *= 1 - WEIGHTS[e]
    return len(words), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(base | labels)), 1 - score, permissive


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, permissive boolean"


def licenses(docs: DataFrame) -> DataFrame:
    """The licence columns of every row of ``docs`` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.bool_()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches):
        for b in batches:
            columns = list(zip(*[judge(t) for t in b.column("text").to_pylist()])) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(list(c), k) for c, k in zip(columns, kinds))], names=names)

    return arrow_map(rows, run, SCHEMA)
