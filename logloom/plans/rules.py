"""Rule files: loading, checking, and the parts of a rule as columns.

A rule file is JSON: sections with a purpose (filter, enrichment, output,
uml, scope), each with rules; a rule has a gate (match, unmatch, dateRange on
a field) and one or more actions.
"""

from __future__ import annotations

import datetime as dt
import json
import re
from functools import reduce
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from logloom.functions.parse import parse_span, rule_date, time_literal
from logloom.functions.text import contains_ci, isin_ci
from logloom.model import FIELD_ALIASES, STRING_COLUMNS, level_name
from logloom.plans.ambiguity import ambiguous

PURPOSES = {"filter", "enrichment", "output", "uml", "scope"}


def load_rules(paths: list[str]) -> tuple[dict, list[str]]:
    """Sections and inputs of several rule files (or folders of them, in name order) put together, and what could not be read."""
    files: list[Path] = []
    for p in map(Path, paths):
        files += sorted([*p.glob("*.rules.json"), *(x for x in p.glob("*.json") if not x.name.endswith(".rules.json"))]) if p.is_dir() else [p]
    rules, problems = {"sections": [], "inputs": []}, []
    for f in files:
        try:
            got = json.loads(f.read_text(encoding="utf-8-sig"))
            if not isinstance(got, dict):
                raise ValueError("not an object")
        except (OSError, ValueError) as e:
            problems.append(f"{f}: {e}")
            continue
        rules["sections"] += [s | {"_file": str(f)} for s in got.get("sections", [])]
        rules["inputs"] += got.get("inputs", [])
    return rules, problems


def sections(rules: dict, purpose: str) -> list[dict]:
    return [s for s in rules.get("sections", []) if str(s.get("purpose", "")).lower() == purpose]


def validate_rules(text: str) -> list[str]:
    """Errors and warnings of a rule file's text."""
    try:
        got = json.loads(text)
    except ValueError as e:
        return [f"error: not JSON: {e}"]
    if not isinstance(got, dict) or not isinstance(got.get("sections"), list):
        return ["error: no sections"]
    out = []
    for i, s in enumerate(got["sections"]):
        name = s.get("name") or f"section {i}"
        if not s.get("purpose"):
            out.append(f"error: {name}: no purpose")
        elif str(s["purpose"]).lower() not in PURPOSES:
            out.append(f"warning: {name}: unusual purpose {s['purpose']}")
        if not s.get("rules"):
            out.append(f"error: {name}: no rules")
        for r in s.get("rules") or []:
            if not actions(r):
                out.append(f"warning: {name}: {r.get('name', '?')} has no action")
    return out


def actions(rule: dict, *kinds: str) -> list[dict]:
    """The rule's actions, of some kinds if given."""
    own = rule.get("actions") or ([rule["action"]] if rule.get("action") else [])
    return [a for a in own if not kinds or str(a.get("type", "")).lower() in kinds]


def enabled(section: dict) -> list[dict]:
    return [r for r in section.get("rules", []) if r.get("enabled", True)]


def java_groups(pattern: str) -> str:
    """Named groups, and references to them, with names that Java takes: letters and digits only."""
    named = re.sub(r"\(\?P?<([A-Za-z_]\w*)>", lambda m: f"(?<{java_group(m[1])}>", pattern)
    return re.sub(r"\\k<([A-Za-z_]\w*)>", lambda m: f"\\k<{java_group(m[1])}>", named)


def java_group(name: str) -> str:
    return "g" + "".join(c if c.isascii() and c.isalnum() else f"x{ord(c):x}x" for c in name)


_compiled: dict[str, bool] = {}


def compiles(pattern: str) -> bool:
    """Whether Spark's regular expressions take the pattern."""
    if pattern not in _compiled:
        spark = SparkSession.getActiveSession()
        try:
            spark.sql("SELECT rlike('', :p)", args={"p": pattern}).collect()
            _compiled[pattern] = True
        except PySparkException:
            _compiled[pattern] = False
        except Exception as e:  # a pattern error of Java itself
            if "PatternSyntax" not in str(e):
                raise
            _compiled[pattern] = False
    return _compiled[pattern]


#: What a pattern may have for ``required_sign`` to look at it: characters that stand for themselves, classes without nesting, groups, quantifiers.
_PLAIN_GROUP = re.compile(r"\((?:\?:|\?=|\?!|\?P?<[A-Za-z_]\w*>)?")
_PLAIN_CLASS = re.compile(r"\[\^?(?:\\[^pPQEkcxu0]|[^\[\]\\&])+\]")
_PLAIN_ESCAPE = re.compile(r"\\[wWsSdDbB.@:/()\[\]{}|+*?^$-]")


def required_sign(pattern: str) -> str | None:
    """A sign, neither letter nor digit, that every match of a pattern must hold; None if none is plain to see.

    Texts without it need no regular expression, which saves the steps that a
    pattern such as an e-mail address takes from each letter of each word. Only
    patterns made of plain parts are looked at: one with a back-reference, a
    quotation, a nested class or a flag has no required sign.
    """
    i, depth, found = 0, 0, None
    while i < len(pattern):
        c, literal = pattern[i], None
        if c == "\\":
            m = _PLAIN_ESCAPE.match(pattern, i)
            literal = m[0][1] if m and not m[0][1].isalnum() else None
        elif c == "[":
            m = _PLAIN_CLASS.match(pattern, i)
        elif c == "(":
            m = _PLAIN_GROUP.match(pattern, i)
            if m and pattern[m.end() : m.end() + 1] == "?":
                return None
            depth += 1
        else:
            m = re.compile(r"\{\d+(?:,\d*)?\}|.", re.DOTALL).match(pattern, i)
            if c == "|" and not depth:
                return None
            depth -= c == ")"
            literal = c if c not in ".^$?*+{}()|" else None
        if not m or depth < 0:
            return None
        after = pattern[m.end() : m.end() + 1]
        if literal and not depth and not literal.isalnum() and not literal.isspace() and literal not in "#_]" and after not in ("?", "*", "{") and found is None:
            found = literal
        i = m.end()
    return found if not depth else None


def guarded(column: Column, pattern: str, hit: Column, other: Column) -> Column:
    """``hit`` where the column holds the pattern's required sign, else ``other``."""
    sign = required_sign(pattern)
    return hit if sign is None else F.when(column.contains(sign), hit).otherwise(other)


#: A pattern's opening letters up to its first sign.
_OPENING = re.compile(r"([A-Za-z0-9]+)([=@:/-])(?![?*{+])")


def from_sign(pattern: str) -> str:
    """A pattern that opens with letters and a sign that every match holds, tried at the text's signs only: the same texts match.

    Letters of either case are compared at each place of a text; a sign is found by a plain loop. Signs that no
    match goes through are passed over, and one more sign is then a match's.
    """
    m = _OPENING.match(pattern)
    if not m or required_sign(pattern) != m[2]:
        return pattern
    return rf"\A[^{m[2]}]*+(?:{m[2]}(?!(?<={m[0]}){pattern[m.end() :]})[^{m[2]}]*+)*+{m[2]}"


def regex_or_contains(column: Column, pattern: str) -> Column:
    """Regular expression, ignoring case; a substring if the pattern does not compile, or could take time without bound (see ``ambiguity``)."""
    p = "(?iu)" + java_groups(from_sign(pattern))
    if ambiguous(pattern) or not compiles(p):
        return F.coalesce(contains_ci(column, pattern), F.lit(False))
    return F.coalesce(guarded(column, pattern, column.rlike(p), F.lit(False)), F.lit(False))


def field_column(name: str | None, default: str = "searchable") -> Column:
    """Column that a rule's field names; unknown names are the searchable text."""
    low = re.sub(r"[^a-z]", "", (name or "").lower())
    if not low:
        return F.col(default)
    aliases = FIELD_ALIASES | {c.replace("_", ""): c for c in STRING_COLUMNS} | {"resultsource": "source", "searchabledata": "searchable"}
    column = aliases.get(low, "searchable")
    if column == "level":
        return level_name(F.col("level"))
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss") if column == "log_time" else F.col(column)


def date_range(rule: dict, now: dt.datetime | None = None) -> Column | None:
    """Condition of a rule's dateRange: after and before (absolute or relative) and withinLast."""
    given = rule.get("dateRange") or {}
    now = now or dt.datetime.now(dt.UTC).replace(tzinfo=None)
    parts = []
    if after := rule_date(given.get("after"), now):
        parts.append(F.col("log_time") >= time_literal(after))
    if before := rule_date(given.get("before"), now):
        parts.append(F.col("log_time") <= time_literal(before))
    if span := parse_span(given.get("withinLast")):
        parts.append(F.col("log_time") >= time_literal(now - span))
    return F.coalesce(reduce(lambda a, b: a & b, parts), F.lit(False)) if parts else None


def rule_matches(rule: dict, default: str = "searchable", now: dt.datetime | None = None) -> Column:
    """Gate of a rule: its dates, its match, and not its unmatch. A rule without match gates by the rest."""
    column = field_column(rule.get("field"), default)
    parts = [x for x in (date_range(rule, now),) if x is not None]
    if rule.get("match"):
        parts.append(regex_or_contains(column, rule["match"]))
    if rule.get("unmatch"):
        parts.append(~regex_or_contains(column, rule["unmatch"]))
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def section_applies(section: dict) -> Column | None:
    """Condition of a section's providers; None if it is for all (``*`` or none named)."""
    names = [p for p in section.get("providers", []) if p]
    return None if not names or "*" in names else F.coalesce(isin_ci(F.col("provider"), names), F.lit(False))


def gated(section: dict, rule: dict, default: str = "searchable", now: dt.datetime | None = None) -> Column:
    """The rule's gate within its section's providers."""
    own, scope = rule_matches(rule, default, now), section_applies(section)
    return own if scope is None else scope & own


