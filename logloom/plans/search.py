"""The search language: field-scoped predicates as one Spark column.

``field OP value`` with ``== = != ~ !~ > < >= <=``, joined by AND, OR, NOT and
parentheses; neighbours are ANDed; quotes hold values with spaces. A term
without an operator is a global substring search. The text is turned into a
SQL condition word by word, and Spark's own parser does the rest: precedence,
parentheses, and the checks of both.
"""

from __future__ import annotations

import re

from pyspark.errors import ParseException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.parse import driver_time
from logloom.model import FIELD_ALIASES, LEVELS, level_to_int

#: Columns of a global search, besides the time's text.
SEARCHED = ["provider", "task_name", "message", "source", "searchable"]
TIME_TEXT = "yyyy-MM-dd HH:mm:ss"

_TOKEN = re.compile(r"""\s*(?:(?P<paren>[()])|(?P<quoted>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|(?P<op>==|!=|!~|>=|<=|=|~|>|<)|(?P<word>[^\s()=!~<>"']+[^\s()=!~<>]*|!))""", re.DOTALL)
_KEYWORDS = {"and", "or", "not"}


def _quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    end = len(text.rstrip())
    while at < end:
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError("unterminated string" if text[at:].lstrip()[:1] in "\"'" else f"unexpected character '{text[at:].lstrip()[:1]}'")
        kind = m.lastgroup
        value = m[kind]
        if kind == "quoted":
            value = re.sub(r"\\(.)", r"\1", value[1:-1], flags=re.DOTALL)
        if kind == "word" and value == "!":
            raise ValueError("unexpected character '!'")
        out.append((kind, value))
        at = m.end()
    return out


def any_contains_sql(term: str) -> str:
    low = _quote(term.lower())
    columns = [*SEARCHED, f"date_format(log_time, '{TIME_TEXT}')"]
    return "(" + " OR ".join(f"coalesce(contains(lower({c}), {low}), false)" for c in columns) + ")"


def _ordered(column: str, op: str, value: str) -> str:
    """Numbers compare as numbers, all else as lower-case text."""
    text = f"lower({column}) {op} {_quote(value.lower())}"
    try:
        number = float(value)
    except ValueError:
        return text
    as_number = f"try_cast({column} AS double)"
    return f"CASE WHEN {as_number} IS NOT NULL THEN {as_number} {op} {number!r}D ELSE {text} END"


def predicate_sql(field: str, op: str, value: str, negated: bool = False) -> str:
    """SQL condition of one ``field OP value``; under a NOT it is never NULL.

    Elsewhere a NULL is as good as false, and the bare comparison can reach the scan.
    """
    sure = (lambda e: f"coalesce({e}, false)") if negated else (lambda e: e)
    column = FIELD_ALIASES.get(field.lower())
    if column is None:
        raise ValueError(f"unknown field '{field}'")
    time, level = column == "log_time", column == "level"
    when = driver_time(value) if time else None
    name = f"date_format(log_time, '{TIME_TEXT}')" if time else f"element_at(array({', '.join(map(_quote, LEVELS))}), level + 1)" if level else column
    known = level_to_int(value) if level else -1
    if op in ("==", "=", "!="):
        if level:
            equal = f"level = {known}"
        elif when is not None:
            equal = f"log_time = timestamp_ntz'{when.isoformat(sep=' ')}'"
        else:
            equal = f"lower({name}) = {_quote(value.lower())}"
        return f"NOT coalesce({equal}, false)" if op == "!=" else sure(equal)
    if op in ("~", "!~"):
        hit = f"contains(lower({name}), {_quote(value.lower())})"
        return f"NOT coalesce({hit}, false)" if op == "!~" else sure(hit)
    if when is not None:
        return sure(f"log_time {op} timestamp_ntz'{when.isoformat(sep=' ')}'")
    if level:
        return f"level {op} {known}" if known >= 0 else _ordered("CAST(level AS string)", op, value)
    return sure(_ordered(name, op, value))


def where_sql(text: str) -> str:
    """The whole search as a SQL condition."""
    tokens = _tokens(text or "")
    if not tokens:
        raise ValueError("empty query")
    out: list[str] = []
    negated = any(kind == "word" and value.lower() == "not" for kind, value in tokens)
    depth, i = 0, 0
    operand_before = False
    while i < len(tokens):
        kind, value = tokens[i]
        word = kind == "word" and value.lower() in _KEYWORDS
        starts = value == "(" and kind == "paren" or kind == "quoted" or kind == "word" and (not word or value.lower() == "not")
        if starts and operand_before:
            if kind == "word" and value.lower() == "not":
                raise ValueError(f"unexpected '{value}'")
            out.append("AND")
        if kind == "paren":
            depth += 1 if value == "(" else -1
            if depth < 0 or value == ")" and not operand_before:
                raise ValueError(f"unexpected '{value}'")
            out.append(value)
            operand_before = value == ")"
        elif word:
            if value.lower() != "not" and not operand_before:
                raise ValueError(f"unexpected '{value}'")
            out.append(value.upper())
            operand_before = False
        elif kind == "op":
            raise ValueError(f"unexpected '{value}'")
        elif kind == "word" and i + 1 < len(tokens) and tokens[i + 1][0] == "op":
            if value.lower() not in FIELD_ALIASES:
                raise ValueError(f"unknown field '{value}'")
            if i + 2 >= len(tokens) or tokens[i + 2][0] not in ("word", "quoted"):
                raise ValueError(f"expected a value after '{value}'")
            out.append(f"({predicate_sql(value, tokens[i + 1][1], tokens[i + 2][1], negated)})")
            operand_before = True
            i += 2
        else:
            out.append(any_contains_sql(value))
            operand_before = True
        i += 1
    if depth:
        raise ValueError("missing ')'")
    if not operand_before:
        raise ValueError("unexpected end of query")
    return " ".join(out)


def where_query(text: str) -> Column:
    """Condition of a search text; ValueError says what is wrong with it."""
    sql = where_sql(text)
    try:
        return F.expr(sql)
    except ParseException as e:
        raise ValueError(str(e)) from e


def looks_structured(text: str) -> bool:
    """Whether a text has an operator or a boolean word, so that it is not one plain term."""
    try:
        tokens = _tokens(text or "")
    except ValueError:
        return False
    return any(kind == "op" or kind == "word" and value.lower() in _KEYWORDS for kind, value in tokens)


def any_contains(term: str, level_and_index: bool = False) -> Column:
    """Global search of a term; with ``level_and_index`` also the level's name and, for digits, the row id."""
    out = F.expr(any_contains_sql(term))
    if level_and_index:
        out = out | F.expr(predicate_sql("level", "~", term))
        if term.isdigit():
            out = out | F.col("row_id").cast("string").contains(term)
    return out


def search(df: DataFrame, text: str, plain: bool = False) -> DataFrame:
    """Rows that a search box's text finds: structured if it looks so, else a plain term; all rows for no text. A ``plain`` text is one term, whatever operators are in it."""
    if not (text or "").strip():
        return df
    return df.where(where_query(text) if not plain and looks_structured(text) else any_contains(text))
