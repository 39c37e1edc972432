"""Text functions of filters, templates, payloads and diagrams."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a message template puts in place of variable parts, in this order.
TEMPLATE_STEPS = [
    (r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", "{guid}"),
    (r"""[A-Za-z]:\\[^\s"']+""", "{path}"),
    (r"\"[^\"]*\"|'[^']*'", "{str}"),
    (r"\b0x[0-9a-fA-F]+\b|\b[0-9a-fA-F]{16,}\b", "{hex}"),
    (r"\b\d+\b", "{n}"),
    (r"\s+", " "),
]
#: What a text must hold, any of it, for a step to change it; None for steps that look themselves.
TEMPLATE_SIGNS = [["-"], [":\\"], ['"', "'"], None, None, None]
TEMPLATE_LENGTH, EXAMPLE_LENGTH = 200, 300


def contains_ci(column: Column, term: str) -> Column:
    """Case-insensitive literal substring. Signs and digits have no case: a text without the term's longest run of them is not lowered."""
    found = F.lower(column).contains(term.lower())
    run = max(re.findall(r"[!-@\[-`{-~]+", term), key=len, default="")
    return column.contains(run) & found if run else found


def equals_ci(column: Column, value: str) -> Column:
    return F.lower(column) == value.lower()


def isin_ci(column: Column, values: list[str]) -> Column:
    return F.lower(column).isin([v.lower() for v in values])


def cut_text(column: Column, length: int) -> Column:
    """At most ``length`` characters, a longer text ends in an ellipsis."""
    return F.when(F.char_length(column) > length, F.concat(F.substring(column, 1, length), F.lit("…"))).otherwise(column)


def template(message: Column) -> Column:
    """Message with its variable parts replaced, so that like messages are equal."""
    out = message
    for (pattern, mark), signs in zip(TEMPLATE_STEPS, TEMPLATE_SIGNS):
        done = F.regexp_replace(out, pattern, mark)
        if signs:
            held = out.contains(signs[0])
            for sign in signs[1:]:
                held = held | out.contains(sign)
            done = F.when(held, done).otherwise(out)
        out = done
    return cut_text(F.trim(out), TEMPLATE_LENGTH)


def first_non_empty(*columns: Column) -> Column:
    """The first column whose trimmed text is not empty; ''."""
    return F.coalesce(*[F.nullif(F.trim(c.cast("string")), F.lit("")) for c in columns], F.lit(""))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def base_name(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def display_name(column: Column) -> Column:
    """Name part of ``Name <mail>``."""
    return F.trim(F.substring_index(column, "<", 1))


def glob_to_regex(glob: str) -> str:
    """``*`` and ``?`` as a regular expression over whole paths; either slash fits either slash."""
    parts = {"*": ".*", "?": ".", "/": r"[/\\]", "\\": r"[/\\]"}
    return "(?is)^" + "".join(parts.get(c, re.escape(c)) for c in glob) + "$"


def xml_name(name: str) -> str:
    """A valid element name: other signs become ``_``, a leading digit gets one in front."""
    out = re.sub(r"[^A-Za-z0-9_]", "_", name) or "_"
    return f"_{out}" if out[0].isdigit() else out


def csv_escape(column: Column, delimiter: str = ",") -> Column:
    """Quoted where it holds the delimiter, a quote or a line break."""
    need = column.contains(delimiter) | column.contains('"') | column.contains("\n") | column.contains("\r")
    return F.when(need, F.concat(F.lit('"'), F.replace(column, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(column)


def html_escape(column: Column) -> Column:
    out = column
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def mermaid_escape(column: Column) -> Column:
    """Text that cannot break a diagram line."""
    out = F.regexp_replace(column, r"[\r\n]+", " ")
    for a, b in (("#", "#35;"), (";", "#59;"), ("<", "#lt;"), (">", "#gt;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(out)


def actor_text(column: Column, length: int = 40) -> Column:
    """Actor of a diagram: white space collapsed, cut; ``(unknown)`` if empty."""
    out = F.substring(F.trim(F.regexp_replace(F.coalesce(column, F.lit("")), r"\s+", " ")), 1, length)
    return F.when(out == "", "(unknown)").otherwise(out)


def label_text(column: Column, length: int = 80) -> Column:
    return cut_text(F.trim(F.regexp_replace(F.coalesce(column, F.lit("")), r"\s+", " ")), length)


def json_to_map(text: Column) -> Column:
    """JSON object as name-value pairs; nested values stay JSON text; NULL for anything else."""
    return F.from_json(text, "map<string,string>")
