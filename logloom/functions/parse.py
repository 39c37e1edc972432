"""Levels and times out of text."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom.model import CATASTROPHIC, ERROR, INFO, VERBOSE, WARNING

# Level texts of structured logs: words, letters, syslog numbers.
LEVEL_TEXT = {
    "fatal": CATASTROPHIC, "critical": CATASTROPHIC, "crit": CATASTROPHIC, "f": CATASTROPHIC, "1": CATASTROPHIC, "2": CATASTROPHIC,
    "error": ERROR, "err": ERROR, "e": ERROR, "3": ERROR,
    "warning": WARNING, "warn": WARNING, "w": WARNING, "4": WARNING,
    "verbose": VERBOSE, "debug": VERBOSE, "trace": VERBOSE, "v": VERBOSE, "d": VERBOSE, "7": VERBOSE,
    "information": INFO, "info": INFO, "i": INFO, "6": INFO,
}
#: What a date may look like once its parts are put in order.
_STAMP = r"^\d{4}-\d{1,2}-\d{1,2}([T ]+\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?)?"
_ZONE, _HALF = r"\s*(Z|[+-]\d{2}:?\d{2})$", r"\s*([AaPp][Mm])$"


def line_level(line: Column) -> Column:
    """Level of a text line by keyword, the first kind that occurs; Info without any."""
    low = F.lower(line)
    return (
        F.when(low.contains("critical") | low.contains("fatal"), CATASTROPHIC)
        .when(low.contains("error"), ERROR)
        .when(low.contains("warn"), WARNING)
        .when(low.contains("debug") | low.contains("verbose"), VERBOSE)
        .otherwise(INFO)
    )


def parse_level(text: Column) -> Column:
    """Level of a level field: word, letter or syslog number; Info for others and for nothing."""
    table = F.create_map(*[F.lit(x) for pair in LEVEL_TEXT.items() for x in pair])
    return F.coalesce(table[F.lower(F.trim(F.coalesce(text, F.lit(""))))], F.lit(INFO))


def trace_level(number: Column) -> Column:
    """Level of a numeric trace level: 1 critical to 5 verbose, Info for others."""
    n = number.try_cast("int")
    return F.when(n == 1, CATASTROPHIC).when(n == 2, ERROR).when(n == 3, WARNING).when(n == 4, INFO).when(n == 5, VERBOSE).otherwise(INFO)


def flexible_time(text: Column) -> Column:
    """Timestamp of a date text; NULL if it is none.

    Accepted are year-month-day with ``-`` or ``/``, month/day/year, each with or without a time, whose
    seconds and fraction may be missing; ``T`` or spaces between; an offset, which is turned to UTC, or AM/PM.
    """
    plain = F.trim(text)
    t = F.regexp_replace(plain, r"^(\d{1,2})/(\d{1,2})/(\d{4})", "$3-$1-$2")
    t = F.regexp_replace(F.regexp_replace(t, r"^(\d{4})/(\d{1,2})/", "$1-$2-"), r"(?<=:\d{2}),(?=\d)", ".")
    instant = F.to_utc_timestamp(F.regexp_replace(t, r"\s+(?=Z$|[+-])", "").try_cast("timestamp"), F.current_timezone()).cast("timestamp_ntz")
    half = F.try_to_timestamp(F.upper(F.regexp_replace(t, r"\s+(?=[AaPp][Mm]$)", " ")), F.lit("yyyy-M-d h:mm:ss a")).cast("timestamp_ntz")
    others = F.when(t.rlike(_STAMP + "$"), t.try_cast("timestamp_ntz")).when(t.rlike(_STAMP + _ZONE), instant).when(t.rlike(_STAMP + _HALF), half)
    # Most texts are empty or in order as they are: those skip all else.
    return F.when(plain.rlike(_STAMP + "$"), plain.try_cast("timestamp_ntz")).when(plain != "", others)


def parse_time(text: Column) -> Column:
    """Time of a time field: integer text is an epoch, of milliseconds from 12 characters on; else a date."""
    t = F.trim(text)
    n = t.try_cast("long")
    epoch = F.when(F.length(t) >= 12, F.timestamp_millis(n)).otherwise(F.timestamp_seconds(n))
    utc = F.to_utc_timestamp(epoch, F.current_timezone()).cast("timestamp_ntz")
    return F.when(t.rlike(r"^[+-]?\d{1,15}$"), utc).otherwise(flexible_time(t))


def line_time(line: Column) -> Column:
    """Time at the head of a text line: in brackets within 40 characters, else an ISO token, else two tokens, else a date."""
    bracket = F.regexp_extract(F.substring(line, 1, 40), r"\[([^\]]+)\]", 1)
    head = F.regexp_extract(line, r"^\s*(\d\S*T\S+|\d\S*\s+\d\d?:\S+?(?=,?(?:\s|$))|\d{4}-\d{2}-\d{2}(?=,?(?:\s|$)))", 1)
    in_brackets = F.when(F.contains(F.substring(line, 1, 40), F.lit("[")), flexible_time(bracket))
    # Most lines begin with no digit, and then have no head to read.
    return F.coalesce(in_brackets, F.when(line.rlike(r"^\s*\d"), flexible_time(head)))


def parse_span(text: str) -> dt.timedelta:
    """``1h``, ``7d``, ``30m``, ``45s`` or ``2w`` as a span; zero for anything else."""
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([smhdw])\s*", text or "", re.IGNORECASE)
    unit = {"s": "seconds", "m": "minutes", "h": "hours", "d": "days", "w": "weeks"}
    return dt.timedelta(**{unit[m[2].lower()]: float(m[1])}) if m else dt.timedelta(0)


def driver_time(text: str | None) -> dt.datetime | None:
    """A time written in a search or a rule, without zone (offsets are turned to UTC)."""
    t = (text or "").strip().replace(",", ".")
    if not t:
        return None
    try:
        out = dt.datetime.fromisoformat(t)
    except ValueError:
        for f in ("%Y/%m/%d %H:%M:%S", "%Y/%m/%d", "%m/%d/%Y %H:%M:%S", "%m/%d/%Y %I:%M:%S %p", "%m/%d/%Y"):
            try:
                out = dt.datetime.strptime(t, f)
                break
            except ValueError:
                continue
        else:
            return None
    return out.astimezone(dt.UTC).replace(tzinfo=None) if out.tzinfo else out


def rule_date(text: str | None, now: dt.datetime) -> dt.datetime | None:
    """An absolute date, or one relative to now such as ``-30d``."""
    t = (text or "").strip()
    if t.startswith("-") and (span := parse_span(t[1:])):
        return now - span
    return driver_time(t)


def time_literal(t: dt.datetime) -> Column:
    return F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz")
