"""Name-value records to events by an alias table of field names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.parse import parse_level, parse_time
from logloom.model import as_events

# Field names of structured logs and the event columns they fill.
FIELD_NAMES = {
    "log_time": ["time", "timestamp", "datetime", "date", "ts", "@t", "eventtime", "_time"],
    "level": ["level", "severity", "loglevel", "lvl", "@l"],
    "message": ["message", "msg", "text", "@m", "@mt", "messagetemplate", "description"],
    "provider": ["provider", "logger", "source", "category", "sourcecontext", "component"],
    "task_name": ["taskname", "task", "operation", "activity"],
    "process_id": ["processid", "pid", "process_id"],
    "thread_id": ["threadid", "tid", "thread", "thread_id"],
    "event_id": ["eventid", "event_id", "id"],
    "machine_name": ["machine", "machinename", "host", "hostname", "computer", "computername"],
    "username": ["user", "username", "userid"],
    "activity_id": ["activityid", "correlationid", "traceid"],
}
# Names of the columns in a user's mapping.
MAPPED = {
    "time": "log_time", "level": "level", "message": "message", "provider": "provider", "task": "task_name", "pid": "process_id", "tid": "thread_id",
    "eventid": "event_id", "machine": "machine_name", "user": "username", "activityid": "activity_id",
}
ALIASES = {name: column for column, names in FIELD_NAMES.items() for name in names}


def field_of(header: str, overrides: dict[str, str] | None = None) -> str | None:
    """Event column of a field name: an override beats the aliases; ``''`` and ``-`` keep it as data only."""
    if overrides is not None and header in overrides:
        chosen = overrides[header]
        return MAPPED.get(chosen, chosen) if chosen not in ("", "-") else None
    return ALIASES.get(header.lower())


def mapping_for(headers: list[str], saved: dict[frozenset[str], dict[str, str]]) -> dict[str, str] | None:
    """The user's mapping saved for a file's set of columns, ignoring case."""
    key = frozenset(h.lower() for h in headers)
    return next((m for k, m in saved.items() if frozenset(h.lower() for h in k) == key), None)


def _all(columns: list[Column]) -> Column:
    return F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in columns]) if columns else F.lit("")


def columns_to_events(df: DataFrame, fields: list[str], source: Column, overrides: dict[str, str] | None = None) -> DataFrame:
    """Events of a table whose columns ``fields`` are texts. The first non-empty value of a target wins, of levels the last."""
    col = lambda c: F.col(f"`{c}`").cast("string")
    targets: dict[str, list[str]] = {}
    for c in fields:
        if (t := field_of(c, overrides)) is not None:
            targets.setdefault(t, []).append(c)
    searchable = _all([col(c) for c in fields])
    out = {"source": source, "searchable": searchable}
    for t, names in targets.items():
        if t == "log_time":
            out[t] = F.coalesce(*[parse_time(col(c)) for c in names])
        elif t == "level":
            out[t] = parse_level(col(names[-1]))
        else:
            out[t] = F.coalesce(*[F.nullif(col(c), F.lit("")) for c in names], F.lit(""))
    out["message"] = F.when(F.coalesce(out.get("message"), F.lit("")) == "", searchable).otherwise(out["message"]) if "message" in out else searchable
    pairs = [x for c in fields for x in (F.lit(c), F.coalesce(col(c), F.lit("")))]
    out["fields"] = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return as_events(df.select(*[v.alias(k) for k, v in out.items()]))


def map_to_events(df: DataFrame, record: str, source: Column, overrides: dict[str, str] | None = None) -> DataFrame:
    """Events of rows with a map<string,string>, whatever its keys. First non-empty value in the record's order wins, of levels the last."""
    m = F.col(record)
    entries = F.map_entries(m)
    value = lambda e: F.coalesce(e["value"], F.lit(""))
    overridden = {k: v for k, v in (overrides or {}).items()}

    def of(column: str) -> Column:
        names = [n for n in FIELD_NAMES.get(column, [])]
        forced = [k for k, v in overridden.items() if v not in ("", "-") and MAPPED.get(v, v) == column]
        barred = [k for k in overridden if k not in forced]
        test = lambda e: (F.lower(e["key"]).isin(names) & ~e["key"].isin(barred) if barred else F.lower(e["key"]).isin(names)) | (e["key"].isin(forced) if forced else F.lit(False))
        return F.filter(entries, test)

    first = lambda c: F.coalesce(F.get(F.filter(of(c), lambda e: value(e) != ""), F.lit(0))["value"], F.lit(""))
    searchable = F.array_join(F.transform(entries, value), " ")
    times = F.transform(of("log_time"), lambda e: parse_time(value(e)))
    levels = of("level")
    message = first("message")
    return as_events(
        df.select(
            F.get(F.filter(times, lambda t: t.isNotNull()), F.lit(0)).alias("log_time"),
            parse_level(F.element_at(F.transform(levels, value), F.when(F.size(levels) > 0, -1).otherwise(F.lit(None).cast("int")))).alias("level"),
            *[first(c).alias(c) for c in FIELD_NAMES if c not in ("log_time", "level", "message")],
            F.when(message == "", searchable).otherwise(message).alias("message"), searchable.alias("searchable"), source.alias("source"), m.alias("fields"),
        )
    )
