"""The canonical event: one wide row per log event, whatever it was read from.

Empty string means "missing" in string columns; only ``log_time`` is NULL when unknown.
``provider`` is the logger or component, ``source`` the file or other origin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Level ordinals, most severe first.
LEVELS = ["Catastrophic", "Error", "Warning", "Info", "Verbose", "Unknown"]
CATASTROPHIC, ERROR, WARNING, INFO, VERBOSE, UNKNOWN = range(6)

STRING_COLUMNS = [
    "provider", "task_name", "op_code", "message", "searchable", "source", "machine_name", "username", "process_id", "thread_id",
    "event_id", "record_id", "activity_id", "related_activity_id", "provider_guid", "keywords", "channel", "process_name",
]

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("row_id", T.LongType()),
        T.StructField("log_time", T.TimestampNTZType()),
        T.StructField("level", T.IntegerType()),
        *[T.StructField(c, T.StringType()) for c in STRING_COLUMNS],
        T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("routes", T.ArrayType(T.StringType())),
    ]
)

# Level names and their synonyms in searches.
LEVEL_WORDS = {"catastrophic": 0, "critical": 0, "fatal": 0, "error": 1, "warning": 2, "warn": 2, "info": 3, "information": 3, "verbose": 4, "debug": 4}
# Fixed value: what old readers wrote for a value they did not support.
NOT_SUPPORTED = "!NOT_SUPPORTED!"

# Names that searches, rules and exports accept for a column.
FIELD_ALIASES = {
    "message": "message", "msg": "message",
    "task": "task_name", "taskname": "task_name",
    "provider": "provider", "prov": "provider",
    "source": "source", "src": "source",
    "level": "level", "lvl": "level",
    "pid": "process_id", "processid": "process_id",
    "tid": "thread_id", "threadid": "thread_id",
    "activityid": "activity_id", "aid": "activity_id", "activity": "activity_id",
    "relatedactivityid": "related_activity_id", "raid": "related_activity_id", "related": "related_activity_id",
    "eventid": "event_id", "event": "event_id", "id": "event_id",
    "channel": "channel",
    "machine": "machine_name", "machinename": "machine_name", "computer": "machine_name",
    "user": "username", "username": "username",
    "opcode": "op_code",
    "time": "log_time", "timestamp": "log_time",
}


def level_name(level: Column) -> Column:
    """Display name of a level ordinal."""
    return F.coalesce(F.element_at(F.array(*[F.lit(x) for x in LEVELS]), level + 1), F.lit("Unknown"))


def level_to_int(name: str | None) -> int:
    """Ordinal of a level name or synonym; -1, which matches nothing, for others."""
    return LEVEL_WORDS.get((name or "").strip().lower(), -1)


def as_events(df: DataFrame, *more: str) -> DataFrame:
    """Canonical columns in order, and ``more`` of the frame's own: missing ones get their default, NULL strings become ''."""
    have = dict(df.dtypes)
    defaults = {"row_id": F.lit(None), "log_time": F.lit(None), "level": F.lit(INFO), "fields": F.create_map(), "tags": F.array(), "routes": F.array()}
    columns = []
    for f in EVENT_SCHEMA.fields:
        kind = f.dataType.simpleString()
        value = F.col(f.name) if f.name in have else defaults.get(f.name, F.lit(""))
        value = value.cast(kind)
        if f.name in STRING_COLUMNS:
            value = F.coalesce(value, F.lit(""))
        elif f.name == "level":
            value = F.coalesce(value, F.lit(UNKNOWN))
        elif f.name in ("fields", "tags", "routes"):
            value = F.coalesce(value, defaults[f.name].cast(kind))
        columns.append(value.alias(f.name))
    return df.select(*columns, *more)


def normalize_events(df: DataFrame) -> DataFrame:
    """Canonical projection in which the legacy "not supported" mark is empty."""
    events = as_events(df)
    return events.withColumns({c: F.when(F.col(c) == NOT_SUPPORTED, "").otherwise(F.col(c)) for c in STRING_COLUMNS})
