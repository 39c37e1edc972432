"""Tables that are events already: query results, work items, issues, old event-log entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.parse import flexible_time, line_level, parse_level, parse_time
from logloom.functions.text import display_name
from logloom.model import CATASTROPHIC, ERROR, INFO, VERBOSE, WARNING, as_events

# Columns of result tables that fill an event column, best first.
CANDIDATES = {
    "log_time": ["PreciseTimeStamp", "Timestamp", "TimeGenerated", "env_time", "Time", "EventTime", "TIMESTAMP"],
    "level": ["Level", "Severity", "SeverityLevel", "LogLevel", "TraceLevel"],
    "provider": ["ProviderName", "Provider", "Source", "Component", "Logger", "Category"],
    "task_name": ["TaskName", "Task", "EventName", "OperationName", "Operation"],
    "message": ["EventMessage", "Message", "RenderedMessage", "Text", "Description", "Details", "RawData"],
    "machine_name": ["MachineName", "Computer", "HostInstance", "Host", "RoleInstance", "NodeName"],
    "username": ["UserName", "User", "UserId"],
    "process_id": ["Pid", "ProcessId"],
    "thread_id": ["Tid", "ThreadId"],
    "event_id": ["EventId", "EventID"],
    "activity_id": ["ActivityId", "CorrelationId", "OperationId"],
    "related_activity_id": ["RelatedActivityId", "ParentId"],
    "channel": ["Channel"],
    "op_code": ["OpcodeName", "Opcode"],
    "process_name": ["ProcessName", "Process"],
}


def _pick(df: DataFrame, names: list[str]) -> Column:
    have = {c.lower(): c for c in df.columns}
    found = [F.col(f"`{have[n.lower()]}`").cast("string") for n in names if n.lower() in have]
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in found], F.lit(""))


def _row_text(df: DataFrame) -> tuple[Column, Column]:
    """(values joined by a space, map of all columns)."""
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]
    pairs = [x for c, v in zip(df.columns, cells) for x in (F.lit(c), v)]
    return F.concat_ws(" ", *cells), F.create_map(*pairs)


def rows_to_events(df: DataFrame, source: str) -> DataFrame:
    """Events of any result table. A table of one text column has log lines in it: a leading ``[time]`` and ``LEVEL:`` are taken out."""
    searchable, fields = _row_text(df)
    texts = [c for c, kind in df.dtypes if kind == "string"]
    if len(df.columns) == 1 and texts:
        line = F.coalesce(F.col(f"`{texts[0]}`"), F.lit(""))
        stamp = F.regexp_extract(line, r"^\s*\[([^\]]+)\]\s*", 1)
        rest = F.regexp_replace(line, r"^\s*\[[^\]]+\]\s*", "")
        word = F.regexp_extract(rest, r"(?i)^(critical|fatal|error|warning|warn|info|information|debug|verbose|trace):\s*", 1)
        time = flexible_time(stamp)
        bare = F.when(time.isNotNull(), rest).otherwise(line)
        return as_events(
            df.select(
                time.alias("log_time"), F.when(word != "", parse_level(word)).otherwise(line_level(line)).alias("level"),
                F.regexp_replace(bare, r"(?i)^(critical|fatal|error|warning|warn|info|information|debug|verbose|trace):\s*", "").alias("message"), line.alias("searchable"), F.lit(source).alias("source"), fields.alias("fields"),
            )
        )
    values = {c: _pick(df, names) for c, names in CANDIDATES.items()}
    message = F.when(values["message"] == "", F.col(f"`{texts[0]}`") if len(texts) == 1 else searchable).otherwise(values["message"])
    return as_events(
        df.select(
            parse_time(values["log_time"]).alias("log_time"), parse_level(values["level"]).alias("level"), F.coalesce(message, F.lit("")).alias("message"),
            *[v.alias(c) for c, v in values.items() if c not in ("log_time", "level", "message")], searchable.alias("searchable"), F.lit(source).alias("source"), fields.alias("fields"),
        )
    )


def work_items_to_events(df: DataFrame, source: str = "work items") -> DataFrame:
    """Events of work items (System.Id, System.Title, System.State, System.WorkItemType, ...): closed states are Verbose, bugs Warning, priority 1 bugs Error."""
    searchable, fields = _row_text(df)
    short = F.transform_keys(fields, lambda k, _: F.element_at(F.split(k, r"\."), -1))
    of = lambda *names: _pick(df, [x for n in names for x in (f"System.{n}", f"Microsoft.VSTS.Common.{n}", n)])
    state, kind = F.lower(of("State")), F.lower(of("WorkItemType"))
    level = F.when(state.isin("closed", "done", "resolved", "removed", "completed"), VERBOSE).when((kind == "bug") & (of("Priority") == "1"), ERROR).when(kind == "bug", WARNING).otherwise(INFO)
    return as_events(
        df.select(
            parse_time(of("ChangedDate", "CreatedDate")).alias("log_time"), level.alias("level"), of("WorkItemType").alias("task_name"), of("State").alias("op_code"), of("Title").alias("message"), searchable.alias("searchable"),
            of("AreaPath", "TeamProject").alias("provider"), F.lit(source).alias("source"), display_name(of("AssignedTo")).alias("username"), of("Id").alias("event_id"), short.alias("fields"),
        )
    )


def issues_to_events(df: DataFrame, source: str = "issues") -> DataFrame:
    """Events of issues (number, title, state, labels, user, updated_at, body): closed is Verbose, a label with ``bug`` Warning."""
    searchable, fields = _row_text(df)
    labels = F.concat_ws(", ", F.col("labels")) if dict(df.dtypes).get("labels", "").startswith("array") else _pick(df, ["labels"])
    level = F.when(F.lower(_pick(df, ["state"])) == "closed", VERBOSE).when(F.lower(labels).contains("bug"), WARNING).otherwise(INFO)
    return as_events(
        df.select(
            parse_time(_pick(df, ["updated_at", "created_at"])).alias("log_time"), level.alias("level"), labels.alias("task_name"), _pick(df, ["state"]).alias("op_code"), _pick(df, ["title"]).alias("message"), searchable.alias("searchable"),
            _pick(df, ["repository", "repo"]).alias("provider"), F.lit(source).alias("source"), _pick(df, ["user", "author"]).alias("username"), _pick(df, ["number", "id"]).alias("event_id"), fields.alias("fields"),
        )
    )


def legacy_entries_to_events(df: DataFrame, source: str = "event log") -> DataFrame:
    """Events of old event-log entries (instance_id, entry_type, source, message, replacement_strings, time_generated, ...)."""
    kind = F.lower(F.coalesce(F.col("entry_type").cast("string"), F.lit("")))
    level = F.when(kind == "error", ERROR).when(kind == "warning", WARNING).when(kind.isin("failureaudit", "failure audit"), WARNING).when(kind == "critical", CATASTROPHIC).otherwise(INFO)
    data = F.coalesce(F.col("replacement_strings"), F.array().cast("array<string>"))
    pairs = F.map_from_entries(F.transform(data, lambda v, i: F.struct(F.concat(F.lit("Data"), (i + 1).cast("string")), v)))
    message = _pick(df, ["message"])
    joined = F.array_join(data, " ")
    return as_events(
        df.select(
            F.col("time_generated").cast("timestamp_ntz").alias("log_time"), level.alias("level"), _pick(df, ["source"]).alias("provider"), _pick(df, ["category"]).alias("task_name"),
            F.when(message == "", joined).otherwise(message).alias("message"), F.concat_ws(" ", message, joined).alias("searchable"), F.lit(source).alias("source"), _pick(df, ["machine_name"]).alias("machine_name"),
            _pick(df, ["user_name"]).alias("username"), F.col("instance_id").cast("long").bitwiseAND(F.lit(0xFFFF)).cast("string").alias("event_id"), _pick(df, ["entry_index"]).alias("record_id"), pairs.alias("fields"),
        )
    )
