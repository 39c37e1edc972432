"""Event-log records exported as XML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.parse import parse_time
from logloom.functions.text import first_non_empty
from logloom.model import CATASTROPHIC, ERROR, INFO, VERBOSE, WARNING, as_events

_SCHEMA = """
System struct<Provider: struct<_Name: string, _Guid: string, _EventSourceName: string>, EventID: struct<_VALUE: string, _Qualifiers: string>, Level: string, Task: string, Opcode: string,
  Keywords: string, TimeCreated: struct<_SystemTime: string>, EventRecordID: string, Correlation: struct<_ActivityID: string, _RelatedActivityID: string>,
  Execution: struct<_ProcessID: string, _ThreadID: string>, Channel: string, Computer: string, Security: struct<_UserID: string>>,
EventData struct<Data: array<struct<_Name: string, _VALUE: string>>>,
RenderingInfo struct<Message: string, Level: string, Task: string, Opcode: string, Channel: string, Provider: string, Keywords: struct<Keyword: array<string>>>
"""


def read_event_xml(spark: SparkSession, path: str) -> DataFrame:
    """Events of ``<Event>`` elements: unnamed data are DataN, the first of equal names wins.

    The message is the rendered text, else the event data, else the system part.
    """
    rows = spark.read.format("xml").option("rowTag", "Event").option("valueTag", "_VALUE").schema(_SCHEMA).load(path)
    s, r = F.col("System"), F.col("RenderingInfo")
    data = F.coalesce(F.col("EventData.Data"), F.array().cast("array<struct<_Name:string,_VALUE:string>>"))
    named = F.transform(data, lambda d, i: F.struct(F.coalesce(F.nullif(d["_Name"], F.lit("")), F.concat(F.lit("Data"), (i + 1).cast("string"))).alias("k"), F.coalesce(d["_VALUE"], F.lit("")).alias("v")))
    first = F.filter(named, lambda p, i: F.array_position(F.transform(named, lambda q: q["k"]), p["k"]) == i + 1)
    pairs = F.array_join(F.transform(named, lambda p: F.concat(p["k"], F.lit(": "), p["v"])), ", ")
    system = F.concat_ws(" ", s["Provider"]["_Name"], F.concat(F.lit("event "), s["EventID"]["_VALUE"]), s["Channel"])
    message = first_non_empty(r["Message"], pairs, system)
    word = F.lower(F.coalesce(r["Level"], F.lit("")))
    level = (
        F.when((s["Level"] == "1") | (word == "critical"), CATASTROPHIC).when((s["Level"] == "2") | (word == "error"), ERROR).when((s["Level"] == "3") | (word == "warning"), WARNING)
        .when((s["Level"] == "5") | (word == "verbose"), VERBOSE).otherwise(INFO)
    )
    return as_events(
        rows.select(
            parse_time(F.regexp_replace(s["TimeCreated"]["_SystemTime"], r"(\.\d{6})\d*", "$1")).alias("log_time"), level.alias("level"), first_non_empty(s["Provider"]["_Name"], s["Provider"]["_EventSourceName"]).alias("provider"),
            first_non_empty(r["Task"], s["Task"]).alias("task_name"), first_non_empty(r["Opcode"], s["Opcode"]).alias("op_code"), message.alias("message"),
            F.concat_ws(" ", message, pairs, system, s["Computer"]).alias("searchable"), F.col("_metadata.file_path").alias("source"), s["Computer"].alias("machine_name"), s["Security"]["_UserID"].alias("username"),
            s["Execution"]["_ProcessID"].alias("process_id"), s["Execution"]["_ThreadID"].alias("thread_id"), s["EventID"]["_VALUE"].alias("event_id"), s["EventRecordID"].alias("record_id"),
            s["Correlation"]["_ActivityID"].alias("activity_id"), s["Correlation"]["_RelatedActivityID"].alias("related_activity_id"), s["Provider"]["_Guid"].alias("provider_guid"),
            first_non_empty(F.concat_ws(", ", r["Keywords"]["Keyword"]), s["Keywords"]).alias("keywords"), s["Channel"].alias("channel"),
            F.map_from_entries(F.transform(first, lambda p: F.struct(p["k"], p["v"]))).alias("fields"),
        )
    )
