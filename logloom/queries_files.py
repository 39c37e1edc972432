"""Queries that write a driver table in a format, read it back through a reader or a sink, and more operators with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom import sinks, streaming
from logloom.functions.text import csv_escape, mermaid_escape
from logloom.model import NOT_SUPPORTED, as_events, normalize_events
from logloom.operators import analysis, packs, paging, processors, rewrite, rules, sequence, trigram
from logloom.plans.durable import remove, scratch, spread
from logloom.plans.rules import regex_or_contains, rule_matches
from logloom.plans.scope import apply_scope, build_scope, scope_from_selection
from logloom.plans.search import search
from logloom.plans.spec import FilterSpec, SortSpec
from logloom.queries import CV, DL, EV, EXTRACT_RULES, ORD, _T, _ids, _time_text, conversation_rows, document_lines, event_rows, order_rows, query, table
from logloom.sources.datasource import register
from logloom.sources.delimited import read_csv_logs, read_tsv_export
from logloom.sources.eventxml import read_event_xml
from logloom.sources.folder import filter_source_types, read_folder, read_inputs, rebase_source, renumbered, source_type, union_sources
from logloom.sources.incremental import compact, ingest_incremental, read_store
from logloom.sources.jsonlogs import read_json_array, read_json_doc, read_json_lines
from logloom.sources.tables import issues_to_events, legacy_entries_to_events, work_items_to_events
from logloom.sources.text import read_text_logs
from logloom.sources.trace import read_trace_text

#: Events of a JSON or XML document in the round trips, and of a JSON array that is read by ranges.
DOCUMENT, ARRAY = 1000, 100_000


def _lines(df: DataFrame, value, name: str) -> str:
    """A new folder of text files with one line for each row."""
    path = scratch(df.sparkSession, name)
    df.select(value.alias("value")).write.text(path)
    return path


# Readers: the table in the format, read back.


@query("read_text", f"WITH {DL} SELECT level, count(*) AS n, CAST(sum(length(message)) AS BIGINT) AS chars FROM dl WHERE NOT contains(message, chr(13)) GROUP BY 1")
def read_text(spark, sf_dir):
    """Document lines as a text log; files of lines with a NUL are no text."""
    rows = document_lines(spark, sf_dir).where(~F.contains("message", F.lit("\r")))
    path = _lines(rows, F.col("message"), "text")
    rows.select(F.concat(F.lit("a\0b"), F.col("row_id").cast("string")).alias("value")).write.text(f"{path}/binary")
    return read_text_logs(spark, path, recursive=True).groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("message")).alias("chars"))


@query("read_text_ids", f"WITH {EV} SELECT count(*) AS n, count(*) AS ids, 0 AS low, count(*) - 1 AS high FROM ev")
def read_text_ids(spark, sf_dir):
    """Ids of a text load are gapless."""
    events = read_text_logs(spark, _lines(event_rows(spark, sf_dir), F.lit("one line like all others"), "text"), ids=True)
    return events.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("row_id").alias("ids"), F.min("row_id").cast("int").alias("low"), F.max("row_id").alias("high"))


_ORDER_EVENTS = "SELECT o_orderkey AS id, o_orderpriority AS message, CAST(o_custkey AS VARCHAR) AS username, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 3 END AS level, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders"


@query("read_csv", _ORDER_EVENTS)
def read_csv(spark, sf_dir):
    """A file with a semicolon, a mapping saved for its columns, and blanks around cells."""
    path = scratch(spark, "csv")
    o = table(spark, sf_dir, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("TimeStamp"), F.col("o_orderstatus").alias("Severity"), F.concat(F.lit(" "), "o_orderpriority", F.lit(" ")).alias("Msg"),
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").cast("string").alias("Who"),
    )
    o.write.csv(path, header=True, sep=";", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    e = read_csv_logs(spark, path, saved={frozenset({"timestamp", "severity", "msg", "id", "who"}): {"Who": "user"}})
    return e.select(F.col("event_id").cast("long").alias("id"), "message", "username", "level", F.date_format("log_time", "yyyy-MM-dd").alias("day"))


@query("read_csv_headers", f"WITH {EV} SELECT row_id AS id, message, level, {_T} AS time, task_name FROM ev")
def read_csv_headers(spark, sf_dir):
    """Files with three different headers and delimiters in one folder, read as one."""
    folder, e = scratch(spark, "tables"), event_rows(spark, sf_dir)
    cells = {"id": F.col("row_id").cast("string"), "Timestamp": _time_text(), "Severity": F.when(F.col("level") == 1, "error").otherwise("info"), "Message": F.col("message"), "Task": F.col("task_name")}
    shapes = [(",", list(cells)), (";", ["Message", "Task", "id", "Severity", "Timestamp"]), ("\t", ["Task", "Timestamp", "id", "Message", "Severity"])]
    for i, (sep, names) in enumerate(shapes):
        part = e.where(F.pmod("row_id", F.lit(3)) == i).select(*[cells[n].alias(n) for n in names])
        part.repartition(3).write.option("quoteAll", True).csv(f"{folder}/{i}", header=True, sep=sep, escape='"')
    out = read_folder(spark, folder)
    return out.select(F.col("event_id").cast("long").alias("id"), "message", "level", _time_text().alias("time"), "task_name")


@query("read_tsv_export", f"WITH {EV} SELECT username AS pid, CASE level WHEN 1 THEN 1 ELSE 3 END AS level, {_T} AS time, task_name FROM ev WHERE row_id % 10 <> 0")
def read_tsv(spark, sf_dir):
    """A telemetry export; every tenth row has a field too many and is dropped."""
    e = event_rows(spark, sf_dir)
    more = F.when(F.col("row_id") % 10 == 0, F.lit("a\tb")).otherwise("c")
    cells = {"PreciseTimeStamp": _time_text(), "ProviderName": F.col("provider"), "Level": F.when(F.col("level") == 1, "2").otherwise("4"), "TaskName": F.col("task_name"), "Pid": F.col("username"), "Message": more}
    path = scratch(spark, "tsv")
    e.select(*[v.alias(k) for k, v in cells.items()]).write.option("quote", "\0").csv(path, header=True, sep="\t")
    return read_tsv_export(spark, path).select(F.col("process_id").alias("pid"), "level", _time_text().alias("time"), "task_name")


_JSON_EVENTS = f"WITH {EV} SELECT row_id AS id, message, level, {_T} AS time FROM ev"


def _record():
    return F.struct(_time_text().alias("timestamp"), F.when(F.col("level") == 1, "error").otherwise("info").alias("severity"), F.col("message").alias("msg"), F.col("row_id").alias("id"), F.struct(F.lit(1).alias("x")).alias("nested"))


def _json_columns(e: DataFrame) -> DataFrame:
    return e.select(F.col("event_id").cast("long").alias("id"), "message", "level", _time_text().alias("time"))


@query("read_json_lines", _JSON_EVENTS)
def read_jsonl(spark, sf_dir):
    """JSON lines among lines that are none."""
    path = _lines(event_rows(spark, sf_dir), F.concat(F.to_json(_record()), F.lit("\n{broken")), "jsonl")
    return _json_columns(read_json_lines(spark, path))


@query("read_json_doc", _JSON_EVENTS)
def read_json(spark, sf_dir):
    """Documents: an array, and an object that holds one."""
    path = scratch(spark, "json")
    docs = event_rows(spark, sf_dir).groupBy(F.expr(f"row_id div {DOCUMENT}").alias("doc")).agg(F.to_json(F.collect_list(_record())).alias("value"))
    docs = docs.withColumn("value", F.when(F.col("doc") % 2 == 0, F.col("value")).otherwise(F.concat(F.lit('{"events": '), "value", F.lit("}"))))
    docs.repartition("doc").write.partitionBy("doc").text(path)
    return _json_columns(read_json_doc(spark, path))


@query("read_json_array", _JSON_EVENTS)
def read_array(spark, sf_dir):
    """Arrays of many byte ranges each, read range by range."""
    e, path = event_rows(spark, sf_dir).withColumn("array", F.expr(f"row_id div {ARRAY}")), scratch(spark, "array")
    ends = e.groupBy("array").agg(F.min("row_id").alias("first"), F.max("row_id").alias("last"))
    sign = lambda at, yes, no: F.when(F.col("row_id") == F.col(at), yes).otherwise(no)
    lines = e.join(F.broadcast(ends), "array").select("array", "row_id", F.concat(sign("first", "[", ","), F.to_json(_record()), sign("last", "]", "")).alias("value"))
    lines.repartition("array").sortWithinPartitions("array", "row_id").drop("row_id").write.partitionBy("array").text(path)
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        read = read_json_array(spark, path)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    return _json_columns(read)


@query("slow_patterns", f"WITH {EV} SELECT 'plain' AS name, count(*) AS n FROM ev WHERE regexp_matches(message, 'user=[0-9]+2\\b')")
def slow_patterns(spark, sf_dir):
    """Rules with a plain pattern and with one that would never end on a long line; the second is looked for as it is written."""
    e = spread(event_rows(spark, sf_dir)).withColumn("searchable", F.concat("message", F.lit(" "), F.repeat(F.lit("a"), 20_000)))
    found = {"plain": r"user=\d+2\b", "loop": r"(\w+\s?)+#"}
    counts = e.agg(*[F.count_if(regex_or_contains(F.col("searchable"), p)).alias(name) for name, p in found.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.col(name).alias("n")) for name in found])).alias("x")).select("x.*").where("n > 0")


@query("read_event_xml", f"WITH {EV} SELECT CAST(row_id AS VARCHAR) AS record_id, level, {_T} AS time, task_name, 'Data1: ' || username || ', kind: ' || task_name AS message, 'host' AS machine_name FROM ev")
def read_xml(spark, sf_dir):
    """Event records of the event log's export."""
    e = event_rows(spark, sf_dir)
    xml = F.concat(
        F.lit("<Event><System><Provider Name='prov'/><EventID>7</EventID><Level>"), F.when(F.col("level") == 1, "2").otherwise("4"), F.lit("</Level><TimeCreated SystemTime='"), F.date_format("log_time", "yyyy-MM-dd'T'HH:mm:ss.SSS"),
        F.lit("Z'/><EventRecordID>"), F.col("row_id").cast("string"), F.lit("</EventRecordID><Channel>App</Channel><Computer>host</Computer></System><EventData><Data>"), "username", F.lit("</Data><Data Name='kind'>"), "task_name",
        F.lit("</Data><Data Name='kind'>"), "task_name", F.lit("</Data></EventData><RenderingInfo><Task>"), "task_name", F.lit("</Task></RenderingInfo></Event>"),
    )
    path = scratch(spark, "xml")
    docs = e.groupBy(F.expr(f"row_id div {DOCUMENT}").alias("doc")).agg(F.concat(F.lit("<Events>"), F.array_join(F.collect_list(xml), ""), F.lit("</Events>")).alias("value"))
    docs.repartition("doc").write.partitionBy("doc").text(path)
    out = read_event_xml(spark, path)
    first_two = F.regexp_replace("message", ", kind: [a-z]+$", "")  # of equal names the first stands in ``fields``; the message has all
    return out.select("record_id", "level", _time_text().alias("time"), "task_name", first_two.alias("message"), "machine_name")


@query("read_trace_files", f"WITH {EV} SELECT username AS process_id, '2604' AS thread_id, level, message FROM ev")
def read_trace(spark, sf_dir):
    e = event_rows(spark, sf_dir)
    body = F.to_json(F.struct(F.col("message").alias("Message"), F.when(F.col("level") == 1, 2).otherwise(4).alias("Level")))
    line = F.concat(F.lit("[0]"), F.upper(F.conv("username", 10, 16)), F.lit(".0A2C::"), F.date_format("log_time", "yyyy-MM-dd HH:mm:ss.SSS"), F.lit(" [Prov]"), body)
    return read_trace_text(spark, _lines(e, line, "trace")).select("process_id", "thread_id", "level", "message")


@query("work_items", "SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderstatus = 'F' THEN 4 WHEN o_orderpriority = '1-URGENT' AND o_custkey % 2 = 0 THEN 1 WHEN o_orderpriority = '1-URGENT' THEN 2 ELSE 3 END AS level, 'User ' || o_custkey AS username, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def work_items(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("System.Id"), F.when(F.col("o_orderstatus") == "F", "Closed").otherwise("Active").alias("System.State"), F.when(F.col("o_orderpriority") == "1-URGENT", "Bug").otherwise("Task").alias("System.WorkItemType"),
        F.when(F.col("o_custkey") % 2 == 0, "1").otherwise("2").alias("Microsoft.VSTS.Common.Priority"), F.concat(F.lit("User "), "o_custkey", F.lit(" <u@x.org>")).alias("System.AssignedTo"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("System.ChangedDate"), F.col("o_orderpriority").alias("System.Title"),
    )
    return work_items_to_events(o).select(F.col("event_id").alias("id"), "level", "username", F.date_format("log_time", "yyyy-MM-dd").alias("day"))


@query("issues", "SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderstatus = 'F' THEN 4 WHEN o_orderpriority = '1-URGENT' THEN 2 ELSE 3 END AS level, o_orderpriority AS message FROM orders")
def issues(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("number"), F.col("o_orderpriority").alias("title"), F.when(F.col("o_orderstatus") == "F", "closed").otherwise("open").alias("state"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.array(F.lit("area"), F.lit("Bug: crash"))).otherwise(F.array(F.lit("area"))).alias("labels"), F.col("o_custkey").cast("string").alias("user"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("updated_at"),
    )
    return issues_to_events(o).select(F.col("event_id").alias("id"), "level", "message")


@query("legacy_entries", f"WITH {EV} SELECT CAST(row_id % 65536 AS VARCHAR) AS event_id, level, task_name || ' ' || username AS message, username AS second FROM ev")
def legacy_entries(spark, sf_dir):
    e = event_rows(spark, sf_dir).select(
        (F.col("row_id") + 3 * 65536 * 256).alias("instance_id"), F.when(F.col("level") == 1, "Error").otherwise("Information").alias("entry_type"), F.lit("src").alias("source"), F.lit("").alias("message"),
        F.array("task_name", "username").alias("replacement_strings"), F.col("log_time").alias("time_generated"),
    )
    return legacy_entries_to_events(e).select("event_id", "level", "message", F.col("fields")["Data2"].alias("second"))


@query(
    "read_folder",
    f"""WITH {EV}, {ORD}, {DL} SELECT 'Text' AS kind, count(*) AS n FROM dl WHERE NOT contains(message, chr(13)) UNION ALL SELECT 'CSV', count(*) FROM od UNION ALL SELECT 'JSON', count(*) FROM ev""",
)
def folder(spark, sf_dir):
    """A rule file's inputs: a folder of text, CSV and JSON files; a disabled input is not read."""
    path = scratch(spark, "folder")
    document_lines(spark, sf_dir).where(~F.contains("message", F.lit("\r"))).select("message").write.text(f"{path}/texts")
    table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("message")).write.csv(f"{path}/tables", header=True)
    event_rows(spark, sf_dir).select("row_id", "message").write.json(f"{path}/objects")
    events = read_inputs(spark, {"inputs": [{"type": "folder", "path": path, "depth": "deep"}, {"type": "folder", "path": f"{path}/nowhere", "enabled": False}]})
    shown = rebase_source(events, path, "archive:")
    kinds = F.when(F.startswith("source", F.lit("archive:")), source_type(F.col("source")))
    return shown.select(kinds.alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("rebase_source", f"WITH {DL} SELECT 'zip!/' || source AS source, count(*) AS n FROM dl GROUP BY 1")
def rebased(spark, sf_dir):
    rows = document_lines(spark, sf_dir).withColumn("source", F.concat(F.lit("/tmp/x1/"), "source"))
    return rebase_source(rows, "/tmp/x1", "zip!").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("capped_rows", f"WITH {EV} SELECT least(count(*), 5000) AS n, count(*) > 5000 AS more FROM ev")
def capped_rows(spark, sf_dir):
    rows, more = paging.cap_rows(event_rows(spark, sf_dir), 5000)
    return rows.agg(F.count(F.lit(1)).alias("n")).withColumn("more", F.lit(more))


@query("sampled_rows", f"WITH {EV} SELECT least(count(*), 700) AS n, least(count(*), 700) AS scanned, count(*) AS total, count(*) > 700 AS truncated FROM ev")
def sampled_rows(spark, sf_dir):
    rows, seen = paging.sample_cap(event_rows(spark, sf_dir), 700)
    return rows.agg(F.count(F.lit(1)).alias("n")).withColumns({k: F.lit(v) for k, v in seen.items()})


# Sinks: written and read back by Spark's own readers.

_EXPORTED = f"WITH {EV} SELECT {_T} AS timestamp, CASE level WHEN 1 THEN 'Error' ELSE 'Info' END AS level, task_name AS task, message FROM ev"
_FIELDS = ["timestamp", "level", "task", "message"]


@query("write_csv", _EXPORTED)
def write_csv(spark, sf_dir):
    path = scratch(spark, "out")
    sinks.write_csv(event_rows(spark, sf_dir), path, _FIELDS)
    return spark.read.schema("timestamp string, level string, task string, message string").csv(path, header=True, escape='"')


@query("write_json", _EXPORTED)
def write_json(spark, sf_dir):
    path = scratch(spark, "out")
    sinks.write_json(event_rows(spark, sf_dir), path, _FIELDS)
    return spark.read.schema("timestamp string, level string, task string, message string").json(path)


@query("write_xml", _EXPORTED)
def write_xml(spark, sf_dir):
    path = scratch(spark, "out")
    sinks.write_xml(event_rows(spark, sf_dir), path, _FIELDS)
    return spark.read.format("xml").option("rowTag", "Result").schema("timestamp string, level string, task string, message string").load(path)


@query("xml_names", f"WITH {EV} SELECT row_id, task_name AS task_name_, username AS _2nd_user FROM ev")
def xml_names(spark, sf_dir):
    """Columns whose names are no element names, written as XML under names that are."""
    rows = event_rows(spark, sf_dir).select(F.col("row_id").cast("string").alias("row id"), F.col("task_name").alias("task-name!"), F.col("username").alias("2nd user"))
    path = scratch(spark, "out")
    sinks.write_rows_xml(rows, path)
    return spark.read.format("xml").option("rowTag", "Result").option("attributePrefix", "@").schema("row_id long, task_name_ string, _2nd_user string").load(path)


@query("write_txt", f"WITH {EV} SELECT 'task=' || task_name || ' | message=' || message AS value FROM ev")
def write_txt(spark, sf_dir):
    path = scratch(spark, "out")
    sinks.write_txt(event_rows(spark, sf_dir), path, ["task", "message"])
    return spark.read.text(path)


@query("write_results", f"WITH {EV} SELECT '[' || {_T} || '] ' || CASE level WHEN 1 THEN 'Error' ELSE 'Info' END || ' events: ' || message AS value FROM ev")
def write_results(spark, sf_dir):
    path = scratch(spark, "out")
    sinks.write_results(event_rows(spark, sf_dir), path, "txt")
    return spark.read.text(path)


@query("write_html", f"WITH {EV} SELECT CASE level WHEN 1 THEN 'error' ELSE 'info' END AS class, count(*) AS n FROM ev GROUP BY 1")
def write_html(spark, sf_dir):
    path = scratch(spark, "out")
    sinks.write_html_rows(event_rows(spark, sf_dir), path)
    return spark.read.text(path).groupBy(F.regexp_extract("value", 'class="([a-z]+)"', 1).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("output_rules", f"WITH {EV} SELECT 'errors' AS file, count(*) AS n FROM ev WHERE level = 1 UNION ALL SELECT 'buys', count(*) FROM ev WHERE task_name = 'purchase'")
def output_rules(spark, sf_dir):
    """Two output rules of a rule file, run and read back."""
    path = scratch(spark, "out")
    sections = [{"name": "o", "purpose": "output", "rules": [
        {"name": "errors", "match": "^error", "action": {"type": "output", "format": "json", "path": "{output}/errors", "fields": ["message"]}},
        {"name": "buys", "match": "purchase", "action": {"type": "output", "format": "json", "path": "{output}/buys", "fields": ["message"]}},
        {"name": "off", "enabled": False, "match": "x", "action": {"type": "output", "path": "{output}/off"}},
    ]}]
    found = None
    for p in sinks.run_output_rules(event_rows(spark, sf_dir), sections, path):
        part = spark.read.schema("message string").json(p).agg(F.count(F.lit(1)).alias("n")).select(F.lit(p.rsplit("/", 1)[1]).alias("file"), "n")
        found = part if found is None else found.unionByName(part)
    return found


@query("csv_cells", f"WITH {EV} SELECT row_id, '\"' || replace(message, '\"', '\"\"') || '\"' AS message, task_name FROM ev")
def csv_cells(spark, sf_dir):
    return event_rows(spark, sf_dir).select("row_id", csv_escape(F.col("message")).alias("message"), csv_escape(F.col("task_name")).alias("task_name"))


@query(
    "mermaid_text",
    """SELECT page_id, trim(replace(replace(replace(replace(regexp_replace(html, '[\r\n]+', ' ', 'g'), '#', '#35;'), ';', '#59;'), '<', '#lt;'), '>', '#gt;')) AS label FROM pages""",
)
def mermaid_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", mermaid_escape(F.col("html")).alias("label"))


# Rewrites, rules, scopes, lookups.


@query("normalized_rows", f"WITH {EV} SELECT row_id, CASE WHEN row_id % 3 = 0 THEN '' ELSE message END AS message, '' AS channel FROM ev")
def normalized_rows(spark, sf_dir):
    rows = event_rows(spark, sf_dir).drop("channel").withColumn("message", F.when(F.col("row_id") % 3 == 0, NOT_SUPPORTED).otherwise(F.col("message")))
    return normalize_events(rows).select("row_id", "message", "channel")


@query("reformat_payload", f"WITH {EV} SELECT row_id, CASE WHEN row_id % 2 = 0 THEN 'got k: ' || json_extract_string(props, '$.k') || ' | ' ELSE 'other' END AS message FROM ev JOIN events ON event_id = row_id")
def reformat_payload(spark, sf_dir):
    rows = event_rows(spark, sf_dir)
    rows = rows.withColumn("message", F.when(F.col("row_id") % 2 == 0, F.concat(F.lit("got "), rewrite.render_payload(F.col("fields"), "key_value"))).otherwise("other"))
    return rewrite.reformat_payload(rows, "key_value", "pipe").select("row_id", "message")


@query("payload_json_custom", "SELECT event_id AS row_id, '{\"k\":\"' || json_extract_string(props, '$.k') || '\"}' AS json, 'k->' || json_extract_string(props, '$.k') || ';' AS custom FROM events")
def payload_json_custom(spark, sf_dir):
    f = F.col("fields")
    return event_rows(spark, sf_dir).select("row_id", rewrite.render_payload(f, "json").alias("json"), rewrite.render_payload(f, "custom", "{name}->{value};").alias("custom"))


@query("search_plain_and_structured", f"WITH {EV} SELECT 'plain' AS way, count(*) AS n FROM ev WHERE contains(message, 'user=42') UNION ALL SELECT 'structured', count(*) FROM ev WHERE username = '42' AND NOT task_name = 'view'")
def search_both(spark, sf_dir):
    """The first text has an operator and is a plain term all the same: it finds user 420 too."""
    rows = event_rows(spark, sf_dir)
    one = lambda text, way: search(rows, text, plain=way == "plain").agg(F.count(F.lit(1)).alias("n")).select(F.lit(way).alias("way"), "n")
    return one("USER=42", "plain").unionByName(one("user == 42 and not task == view", "structured"))


@query("scope_of_selection", f"WITH {ORD} SELECT row_id FROM od WHERE level = 1 AND log_time >= TIMESTAMP '1995-01-01' AND log_time <= TIMESTAMP '1996-06-01'")
def scope_of_selection(spark, sf_dir):
    """A selection turned into a scope rule file and applied."""
    file = scope_from_selection(["orders"], "include", "1995-01-01", "1996-06-01", ["Error"])
    return apply_scope(order_rows(spark, sf_dir), build_scope(file["sections"])).select("row_id")


@query("rule_dates_and_providers", f"WITH {EV}, {ORD} SELECT 'events' AS provider, count(*) AS n FROM ev WHERE NOT (log_time >= TIMESTAMP '2024-01-10' AND log_time <= TIMESTAMP '2024-01-20') UNION ALL SELECT 'orders', count(*) FROM od")
def rule_dates(spark, sf_dir):
    """A rule with a date range in a section of one provider: it drops that provider's rows of these days."""
    sections = [{"name": "days", "purpose": "filter", "providers": ["EVENTS"], "rules": [{"name": "d", "dateRange": {"after": "2024-01-10", "before": "2024-01-20"}, "action": {"type": "exclude"}}]}]
    both = event_rows(spark, sf_dir).unionByName(order_rows(spark, sf_dir))
    return rules.rules_filter_pipeline(both, {"sections": sections}).groupBy("provider").agg(F.count(F.lit(1)).alias("n"))


@query("crash_and_power", f"WITH {EV} SELECT 'crash' AS pack, count(*) AS n FROM ev WHERE level = 1 UNION ALL SELECT 'power', count(*) FROM ev WHERE task_name = 'signup'")
def crash_and_power(spark, sf_dir):
    said = F.when(F.col("level") == 1, "Faulting application name: shop.exe ").when(F.col("task_name") == "signup", "The system uptime is 5 ").otherwise("")
    rows = event_rows(spark, sf_dir).withColumn("searchable", F.concat(said, "searchable"))
    one = lambda pack, name: rules.rules_filter_view(rows, pack).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("pack"), "n")
    return one(packs.CRASH_FILTER, "crash").unionByName(one(packs.POWER_FILTER, "power"))


@query("extract_order_and_targets", f"WITH {EV} SELECT row_id, level, {_T} AS time, username AS provider, 'late ' || task_name AS task_name FROM ev")
def extract_order(spark, sf_dir):
    """Later sections win; time, level and id are no targets."""
    ex = lambda pattern, **targets: {"name": "x", "action": {"type": "extract", "pattern": pattern, "set": targets}}
    file = {"sections": [
        {"name": "a", "purpose": "enrichment", "rules": [ex(r"^(?<kind>\w+)", TaskName="early {kind}", Level="{kind}", Time="{kind}", RowId="{kind}"), ex(r"user=(?<who>\d+)", Provider="first")]},
        {"name": "b", "purpose": "enrichment", "rules": [ex(r"^(?<kind>\w+)", TaskName="late {kind}"), ex(r"user=(?<who>\d+)", Provider="{who}"), ex(r"(?<no>nothing)", Provider="{no}")]},
    ]}
    return rules.extract(event_rows(spark, sf_dir), file).select("row_id", "level", _time_text().alias("time"), "provider", "task_name")


@query("servicing_fields", f"WITH {EV} SELECT row_id, 'DISM' AS provider, 'DISM Store' AS task_name, username AS process_id, '7' AS thread_id FROM ev")
def servicing_fields(spark, sf_dir):
    """The field pack of servicing logs over lines of their shape."""
    line = F.concat(F.lit("2024-05-06 07:08:09, Info                  DISM   DISM Store: PID="), "username", F.lit(" TID=7 done"))
    rows = event_rows(spark, sf_dir).withColumn("message", line).withColumn("searchable", line)
    return rules.extract(rows, packs.DISM_FIELDS).select("row_id", "provider", "task_name", "process_id", "thread_id")


@query(
    "servicing_packs",
    f"""WITH {EV} SELECT row_id, 'cbs' AS pack, 'CBS' AS provider, 'CBS' AS task_name, '0x' || username AS event_id, 'Exec: Failed user ' || username || ' [HRESULT = 0x' || username || ' - E_FAIL]' AS message FROM ev
    UNION ALL SELECT row_id, 'setup', 'events', 'setup.exe', '0x' || username, 'Migration of user ' || username || ' done. Result = 0x' || username FROM ev
    UNION ALL SELECT row_id, 'update', 'events', task_name, '', 'scan for user ' || username FROM ev""",
)
def servicing_packs(spark, sf_dir):
    """The packs of component servicing, setup and update logs over lines of their shapes."""
    e, who = event_rows(spark, sf_dir), F.col("username")
    head = F.lit("2024-05-06 07:08:09, ")
    shapes = {
        "cbs": (packs.CBS_FIELDS, F.concat(head, F.lit("Error                 CBS    Exec: Failed user "), who, F.lit(" [HRESULT = 0x"), who, F.lit(" - E_FAIL]"))),
        "setup": (packs.SETUP_FIELDS, F.concat(head, F.lit("Info                  MIG    [setup.exe] Migration of user "), who, F.lit(" done. Result = 0x"), who)),
        "update": (packs.UPDATE_FIELDS, F.concat(F.lit("Agent == Info:  scan for user "), who, F.lit(" | "))),
    }
    out = [rules.extract(e.withColumns({"message": line, "searchable": line}), pack).select("row_id", F.lit(name).alias("pack"), "provider", "task_name", "event_id", "message") for name, (pack, line) in shapes.items()]
    return reduce(DataFrame.unionByName, out)


_KINDS = "CASE row_id % 5 WHEN 0 THEN '/d/a.ETL.001' WHEN 1 THEN '/d/b.log' WHEN 2 THEN 'c:/d/c.csv' WHEN 3 THEN '/d/none' ELSE '/d/e.jsonl' END"


@query("source_types_off", f"WITH {EV} SELECT row_id, {_KINDS} AS source FROM ev WHERE row_id % 5 IN (0, 3, 4)")
def source_types_off(spark, sf_dir):
    """Text and CSV switched off among sources of five kinds."""
    rows = event_rows(spark, sf_dir).withColumn("source", F.expr(_KINDS))
    return filter_source_types(rows, ["ETL", "JSON", "Other"]).select("row_id", "source")


def _told(e: DataFrame, lines: dict) -> DataFrame:
    """Events that tell another line for some of their types; the others keep their message."""
    line = F.col("message")
    for kind, text in lines.items():
        line = F.when(F.col("task_name") == kind, text).otherwise(line)
    return e.withColumn("message", line).withColumn("searchable", F.col("message"))


@query(
    "process_diagrams",
    f"""WITH {EV}, h AS (SELECT username, row_id, log_time, 0 AS rule_no, 'note' AS type, '    note left of Client: ' || chr(39) || 'pid=' || username || chr(39) AS line FROM ev WHERE task_name = 'purchase'
    UNION ALL SELECT username, row_id, log_time, 1, 'message', '    Client->>Broker: ' || chr(39) || 'request (req=' || row_id || ')' || chr(39) FROM ev WHERE task_name = 'view'
    UNION ALL SELECT username, row_id, log_time, 2, 'activate', '    activate Broker' FROM ev WHERE task_name = 'signup'
    UNION ALL SELECT username, row_id, log_time, 5, 'message', '    Store->>Worker: ' || chr(39) || 'persisted job ' || row_id || chr(39) FROM ev WHERE task_name = 'click'
    UNION ALL SELECT username, row_id, log_time, 7, 'message', '    Broker->>Client: ' || chr(39) || 'response' || chr(39) FROM ev WHERE task_name = 'error'
    UNION ALL SELECT username, row_id, log_time, 8, 'deactivate', '    deactivate Broker' FROM ev WHERE task_name = 'error'),
    sw AS (SELECT *, lag(type) OVER (PARTITION BY username ORDER BY log_time, row_id, rule_no) AS before FROM h WHERE type IN ('activate', 'deactivate')),
    el AS (SELECT username, row_id, log_time, rule_no, line FROM h WHERE type NOT IN ('activate', 'deactivate') UNION ALL SELECT username, row_id, log_time, rule_no, line FROM sw WHERE type = 'activate' OR before = 'activate')
    SELECT username, count(*) AS elements, concat('sequenceDiagram', chr(10), '    title Process interaction sequence', chr(10), '    participant Client', chr(10), '    participant Broker', chr(10), '    participant Worker', chr(10),
        '    participant Store', chr(10), string_agg(line || chr(10), '' ORDER BY log_time, row_id, rule_no)) AS markup FROM el GROUP BY username""",
)
def process_diagrams(spark, sf_dir):
    """The pack of requests between processes over lines of its shapes, a diagram for each user."""
    e, row, who = event_rows(spark, sf_dir), F.col("row_id").cast("string"), F.col("username")
    lines = {
        "purchase": F.concat(F.lit("Client process started pid="), who), "view": F.concat(F.lit("Client sending request to Broker req="), row), "signup": F.lit("Broker received request"),
        "click": F.concat(F.lit("Store persisted job "), row), "error": F.lit("Broker responding to Client"),
    }
    return sequence.diagram_texts(_told(e, lines), packs.PROCESS_INTERACTION_UML, ["username"])


_DISM = f"""{EV}, h AS (SELECT row_id, log_time, 1 AS rule_no, 'note' AS type, '    note over API: ' AS head, 'OS 10.0.' || row_id % 500 || ' (amd64)' AS text FROM ev WHERE task_name = 'purchase'
    UNION ALL SELECT row_id, log_time, 2, 'activate', '    activate API', '' FROM ev WHERE task_name = 'signup'
    UNION ALL SELECT row_id, log_time, 3, 'message', '    API->>Mgr: ', 'load local image session' FROM ev WHERE task_name = 'view'
    UNION ALL SELECT row_id, log_time, 6, 'message', '    Store-->>Prov: ', CASE WHEN row_id % 2 = 0 THEN 'WimManager' ELSE 'VHDManager' END || ': not for this image' FROM ev WHERE task_name = 'click'
    UNION ALL SELECT row_id, log_time, 8, 'message', '    Mgr-->>API: ', 'shutdown session' FROM ev WHERE task_name = 'error'
    UNION ALL SELECT row_id, log_time, 9, 'deactivate', '    deactivate API', '' FROM ev WHERE task_name = 'error'),
    sw AS (SELECT *, lag(type) OVER (ORDER BY log_time, row_id, rule_no) AS before FROM h WHERE type IN ('activate', 'deactivate')),
    el AS (SELECT * FROM h WHERE type NOT IN ('activate', 'deactivate') UNION ALL SELECT row_id, log_time, rule_no, type, head, text FROM sw WHERE type = 'activate' OR before = 'activate'),
    one AS (SELECT head, text, count(*) AS n, min((log_time, row_id, rule_no)) AS first_at FROM el GROUP BY 1, 2),
    shown AS (SELECT CASE WHEN text = '' THEN head ELSE head || chr(39) || text || CASE WHEN n > 1 THEN ' ×' || n ELSE '' END || chr(39) END AS line, row_number() OVER (ORDER BY first_at) AS place FROM one)"""


@query(
    "dism_diagram",
    f"""WITH {_DISM} SELECT CAST(unnest(range(6)) AS INTEGER) AS line_no, unnest(['sequenceDiagram', '    title DISM session interaction', '    participant API as DismApi', '    participant Mgr as "DISM Manager"',
        '    participant Store as "Provider Store"', '    participant Prov as "Imaging Providers"']) AS line
    UNION ALL SELECT CAST(place + 5 AS INTEGER), line FROM shown WHERE place <= 200
    UNION ALL SELECT 206, '    note over API: ' || chr(39) || 'diagram truncated at 200 elements' || chr(39) WHERE (SELECT count(*) FROM shown) > 200""",
)
def dism_diagram(spark, sf_dir):
    """The output pack of servicing sessions: its diagram of all events, equal elements once, written and read back by line."""
    e, row = event_rows(spark, sf_dir), F.col("row_id")
    lines = {
        "purchase": F.concat(F.lit("Host machine information: OS Version=10.0."), (row % 500).cast("string"), F.lit(", Running architecture=amd64")), "signup": F.lit("Created g_internalDismSession"),
        "view": F.lit("Successfully loaded the ImageSession"), "click": F.concat(F.lit("The provider "), F.when(row % 2 == 0, "WimManager").otherwise("VHDManager"), F.lit(" does not support CreateDismImage on C:\\")),
        "error": F.lit("DismShutdownInternal"),
    }
    paths = sinks.run_output_rules(_told(e, lines), packs.DISM_INTERACTION["sections"], scratch(spark, "diagram"))
    # Two hundred elements at most.
    whole = spark.read.text(paths[0], wholetext=True).select(F.regexp_replace("value", r"\n\z", "").alias("value"))
    return whole.select(F.posexplode(F.split("value", "\n")).alias("line_no", "line"))


@query(
    "pack_reports",
    f"""WITH {EV} SELECT 'crash' AS report, 'time=' || {_T} || ' | source=events | machine= | message=Faulting application name: app' || username || '.exe' AS line FROM ev WHERE task_name = 'error'
    UNION ALL SELECT 'power', {_T} || '|events|The system uptime is ' || username || ' seconds.' FROM ev WHERE task_name = 'purchase'""",
)
def pack_reports(spark, sf_dir):
    """The output packs of crashes (text) and of a machine's power (CSV), written and read back."""
    who = F.col("username")
    lines = {"error": F.concat(F.lit("Faulting application name: app"), who, F.lit(".exe")), "purchase": F.concat(F.lit("The system uptime is "), who, F.lit(" seconds."))}
    both = packs.CRASH_REPORT["sections"] + packs.POWER_TIMELINE["sections"]
    crash, power = sinks.run_output_rules(_told(event_rows(spark, sf_dir), lines), both, scratch(spark, "reports"))
    rows = spark.read.schema("time string, source string, message string").csv(power, header=True)
    return spark.read.text(crash).select(F.lit("crash").alias("report"), F.col("value").alias("line")).unionByName(rows.select(F.lit("power").alias("report"), F.concat_ws("|", "time", "source", "message").alias("line")))


@query(
    "auto_packs",
    f"""WITH {EV} SELECT 0 AS no, 'noise-filter.rules.json' AS rule_file UNION ALL SELECT 3, 'pii-filter.rules.json' UNION ALL SELECT 4, 'pii-redact.rules.json'
    UNION ALL SELECT unnest([5, 6]), unnest(['dism-interaction.rules.json', 'dism-fields.rules.json']) WHERE EXISTS (SELECT 1 FROM ev WHERE task_name = 'click')
    UNION ALL SELECT 9, 'panther-fields.rules.json' WHERE EXISTS (SELECT 1 FROM ev WHERE task_name = 'view' AND username = '7')
    UNION ALL SELECT unnest([10, 11]), unnest(['crash-filter.rules.json', 'crash-report.rules.json']) WHERE EXISTS (SELECT 1 FROM ev WHERE task_name = 'error')
    UNION ALL SELECT unnest([12, 13]), unnest(['machine-power-filter.rules.json', 'machine-power-timeline.rules.json']) WHERE EXISTS (SELECT 1 FROM ev WHERE task_name = 'none such')""",
)
def auto_packs(spark, sf_dir):
    """Which packs apply by themselves to events whose sources and providers depend on their rows."""
    kind = F.col("task_name")
    source = F.when(kind == "click", "/logs/dism.log").when((kind == "view") & (F.col("username") == "7"), "/logs/setupact.log").otherwise("/logs/app.log")
    provider = F.when(kind == "error", "application error").when(kind == "none such", "EventLog").otherwise("app")
    return rules.auto_rules(event_rows(spark, sf_dir).withColumns({"source": source, "provider": provider}), packs.AUTO_PACKS)


@query("preview_extract", f"WITH {EV} SELECT row_id, message AS before, trim(regexp_replace(regexp_replace(regexp_replace(message, 'user=[0-9]+', ''), '\\{{\"k\": [0-9]+\\}}', ''), '\\s{{2,}}', ' ', 'g')) AS after, 'u' || username AS thread_id FROM ev ORDER BY row_id LIMIT 500")
def preview_extract(spark, sf_dir):
    """What extraction makes of the first 500 events, beside what they were."""
    return rules.preview_extract(event_rows(spark, sf_dir).orderBy("row_id"), EXTRACT_RULES, 500).select("row_id", "before", "after", "thread_id")


_SAID = f"""{EV}, t AS (SELECT unnest(['keyed', CASE WHEN task_name = 'purchase' THEN 'buy' END, CASE WHEN level = 1 THEN 'fault' END]) AS tag FROM ev),
    n AS (SELECT tag, count(*) AS n FROM t WHERE tag IS NOT NULL GROUP BY 1),
    total AS (SELECT sum(n) + 2 * (SELECT count(*) FROM ev) + (SELECT count(*) FROM ev WHERE task_name = 'purchase') AS total FROM n),
    said AS (SELECT 'rule tags' AS processor, 0 AS no, 'Found ' || CAST(total AS BIGINT) || ' results' AS value FROM total UNION ALL SELECT 'rule tags', 1, 'Tags found:'
    UNION ALL SELECT 'rule tags', CAST(1 + row_number() OVER (ORDER BY n DESC, tag) AS INTEGER), '  ' || tag || ': ' || n FROM n
    UNION ALL SELECT 'count', 0, 'There were: ' || count(*) || ' results.' FROM ev)"""


@query("processed", f"WITH {_SAID} SELECT * FROM said UNION ALL SELECT 'sales', 0, 'There were: ' || count(*) || ' results.' FROM ev WHERE task_name = 'purchase'")
def processed(spark, sf_dir):
    """Processors of all events and of the rows that rules route to one, written as text and read back in order."""
    e, path = event_rows(spark, sf_dir), scratch(spark, "processed")
    lines = processors.process(e, ["count", "rule tags"], {"rule tags": processors.tag_report(EXTRACT_RULES)})
    # ``count`` is a processor too, but no rule routes to it.
    sales = processors.process_routes(rules.route(e, EXTRACT_RULES), {"sales": processors.count_lines}).where("processor = 'sales'")
    processors.write_processed(lines.unionByName(sales), path)
    # A few lines a processor.
    whole = spark.read.text(path, wholetext=True).select("processor", F.regexp_replace("value", r"\n\z", "").alias("value"))
    return whole.select("processor", F.posexplode(F.split("value", "\n")).alias("no", "value"))


@query("quiet_actions", f"WITH {EV} SELECT row_id, message, CAST(task_name = 'error' AS INTEGER) AS tags FROM ev")
def quiet_actions(spark, sf_dir):
    """Actions that only a desktop shows (message, notification) leave rows as they are, beside a tag that counts."""
    own = {"sections": [{"purpose": "enrichment", "rules": [
        {"name": "tell", "match": ".", "actions": [{"type": "message", "text": "seen"}, {"type": "notification", "title": "t"}]},
        {"name": "fault", "match": "^error", "actions": [{"type": "notification"}, {"type": "tag", "tag": "fault"}]},
    ]}]}
    return rules.enrich(event_rows(spark, sf_dir), own).select("row_id", "message", F.size("tags").alias("tags"))


@query("relative_dates", "SELECT 'within a week' AS rule, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY UNION ALL SELECT 'before two days', count(*) FROM events WHERE ts <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY UNION ALL SELECT 'after 36 hours', count(*) FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 36 HOUR")
def relative_dates(spark, sf_dir):
    """Rules whose dates are spans back from a time, here the newest event's."""
    e = event_rows(spark, sf_dir)
    now = e.agg(F.max("log_time")).first()[0]
    ranges = {"within a week": {"withinLast": "7d"}, "before two days": {"before": "-2d"}, "after 36 hours": {"after": "-36h"}}
    counts = e.agg(*[F.count_if(rule_matches({"dateRange": r}, now=now)).alias(name) for name, r in ranges.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.col(name).alias("n")) for name in ranges])).alias("x")).select("x.*")


@query("write_results_tables", f"WITH {EV} SELECT f.format, task_name AS task, CASE level WHEN 1 THEN 'Error' ELSE 'Info' END AS level, count(*) AS n, CAST(sum(length(message)) AS BIGINT) AS chars FROM ev, (VALUES ('csv'), ('json')) AS f(format) GROUP BY 1, 2, 3")
def write_results_tables(spark, sf_dir):
    """The fixed eight columns as CSV and as JSON, read back."""
    e, parts = event_rows(spark, sf_dir), []
    for fmt in ("csv", "json"):
        path = scratch(spark, fmt)
        sinks.write_results(e, path, fmt)
        back = spark.read.csv(path, header=True, escape='"') if fmt == "csv" else spark.read.json(path)
        parts.append(back.groupBy(F.lit(fmt).alias("format"), F.col("taskname").alias("task"), "level").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("message")).alias("chars")))
    return reduce(DataFrame.unionByName, parts)


@query("source_rows", "SELECT CASE WHEN i % 20 = 0 THEN 1 WHEN i % 7 = 0 THEN 2 WHEN i % 13 = 0 THEN 4 ELSE 3 END AS level, count(*) AS n, min(i) AS low, max(i) AS high FROM (SELECT unnest(range((SELECT count(*) FROM events))) AS i) WHERE i >= 100 GROUP BY 1")
def source_rows(spark, sf_dir):
    """Rows of the synthetic source, as many as there are events, from the hundredth on."""
    register(spark)
    rows = spark.read.format("synthetic_logs").option("rows", event_rows(spark, sf_dir).count()).load()
    return rows.where("row_id >= 100").groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("low"), F.max("row_id").alias("high"))


@query("row_by_id", f"WITH {EV} SELECT row_id, message FROM ev WHERE row_id = (SELECT max(row_id) FROM ev)")
def row_by_id(spark, sf_dir):
    rows = event_rows(spark, sf_dir)
    return paging.get_row(rows, rows.agg(F.max("row_id")).first()[0]).select("row_id", "message")


@query("positions", f"WITH {EV} SELECT row_id, row_number() OVER (ORDER BY log_time DESC, row_id) - 1 AS position FROM ev")
def positions(spark, sf_dir):
    return paging.with_position(event_rows(spark, sf_dir), SortSpec("Time", True)).select("row_id", "position")


@query("deep_page", "SELECT l_orderkey AS row_id, l_linenumber AS level FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 50 OFFSET (SELECT CAST(count(*) * 9 / 10 AS BIGINT) FROM lineitem)")
def deep_page(spark, sf_dir):
    """Page far down a long table, by the numbered order."""
    rows = as_events(table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_id"), F.col("l_linenumber").alias("level"), F.col("l_returnflag").alias("message")))
    at = rows.count() * 9 // 10
    placed = paging.with_position(rows, SortSpec())
    return placed.where((F.col("position") >= at) & (F.col("position") < at + 50)).select(F.expr("row_id div 8").alias("row_id"), "level")


@query("page_number", f"WITH {EV} SELECT CAST(floor(count(*) / 25) AS BIGINT) AS page FROM ev WHERE row_id < (SELECT max(row_id) FROM ev)")
def page_number(spark, sf_dir):
    rows = event_rows(spark, sf_dir)
    last = rows.agg(F.max("row_id")).first()[0]
    page = paging.page_of(paging.row_position(rows, SortSpec(), last), 25)
    return rows.agg(F.lit(page).cast("long").alias("page"))


@query("two_values", f"WITH {EV} SELECT count(DISTINCT provider) > 1 AS provider, count(DISTINCT task_name) > 1 AS task_name FROM ev")
def two_values(spark, sf_dir):
    rows = event_rows(spark, sf_dir)
    return rows.agg(*[F.lit(analysis.has_two_values(rows, c)).alias(c) for c in ("provider", "task_name")])


@query("counts_large_set", f"WITH {EV} SELECT count(*) AS total, count(*) FILTER (WHERE task_name = 'click' AND level = 3) AS filtered, count(*) FILTER (WHERE task_name = 'click' AND level = 3) AS info FROM ev")
def counts_large_set(spark, sf_dir):
    """Counts and summary under a set that is too large for the plan."""
    spec = FilterSpec(task_names=frozenset([f"none {i}" for i in range(1200)] + ["CLICK"]), level="Info")
    rows = event_rows(spark, sf_dir)
    two = analysis.summary(rows, spec).select(F.col("filtered").alias("again"), "info")
    return analysis.counts(rows, spec).crossJoin(F.broadcast(two)).where("filtered = again").select("total", "filtered", "info")  # one row each


@query("regex_backreference", f"WITH {DL} SELECT row_id FROM dl WHERE regexp_matches(message, 'aa|bb|cc|dd|ee|ff|gg|hh|ii|jj|kk|ll|mm|nn|oo|pp|qq|rr|ss|tt|uu|vv|ww|xx|yy|zz') OR regexp_matches(message, '[A-Za-z0-9]qu')")
def regex_backreference(spark, sf_dir):
    """Back-references and nested classes, whose signs no text need hold."""
    sections = [{"name": "r", "purpose": "filter", "rules": [
        {"name": "twice", "match": r"(?-i)(?<q>[a-z])\k<q>", "action": {"type": "include"}}, {"name": "class", "match": r"(?-i)[\w&&[A-Za-z0-9]]qu", "action": {"type": "include"}},
    ]}]
    return rules.rules_filter_view(document_lines(spark, sf_dir), {"sections": sections}).select("row_id")


@query("saved_index", f"WITH {EV} SELECT row_id, level, task_name FROM ev WHERE contains(message, 'user=42')")
def saved_index(spark, sf_dir):
    """A trigram index saved by two ranges of ids, one of them twice, and searched."""
    rows, path = event_rows(spark, sf_dir), scratch(spark, "index")
    middle = rows.agg(F.expr("max(row_id) div 2")).first()[0]
    trigram.save_trigrams(rows, path, 0, middle)
    trigram.save_trigrams(rows, path, 0, middle)
    trigram.save_trigrams(rows, path, middle)
    return _ids(trigram.search_indexed(rows, trigram.load_trigrams(spark, path), "USER=42"))


# Stores and streams.


_TWICE = " UNION ALL ".join(
    f"SELECT '{step}' AS step, '{tag}' AS tag, level, count(*) AS n FROM ev WHERE {where} GROUP BY level"
    for step, tag, where in (("1 loaded", "a", "true"), ("2 other rules", "b", "true"), ("3 a file gone", "b", "task_name <> 'click'"), ("4 compacted", "b", "task_name <> 'click'"))
)


@query("ingest_twice", f"WITH {EV} {_TWICE}")
def ingest_twice(spark, sf_dir):
    """A folder with a file for each kind of event is loaded, loaded under other rules, loses a kind, and is compacted; the store after each step."""
    folder, store = scratch(spark, "folder"), scratch(spark, "versions")
    e = event_rows(spark, sf_dir)
    e.select("task_name", F.concat(F.when(F.col("level") == 1, "ERROR ").otherwise("INFO "), "message").alias("value")).repartition("task_name").write.partitionBy("task_name").text(folder)
    seen = []

    def state(step: str) -> None:
        path = scratch(spark, "state")  # as the store was then
        read_store(spark, store).groupBy(F.element_at("tags", 1).alias("tag"), "level").agg(F.count(F.lit(1)).alias("n")).write.parquet(path)
        seen.append(spark.read.parquet(path).withColumn("step", F.lit(step)))

    for step, tag in (("1 loaded", "a"), ("2 other rules", "b"), ("3 a file gone", "b")):
        if step.startswith("3"):
            remove(spark, f"{folder}/task_name=click")
        ingest_incremental(spark, folder, store, lambda s, p, tag=tag: read_text_logs(s, p, ids=True).withColumn("tags", F.array(F.lit(tag))), tag)
        state(step)
    compact(spark, store)
    state("4 compacted")
    return reduce(DataFrame.unionByName, seen)


@query("step_records", f"WITH {EV} SELECT 'store' AS step, count(*) AS records FROM ev UNION ALL SELECT 'errors', count(*) FROM ev WHERE level = 1")
def step_records(spark, sf_dir):
    """Records of the steps of a run, counted by the steps' own jobs."""
    report, path = analysis.RunReport(), scratch(spark, "steps")
    with report.timed("store"):
        sinks.save_events(report.observed(event_rows(spark, sf_dir), "store"), path)
    with report.timed("errors"):
        report.observed(sinks.load_events(spark, path).where("level = 1"), "errors").write.parquet(scratch(spark, "errors"))
    return spark.createDataFrame([(r["step"], r["records"]) for r in report.rows()], "step string, records long")


def _event_lines(spark: SparkSession, sf_dir: str) -> str:
    """A folder of text files with a line for each event, each twice."""
    line = F.concat(F.when(F.col("level") == 1, "ERROR ").otherwise("INFO "), "task_name")
    lines = event_rows(spark, sf_dir).select(line.alias("value")).withColumn("value", F.explode(F.array("value", "value")))
    return _lines(lines, F.col("value"), "grown")


def _ingested(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, object]:
    """Event lines, each twice, streamed into a store; the store and the finished query."""
    path = _event_lines(spark, sf_dir)
    store = scratch(spark, "store")
    q = streaming.ingest(streaming.stream_events(spark, path), store, scratch(spark, "progress"), enrich=lambda df: df.withColumn("tags", F.array(F.lit("seen"))))
    q.awaitTermination()
    return spark.read.parquet(store), q


@query("stream_ingest", f"WITH {EV} SELECT level, 2 * count(*) AS n, 2 * count(*) AS ids, 2 * count(*) AS tagged FROM ev GROUP BY 1")
def stream_ingest(spark, sf_dir):
    """Lines streamed into a store with an enrichment; equal lines have ids of their own."""
    stored, _ = _ingested(spark, sf_dir)
    return stored.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("row_id").alias("ids"), F.count_if(F.array_contains("tags", "seen")).alias("tagged"))


@query("stream_progress", f"WITH {EV} SELECT 2 * count(*) AS n, CAST(2 * count(*) AS BIGINT) AS rows, false AS active FROM ev")
def stream_progress(spark, sf_dir):
    stored, q = _ingested(spark, sf_dir)
    seen = streaming.progress(q)
    return stored.agg(F.count(F.lit(1)).alias("n")).withColumns({"rows": F.lit(seen["rows"]).cast("long"), "active": F.lit(seen["active"])})


@query("stream_bounded", f"WITH {EV} SELECT least(2 * count(*), 777) AS n, least(2 * count(*), 777) AS ids, 0 AS low, least(2 * count(*), 777) - 1 AS high FROM ev")
def stream_bounded(spark, sf_dir):
    """A collection that ends at its 777th event."""
    got = streaming.collect_bounded(streaming.stream_events(spark, _event_lines(spark, sf_dir), files_per_batch=1), scratch(spark, "store"), scratch(spark, "progress"), most=777)
    return got.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("row_id").alias("ids"), F.min("row_id").alias("low"), F.max("row_id").alias("high"))


@query("ids_of_streams", f"WITH {EV} SELECT 5 * count(*) AS n, 5 * count(*) AS ids FROM ev")
def ids_of_streams(spark, sf_dir):
    """A streamed store with itself and with events that have ids of their own: as many ids as rows."""
    stored, _ = _ingested(spark, sf_dir)
    hashed = event_rows(spark, sf_dir).withColumn("row_id", F.xxhash64("row_id"))
    return union_sources([stored, stored, renumbered(hashed)]).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("row_id").alias("ids"))


@query("index_of_stream", f"WITH {EV} SELECT level, 2 * count(*) AS n FROM ev WHERE contains(task_name, 'chase') GROUP BY 1")
def index_of_stream(spark, sf_dir):
    """A streamed store is indexed, half of it under ids below 0, and searched."""
    stored, _ = _ingested(spark, sf_dir)
    half = F.when(F.col("row_id") % 2 == 0, F.col("row_id")).otherwise(-F.col("row_id") * 1_000_003)
    rows, path = stored.withColumn("row_id", half), scratch(spark, "index")
    trigram.save_trigrams(rows, path)
    return trigram.search_indexed(rows, trigram.load_trigrams(spark, path), "CHASE").groupBy("level").agg(F.count(F.lit(1)).alias("n"))


@query("stream_collected", f"WITH {CV} SELECT count(*) AS n FROM cv, (SELECT 1) WHERE trim(replace(replace(message, chr(10), ' '), chr(13), ' ')) <> ''")
def stream_collected(spark, sf_dir):
    """A collection that ends when what is there is read."""
    rows = conversation_rows(spark, sf_dir)
    path = _lines(rows, F.regexp_replace("message", r"[\r\n]", " "), "live")
    return streaming.collect_bounded(streaming.stream_events(spark, path), scratch(spark, "store"), scratch(spark, "progress")).agg(F.count(F.lit(1)).alias("n"))
