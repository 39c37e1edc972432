"""The operators as named queries over the driver's tables, with their SQL."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom import sinks, streaming
from logloom.functions.parse import line_level, line_time, parse_level, parse_time, trace_level
from logloom.functions.text import template
from logloom.model import as_events
from logloom.operators import analysis, overlay, packs, paging, rewrite, rules, sequence, trigram
from logloom.plans.durable import scratch, spread
from logloom.plans.scope import apply_scope, build_scope
from logloom.plans.search import any_contains, search, where_query
from logloom.plans.spec import FilterSpec, SortSpec, apply_filters, filter_all, last_minutes
from logloom.sources.folder import filter_source_types, source_type, union_sources
from logloom.sources.incremental import new_files
from logloom.sources.mapper import columns_to_events, map_to_events
from logloom.sources.tables import rows_to_events
from logloom.sources.text import lines_to_events
from logloom.sources.trace import trace_lines_to_events

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Lines of a document in the adapters' row ids.
LINES = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Adapters: driver tables as events.


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    message = F.concat_ws(" ", "event_type", F.concat(F.lit("user="), F.col("user_id").cast("string")), "props")
    return as_events(
        e.select(
            F.col("event_id").alias("row_id"), F.col("ts").cast("timestamp_ntz").alias("log_time"), parse_level(F.col("event_type")).alias("level"), F.lit("events").alias("provider"), F.col("event_type").alias("task_name"),
            F.col("user_id").cast("string").alias("username"), F.lit("events").alias("source"), message.alias("message"), message.alias("searchable"), F.from_json("props", "map<string,string>").alias("fields"),
        )
    )


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents")).select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("line", "value"))
    rows = d.where(F.trim("value") != "")
    return as_events(
        rows.select(
            (F.col("doc_id") * LINES + F.col("line")).alias("row_id"), line_level(F.col("value")).alias("level"), F.col("lang").alias("provider"), F.concat(F.col("source"), F.lit(".log")).alias("source"),
            F.col("doc_id").cast("string").alias("activity_id"), F.col("value").alias("message"), F.col("value").alias("searchable"),
        )
    )


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    level = F.when(F.col("o_orderpriority") == "1-URGENT", 1).when(F.col("o_orderpriority") == "2-HIGH", 2).otherwise(3)
    return as_events(
        o.select(
            F.col("o_orderkey").alias("row_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("log_time"), level.alias("level"), F.lit("orders").alias("provider"), F.col("o_orderstatus").alias("task_name"),
            F.col("o_custkey").cast("string").alias("username"), F.lit("orders.csv").alias("source"), F.col("o_orderpriority").alias("message"), F.col("o_orderpriority").alias("searchable"), F.col("o_orderkey").cast("string").alias("event_id"),
        )
    )


def conversation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return as_events(
        c.select(
            (F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), F.col("role").alias("provider"), F.col("conv_id").cast("string").alias("activity_id"), F.lit("conversations.jsonl").alias("source"),
            F.substring(F.col("text"), 1, 40).alias("task_name"), F.col("text").alias("message"), F.col("text").alias("searchable"),
        )
    )


def page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return as_events(p.select(F.col("page_id").alias("row_id"), F.lit("pages").alias("provider"), F.col("url").alias("source"), F.col("html").alias("message"), F.col("html").alias("searchable")))


# The adapters as SQL.
_LEVEL_OF_LINE = """CASE WHEN contains(lower({0}), 'critical') OR contains(lower({0}), 'fatal') THEN 0 WHEN contains(lower({0}), 'error') THEN 1
    WHEN contains(lower({0}), 'warn') THEN 2 WHEN contains(lower({0}), 'debug') OR contains(lower({0}), 'verbose') THEN 4 ELSE 3 END"""
EV = """ev AS (SELECT event_id AS row_id, ts AS log_time, CASE WHEN event_type = 'error' THEN 1 ELSE 3 END AS level, 'events' AS provider, event_type AS task_name,
    CAST(user_id AS VARCHAR) AS username, 'events' AS source, concat_ws(' ', event_type, 'user=' || user_id, props) AS message FROM events)"""
DL = f"""dl0 AS (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS message, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents),
dl AS (SELECT doc_id * {LINES} + line AS row_id, {_LEVEL_OF_LINE.format('message')} AS level, lang AS provider, source || '.log' AS source, CAST(doc_id AS VARCHAR) AS activity_id, message
    FROM dl0 WHERE trim(message) <> '')"""
ORD = """od AS (SELECT o_orderkey AS row_id, o_orderdate AS log_time, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 3 END AS level, 'orders' AS provider,
    o_orderstatus AS task_name, CAST(o_custkey AS VARCHAR) AS username, o_orderpriority AS message FROM orders)"""
CV = "cv AS (SELECT conv_id * 1000 + turn AS row_id, role AS provider, CAST(conv_id AS VARCHAR) AS activity_id, conv_id, turn, text AS message, left(text, 40) AS task_name FROM conversations)"
_T = "strftime(log_time, '%Y-%m-%d %H:%M:%S')"


def query(name: str, sql: str | None = None):
    """Registers a query, and its SQL if SQL can say it."""

    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


def _time_text(c: str = "log_time"):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def _ids(df: DataFrame) -> DataFrame:
    return df.select("row_id", "level", "task_name")


# Searches and filters.


def _search(name: str, text: str, condition: str) -> None:
    @query(name, f"WITH {EV} SELECT row_id, level, task_name FROM ev WHERE {condition}")
    def run(spark, sf_dir):
        return _ids(event_rows(spark, sf_dir).where(where_query(text)))


_search("where_eq_and_ne", "level == Error AND user != 17", "level = 1 AND username <> '17'")
_search("where_contains_not", "task ~ IC and not msg ~ 'user=1'", "contains(lower(task_name), 'ic') AND NOT contains(lower(message), 'user=1')")
_search("where_or_parens", "(task == CLICK or task == view) and (user == 3 or user == 5)", "task_name IN ('click', 'view') AND username IN ('3', '5')")
_search("where_ordered_numeric", "user >= 20 user < 100", "CAST(username AS DOUBLE) >= 20 AND CAST(username AS DOUBLE) < 100")
_search("where_time", "time >= '2024-01-10T00:00:00' and time < 2024-01-12", "log_time >= TIMESTAMP '2024-01-10' AND log_time < TIMESTAMP '2024-01-12'")
_search("where_quoted_and_level_order", "level <= Error and msg ~ \"user=\"", "level <= 1 AND contains(message, 'user=')")


@query("where_bare_term", f"WITH {EV} SELECT row_id, level, task_name FROM ev WHERE contains(lower(message), 'purchase') AND contains(lower(message), '\"k\": 1')")
def where_bare_term(spark, sf_dir):
    return _ids(search(event_rows(spark, sf_dir), "purchase AND '\"k\": 1'"))


@query("global_search", f"WITH {DL} SELECT row_id, message FROM dl WHERE contains(lower(message), 'ing the') OR contains(lower(provider), 'ing the') OR contains(lower(source), 'ing the')")
def global_search(spark, sf_dir):
    return document_lines(spark, sf_dir).where(any_contains("ING the")).select("row_id", "message")


@query("search_literal_percent", f"WITH {DL} SELECT row_id FROM dl WHERE contains(message, '%%%') AND NOT contains(message, '$_')")
def search_literal_percent(spark, sf_dir):
    return document_lines(spark, sf_dir).where(where_query("msg ~ '%%%' and not msg ~ '$_'")).select("row_id")


@query("column_filters", f"WITH {DL} SELECT row_id FROM dl WHERE contains(provider, 'e') AND contains(source, 'src1') AND contains(lower(message), 'tion')")
def column_filters(spark, sf_dir):
    return apply_filters(document_lines(spark, sf_dir), FilterSpec(provider="E", source="SRC1", message="tion")).select("row_id")


@query("or_sets", f"WITH {EV} SELECT row_id, level, task_name FROM ev WHERE task_name IN ('click', 'view')")
def or_sets(spark, sf_dir):
    return _ids(apply_filters(event_rows(spark, sf_dir), FilterSpec(task_names=frozenset({"CLICK", "View"}), task_name="purchase")))


@query("large_or_set", f"WITH {DL} SELECT row_id FROM dl WHERE CAST(regexp_extract(source, '([0-9]+)', 1) AS INT) < 1500 AND source <> 'src3.log'")
def large_or_set(spark, sf_dir):
    names = frozenset(f"SRC{i}.log" for i in range(1500) if i != 3)
    return apply_filters(document_lines(spark, sf_dir), FilterSpec(sources=names)).select("row_id")


@query("level_set", f"WITH {ORD} SELECT row_id, level, task_name FROM od WHERE level IN (1, 2)")
def level_set(spark, sf_dir):
    return _ids(apply_filters(order_rows(spark, sf_dir), FilterSpec(levels=frozenset({"Error", "warn", "no such level"}))))


@query("time_window", f"WITH {EV} SELECT row_id, level, task_name FROM ev WHERE log_time >= TIMESTAMP '2024-01-05' AND log_time <= TIMESTAMP '2024-01-06 12:00:00'")
def time_window(spark, sf_dir):
    return _ids(apply_filters(event_rows(spark, sf_dir), FilterSpec(time_from=dt.datetime(2024, 1, 5), time_to=dt.datetime(2024, 1, 6, 12))))


@query("last_24h", f"WITH {EV} SELECT row_id, level, task_name FROM ev WHERE log_time >= (SELECT max(log_time) FROM ev) - INTERVAL 1 DAY")
def last_24h(spark, sf_dir):
    return _ids(last_minutes(event_rows(spark, sf_dir), 24 * 60))


@query("combined_filters", f"WITH {EV} SELECT row_id, level, task_name FROM ev WHERE level = 1 AND log_time >= TIMESTAMP '2024-01-10' AND contains(message, '\"k\": 5')")
def combined_filters(spark, sf_dir):
    return _ids(apply_filters(event_rows(spark, sf_dir), FilterSpec(level="Error", time_from=dt.datetime(2024, 1, 10), search='"k": 5')))


@query("row_predicates", f"WITH {EV} SELECT row_id, level, task_name FROM ev WHERE row_id % 3 = 0 AND length(username) = 2")
def row_predicates(spark, sf_dir):
    return _ids(filter_all(event_rows(spark, sf_dir), [F.col("row_id") % 3 == 0, F.length("username") == 2]))


@query("source_type_toggle", f"WITH {DL} SELECT row_id FROM dl")
def source_type_toggle(spark, sf_dir):
    both = union_sources([document_lines(spark, sf_dir), order_rows(spark, sf_dir)])
    return filter_source_types(both, ["Text"]).select("row_id")


SCOPE_SECTIONS = [
    {"name": "a", "providers": ["en", "de", "fr"], "rules": [{"name": "s", "action": {"type": "scope", "levels": ["Info", "Error"]}}]},
    {"name": "b", "providers": ["fr"], "rules": [{"name": "x", "action": {"type": "scope", "providerMode": "exclude"}}]},
    {"name": "c", "providers": ["EN", "fr"], "rules": [{"name": "t", "action": {"type": "scope", "timeFrom": "2024-01-01"}}]},
]


@query("apply_scope", f"WITH {DL} SELECT row_id, provider FROM dl WHERE provider = 'en' AND level IN (1, 3) OR provider IS NULL AND level IN (1, 3)")
def scope_applied(spark, sf_dir):
    return apply_scope(document_lines(spark, sf_dir), build_scope(SCOPE_SECTIONS)).select("row_id", F.nullif("provider", F.lit("")).alias("provider"))


# Counts, facets, histograms.


@query("level_counts", f"WITH {ORD} SELECT level, CASE level WHEN 1 THEN 'Error' WHEN 2 THEN 'Warning' ELSE 'Info' END AS level_name, count(*) AS n FROM od GROUP BY 1, 2")
def level_counts(spark, sf_dir):
    return analysis.level_counts(order_rows(spark, sf_dir))


@query("distinct_levels", f"WITH {ORD} SELECT DISTINCT level FROM od")
def distinct_levels(spark, sf_dir):
    return analysis.distinct_levels(order_rows(spark, sf_dir))


@query("filtered_counts", f"WITH {EV} SELECT count(*) AS total, count(*) FILTER (level = 1) AS filtered FROM ev")
def filtered_counts(spark, sf_dir):
    return analysis.counts(event_rows(spark, sf_dir), FilterSpec(levels=frozenset({"Error"})))


@query("source_counts", f"WITH {DL} SELECT source, count(*) AS n FROM dl GROUP BY 1")
def source_counts(spark, sf_dir):
    return analysis.source_counts(document_lines(spark, sf_dir))


@query("source_type_counts", f"WITH {DL}, {ORD}, x AS (SELECT 'Text' AS source_type FROM dl UNION ALL SELECT 'CSV' FROM od) SELECT source_type, count(*) AS n FROM x GROUP BY 1")
def source_type_counts(spark, sf_dir):
    return analysis.source_type_counts(union_sources([document_lines(spark, sf_dir), order_rows(spark, sf_dir)]))


@query("field_counts", f"WITH {EV} SELECT task_name AS value, count(*) AS n FROM ev WHERE level = 3 GROUP BY 1")
def field_counts(spark, sf_dir):
    return analysis.field_counts(apply_filters(event_rows(spark, sf_dir), FilterSpec(level="info")), "task_name")


@query("facet_excluding_self", f"WITH {EV} SELECT task_name AS value, count(*) AS n FROM ev WHERE contains(message, 'user=7') GROUP BY 1")
def facet_excluding_self(spark, sf_dir):
    return analysis.facet_excluding_self(event_rows(spark, sf_dir), FilterSpec(task_names=frozenset({"click"}), message="user=7"), "task_name")


@query("facets_task", f"WITH {EV} SELECT task_name AS value, count(*) AS n FROM ev GROUP BY 1 ORDER BY n DESC, value LIMIT 3")
def facets_task(spark, sf_dir):
    return analysis.facets(event_rows(spark, sf_dir), "taskName", 3)


@query("facets_none", f"WITH {EV} SELECT CASE WHEN task_name = 'click' THEN 'Web' ELSE '(none)' END AS value, count(*) AS n FROM ev GROUP BY 1")
def facets_none(spark, sf_dir):
    rows = event_rows(spark, sf_dir).withColumn("channel", F.when(F.col("task_name") == "click", "Web").otherwise(""))
    return analysis.facets(rows, "channel")


@query("time_range", f"WITH {EV} SELECT strftime(min(log_time), '%Y-%m-%d %H:%M:%S') AS first_time, strftime(max(log_time), '%Y-%m-%d %H:%M:%S') AS last_time FROM ev")
def time_range(spark, sf_dir):
    return analysis.time_range(event_rows(spark, sf_dir)).select(_time_text("first_time").alias("first_time"), _time_text("last_time").alias("last_time"))


@query(
    "summary",
    f"""WITH {ORD}, h AS (SELECT *, task_name = 'F' AS hit FROM od) SELECT count(*) AS total, count(*) FILTER (hit) AS filtered, count(*) FILTER (hit AND level = 0) AS catastrophic,
    count(*) FILTER (hit AND level = 1) AS error, count(*) FILTER (hit AND level = 2) AS warning, count(*) FILTER (hit AND level = 3) AS info, count(*) FILTER (hit AND level = 4) AS verbose,
    count(*) FILTER (hit AND level = 5) AS unknown, strftime(min(log_time) FILTER (hit), '%Y-%m-%d %H:%M:%S') AS first_time, strftime(max(log_time) FILTER (hit), '%Y-%m-%d %H:%M:%S') AS last_time, 1 AS sources FROM h""",
)
def summary(spark, sf_dir):
    s = analysis.summary(order_rows(spark, sf_dir), FilterSpec(task_names=frozenset({"f"})))
    return s.withColumns({"first_time": _time_text("first_time"), "last_time": _time_text("last_time"), "sources": F.col("sources").cast("int")})


def _bucket_sql(n: int) -> str:
    return f"CASE WHEN hi = lo THEN 0 ELSE least(((t - lo) * {n}) // (hi - lo), {n - 1}) END"


@query(
    "histogram_20",
    f"""WITH {EV}, m AS (SELECT epoch_us(log_time) AS t FROM ev WHERE log_time IS NOT NULL), r AS (SELECT min(t) AS lo, max(t) AS hi FROM m),
    b AS (SELECT CAST({_bucket_sql(20)} AS INT) AS bucket, count(*) AS n FROM m, r GROUP BY 1), e AS (SELECT CAST(range AS INT) AS bucket FROM range(20))
    SELECT e.bucket, lo + (e.bucket * (hi - lo)) // 20 AS from_micros, lo + ((e.bucket + 1) * (hi - lo)) // 20 AS to_micros, CAST(coalesce(n, 0) AS BIGINT) AS n FROM e LEFT JOIN b USING (bucket), r""",
)
def histogram_20(spark, sf_dir):
    return analysis.histogram(event_rows(spark, sf_dir), 20)


@query(
    "density_48",
    f"""WITH {EV}, m AS (SELECT epoch_us(log_time) AS t, level FROM ev WHERE log_time IS NOT NULL), r AS (SELECT min(t) AS lo, max(t) AS hi FROM m)
    SELECT CAST({_bucket_sql(48)} AS INT) AS bucket, level, count(*) AS n FROM m, r GROUP BY 1, 2""",
)
def density_48(spark, sf_dir):
    return analysis.density(event_rows(spark, sf_dir), 48)


@query("errors_by_bucket", ORACLE["density_48"].replace("FROM ev WHERE", "FROM ev WHERE level = 1 AND"))
def errors_by_bucket(spark, sf_dir):
    """Flagship: errors over time."""
    return analysis.density(event_rows(spark, sf_dir).where(where_query("level == Error")), 48)


@query("provider_counts", f"WITH {DL} SELECT provider, count(*) AS n FROM dl GROUP BY 1")
def provider_counts(spark, sf_dir):
    return analysis.provider_counts(document_lines(spark, sf_dir))


@query("provider_by_source", f"WITH {DL} SELECT provider, source, count(*) AS n FROM dl GROUP BY 1, 2")
def provider_by_source(spark, sf_dir):
    return analysis.provider_by_source(document_lines(spark, sf_dir))


@query("files_per_reader", f"WITH {DL} SELECT 'Text' AS reader, count(DISTINCT source) AS files, count(*) AS rows FROM dl")
def files_per_reader(spark, sf_dir):
    return analysis.files_per_reader(document_lines(spark, sf_dir))


@query(
    "inventory",
    f"""WITH {EV} SELECT count(*) AS events, CAST(0 AS BIGINT) AS lost, CAST(0 AS BIGINT) AS kernel, count(*) AS self_describing,
    max(epoch_us(log_time)) - min(epoch_us(log_time)) AS duration_micros, CAST(1 AS BIGINT) AS providers FROM ev""",
)
def inventory(spark, sf_dir):
    return analysis.inventory(event_rows(spark, sf_dir))[0].drop("first_time", "last_time")


_TEMPLATE_SQL = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(message,
    '\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b', '{guid}', 'g'), '[A-Za-z]:\\[^\s"'']+', '{path}', 'g'), '"[^"]*"|''[^'']*''', '{str}', 'g'),
    '\b0x[0-9a-fA-F]+\b|\b[0-9a-fA-F]{16,}\b', '{hex}', 'g'), '\b[0-9]+\b', '{n}', 'g'), '\s+', ' ', 'g'))"""


@query("top_patterns", f"WITH {EV}, t AS (SELECT {_TEMPLATE_SQL} AS template, message, row_id FROM ev) SELECT template, count(*) AS n, arg_min(message, row_id) AS example FROM t GROUP BY 1 ORDER BY n DESC, template LIMIT 20")
def top_patterns(spark, sf_dir):
    return analysis.top_patterns(event_rows(spark, sf_dir), 20)


@query("line_templates", f"WITH {DL}, t AS (SELECT {_TEMPLATE_SQL} AS s FROM dl), c AS (SELECT CASE WHEN length(s) > 200 THEN left(s, 200) || '…' ELSE s END AS template FROM t) SELECT template, count(*) AS n FROM c GROUP BY 1")
def line_templates(spark, sf_dir):
    return document_lines(spark, sf_dir).select(template(F.col("message")).alias("template")).groupBy("template").agg(F.count(F.lit(1)).alias("n"))


# Sorts and pages.


@query("page", f"WITH {EV} SELECT row_id, level, task_name FROM ev ORDER BY task_name DESC, row_id LIMIT 50 OFFSET 100")
def page(spark, sf_dir):
    return _ids(paging.page(event_rows(spark, sf_dir), SortSpec("TaskName", True), 100, 50))


@query("last_page", f"WITH {EV}, k AS (SELECT CASE count(*) % 64 WHEN 0 THEN 64 ELSE count(*) % 64 END AS k FROM ev), n AS (SELECT *, row_number() OVER (ORDER BY log_time DESC, row_id DESC) AS r FROM ev) SELECT row_id, level, task_name FROM n, k WHERE r <= k")
def last_page(spark, sf_dir):
    return _ids(paging.last_page(event_rows(spark, sf_dir), SortSpec("Time"), 64))


@query("row_position", f"WITH {EV}, n AS (SELECT row_id, row_number() OVER (ORDER BY task_name, row_id) - 1 AS position FROM ev WHERE level = 3) SELECT position, position // 100 AS page FROM n WHERE row_id = (SELECT max(row_id) FROM ev WHERE level = 3)")
def row_position(spark, sf_dir):
    rows = event_rows(spark, sf_dir).where("level = 3")
    last = rows.agg(F.max("row_id")).first()[0]
    position = paging.row_position(rows, SortSpec("TaskName"), last)
    return spark.range(1).select(F.lit(position).cast("long").alias("position"), F.lit(paging.page_of(position, 100)).cast("long").alias("page"))


@query(
    "context",
    f"WITH {EV}, n AS (SELECT *, row_number() OVER (ORDER BY log_time, row_id) AS r FROM ev), a AS (SELECT r AS pos FROM n WHERE row_id = (SELECT max(row_id) // 2 FROM ev)) SELECT row_id, level, task_name FROM n, a WHERE r BETWEEN pos - 5 AND pos + 7",
)
def context(spark, sf_dir):
    rows = event_rows(spark, sf_dir)
    middle = rows.agg(F.expr("max(row_id) div 2")).first()[0]
    return _ids(paging.context(rows, SortSpec("Time"), middle, 5, 7))


@query("follow_activity", f"WITH {CV} SELECT row_id, message FROM cv WHERE activity_id = '7' ORDER BY row_id LIMIT 500")
def follow_activity(spark, sf_dir):
    return paging.follow_activity(conversation_rows(spark, sf_dir), "7").select("row_id", "message")


@query("sort_events", f"WITH {EV} SELECT row_id, level, task_name FROM ev")
def sort_events(spark, sf_dir):
    return _ids(paging.sort_events(event_rows(spark, sf_dir), SortSpec("Level", True)))


# Rules.

_PII = [p for _, p, _, on in packs.PII if on]


def _re2(pattern: str) -> str:
    return pattern.replace("'", "''")


@query("rules_filter_view", f"WITH {DL} SELECT row_id FROM dl WHERE NOT regexp_matches(message, '(?i)password|token') AND regexp_matches(message, '(?i)licen[sc]e|ing the')")
def rules_filter_view(spark, sf_dir):
    own = {"sections": [{"purpose": "filter", "rules": [{"match": "password|token", "action": {"type": "exclude"}}, {"match": "licen[sc]e|ing the", "action": {"type": "include"}}, {"match": ".", "enabled": False, "action": {"type": "exclude"}}]}]}
    return rules.rules_filter_view(document_lines(spark, sf_dir), own).select("row_id")


@query("rules_filter_pipeline", f"WITH {DL} SELECT row_id FROM dl WHERE NOT regexp_matches(message, '(?i)password') AND NOT (regexp_matches(message, '(?i)tion') AND NOT regexp_matches(message, '(?i)ing'))")
def rules_filter_pipeline(spark, sf_dir):
    own = {
        "sections": [
            {"purpose": "filter", "rules": [{"match": "ing", "action": {"type": "include"}}, {"match": "password", "action": {"type": "exclude"}}]},
            {"purpose": "filter", "rules": [{"match": "tion", "action": {"type": "exclude"}}, {"match": "ing", "action": {"type": "include"}}]},
        ]
    }
    return rules.rules_filter_pipeline(document_lines(spark, sf_dir), own).select("row_id")


@query("noise_filter", f"WITH {DL} SELECT row_id FROM dl WHERE NOT (regexp_matches(message, '(?i)DEBUG|TRACE|VERBOSE') AND NOT regexp_matches(message, '(?i)ERROR|CRITICAL|FATAL'))")
def noise_filter(spark, sf_dir):
    return rules.rules_filter_view(document_lines(spark, sf_dir), packs.NOISE_FILTER).select("row_id")


@query("pii_filter", f"WITH {DL} SELECT row_id FROM dl WHERE NOT (" + " OR ".join(f"regexp_matches(message, '(?i){_re2(p)}')" for p in _PII) + ")")
def pii_filter(spark, sf_dir):
    return rules.rules_filter_view(document_lines(spark, sf_dir), packs.PII_FILTER).select("row_id")


def _redact_sql(column: str) -> str:
    for _, p, mark, on in packs.PII:
        if on:
            column = f"regexp_replace({column}, '(?i){_re2(p)}', '[REDACTED-{mark}]', 'g')"
    return column


@query("redact_pii", f"WITH {DL} SELECT row_id, {_redact_sql('message')} AS message FROM dl")
def redact_pii(spark, sf_dir):
    return rules.redact(document_lines(spark, sf_dir), packs.PII_REDACT).select("row_id", "message")


EXTRACT_RULES = {
    "sections": [
        {
            "name": "events", "purpose": "enrichment", "providers": ["*"],
            "rules": [
                {"name": "user", "field": "message", "match": "user=\\d+", "action": {"type": "extract", "pattern": "user=(?<uid>\\d+)", "set": {"ThreadId": "u{uid}", "Channel": "users"}, "strip": True}},
                {"name": "key", "field": "message", "match": "\"k\"", "actions": [{"type": "extract", "pattern": "\\{\"k\": (?<the_key>\\d+)\\}", "set": {"EventId": "{the_key}"}, "strip": True}, {"type": "tag", "tag": "keyed"}]},
                {"name": "buys", "field": "message", "match": "^purchase", "actions": [{"type": "tag", "tag": "buy"}, {"type": "route", "processor": "sales"}]},
                {"name": "faults", "field": "level", "match": "error", "action": {"type": "tag", "tag": "fault"}},
            ],
        }
    ]
}


@query("extract_fields", f"WITH {EV} SELECT row_id, 'u' || username AS thread_id, 'users' AS channel, regexp_extract(message, '\"k\": ([0-9]+)', 1) AS event_id FROM ev")
def extract_fields(spark, sf_dir):
    return rules.extract(event_rows(spark, sf_dir), EXTRACT_RULES).select("row_id", "thread_id", "channel", "event_id")


@query("strip_message", f"WITH {EV} SELECT row_id, trim(regexp_replace(regexp_replace(regexp_replace(message, 'user=[0-9]+', ''), '\\{{\"k\": [0-9]+\\}}', ''), '\\s{{2,}}', ' ', 'g')) AS message FROM ev")
def strip_message(spark, sf_dir):
    return rules.extract(event_rows(spark, sf_dir), EXTRACT_RULES).select("row_id", "message")


@query("tag_counts", f"WITH {EV}, t AS (SELECT unnest(['keyed', CASE WHEN task_name = 'purchase' THEN 'buy' END, CASE WHEN level = 1 THEN 'fault' END]) AS tag FROM ev) SELECT tag, count(*) AS n FROM t WHERE tag IS NOT NULL GROUP BY 1")
def tag_counts(spark, sf_dir):
    return rules.tag_counts(rules.tag(event_rows(spark, sf_dir), EXTRACT_RULES))


@query("routes", f"WITH {EV} SELECT row_id, level, task_name FROM ev WHERE task_name = 'purchase'")
def routes(spark, sf_dir):
    return _ids(rules.split_routes(rules.route(event_rows(spark, sf_dir), EXTRACT_RULES), ["sales"])["sales"])


@query(
    "rule_stats",
    f"WITH {EV}, c AS (SELECT count(*) AS a, count(*) FILTER (task_name = 'purchase') AS b, count(*) FILTER (level = 1) AS e FROM ev) SELECT unnest([0, 1, 2, 3]) AS rule_no, unnest(['user', 'key', 'buys', 'faults']) AS rule, unnest([a, a, b, e]) AS matches FROM c",
)
def rule_stats(spark, sf_dir):
    return rules.rule_stats(event_rows(spark, sf_dir), EXTRACT_RULES)


@query(
    "rule_matches_long",
    f"""WITH {EV}, r AS (SELECT row_id, unnest([{{'no': 0, 'rule': 'user', 'action': 'extract', 'value': '', 'on': true}}, {{'no': 1, 'rule': 'key', 'action': 'extract', 'value': '', 'on': true}},
    {{'no': 1, 'rule': 'key', 'action': 'tag', 'value': 'keyed', 'on': true}}, {{'no': 2, 'rule': 'buys', 'action': 'tag', 'value': 'buy', 'on': task_name = 'purchase'}},
    {{'no': 2, 'rule': 'buys', 'action': 'route', 'value': 'sales', 'on': task_name = 'purchase'}}, {{'no': 3, 'rule': 'faults', 'action': 'tag', 'value': 'fault', 'on': level = 1}}]) AS h FROM ev)
    SELECT row_id, h.no AS rule_no, h.rule AS rule, h.action AS action, h.value AS value FROM r WHERE h.on""",
)
def rule_matches_long(spark, sf_dir):
    return rules.rule_matches_long(event_rows(spark, sf_dir), EXTRACT_RULES)


@query("quick_rule", f"WITH {EV} SELECT row_id, username AS process_id, trim(regexp_replace(regexp_replace(message, 'user=([0-9]+)', ''), '\\s{{2,}}', ' ', 'g')) AS message FROM ev")
def quick_rule(spark, sf_dir):
    return rules.quick_rule(event_rows(spark, sf_dir), r"user=(\d+)", 1, "process_id", True).select("row_id", "process_id", "message")


@query("auto_rules", f"""WITH {DL} SELECT 0 AS no, 'always.json' AS rule_file UNION ALL SELECT 1, 'logs.json' WHERE EXISTS (SELECT 1 FROM dl WHERE ends_with(source, '.log'))
    UNION ALL SELECT 2, 'none.json' WHERE EXISTS (SELECT 1 FROM dl WHERE ends_with(source, '.etl'))
    UNION ALL SELECT 3, 'german.json' WHERE EXISTS (SELECT 1 FROM dl WHERE regexp_matches(source, '^src.*[.]log$')) AND EXISTS (SELECT 1 FROM dl WHERE provider = 'de')""")
def auto_rules(spark, sf_dir):
    entries = [
        {"ruleFile": "always.json", "always": True}, {"ruleFile": "logs.json", "extensions": ["txt", ".LOG"], "sourceTypes": ["Text"]}, {"ruleFile": "none.json", "pathGlobs": ["*.etl"]},
        {"ruleFile": "german.json", "pathGlobs": ["src*.log"], "providers": ["DE"], "minBuild": 100}, {"ruleFile": "logs.json", "extensions": ["log"]}, {"ruleFile": "old.json", "maxBuild": 99},
    ]
    return rules.auto_rules(document_lines(spark, sf_dir), entries, build=200)


_GUID_OF = "printf('%08x-0000-4000-8000-%012d', {0} % 7, {0} % 7)"


@query("collapse_unformatted", f"WITH {EV} SELECT {_GUID_OF.format('row_id')} AS guid, count(*) AS n, min(row_id) AS first_row FROM ev GROUP BY 1")
def collapse_unformatted(spark, sf_dir):
    k = F.col("row_id") % 7
    rows = event_rows(spark, sf_dir).withColumn("message", F.concat(F.lit("Unknown( 12): GUID="), F.format_string("%08X-0000-4000-8000-%012d", k, k), F.lit(" (No Format Information found).")))
    return rules.collapse_unformatted(rows).select("guid", "n", "first_row")


# Rewrites and parsing.


@query("clean_message", f"WITH {EV} SELECT row_id, CASE WHEN row_id % 2 = 0 THEN message ELSE '[2001-01-01 00:00:00] ERROR: ' || message END AS message FROM ev")
def clean_message(spark, sf_dir):
    stamp = F.when(F.col("row_id") % 2 == 0, _time_text()).otherwise("2001-01-01 00:00:00")
    rows = event_rows(spark, sf_dir).withColumn("message", F.concat(F.lit("["), stamp, F.lit("] ERROR: "), "message"))
    return rewrite.clean_message(rows).select("row_id", "message")


@query("parse_level", f"WITH {ORD} SELECT row_id, CASE (row_id % 8) WHEN 0 THEN 3 WHEN 1 THEN 0 WHEN 2 THEN 0 WHEN 3 THEN 1 WHEN 4 THEN 2 WHEN 5 THEN 3 WHEN 6 THEN 3 ELSE 4 END AS level, CASE row_id % 8 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 5 THEN 4 ELSE 3 END AS traced FROM od")
def parsed_level(spark, sf_dir):
    n = (F.col("row_id") % 8).cast("string")
    return order_rows(spark, sf_dir).select("row_id", parse_level(n).alias("level"), trace_level(n).alias("traced"))


@query("parse_time", f"WITH {EV} SELECT row_id, {_T} AS iso, {_T} AS epoch, {_T} AS millis, {_T} AS bracketed, {_T} AS tokens FROM ev")
def parsed_time(spark, sf_dir):
    rows = event_rows(spark, sf_dir)
    seconds, text = F.expr("unix_micros(CAST(log_time AS timestamp)) div 1000000"), _time_text()
    times = {
        "iso": parse_time(F.replace(text, F.lit(" "), F.lit("T"))), "epoch": parse_time(seconds.cast("string")), "millis": parse_time((seconds * 1000).cast("string")),
        "bracketed": line_time(F.concat(F.lit("["), text, F.lit("] INFO: x"))), "tokens": line_time(F.concat(text, F.lit(", Info  CBS  x"))),
    }
    return rows.select("row_id", *[_time_text(v).alias(k) for k, v in times.items()])


@query("line_levels", f"WITH {DL} SELECT level, count(*) AS n FROM dl GROUP BY 1")
def line_levels(spark, sf_dir):
    return document_lines(spark, sf_dir).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


@query("text_reader", f"WITH {DL} SELECT source AS file, count(*) AS n, CAST(sum(length(message)) AS BIGINT) AS chars FROM dl GROUP BY 1")
def text_reader(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("value"), F.concat(F.lit("/logs/"), "source", F.lit(".log")).alias("path"))
    return lines_to_events(lines).groupBy(F.concat("provider", F.lit(".log")).alias("file")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("message")).alias("chars"))


@query("field_mapper", "SELECT o_orderkey AS id, o_orderpriority AS message, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 3 END AS level, 'F' IN (o_orderstatus) AS has_status, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def field_mapper(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("TimeStamp"), F.col("o_orderstatus").alias("Severity"), F.col("o_orderpriority").alias("Msg"), F.col("o_orderkey").cast("string").alias("id")
    )
    e = columns_to_events(o, o.columns, F.lit("orders.csv"))
    return e.select(F.col("event_id").cast("long").alias("id"), "message", "level", (F.col("fields")["Severity"] == "F").alias("has_status"), F.date_format("log_time", "yyyy-MM-dd").alias("day"))


@query("json_lines_mapper", "SELECT event_id AS id, event_type || ' ' || event_id AS message, strftime(ts, '%Y-%m-%d %H:%M:%S') AS time FROM events")
def json_lines_mapper(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    line = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("@t"), F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("@m"), F.col("event_id").alias("EventId"), F.lit("").alias("message"), F.struct(F.lit(1).alias("x")).alias("nested")))
    rows = e.select(F.from_json(line, "map<string,string>").alias("record"))
    out = map_to_events(rows, "record", F.lit("events.jsonl"))
    return out.select(F.col("event_id").cast("long").alias("id"), "message", _time_text().alias("time"))


@query("result_table_rows", "SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS message, CASE o_orderstatus WHEN 'F' THEN 0 ELSE 3 END AS level FROM orders")
def result_table_rows(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("TimeGenerated"), F.col("o_orderkey").alias("EventId"), F.col("o_orderpriority").alias("Message"), F.col("o_orderstatus").alias("Level"))
    return rows_to_events(o, "orders").select(F.col("event_id").alias("id"), "message", "level")


@query("trace_reader", f"WITH {EV} SELECT username, level, count(*) AS n FROM ev GROUP BY 1, 2")
def trace_reader(spark, sf_dir):
    e = event_rows(spark, sf_dir)
    body = F.to_json(F.struct(F.col("message").alias("Message"), F.when(F.col("level") == 1, 2).otherwise(4).alias("Level")))
    line = F.concat(F.lit("[0]"), F.upper(F.conv("username", 10, 16)), F.lit(".0A2C::"), F.date_format("log_time", "yyyy-MM-dd HH:mm:ss.SSS"), F.lit(" [Prov]"), body)
    out = trace_lines_to_events(e.select(line.alias("value"), F.lit("x.trace").alias("path")))
    return out.groupBy(F.col("process_id").alias("username"), "level").agg(F.count(F.lit(1)).alias("n"))


@query("payload_render", f"WITH {EV} SELECT row_id, 'k=\"' || regexp_extract(message, ': ([0-9]+)', 1) || '\"' AS quoted, 'k=' || regexp_extract(message, ': ([0-9]+)', 1) AS bare, 'k: ' || regexp_extract(message, ': ([0-9]+)', 1) || ' | ' AS piped FROM ev")
def payload_render(spark, sf_dir):
    f = F.col("fields")
    return event_rows(spark, sf_dir).select("row_id", rewrite.render_payload(f).alias("quoted"), rewrite.render_payload(f, "key_value").alias("bare"), rewrite.render_payload(f, "pipe").alias("piped"))


@query("reformat_message", f"WITH {EV} SELECT row_id, username AS user, CASE WHEN task_name IN ('click', 'view') THEN task_name END AS seen FROM ev")
def reformat_message(spark, sf_dir):
    catalogue = [{"pattern": r"^(?<seen>click|view) user=(?<user>\d+)", "gate": "click|view"}, {"pattern": r"user=(?<user>\d+)"}]
    out = rewrite.reformat_message(event_rows(spark, sf_dir), catalogue)
    return out.select("row_id", F.try_element_at("parsed", F.lit("user")).alias("user"), F.try_element_at("parsed", F.lit("seen")).alias("seen"))


@query("empty_columns", f"WITH {EV}, x AS (SELECT unnest({['provider', 'task_name', 'op_code', 'message', 'searchable', 'source', 'machine_name', 'username', 'process_id', 'thread_id', 'event_id', 'record_id', 'activity_id', 'related_activity_id', 'provider_guid', 'keywords', 'channel', 'process_name']}) AS \"column\") SELECT \"column\", \"column\" NOT IN ('provider', 'task_name', 'message', 'searchable', 'source', 'username') AS is_empty FROM x")
def empty_columns(spark, sf_dir):
    return rewrite.empty_columns(event_rows(spark, sf_dir))


@query("stable_row_ids", "SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) - 1 AS row_id FROM documents")
def stable_row_ids(spark, sf_dir):
    return rewrite.with_row_id(table(spark, sf_dir, "documents").select("source", "doc_id"), ["source", "doc_id"]).select("doc_id", "row_id")


# Sequences and diagrams.


@query(
    "interactions",
    r"""WITH t AS (SELECT conv_id, turn, role AS a, CASE WHEN length(l) > 80 THEN left(l, 79) || '…' WHEN l = '' THEN '(event)' ELSE l END AS l FROM
        (SELECT conv_id, turn, role, trim(regexp_replace(translate(coalesce(text, ''), chr(13) || chr(10) || ';#', '  , '), ' +', ' ', 'g')) AS l FROM conversations WHERE trim(coalesce(role, '')) <> '')),
    c AS (SELECT *, CASE WHEN a IS NOT DISTINCT FROM lag(a) OVER w AND l IS NOT DISTINCT FROM lag(l) OVER w THEN 0 ELSE 1 END AS changed FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    r AS (SELECT *, sum(changed) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM c),
    g AS (SELECT conv_id, run, min(a) AS a, min(l) AS l, count(*) AS n FROM r GROUP BY 1, 2)
    SELECT CAST(conv_id AS VARCHAR) AS activity_id, CAST(run AS BIGINT) AS seq, CASE WHEN lag(a) OVER w IS NULL THEN 'note' ELSE 'message' END AS kind, lag(a) OVER w AS from_actor, a AS to_actor, l AS label, n FROM g WINDOW w AS (PARTITION BY conv_id ORDER BY run)""",
)
def interactions(spark, sf_dir):
    return sequence.interactions(conversation_rows(spark, sf_dir), "provider", "message", ["activity_id"], ["row_id"])


@query(
    "collapse_runs",
    f"""WITH {EV}, c AS (SELECT *, CASE WHEN task_name = lag(task_name) OVER w THEN 0 ELSE 1 END AS changed FROM ev WINDOW w AS (PARTITION BY username ORDER BY log_time, row_id)),
    r AS (SELECT *, sum(changed) OVER (PARTITION BY username ORDER BY log_time, row_id) AS seq FROM c) SELECT username, CAST(seq AS BIGINT) AS seq, min(task_name) AS task_name, count(*) AS n FROM r GROUP BY 1, 2""",
)
def collapse_runs(spark, sf_dir):
    return sequence.collapse_runs(event_rows(spark, sf_dir), ["task_name"], ["username"], ["log_time", "row_id"])


@query("actor_alias", f"WITH {CV}, f AS (SELECT activity_id, provider AS actor, min(row_id) AS pos FROM cv GROUP BY 1, 2) SELECT activity_id, actor, 'p' || (row_number() OVER (PARTITION BY activity_id ORDER BY pos) - 1) AS alias FROM f")
def actor_alias(spark, sf_dir):
    return sequence.actor_alias(conversation_rows(spark, sf_dir), "provider", ["activity_id"], ["row_id"])


DIAGRAM = {
    "title": "Shop", "participants": [{"id": "U", "displayName": "The user", "type": "actor"}, {"id": "S", "displayName": "Shop"}],
    "rules": [
        {"name": "open", "match": "^signup", "action": {"type": "activate", "from": "S"}},
        {"name": "buy", "match": "purchase", "useRegex": False, "action": {"type": "message", "from": "U", "to": "S", "text": "buys{afterMatch:untilSpace} as {extract:user=(\\d+)}"}},
        {"name": "fail", "match": "error", "unmatch": "user=9", "action": {"type": "note", "from": "S", "text": "failed", "notePosition": "right"}},
        {"name": "close", "match": "^error", "action": {"type": "deactivate", "from": "S"}},
    ],
}
_HITS = f"""{EV}, h AS (SELECT row_id, log_time, 0 AS rule_no, 'open' AS rule, 'activate' AS type, 'S' AS from_id, '' AS text FROM ev WHERE starts_with(message, 'signup')
    UNION ALL SELECT row_id, log_time, 1, 'buy', 'message', 'U', 'buys as ' || username FROM ev WHERE contains(message, 'purchase')
    UNION ALL SELECT row_id, log_time, 2, 'fail', 'note', 'S', 'failed' FROM ev WHERE contains(message, 'error') AND NOT contains(message, 'user=9')
    UNION ALL SELECT row_id, log_time, 3, 'close', 'deactivate', 'S', '' FROM ev WHERE starts_with(message, 'error')),
    sw AS (SELECT *, lag(type) OVER (PARTITION BY from_id ORDER BY log_time, row_id, rule_no) AS before FROM h WHERE type IN ('activate', 'deactivate')),
    el AS (SELECT row_id, rule_no, rule, type, from_id, text FROM h WHERE type NOT IN ('activate', 'deactivate') UNION ALL SELECT row_id, rule_no, rule, type, from_id, text FROM sw WHERE type = 'activate' OR before = 'activate')"""


@query("diagram_elements", f"WITH {_HITS} SELECT * FROM el")
def diagram_elements(spark, sf_dir):
    return sequence.diagram_elements(event_rows(spark, sf_dir), DIAGRAM).select("row_id", "rule_no", "rule", "type", "from_id", "text")


_LINES = f"""{EV}, h AS (SELECT username, row_id, log_time, 0 AS rule_no, 'activate' AS type, '    activate S' AS line FROM ev WHERE starts_with(message, 'signup')
    UNION ALL SELECT username, row_id, log_time, 1, 'message', concat('    U->>S: ', chr(39), 'buys as ', username, chr(39)) FROM ev WHERE contains(message, 'purchase')
    UNION ALL SELECT username, row_id, log_time, 2, 'note', concat('    note right of S: ', chr(39), 'failed', chr(39)) FROM ev WHERE contains(message, 'error') AND NOT contains(message, 'user=9')
    UNION ALL SELECT username, row_id, log_time, 3, 'deactivate', '    deactivate S' FROM ev WHERE starts_with(message, 'error')),
    sw AS (SELECT *, lag(type) OVER (PARTITION BY username ORDER BY log_time, row_id, rule_no) AS before FROM h WHERE type IN ('activate', 'deactivate')),
    el AS (SELECT username, row_id, log_time, rule_no, line FROM h WHERE type NOT IN ('activate', 'deactivate') UNION ALL SELECT username, row_id, log_time, rule_no, line FROM sw WHERE type = 'activate' OR before = 'activate'),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY username ORDER BY log_time, row_id, rule_no) AS place FROM el)"""


@query(
    "diagram_texts",
    f"""WITH {_LINES} SELECT username, least(count(*), 6) AS elements, concat('sequenceDiagram', chr(10), '    title Shop', chr(10), '    actor U as "The user"', chr(10), '    participant S as Shop', chr(10),
        string_agg(line || chr(10), '' ORDER BY place) FILTER (WHERE place <= 6),
        CASE WHEN count(*) > 6 THEN concat('    note over U: ', chr(39), 'diagram truncated at 6 elements', chr(39), chr(10)) ELSE '' END) AS markup FROM numbered GROUP BY username""",
)
def diagram_texts(spark, sf_dir):
    """A diagram for each user, six elements each at most."""
    return sequence.diagram_texts(event_rows(spark, sf_dir), DIAGRAM | {"maxElements": 6}, ["username"])


@query("diagram_usage", f"WITH {_HITS} SELECT rule_no, rule, count(*) AS hits FROM h GROUP BY 1, 2")
def diagram_usage(spark, sf_dir):
    return sequence.diagram_usage(event_rows(spark, sf_dir), DIAGRAM)


@query("diagram_rows", f"WITH {_HITS} SELECT row_id, arg_min(rule, rule_no) AS rule FROM h GROUP BY 1")
def diagram_rows(spark, sf_dir):
    return sequence.diagram_rows(event_rows(spark, sf_dir), DIAGRAM)


@query("dedupe_elements", f"WITH {_HITS}, d AS (SELECT type, from_id, text, count(*) AS n, min(row_id) AS any_row FROM el GROUP BY 1, 2, 3) SELECT type, from_id, CASE WHEN n > 1 AND text <> '' THEN text || ' ×' || n ELSE text END AS text, n FROM d")
def dedupe_elements(spark, sf_dir):
    return sequence.dedupe_elements(sequence.diagram_elements(event_rows(spark, sf_dir), DIAGRAM)).select("type", "from_id", "text", "n")


@query(
    "capped_sequence",
    r"""WITH t AS (SELECT conv_id, turn, role AS a, CASE WHEN length(l) > 80 THEN left(l, 79) || '…' WHEN l = '' THEN '(event)' ELSE l END AS l FROM
        (SELECT conv_id, turn, role, trim(regexp_replace(translate(coalesce(text, ''), chr(13) || chr(10) || ';#', '  , '), ' +', ' ', 'g')) AS l FROM conversations WHERE trim(coalesce(role, '')) <> '')),
    c AS (SELECT *, CASE WHEN a IS NOT DISTINCT FROM lag(a) OVER w AND l IS NOT DISTINCT FROM lag(l) OVER w THEN 0 ELSE 1 END AS changed FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    r AS (SELECT *, sum(changed) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM c),
    g AS (SELECT conv_id, run, min(a) AS a, min(l) AS l, count(*) AS n FROM r GROUP BY 1, 2),
    s AS (SELECT *, lag(a) OVER (PARTITION BY conv_id ORDER BY run) AS before, sum(n) FILTER (WHERE run > 2) OVER (PARTITION BY conv_id) AS rest FROM g)
    SELECT CAST(conv_id AS VARCHAR) AS activity_id, CAST(run AS BIGINT) AS seq, CASE WHEN run > 2 OR before IS NULL THEN 'note' ELSE 'message' END AS kind, CASE WHEN run <= 2 THEN before END AS from_actor,
        CASE WHEN run > 2 THEN before ELSE a END AS to_actor, CASE WHEN run > 2 THEN '… ' || CAST(rest AS BIGINT) || ' more events (truncated)' ELSE l END AS label, CASE WHEN run > 2 THEN 1 ELSE n END AS n
    FROM s WHERE run <= 3""",
)
def capped_sequence(spark, sf_dir):
    rows = sequence.interactions(conversation_rows(spark, sf_dir), "provider", "message", ["activity_id"], ["row_id"])
    return sequence.cap_sequence(rows, ["activity_id"], 2)


# Joins.


@query("tag_overlay", "SELECT doc_id, CASE toxic WHEN 1 THEN 'toxic' ELSE 'clean' END AS tag FROM documents LEFT JOIN labels USING (doc_id) WHERE toxic IS NOT NULL UNION ALL SELECT doc_id, NULL FROM documents LEFT JOIN labels USING (doc_id) WHERE toxic IS NULL")
def tag_overlay(spark, sf_dir):
    tags = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_id"), F.when(F.col("toxic") == 1, "toxic").otherwise("clean").alias("tag"), F.lit("").alias("note"))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"))
    return overlay.with_tags(rows, tags).select(F.col("row_id").alias("doc_id"), "tag")


@query("tag_overlay_counts", "SELECT CASE toxic WHEN 1 THEN 'toxic' ELSE 'clean' END AS tag, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def tag_overlay_counts(spark, sf_dir):
    tags = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_id"), F.when(F.col("toxic") == 1, "toxic").otherwise("clean").alias("tag"), F.lit("").alias("note"))
    return overlay.tag_overlay_counts(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id")), tags)


@query("search_indexed", f"WITH {EV} SELECT row_id, level, task_name FROM ev WHERE contains(message, 'user=42')")
def search_indexed(spark, sf_dir):
    rows = event_rows(spark, sf_dir)
    return _ids(trigram.search_indexed(rows, trigram.build_trigrams(rows), "USER=42"))


@query("trigram_index_stats", f"WITH {EV}, x AS (SELECT row_id, lower(message) AS m FROM ev), t AS (SELECT DISTINCT row_id, substring(m, CAST(i AS INT), 3) AS tri FROM x, range(1, 200) AS r(i) WHERE i <= length(m) - 2) SELECT count(*) AS postings, count(DISTINCT tri) AS trigrams, count(DISTINCT row_id) AS rows FROM t")
def trigram_index_stats(spark, sf_dir):
    rows = event_rows(spark, sf_dir).select("row_id", "message")
    blank = as_events(rows).withColumns({c: F.lit("") for c in ("provider", "task_name", "source", "searchable")})
    return trigram.index_stats(trigram.build_trigrams(blank))


@query("incremental_anti_join", "SELECT CAST(doc_id AS VARCHAR) AS path, n_chars AS length FROM documents WHERE lang IS DISTINCT FROM 'en' OR doc_id % 10 = 0")
def incremental_anti_join(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    shape = lambda n: [F.col("doc_id").cast("string").alias("path"), n.alias("length"), F.lit("2024-01-01").cast("timestamp").alias("modified"), F.lit(1).alias("version"), F.lit("").alias("rules")]
    held = d.where("lang = 'en'").select(*shape(F.col("n_chars") + F.when(F.col("doc_id") % 10 == 0, 1).otherwise(0)))
    return new_files(d.select(*shape(F.col("n_chars"))), held).select("path", "length")


@query("union_sources", f"WITH {EV}, {ORD}, {CV} SELECT 'events' AS part, count(*) AS n FROM ev UNION ALL SELECT 'orders.csv', count(*) FROM od UNION ALL SELECT 'conversations.jsonl', count(*) FROM cv")
def united(spark, sf_dir):
    parts = [event_rows(spark, sf_dir), order_rows(spark, sf_dir), conversation_rows(spark, sf_dir)]
    return union_sources(parts).groupBy(F.col("source").alias("part")).agg(F.count(F.lit(1)).alias("n"))


@query("source_kinds", "SELECT CASE WHEN url LIKE '%.html' THEN 'HTML' ELSE 'Other' END AS kind, count(*) AS n FROM (SELECT regexp_replace(url, '[?#].*$', '') AS url FROM pages) GROUP BY 1")
def source_kinds(spark, sf_dir):
    p = page_rows(spark, sf_dir)
    return p.select(source_type(F.regexp_replace("source", "[?#].*$", "")).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


# Sinks and streams.


@query("export_fields", f"WITH {EV} SELECT {_T} AS timestamp, CASE level WHEN 1 THEN 'Error' ELSE 'Info' END AS level, 'events' AS source, message FROM ev")
def export_fields(spark, sf_dir):
    return sinks.select_fields(event_rows(spark, sf_dir))


@query("html_rows", f"WITH {EV} SELECT '<tr class=\"' || CASE level WHEN 1 THEN 'error' ELSE 'info' END || '\"><td>' || task_name || '</td><td>' || replace(message, '\"', '&quot;') || '</td></tr>' AS value FROM ev")
def html_rows(spark, sf_dir):
    return sinks.html_rows(event_rows(spark, sf_dir), ["task", "message"])


@query("output_rule_rows", f"WITH {EV} SELECT row_id, level, task_name FROM ev WHERE task_name = 'purchase' AND NOT contains(message, 'user=1')")
def output_rule_rows(spark, sf_dir):
    tagged = rules.tag(event_rows(spark, sf_dir), EXTRACT_RULES)
    return _ids(sinks.output_rows(tagged, {"match": "user", "unmatch": "user=1"}, {"tag": "BUY"}))


@query("saved_store", f"WITH {EV} SELECT strftime(log_time, '%Y-%m-%d') AS day, level, count(*) AS n FROM ev GROUP BY 1, 2")
def saved_store(spark, sf_dir):
    """Events written to the day-partitioned store and read back."""
    path = scratch(spark, "store")
    sinks.save_events(event_rows(spark, sf_dir), path)
    return sinks.load_events(spark, path).groupBy(F.date_format("log_time", "yyyy-MM-dd").alias("day"), "level").agg(F.count(F.lit(1)).alias("n"))


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    s = spark.readStream.schema(e.schema).parquet(f"{sf_dir}/events.parque[t]")
    return as_events(s.select(F.col("event_id").alias("row_id"), F.col("ts").cast("timestamp_ntz").alias("log_time"), parse_level(F.col("event_type")).alias("level"), F.col("event_type").alias("message")))


def _drained(spark: SparkSession, counts: DataFrame, name: str) -> DataFrame:
    """A finished run of a small running aggregate; its last state is the result."""
    q = counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", scratch(spark, name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


@query("stream_level_counts", f"WITH {EV} SELECT level, count(*) AS n FROM ev GROUP BY 1")
def stream_level_counts(spark, sf_dir):
    return _drained(spark, streaming.stream_level_counts(_streamed(spark, sf_dir)), "logloom_level_counts")


@query("stream_density", f"WITH {EV} SELECT strftime(time_bucket(INTERVAL 1 DAY, log_time), '%Y-%m-%d') AS day, level, count(*) AS n FROM ev GROUP BY 1, 2")
def stream_density(spark, sf_dir):
    out = _drained(spark, streaming.stream_density(_streamed(spark, sf_dir), "1 day", "1 day"), "logloom_density")
    return out.select(F.date_format("from_time", "yyyy-MM-dd").alias("day"), "level", "n")
