"""Exports of events: CSV, JSON, XML, text, HTML, Parquet, and rule-driven outputs."""

from __future__ import annotations

import datetime as dt
import json
import re
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.text import html_escape, xml_name
from logloom.model import FIELD_ALIASES, STRING_COLUMNS, level_name
from logloom.operators.packs import DIAGRAMS
from logloom.operators.rules import has_tag
from logloom.operators.sequence import diagram_texts
from logloom.plans.rules import actions, enabled, regex_or_contains

DEFAULT_FIELDS = ["timestamp", "level", "source", "message"]
RESULT_FIELDS = ["time", "level", "provider", "taskname", "message", "source", "machinename", "username"]
TIME_TEXT = "yyyy-MM-dd HH:mm:ss"


def export_field(name: str) -> Column:
    """Column of an export field, as text; unknown names are the searchable text."""
    low = re.sub(r"[^a-z]", "", name.lower())
    extra = {"file": "source", "datetime": "log_time", "date": "log_time", "logtime": "log_time", "resultsource": "source", "searchabledata": "searchable"}
    column = (FIELD_ALIASES | {c.replace("_", ""): c for c in STRING_COLUMNS} | extra).get(low, "searchable")
    if column == "log_time":
        return F.coalesce(F.date_format("log_time", TIME_TEXT), F.lit(""))
    return level_name(F.col("level")) if column == "level" else F.coalesce(column, F.lit(""))


def select_fields(df: DataFrame, fields: list[str] | None = None) -> DataFrame:
    return df.select(*[export_field(f).alias(f) for f in fields or DEFAULT_FIELDS])


def write_csv(df: DataFrame, path: str, fields: list[str] | None = None, header: bool = True, delimiter: str = ",") -> None:
    select_fields(df, fields).write.mode("overwrite").option("emptyValue", "").csv(path, header=header, sep=delimiter, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_json(df: DataFrame, path: str, fields: list[str] | None = None) -> None:
    """One object per line."""
    select_fields(df, fields).write.mode("overwrite").json(path)


def write_xml(df: DataFrame, path: str, fields: list[str] | None = None) -> None:
    write_rows_xml(select_fields(df, fields), path)


def write_rows_xml(rows: DataFrame, path: str) -> None:
    """Rows of any columns as XML; their names become element names. No column is an attribute or an element's text, whatever its name."""
    rows.toDF(*[xml_name(c) for c in rows.columns]).write.mode("overwrite").format("xml").option("rootTag", "Results").option("rowTag", "Result").option("attributePrefix", "@").option("valueTag", "@text").save(path)


def write_txt(df: DataFrame, path: str, fields: list[str] | None = None) -> None:
    """``field=value | field=value`` lines; line breaks in values become spaces."""
    names = fields or DEFAULT_FIELDS
    cells = [F.concat(F.lit(f"{f}="), F.regexp_replace(export_field(f), r"[\r\n]+", " ")) for f in names]
    df.select(F.concat_ws(" | ", *cells).alias("value")).write.mode("overwrite").text(path)


def result_line() -> Column:
    """One line of the fixed text format."""
    return F.format_string("[%s] %s %s: %s", export_field("time"), export_field("level"), export_field("provider"), F.regexp_replace(export_field("message"), r"[\r\n]+", " "))


def write_results(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """The fixed eight columns as csv or json, or the fixed line as txt."""
    if fmt == "txt":
        df.select(result_line().alias("value")).write.mode("overwrite").text(path)
    else:
        {"csv": write_csv, "json": write_json}[fmt](df, path, RESULT_FIELDS)


def html_rows(df: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """A table row of markup for each event, its level as class."""
    cells = [F.concat(F.lit("<td>"), html_escape(export_field(f)), F.lit("</td>")) for f in fields or RESULT_FIELDS]
    return df.select(F.concat(F.lit('<tr class="'), F.lower(level_name(F.col("level"))), F.lit('">'), *cells, F.lit("</tr>")).alias("value"))


def write_html_rows(df: DataFrame, path: str, fields: list[str] | None = None) -> None:
    html_rows(df, fields).write.mode("overwrite").text(path)


def expand_path(path: str, now: dt.datetime | None = None, output: str = "output") -> str:
    """Placeholders {date} {time} {datetime} {output} {temp} of an output path."""
    now = now or dt.datetime.now()
    values = {"{date}": f"{now:%Y-%m-%d}", "{time}": f"{now:%H-%M-%S}", "{datetime}": f"{now:%Y-%m-%d_%H-%M-%S}", "{output}": output, "{temp}": tempfile.gettempdir()}
    for k, v in values.items():
        path = path.replace(k, v)
    return path


WRITERS = {"csv": write_csv, "json": write_json, "xml": write_xml, "txt": write_txt, "text": write_txt}


def output_rows(df: DataFrame, rule: dict, action: dict) -> DataFrame:
    """Rows that an output rule selects: by its match, its unmatch, and its tag."""
    out = df
    if rule.get("match"):
        out = out.where(regex_or_contains(F.col("searchable"), rule["match"]))
    if rule.get("unmatch"):
        out = out.where(~regex_or_contains(F.col("searchable"), rule["unmatch"]))
    return out.where(has_tag(action["tag"])) if action.get("tag") else out


def diagram_definition(rules_file: str | None, beside: str | None = None) -> dict:
    """The definition a diagram action names: a file as given or in the folder of the rule file ``beside``, else the pack of that name.

    A definition that is nowhere, or cannot be read, is an empty one: its diagrams have a first line alone.
    """
    named = (rules_file or "").strip().replace("\\", "/")
    for path in [Path(named), *([Path(beside).parent / named, Path(beside).parent / Path(named).name] if beside else [])] if named else []:
        if path.is_file():
            try:
                got = json.loads(path.read_text(encoding="utf-8-sig"))
            except (OSError, ValueError):
                return {}
            return got if isinstance(got, dict) else {}
    return DIAGRAMS.get(named.rsplit("/", 1)[-1], {})


def write_diagram(df: DataFrame, path: str, definition: dict, syntax: str = "mermaid") -> None:
    """Markup of one diagram over the searchable texts of all rows, put together on executors, as one text file."""
    named = "plantuml" if syntax.lower() in ("plantuml", "plant") else "mermaid"
    markup = diagram_texts(df, definition, [], named, "searchable")
    markup.select(F.regexp_replace("markup", r"\n\z", "").alias("value")).write.mode("overwrite").text(path)


def run_output_rules(df: DataFrame, sections: list[dict], output: str = "output") -> list[str]:
    """Writes what every output rule selects and the diagrams of ``uml`` actions, and returns the paths.

    A diagram is made of all rows, whatever its rule's match: its definition has matches of its own.
    """
    paths = []
    for s in sections:
        for r in enabled(s):
            for a in actions(r, "uml"):
                path = expand_path(a.get("path") or f"{{output}}/{r.get('name', 'diagram')}.mmd", output=output)
                write_diagram(df, path, diagram_definition(a.get("rulesFile"), s.get("_file")), str(a.get("syntax") or "mermaid"))
                paths.append(path)
            for a in actions(r, "output"):
                rows, path, fmt = output_rows(df, r, a), expand_path(a.get("path") or f"{{output}}/{r.get('name', 'results')}", output=output), str(a.get("format") or "csv").lower()
                if fmt == "csv":
                    write_csv(rows, path, a.get("fields"), a.get("includeHeaders", True), a.get("delimiter") or ",")
                else:
                    WRITERS[fmt](rows, path, a.get("fields"))
                paths.append(path)
    return paths


#: Rows of a file of the store.
MAX_RECORDS = 5_000_000


def save_events(df: DataFrame, path: str) -> None:
    """Events as the queryable store: Parquet by day, so that time filters prune folders.

    Rows are dealt by day, and Spark splits days that are larger than its advisory partition (or the rows
    without a time) and puts small ones together, so a busy day is as many tasks as it is large, and a file has few days. Within a file rows are in the order of time and id.
    """
    day = F.coalesce(F.to_date("log_time"), F.lit("1970-01-01").cast("date"))
    dealt = df.withColumn("log_date", day).hint("rebalance", "log_date").sortWithinPartitions("log_date", "log_time", "row_id")
    dealt.write.mode("overwrite").option("maxRecordsPerFile", MAX_RECORDS).partitionBy("log_date").parquet(path)


def load_events(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("log_date")
