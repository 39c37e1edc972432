"""The search language, filters, scopes."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

import logloom.queries_files  # noqa: F401
from logloom.model import as_events, level_to_int, normalize_events
from logloom.plans.scope import Scope, apply_scope, build_scope, scope_from_selection, validate_scope
from logloom.plans.search import looks_structured, search, where_query
from logloom.plans.spec import FilterSpec, apply_filters, preset
from logloom.queries import QUERIES


@pytest.fixture(scope="module")
def events(spark):
    rows = [
        (0, dt.datetime(2024, 1, 1, 10), 1, "Disk", "read failed 50%", "a.log", "7"),
        (1, dt.datetime(2024, 1, 1, 11), 2, "Disk", "5000 slow reads", "a.log", "30"),
        (2, dt.datetime(2024, 1, 2, 10), 3, "Net", "Connected to HOST", "b.log", "200"),
        (3, None, 4, "net", "it's \"quoted\" c:\\temp", "b.log", ""),
        (4, dt.datetime(2024, 1, 3), 0, "Token_X", "plain", "c.log", "x1"),
    ]
    return as_events(spark.createDataFrame(rows, "row_id long, log_time timestamp_ntz, level int, provider string, message string, source string, process_id string")).cache()


def ids(df):
    return sorted(r.row_id for r in df.select("row_id").collect())


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("level == Error", [0]),
        ("lvl=WARN or level == critical", [1, 4]),
        ("level == nonsense", []),
        ("level != nonsense", [0, 1, 2, 3, 4]),
        ("provider == disk and msg ~ slow", [1]),
        ("prov == disk msg ~ slow", [1]),
        ("not provider == disk", [2, 3, 4]),
        ("(provider == net or provider == disk) and not level == Error", [1, 2, 3]),
        ("pid > 20", [1, 2, 4]),
        ("pid >= 7 and pid < 200", [0, 1]),
        ("time >= 2024-01-02", [2, 4]),
        ("time < '2024-01-01 11:00:00'", [0]),
        ("time ~ 2024-01-03", [4]),
        ("msg !~ read", [2, 3, 4]),
        ("not time >= 2024-01-02", [0, 1, 3]),
        ("time != 2024-01-03", [0, 1, 2, 3]),
        ('msg ~ "it\'s"', [3]),
        (r'msg ~ "\"quoted\""', [3]),
        (r"msg ~ 'c:\\temp'", [3]),
        ("HOST", [2]),
        ("50%", [0]),
        ("token_x", [4]),
        ("level <= Error", [0, 4]),
        ("", [0, 1, 2, 3, 4]),
    ],
)
def test_search(events, text, expected):
    assert ids(search(events, text)) == expected


@pytest.mark.parametrize(("text", "say"), [("nofield == 1", "unknown field"), ("level ==", "expected a value"), ("(level == Error", "missing"), ("msg ~ 'open", "unterminated"), ("level == Error )", "unexpected"), ("and", "unexpected"), ("  ", "empty"), ("a or", "unexpected")])
def test_search_errors(spark, text, say):
    with pytest.raises(ValueError, match=say):
        where_query(text)


def test_time_reaches_the_scan(events, tmp_path, spark):
    events.write.parquet(str(tmp_path / "e"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    plan = spark.read.parquet(str(tmp_path / "e")).where(where_query("time >= 2024-01-02 and level == Error"))._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(log_time" in plan and "EqualTo(level,1)" in plan


def test_detection():
    assert looks_structured("a == b") and looks_structured("x AND y") and looks_structured("not z")
    assert not looks_structured("plain words") and not looks_structured("") and not looks_structured("'open")


def test_plain_text_with_an_operator(spark, tmp_path):
    events = as_events(spark.createDataFrame([(0, "user=42", "42"), (1, "USER=420", "420"), (2, "user=142", "142"), (3, "none", "42")], "row_id long, message string, username string"))
    assert ids(search(events, "User=42", plain=True)) == [0, 1]
    assert ids(search(events, "User=42")) == [0, 3]
    rows = [(i, dt.datetime(2024, 1, 1), u, t, 0.0, "{}") for i, (u, t) in enumerate([(42, "view"), (42, "click"), (420, "click"), (1042, "click")])]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    assert {r.way: r.n for r in QUERIES["search_plain_and_structured"](spark, str(tmp_path)).collect()} == {"plain": 3, "structured": 1}


def test_spec(events):
    assert ids(apply_filters(events, FilterSpec(providers=frozenset({"NET"}), provider="disk"))) == [2, 3]
    assert ids(apply_filters(events, FilterSpec(provider="ne", level="Info"))) == [2]
    assert ids(apply_filters(events, FilterSpec(levels=frozenset({"Nope"})))) == []
    assert ids(apply_filters(events, FilterSpec(time_from=dt.datetime(2024, 1, 1, 11), time_to=dt.datetime(2024, 1, 2, 10)))) == [1, 2]
    assert ids(apply_filters(events, FilterSpec())) == [0, 1, 2, 3, 4]
    assert FilterSpec(provider="a").without("provider").is_empty and FilterSpec(sources=frozenset("x")) == FilterSpec(sources=frozenset("x"))
    assert ids(preset(events, "24h")) == [2, 4]


def test_scope(events):
    sections = [
        {"providers": ["Disk", "Net"], "rules": [{"name": "a", "action": {"type": "scope", "levels": ["Error", "Warning", "Info"]}}]},
        {"providers": ["disk"], "rules": [{"name": "b", "action": {"type": "scope", "providerMode": "include", "timeFrom": "2024-01-01T10:30:00"}}]},
    ]
    scope = build_scope(sections)
    assert scope.include == {"disk"} and scope.levels == {1, 2, 3} and validate_scope(sections) == []
    assert ids(apply_scope(events, scope)) == [1]
    assert ids(apply_scope(events, Scope(time_from=dt.datetime(2024, 1, 3)))) == [3, 4]
    assert ids(apply_scope(events.withColumn("provider", F.lit("")), Scope(include=frozenset()))) == [0, 1, 2, 3, 4]
    assert build_scope([]) is None and ids(apply_scope(events, None)) == [0, 1, 2, 3, 4]
    again = build_scope(scope_from_selection(["Net"], "exclude", levels=["Error"])["sections"])
    assert again.exclude == {"net"} and again.levels == {1}
    bad = [{"rules": [{"name": "x", "match": "m", "action": {"type": "scope", "timeFrom": "soon", "levels": ["Loud"], "providerMode": "some"}}]}]
    assert len(validate_scope(bad)) == 4


def test_model(spark):
    df = normalize_events(spark.createDataFrame([("!NOT_SUPPORTED!", None)], "username string, message string"))
    r = df.first()
    assert (r.username, r.message, r.log_time, r.level, r.fields, r.tags) == ("", "", None, 3, {}, [])
    assert level_to_int("Critical") == 0 and level_to_int(" debug ") == 4 and level_to_int("x") == -1
