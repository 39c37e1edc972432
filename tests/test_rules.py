"""Rules: loading, filters, extraction, tags, redaction, packs, outputs."""

import datetime as dt
import json
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logloom import sinks
from logloom.functions.parse import parse_span, rule_date
from logloom.functions.text import contains_ci
from logloom.model import as_events
from logloom.operators import packs, processors, rewrite, rules
from logloom.plans.ambiguity import ambiguous
from logloom.plans.rules import compiles, from_sign, java_groups, load_rules, regex_or_contains, required_sign, sections, validate_rules


def make(spark, messages, **more):
    rows = [(i, m) for i, m in enumerate(messages)]
    df = spark.createDataFrame(rows, "row_id long, message string")
    return as_events(df.selectExpr("*", "message AS searchable", *[f"'{v}' AS {k}" for k, v in more.items()]))


def messages(df):
    return [r.message for r in df.orderBy("row_id").collect()]


@pytest.mark.parametrize("name", sorted(packs.PACKS))
def test_packs_compile(spark, name):
    for s in packs.PACKS[name]["sections"]:
        for r in s["rules"]:
            for p in (r.get("match"), r.get("unmatch"), r["action"].get("pattern")):
                assert not p or compiles(java_groups(p)), p


def test_view_and_pipeline_filters(spark):
    df = make(spark, ["keep this", "drop this", "keep but drop", "other"])
    both = {"sections": [{"purpose": "filter", "rules": [{"match": "keep", "action": {"type": "include"}}, {"match": "drop", "action": {"type": "exclude"}}]}]}
    assert messages(rules.rules_filter_view(df, both)) == ["keep this"]
    assert messages(rules.rules_filter_pipeline(df, both)) == ["keep this", "other"]
    only = {"sections": [{"purpose": "filter", "rules": [{"match": "keep", "action": {"type": "include"}}]}]}
    assert len(messages(rules.rules_filter_pipeline(df, only))) == 4
    assert messages(rules.rules_filter_view(df, only)) == ["keep this", "keep but drop"]
    assert rules.rules_filter_pipeline(df, {"sections": []}) is df


def test_bad_regex_is_a_substring(spark):
    df = make(spark, ["a [x", "b"])
    assert messages(df.where(regex_or_contains(df.message, "[X"))) == ["a [x"]


@pytest.mark.parametrize(
    ("pattern", "sign"),
    [
        (r"[\w.]+@[\w.]+", "@"), (r"\b\d{3}-\d{2}\b", "-"), ("a|b@c", None), ("b@c|a", None), ("x(@)?y", None), (r"x@?y", None), (r"x@*y", None), (r"x@{0,2}y", None), (r"[@]y", None), (r"[\]@]z", None), (r"\[x\]", "["),
        (r"user=(?<uid>\d+)", "="), (r"(?i)a(b[)]@)c", None), (r"\.x", "."), (".x", None), ("plain", None), ("a@+b", "@"), ("", None),
    ],
)
def test_required_sign(pattern, sign):
    assert required_sign(pattern) == sign


def test_extract_merges_spans_and_keeps_old_values(spark):
    df = make(spark, ["2024-01-02 03:04:05, Info  DISM API: PID=12 TID=34 done", "nothing"], provider="p", task_name="t")
    first, second = rules.extract(df, packs.DISM_FIELDS).orderBy("row_id").collect()
    assert (first.provider, first.task_name, first.process_id, first.thread_id, first.message) == ("DISM", "API", "12", "34", "done")
    assert (second.provider, second.task_name, second.message) == ("p", "t", "nothing")
    cbs = rules.extract(make(spark, ["2016-09-28 04:30:31, Info                  CBS    Loaded [HRESULT = 0x800f0805 - X]"]), packs.CBS_FIELDS).first()
    assert (cbs.provider, cbs.task_name, cbs.event_id, cbs.message) == ("CBS", "CBS", "0x800f0805", "Loaded [HRESULT = 0x800f0805 - X]")
    preview = rules.preview_extract(df, packs.DISM_FIELDS, 1).first()
    assert preview.before.startswith("2024") and preview.after == "done"


def test_overlapping_strips(spark):
    own = {"sections": [{"rules": [{"match": "abc", "action": {"type": "extract", "pattern": "bcd", "strip": True}}, {"match": "abc", "action": {"type": "extract", "pattern": "cde", "strip": True}}]}]}
    assert messages(rules.extract(make(spark, ["x abcdef y"]), own)) == ["x af y"]


def test_providers_and_unmatch(spark):
    own = {"sections": [{"purpose": "enrichment", "providers": ["P"], "rules": [{"match": "a", "unmatch": "z", "action": {"type": "tag", "tag": "T"}}, {"match": "a", "enabled": False, "action": {"type": "tag", "tag": "U"}}]}]}
    got = rules.tag(make(spark, ["a", "az", "b"], provider="p"), own).orderBy("row_id").collect()
    assert [r.tags for r in got] == [["T"], [], []]
    assert all(r.tags == [] for r in rules.tag(make(spark, ["a"], provider="q"), own).collect())
    assert rules.tag(make(spark, ["a"], provider="p"), own).where(rules.has_tag("t")).count() == 1


def test_date_range(spark):
    now = dt.datetime(2024, 5, 1)
    assert rule_date("-30d", now) == dt.datetime(2024, 4, 1) and rule_date("2024-01-01", now) == dt.datetime(2024, 1, 1) and rule_date("x", now) is None
    assert parse_span("90m") == dt.timedelta(minutes=90) and not parse_span("bad")
    df = as_events(spark.sql("SELECT 1L AS row_id, timestamp_ntz'2024-01-05' AS log_time, 'm' AS searchable UNION ALL SELECT 2L, timestamp_ntz'2023-01-05', 'm'"))
    own = {"sections": [{"rules": [{"match": "m", "dateRange": {"after": "2024-01-01"}, "action": {"type": "tag", "tag": "new"}}]}]}
    assert [r.tags for r in rules.tag(df, own).orderBy("row_id").collect()] == [["new"], []]


def test_redact(spark):
    text = "mail a.b@c.org card 1234-5678-9012-3456 ssn 123-45-6789 call 555-123-4567 mac 00:1A:2b:3c:4D:5e ip 10.0.0.1"
    df = make(spark, [text], username="x@y.com").selectExpr("* EXCEPT (fields)", "map('k', 'me@here.net') AS fields")
    r = rules.redact(df, packs.PII_REDACT).first()
    assert r.message == "mail [REDACTED-EMAIL] card [REDACTED-CARD] ssn [REDACTED-SSN] call [REDACTED-PHONE] mac [REDACTED-MAC] ip 10.0.0.1"
    assert r.username == "[REDACTED-EMAIL]" and r.fields == {"k": "[REDACTED-EMAIL]"}
    assert rules.rules_filter_view(df, packs.PII_FILTER).count() == 0


def test_load_and_validate(tmp_path):
    (tmp_path / "b.rules.json").write_text(json.dumps({"sections": [{"name": "B", "purpose": "filter", "rules": [{"match": "x", "action": {"type": "exclude"}}]}]}))
    (tmp_path / "a.rules.json").write_text(json.dumps({"sections": [{"name": "A", "purpose": "uml", "rules": []}], "inputs": [{"path": "p"}]}))
    (tmp_path / "c.rules.json").write_text("{")
    got, problems = load_rules([str(tmp_path)])
    assert [s["name"] for s in got["sections"]] == ["A", "B"] and got["inputs"] == [{"path": "p"}] and len(problems) == 1
    assert [s["name"] for s in sections(got, "filter")] == ["B"]
    assert validate_rules("{") and validate_rules("[]") and validate_rules('{"sections": [{"name": "x"}]}') == ["error: x: no purpose", "error: x: no rules"]
    assert validate_rules('{"sections": [{"purpose": "odd", "rules": [{}]}]}') == ["warning: section 0: unusual purpose odd", "warning: section 0: ? has no action"]


def test_payloads(spark):
    df = make(spark, ["start a=\"1\" b=\"x y\""]).selectExpr("* EXCEPT (fields)", "map('a', '1', 'b', 'x y') AS fields")
    out = {f: df.select(rewrite.render_payload(df.fields, f)).first()[0] for f in rewrite.FORMATS}
    assert out == {"key_value_quoted": 'a="1" b="x y"', "key_value": 'a=1 b="x y"', "json": '{"a":"1","b":"x y"}', "pipe": "a: 1 | b: x y | ", "custom": 'a="1" b="x y" '}
    assert messages(rewrite.reformat_payload(df, "key_value_quoted", "json")) == ['start {"a":"1","b":"x y"}']
    assert messages(rewrite.reformat_payload(df, "pipe", "json")) == messages(df)
    assert rewrite.validate_pattern("a") and rewrite.validate_pattern("(?<a_b>[") and rewrite.validate_pattern("(?<a_b>x)") is None


def test_sinks(spark, tmp_path):
    df = make(spark, ['say "hi", you', "two"], provider="p").selectExpr("* EXCEPT (tags)", "array('T') AS tags")
    fields = ["time", "level", "provider", "message"]
    sinks.write_csv(df, str(tmp_path / "csv"), fields)
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert sorted(r.message for r in back.collect()) == ['say "hi", you', "two"] and back.columns == fields
    sinks.write_json(df, str(tmp_path / "json"), fields)
    assert sorted(r.message for r in spark.read.json(str(tmp_path / "json")).collect()) == ['say "hi", you', "two"]
    sinks.write_xml(df, str(tmp_path / "xml"), ["message", "machine name"])
    assert spark.read.format("xml").option("rowTag", "Result").load(str(tmp_path / "xml")).count() == 2
    sinks.write_txt(df, str(tmp_path / "txt"), ["level", "message"])
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "txt")).collect())[1] == "level=Info | message=two"
    for fmt in ("csv", "json", "txt"):
        sinks.write_results(df, str(tmp_path / f"r{fmt}"), fmt)
    assert "[] Info p: two" in [r.value for r in spark.read.text(str(tmp_path / "rtxt")).collect()]
    sinks.write_html_rows(df, str(tmp_path / "html"))
    assert any("say &quot;hi&quot;" in r.value for r in spark.read.text(str(tmp_path / "html")).collect())
    paths = sinks.run_output_rules(df, [{"rules": [{"name": "o", "match": "two", "actions": [{"type": "output", "format": "json", "path": f"{tmp_path}/{{date}}", "tag": "t", "fields": ["message"]}]}]}])
    assert [r.message for r in spark.read.json(paths[0]).collect()] == ["two"] and "{" not in paths[0]


_PARTS = st.sampled_from(["a", "b", "x", "@", "-", "_", ".", ":", r"\.", r"\w", r"\d", "[a-c]", "[^@]", r"[\w&&[^_]]", "(a)", "(?:b@)", "(?<q>a)", r"\k<q>", "(a|@)", "|", "?", "*", "+", "{2}", r"\Q", r"\E", "^", "$", r"\b", "(?i)", "(?x)", "(?=a)", "(?!@)"])
_TEXTS = ["", "a", "b@", "a@b", "aa", "a-b", "x.y", "a:b@c", "_", "aab", "ab ab", "x@", "-", "a_b", "@@", "b.b", ":", "aa@aa", "abx"]


def test_guard_changes_no_match(spark):
    """Random patterns over random texts: the guarded regular expression finds what the plain one does."""
    patterns = set()

    @settings(max_examples=250, deadline=None, database=None, derandomize=True)
    @given(st.lists(_PARTS, min_size=1, max_size=5))
    def draw(parts):
        patterns.add("".join(parts))

    draw()
    fit = [p for p in sorted(patterns) if required_sign(p) and compiles("(?iu)" + java_groups(p))]
    assert len(fit) > 15
    rows = spark.createDataFrame([(t,) for t in _TEXTS], "t string")
    plain = lambda p: F.coalesce(F.col("t").rlike("(?iu)" + java_groups(p)), F.lit(False))
    for i in range(0, len(fit), 60):
        differ = [F.count_if(regex_or_contains(F.col("t"), p) != plain(p)).alias(f"p{j}") for j, p in enumerate(fit[i : i + 60])]
        found = rows.agg(*differ).first()
        assert not any(found), [fit[i + j] for j, n in enumerate(found) if n]


@pytest.mark.parametrize("pattern", [r"(?<q>a)\k<q>", r"[\w&&[^_]]+x", r"\Qa@\E", "(?x) a # @", "a@?b", "a|@"])
def test_no_sign_is_required(pattern):
    assert required_sign(pattern) is None


SLOW = [r"^(a|a)+$", r"(a*)*b", r"(a+)+$", r"(\w+\s?)*x", r"^(\d+,?)+$", r"(.*)*z", r"(a|ab|b)+c", r"(?:x|[a-z])+!", r"([a-z]+)*\d", r"(?<x>a|b|ab)*c", r"((a{2}|a{3})+)$"]
QUICK = [r"abc", r"a*b", r"\d+\.\d+", r"(ab)+c", r"(a|b)*c", r"^\s*(\w+)=(\w+)$", r"(?:\d{1,3}\.){3}\d{1,3}", r".*error.*", r"(\w+,)*\w+", r"[a|b|a]+", r"(\||a)+", r"(a|b\p{L}", r"(?<=,\s{1,4}(?:Info|Error)\s{1,40})(?<comp>CBS|CSI)\b"]


def test_ambiguous_patterns():
    assert [p for p in SLOW if not ambiguous(p)] == [] and [p for p in QUICK if ambiguous(p)] == []
    shipped = [x for pack in packs.PACKS.values() for s in pack["sections"] for r in s["rules"] for x in (r.get("match"), r["action"].get("pattern")) if x]
    assert shipped and not any(map(ambiguous, shipped))


def test_slow_patterns_end(spark):
    text = "a" * 100_000
    df = as_events(spark.createDataFrame([(0, text), (1, "has (a*)*b in it"), (2, "ab")], "row_id long, searchable string")).cache()
    df.count()
    for pattern in SLOW:
        began = time.perf_counter()
        found = {r.row_id for r in df.where(regex_or_contains(F.col("searchable"), pattern)).select("row_id").collect()}
        assert found == ({1} if pattern == "(a*)*b" else set()) and time.perf_counter() - began < 5


@settings(max_examples=60, deadline=None)
@given(st.recursive(st.sampled_from(["a", "b", "[ab]", "c"]), lambda x: st.one_of(st.tuples(x, x).map("".join), st.tuples(x, x).map(lambda t: f"(?:{t[0]}|{t[1]})"), x.map(lambda t: f"(?:{t})+"), x.map(lambda t: f"(?:{t})?")), max_leaves=7))
def test_patterns_that_are_not_ambiguous_do_not_explode(pattern):
    """A pattern judged safe fails within few steps on words of its own letters; Python's matcher, which backtracks as well, is the clock."""
    if not ambiguous(pattern):
        for word in ("a" * 28, "ab" * 14, "abc" * 9, "b" * 28):
            began = time.process_time()
            re.fullmatch(pattern, word + "!")
            assert time.process_time() - began < 1


def test_processors(spark):
    """Registered names are free once, unknown ones fail, routed rows reach their processor, no rows still make lines."""
    df = as_events(spark.createDataFrame([(1, "a x"), (2, "b x"), (3, None)], "row_id long, searchable string"))
    own = {"sections": [{"purpose": "enrichment", "rules": [{"match": "x", "actions": [{"type": "tag", "tag": "T"}, {"type": "tag"}]}, {"match": "^b", "action": {"type": "route", "processor": "count"}}, {"match": "a", "action": {"type": "route", "processor": "nowhere"}}]}]}
    said = lambda out: [(r.processor, r.no, r.value) for r in out.orderBy("processor", "no").collect()]
    report = {"tags": processors.tag_report(own)}
    assert said(processors.process(df, ["tags", "count", "tags"], report)) == [("count", 0, "There were: 3 results."), ("tags", 0, "Found 6 results"), ("tags", 1, "Tags found:"), ("tags", 2, "  T: 2")]
    assert said(processors.process(df.limit(0), ["tags", "count"], report)) == [("count", 0, "There were: 0 results."), ("tags", 0, "Found 0 results")]
    assert said(processors.process_routes(rules.route(df, own))) == [("count", 0, "There were: 1 results.")]
    assert processors.process(df, []).count() == 0
    with pytest.raises(ValueError, match="no such"):
        processors.process(df, ["nowhere"])
    with pytest.raises(ValueError, match="already"):
        processors.processor("count")(processors.count_lines)


def test_patterns_from_their_sign(spark):
    """A pattern that opens with letters and a sign finds what it found, and is not tried at every letter."""
    texts = ["", "user=12", "USER=12 x", "x=1 user=2", "user=1x user=32", "user=", "=user", "a=b\nuSer=72\n", "superuser=2", "user=2=", "use=r2", "user==2", "=" * 20_000 + "user=12"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for p in (r"user=\d+2\b", r"user=\d*2\b", r"(user)=2", r"user=2|x", r"user=?2", r"user={1}2", r"user=(?<k>\d)\k<k>", r"us.r=2", r"user=(2|3)+$", "user="):
        got = [r[0] for r in df.select(regex_or_contains(F.col("t"), p)).collect()]
        assert got == [r[0] for r in df.select(F.col("t").rlike("(?iu)" + p)).collect()], p
    assert from_sign(r"user=\d+2\b") != r"user=\d+2\b" and from_sign("user=2|x") == "user=2|x" and from_sign("user=?2") == "user=?2"


def test_substrings_without_case(spark):
    terms = ["ab1.", "B", "1.-", "K", "i"]
    texts = ["AB1.x", "ab1", "xB", "1.-", "", None, "K", "İ", "k"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for term in terms:
        got = [r[0] for r in df.select(F.coalesce(contains_ci(F.col("t"), term), F.lit(False))).collect()]
        assert got == [r[0] for r in df.select(F.coalesce(F.contains(F.lower("t"), F.lit(term.lower())), F.lit(False))).collect()], term


def test_lookbehinds_last(spark):
    """What follows a look-behind is looked for first; groups and matches stay."""
    texts = ["", ", Error   CBS x", ", Info CBS CSI", "CBS", ",  Warning  SXS", ", Error MIG    [a.exe] MIG", "xa1", "ya1 xb2", None]
    patterns = [r"(?<=,\s{1,4}(?:Info|Warning|Error)\s{1,40})(?<comp>CBS|CSI|SXS)\b", r"(?<=,\s{1,4}(?:Info|Error)\s{1,40})(?<comp>[A-Z][A-Za-z0-9]{1,9})(?=\s{2,})", r"(?<=x)(?<comp>a|b)(\d)", r"(?<!x)(?<comp>[ab(])\d"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for p in patterns:
        looked = rules.lookbehind_last(p)
        assert looked != p
        for group in (0, 1):
            one, two = ([r[0] for r in df.select(F.regexp_extract("t", java_groups(x), group)).collect()] for x in (p, looked))
            assert one == two, p
    for p in (r"(?<=x)a|b", r"(?<=x)(a)\1", r"(?<k>a)", r"(?<=x)?a", "a(?<=a)"):
        assert rules.lookbehind_last(p) == p


def test_extract_runs_each_pattern_once(spark):
    """The gate's and the pattern's test, the field, and place and length of the span: no copies of them in the plan."""
    df = make(spark, ["2024-05-06 07:08:09, Error                 CBS    Exec: Failed [HRESULT = 0x7 - E_FAIL]"])
    done = rules.extract(df, packs.CBS_FIELDS)
    r = done.first()
    assert (r.provider, r.task_name, r.event_id, r.message) == ("CBS", "CBS", "0x7", "Exec: Failed [HRESULT = 0x7 - E_FAIL]") and done.columns == df.columns
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract") + plan.count("regexp_instr") < 12, plan
