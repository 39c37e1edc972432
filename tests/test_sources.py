"""Readers over small files, streams, incremental ingest, paging, diagrams."""

import datetime as dt
import json
import random
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, LessThanOrEqual

from logloom import queries_files, sinks, streaming
from logloom.functions.parse import flexible_time, line_time, parse_time
from logloom.model import as_events
from logloom.operators import analysis, paging, sequence, trigram
from logloom.plans.search import any_contains
from logloom.plans.spec import SortSpec
from logloom.sources.datasource import SyntheticLogs, ranges, register
from logloom.sources.delimited import read_csv_files, read_csv_logs, read_tsv_export
from logloom.sources.eventxml import read_event_xml
from logloom.sources.folder import read_folder, read_inputs, rebase_source, renumbered, source_type, union_sources
from logloom.sources.incremental import compact, ingest_incremental, manifest, read_store
from logloom.sources.jsonlogs import array_elements, read_json_array, read_json_doc, read_json_lines
from logloom.sources.synth import synthetic_logs
from logloom.sources.tables import issues_to_events, legacy_entries_to_events, rows_to_events, work_items_to_events
from logloom.sources.text import number_lines, read_text_logs, text_lines
from logloom.sources.trace import read_trace_text


def test_times(spark):
    texts = ["2024-01-02 03:04:05", "2024-01-02T03:04:05.123Z", "2024-01-02T03:04:05+02:00", "2024/01/02 03:04:05", "1/2/2024 3:04:05 PM", "2024-01-02 03:04:05,250", "2024-01-02", "no", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", flexible_time(F.col("t")).alias("v")).orderBy("i")
    d = dt.datetime
    assert [r.v for r in df.collect()] == [d(2024, 1, 2, 3, 4, 5), d(2024, 1, 2, 3, 4, 5, 123000), d(2024, 1, 2, 1, 4, 5), d(2024, 1, 2, 3, 4, 5), d(2024, 1, 2, 15, 4, 5), d(2024, 1, 2, 3, 4, 5, 250000), d(2024, 1, 2), None, None]
    one = spark.createDataFrame([("1704164645", "1704164645000", "[2024-01-02 03:04:05] INFO: x", "2024-01-02T03:04:05.5Z INFO x", "2024-01-02 03:04:05, Info x", "2024-01-02 x", "x 2024")], "a string, b string, c string, d string, e string, f string, g string")
    r = one.select(parse_time(F.col("a")), parse_time(F.col("b")), *[line_time(F.col(c)) for c in "cdefg"]).first()
    assert list(r) == [d(2024, 1, 2, 3, 4, 5), d(2024, 1, 2, 3, 4, 5), d(2024, 1, 2, 3, 4, 5), d(2024, 1, 2, 3, 4, 5, 500000), d(2024, 1, 2, 3, 4, 5), d(2024, 1, 2), None]


def test_text(spark, tmp_path):
    (tmp_path / "app.log").write_text("[2024-01-02 03:04:05] ERROR: boom\n\n   \nwarning: low\nplain\n")
    (tmp_path / "bin.log").write_bytes(b"MZ\x00\x01\nrest\n")
    rows = read_text_logs(spark, str(tmp_path)).orderBy("message").collect()
    assert [(r.message, r.level, r.provider) for r in rows] == [("[2024-01-02 03:04:05] ERROR: boom", 1, "app"), ("plain", 3, "app"), ("warning: low", 2, "app")]
    assert rows[0].log_time == dt.datetime(2024, 1, 2, 3, 4, 5) and rows[0].source.endswith("app.log")


def test_row_ids_in_load_order(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        for name in "ba":
            (tmp_path / f"{name}.log").write_text("".join(f"{name} line {i}\n" + "\n" * (i % 3) for i in range(700)))
        rows = read_text_logs(spark, str(tmp_path), ids=True).orderBy("row_id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.row_id for r in rows] == list(range(1400))
    assert [r.message for r in rows] == [f"{name} line {i}" for name in "ab" for i in range(700)]


def test_csv(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_text('Timestamp,Level,Provider,ThreadId,Message,Region,\n2024-01-02 03:04:05,warn,Auth,7,"a, b",eu,x\n,E,Auth,,plain,us,\n')
    first, second = read_csv_logs(spark, str(f)).orderBy(F.desc("message")).collect()[::-1]
    assert (first.message, first.level, first.provider, first.thread_id, first.fields["Region"], first.fields["col7"]) == ("a, b", 2, "Auth", "7", "eu", "x")
    assert (second.level, second.log_time, second.searchable) == (1, None, " E Auth  plain us ")
    over = read_csv_logs(spark, str(f), overrides={"Message": "-", "Region": "message"}).orderBy("message").collect()
    assert [r.message for r in over] == ["eu", "us"]
    g = tmp_path / "b.csv"
    g.write_text("k;v\n1;2\n")
    assert read_csv_logs(spark, str(g)).first().message == "1 2"


def test_json(spark, tmp_path):
    lines = tmp_path / "a.jsonl"
    lines.write_text('{"@t": "2024-01-02T03:04:05Z", "@l": "Error", "@m": "bad", "n": {"x": 1}}\nbroken\n{"time": "1704164645", "logger": "L", "msg": ""}\n')
    a, b = read_json_lines(spark, str(lines)).orderBy("level").collect()
    assert (a.message, a.level, json.loads(a.fields["n"]), a.log_time) == ("bad", 1, {"x": 1}, dt.datetime(2024, 1, 2, 3, 4, 5))
    assert (b.provider, b.message, b.log_time) == ("L", "1704164645 L ", dt.datetime(2024, 1, 2, 3, 4, 5))
    for text, n in (('[{"msg": "a"}, {"msg": "b"}]', 2), ('{"meta": 1, "rows": [{"msg": "a"}]}', 1), ('{\n "msg": "one"\n}', 1), ('{"msg": "a"}\n{"msg": "b"}\n', 2)):
        f = tmp_path / "doc.json"
        f.write_text(text)
        assert read_json_doc(spark, str(f)).count() == n, text


def test_xml_trace_tsv(spark, tmp_path):
    x = tmp_path / "e.xml"
    x.write_text(
        '<Events><Event><System><Provider Name="Svc" Guid="{1}"/><EventID>42</EventID><Level>2</Level><TimeCreated SystemTime="2024-01-02T03:04:05.1234567Z"/><EventRecordID>9</EventRecordID>'
        '<Correlation ActivityID="{a}"/><Execution ProcessID="4" ThreadID="8"/><Channel>App</Channel><Computer>pc</Computer></System>'
        '<EventData><Data Name="k">v</Data><Data>w</Data><Data Name="k">z</Data></EventData></Event></Events>'
    )
    r = read_event_xml(spark, str(x)).first()
    assert (r.provider, r.level, r.event_id, r.process_id, r.activity_id, r.fields, r.message) == ("Svc", 1, "42", "4", "{a}", {"k": "v", "Data2": "w"}, "k: v, Data2: w, k: z")
    assert r.log_time == dt.datetime(2024, 1, 2, 3, 4, 5, 123456)
    t = tmp_path / "t.trace"
    t.write_text('[0]0A2C.0B10::01/02/2024-03:04:05.123 [Prov]{"Message":"hello","Level":2}\nno header\n')
    r = read_trace_text(spark, str(t)).collect()
    assert [(x.provider, x.process_id, x.thread_id, x.message, x.level, x.log_time) for x in r] == [("Prov", "2604", "2832", "hello", 1, dt.datetime(2024, 1, 2, 3, 4, 5, 123000))]
    v = tmp_path / "k.tsv"
    v.write_text("PreciseTimeStamp\tProviderName\tLevel\tMessage\n2024-01-02T03:04:05Z\tP\t3\tm\nshort\tP\n")
    r = read_tsv_export(spark, str(v)).collect()
    assert [(x.provider, x.level, x.message) for x in r] == [("P", 2, "m")]


def test_tables(spark):
    one = rows_to_events(spark.createDataFrame([("[2024-01-02 03:04:05] ERROR: boom",)], "line string"), "q").first()
    assert (one.message, one.level, one.log_time) == ("boom", 1, dt.datetime(2024, 1, 2, 3, 4, 5))
    w = work_items_to_events(spark.createDataFrame([("1", "Crash", "Active", "Bug", "Ann <a@b.c>", "1")], "`System.Id` string, `System.Title` string, `System.State` string, `System.WorkItemType` string, `System.AssignedTo` string, Priority string")).first()
    assert (w.message, w.level, w.username, w.fields["Title"]) == ("Crash", 1, "Ann", "Crash")
    i = issues_to_events(spark.createDataFrame([(5, "T", "open", ["Bug", "x"])], "number int, title string, state string, labels array<string>")).first()
    assert (i.level, i.event_id, i.task_name) == (2, "5", "Bug, x")
    e = legacy_entries_to_events(spark.createDataFrame([(0x40000007, "Warning", ["a", "b"], dt.datetime(2024, 1, 1))], "instance_id long, entry_type string, replacement_strings array<string>, time_generated timestamp_ntz")).first()
    assert (e.event_id, e.level, e.fields, e.message) == ("7", 2, {"Data1": "a", "Data2": "b"}, "a b")


def test_folder_and_incremental(spark, tmp_path):
    logs = tmp_path / "in"
    (logs / "sub").mkdir(parents=True)
    (logs / "a.log").write_text("one\ntwo\n")
    (logs / "sub" / "b.jsonl").write_text('{"msg": "three"}\n')
    (logs / "c.bin").write_text("x")
    assert sorted(r.message for r in read_folder(spark, str(logs)).collect()) == ["one", "three", "two"]
    assert sorted(r.message for r in read_folder(spark, str(logs), "shallow").collect()) == ["one", "two"]
    assert read_inputs(spark, {"inputs": [{"type": "folder", "path": str(logs)}, {"path": "gone", "enabled": False}]}).count() == 3
    moved = rebase_source(read_folder(spark, str(logs), "shallow"), str(logs), "zip:")
    assert {r.source for r in moved.collect()} == {"zip:/a.log"}
    store = str(tmp_path / "store")
    assert ingest_incremental(spark, str(logs), store, lambda s, p: read_text_logs(s, [x for x in p if x.endswith(".log")])) == 3
    assert ingest_incremental(spark, str(logs), store, read_text_logs) == 0
    assert sorted(r.message for r in read_store(spark, store).collect()) == ["one", "two"]
    kinds = spark.createDataFrame([("x/T.ETL.001",), ("y.LOG",), ("z",)], "p string").select(source_type(F.col("p")).alias("k")).collect()
    assert [r.k for r in kinds] == ["ETL", "Text", "Other"]


def test_stream_equals_batch(spark, tmp_path):
    logs = tmp_path / "in"
    logs.mkdir()
    (logs / "a.log").write_text("2024-01-02 03:04:05 error x\nplain\n\nwarn y\n")
    stream = streaming.stream_events(spark, str(logs))
    got = streaming.collect_bounded(stream, str(tmp_path / "store"), str(tmp_path / "ckpt"))
    batch = read_text_logs(spark, str(logs))
    pick = lambda df: sorted((r.message, r.level, str(r.log_time)) for r in df.collect())
    assert pick(got) == pick(batch) and got.count() == 3


def test_paging(spark):
    df = synthetic_logs(spark, 300, 4)
    assert df.agg(F.countDistinct("row_id")).first()[0] == 300
    assert [r.level for r in df.orderBy("row_id").limit(14).collect()] == [1, 3, 3, 3, 3, 3, 3, 2, 3, 3, 3, 3, 3, 4]
    for sort in (SortSpec(), SortSpec("Level"), SortSpec("Time", True), SortSpec("Message", True), SortSpec("Index", True)):
        order = [r.row_id for r in paging.sort_events(df, sort).collect()]
        assert [r.row_id for r in paging.page(df, sort, 290, 20).collect()] == order[290:310]
        assert [r.row_id for r in paging.last_page(df, sort, 64).collect()] == order[256:]
        assert paging.row_position(df, sort, 123) == order.index(123)
        at = order.index(2)
        assert [r.row_id for r in paging.context(df, sort, 2, 3, 3).collect()] == order[max(0, at - 3) : at + 4]
        numbered = {r.row_id: r.position for r in paging.with_position(df, sort).collect()}
        assert all(numbered[x] == i for i, x in enumerate(order))
    assert paging.row_position(df, SortSpec(), 999) == -1 and paging.context(df, SortSpec(), 999, 1, 1).count() == 0
    assert paging.last_page(df.limit(0), SortSpec(), 10).count() == 0 and paging.page_of(99, 50) == 1
    assert paging.cap_rows(df, 10)[1] and not paging.cap_rows(df, -1)[1]


def test_histogram_edges(spark):
    times = [dt.datetime(2024, 1, 1, 0, m) for m in (0, 5, 10, 10)]
    df = as_events(spark.createDataFrame(list(enumerate(times)), "row_id long, log_time timestamp_ntz"))
    assert [r.n for r in analysis.histogram(df, 2).collect()] == [1, 3]
    assert [r.n for r in analysis.histogram(df.limit(1), 5).collect()] == [1] and analysis.histogram(df.limit(0), 5).count() == 0
    assert analysis.density_wide(df, 2).collect()[1]["3"] == 3


def test_index_equals_scan(spark):
    df = synthetic_logs(spark, 2000, 4)
    tri = trigram.build_trigrams(df)
    for term in ("needle_0", "ALPHA b", "line 77", "zz", "nope nope"):
        assert sorted(r.row_id for r in trigram.search_indexed(df, tri, term).collect()) == sorted(r.row_id for r in df.where(any_contains(term)).collect())


def test_index_takes_any_id(spark, tmp_path):
    """Ids below 0, far apart and at both ends; columns that repeat; rows without an id; a short scan and times."""
    rows = [(i * i * 7919 - 40_000, f"entry {i} of the log", f"App{i % 3}", dt.datetime(2024, 1, 1, 0, i % 60)) for i in range(300)]
    rows += [(2**63 - 1, "last entry", "Top\u00c4", None), (-(2**63), "first entry", "Bottom", None), (None, "no id entry", "App1", None), (5, "naïve 😀 entry", "x", None)]
    df = as_events(spark.createDataFrame(rows, "row_id long, message string, provider string, log_time timestamp_ntz")).withColumn("searchable", F.concat("message", F.lit(" (all)"))).repartition(3)
    trigram.save_trigrams(df, str(tmp_path / "one"))
    trigram.save_trigrams(df, str(tmp_path / "two"), None, 0)
    trigram.save_trigrams(df, str(tmp_path / "two"), 0)
    assert trigram.indexed_ranges(spark, str(tmp_path / "one")) == ["all"] and trigram.indexed_ranges(spark, str(tmp_path / "two")) == ["..0", "0.."]
    for index in (trigram.load_trigrams(spark, str(tmp_path / "one")), trigram.load_trigrams(spark, str(tmp_path / "two"))):
        for term in ("entry 29", "APP1", "topä", "bottom", "no id", "😀 e", "00:17", "2024-01-01", "(all)", "log (", "zzz", "17"):
            assert sorted(map(repr, trigram.search_indexed(df, index, term).collect())) == sorted(map(repr, df.where(any_contains(term)).collect())), term
    stats = trigram.index_stats(trigram.load_trigrams(spark, str(tmp_path / "one"))).first()
    assert stats.rows == 303


def test_text_ids_are_those_of_a_sort(spark, tmp_path):
    logs = tmp_path / "in"
    logs.mkdir()
    for name, n in (("b.log", 3000), ("a.log", 1), ("c.log", 500), ("empty.log", 0)):
        (logs / name).write_text("".join(f"{name} line {i} {'x' * (i % 50)}\n{chr(10) if i % 7 == 0 else ''}" for i in range(n)))
    (logs / "bin.log").write_text("text\nwith \0 sign\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        lines = text_lines(spark, str(logs))
        got = read_text_logs(spark, str(logs), ids=True)
        plan = got._jdf.queryExecution().executedPlan().toString()
        found = {(r.row_id, r.message) for r in got.collect()}
        blocks = lines.select("path", "block").distinct().count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    order = [f"{name} line {i} {'x' * (i % 50)}" for name, n in (("a.log", 1), ("b.log", 3000), ("c.log", 500)) for i in range(n)]
    assert found == set(enumerate(order)) and blocks > 5
    assert "Sort " not in plan or "value" not in plan[plan.index("Sort ") : plan.index("Sort ") + 200]


def test_versions_of_a_store(spark, tmp_path):
    logs, store = tmp_path / "in", str(tmp_path / "store")
    logs.mkdir()
    (logs / "a.log").write_text("one\ntwo\n")
    (logs / "b.log").write_text("three\n")
    load = lambda rules: ingest_incremental(spark, str(logs), store, lambda s, p: read_text_logs(s, p).withColumn("tags", F.array(F.lit(rules))), rules)
    state = lambda rules=None: sorted((r.message, *r.tags) for r in read_store(spark, store, rules).collect())
    assert state() == []
    for rules in "abcd":
        assert load(rules) == 2 and state() == [("one", rules), ("three", rules), ("two", rules)]
    assert state("b") == [("one", "b"), ("three", "b"), ("two", "b")]
    (logs / "b.log").unlink()
    (logs / "a.log").write_text("one\nmore than before\n")
    assert load("d") == 1 and state() == [("more than before", "d"), ("one", "d")] and load("d") == 0
    compact(spark, store)
    assert state() == [("more than before", "d"), ("one", "d")] and manifest(spark, store).count() == 1 and load("d") == 0
    (logs / "b.log").write_text("again\n")
    assert load("d") == 1 and len(state()) == 3


def test_ids_of_parts_are_checked(spark):
    df = as_events(spark.createDataFrame([(-5, "a"), (7, "b"), (7, "c")], "row_id long, message string"))
    with pytest.raises(Exception, match="row_id of part 1"):
        union_sources([df.limit(0), df]).collect()
    out = union_sources([renumbered(df), renumbered(df), df.withColumn("row_id", F.lit(None).cast("long"))])
    assert out.where("row_id is not null").select("row_id").distinct().count() == 6 and out.count() == 9
    assert sorted(r.row_id for r in union_sources([df]).collect()) == [-5, 7, 7]


def test_one_line_many_times_has_many_ids(spark, tmp_path):
    logs = tmp_path / "in"
    logs.mkdir()
    (logs / "a.log").write_text("same line\n" * 200_000)
    (logs / "b.log").write_text("same line\nother\n")
    store, check = str(tmp_path / "store"), str(tmp_path / "check")
    streaming.ingest(streaming.stream_events(spark, str(logs)), store, check).awaitTermination()
    (logs / "c.log").write_text("late\n")
    streaming.ingest(streaming.stream_events(spark, str(logs)), store, check).awaitTermination()
    stored = spark.read.parquet(store)
    assert stored.agg(F.count("row_id"), F.count_distinct("row_id"), F.min("row_id"), F.max("row_id")).first()[:] == (200_003, 200_003, 0, 200_002)
    assert stored.where("message = 'late'").first().row_id == 200_002 and streaming.held_rows(spark, store) == 200_003


def test_collection_ends(spark, tmp_path):
    """At the n-th event, and in time while a source never rests."""
    source = spark.readStream.format("rate").option("rowsPerSecond", 1000).load()
    steady = as_events(source.select(F.col("value").alias("row_id"), F.col("timestamp").cast("timestamp_ntz").alias("log_time"), F.lit("tick").alias("message")))
    began = time.monotonic()
    assert streaming.collect_bounded(steady, str(tmp_path / "a"), str(tmp_path / "ca"), seconds=6).count() >= 0
    assert time.monotonic() - began < 20
    assert streaming.collect_bounded(steady, str(tmp_path / "b"), str(tmp_path / "cb"), seconds=60, most=700).count() == 700
    logs = tmp_path / "in"
    logs.mkdir()
    for i in range(5):
        (logs / f"{i}.log").write_text(f"line of {i}\n" * 10)
    got = streaming.collect_bounded(streaming.stream_events(spark, str(logs), 1), str(tmp_path / "c"), str(tmp_path / "cc"), most=23)
    assert sorted(r.row_id for r in got.collect()) == list(range(23))


def test_progress_of_many_batches(spark, tmp_path):
    logs = tmp_path / "in"
    logs.mkdir()
    for i in range(130):
        (logs / f"{i}.log").write_text("a line\n")
    writer = streaming.stream_events(spark, str(logs), 1).drop("_block").writeStream.format("noop").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True)
    streaming._totals(spark)
    query = writer.start()
    query.awaitTermination()
    seen = streaming.progress(query)
    assert (seen["rows"], seen["active"]) == (130, False) and seen["batches"] == 130 and len(query.recentProgress) <= 100


def test_run_report(spark, tmp_path):
    report = analysis.RunReport()
    with report.timed("write"):
        report.observed(synthetic_logs(spark, 500, 2), "write").write.parquet(str(tmp_path / "x"))
    (row,) = report.rows()
    assert row["step"] == "write" and row["records"] == 500 and row["seconds"] > 0


def test_diagram_text(spark):
    rows = [(0, "open db"), (1, "call get x end"), (2, "call get x end"), (3, "close db"), (4, "close db")]
    df = as_events(spark.createDataFrame(rows, "row_id long, message string"))
    d = {
        "title": "T", "participants": [{"id": "A", "displayName": "The app", "type": "actor"}, {"id": "B"}],
        "rules": [
            {"name": "o", "match": "^open", "action": {"type": "activate", "from": "B"}},
            {"name": "c", "match": "call", "action": {"type": "message", "from": "A", "to": "B", "text": "{afterMatch:until:x}|{extract:get (\\w)}", "arrowStyle": "dashed"}},
            {"name": "x", "match": "^close", "action": {"type": "deactivate", "from": "B"}},
        ],
    }
    assert sequence.diagram_text(df, d).splitlines() == ["sequenceDiagram", "    title T", '    actor A as "The app"', "    participant B", "    activate B", "    A-->>B: 'get |x'", "    A-->>B: 'get |x'", "    deactivate B"]
    text = sequence.diagram_text(df, d | {"dedupe": True, "maxElements": 2}, "plantuml")
    assert text.splitlines() == ["@startuml", "title T", 'actor "The app" as A', "participant B", "activate B", "A --> B :  get |x ×2", "note over A : diagram truncated at 2 elements", "@enduml"]


def test_json_array_over_many_ranges(spark, tmp_path):
    """Quotes, escapes, brackets and commas in strings, nesting, line breaks, empty arrays, a mark at the start, all across borders of ranges."""
    rng = random.Random(1)

    def value(depth=0):
        kind = rng.random()
        if kind < 0.5:
            return "".join(rng.choice('ab,"\\[]{}:\n é') for _ in range(rng.randint(0, 12)))
        if kind < 0.7 and depth < 3:
            return [value(depth + 1) for _ in range(rng.randint(0, 3))]
        if kind < 0.85 and depth < 3:
            return {f"k{i}": value(depth + 1) for i in range(rng.randint(0, 3))}
        return rng.choice([1, 2.5, None, True])

    expected = {}
    for n, (size, indent) in enumerate([(300, None), (200, 1), (0, None), (1, None), (40, None)]):
        expected[f"{n}.json"] = data = [{"id": i, "msg": value()} for i in range(size)]
        (tmp_path / f"{n}.json").write_text(("\ufeff" if n == 4 else "") + " " + json.dumps(data, ensure_ascii=n % 2 == 0, indent=indent) + " \n", encoding="utf-8")
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert spark.read.option("lineSep", ",").text(str(tmp_path)).rdd.getNumPartitions() > 30
        found = {name: [] for name in expected}
        for r in array_elements(spark, str(tmp_path)).orderBy("no").collect():
            found[r.path.split("/")[-1]].append(json.loads(r.element))
        events = read_json_array(spark, str(tmp_path / "0.json")).count()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert found == expected and events == 300


def test_json_array_pieces_stay_in_their_ranges(spark, tmp_path, sf_dir, monkeypatch):
    """Pieces are neither sorted nor shuffled, small ranges share tasks, a table is more than one array."""
    data = [{"id": i, "msg": ["a,b", '\\",', {"x": [i]}]} for i in range(3000)] + ["x" * 50_000, "end"]
    (tmp_path / "a.json").write_text(json.dumps(data))
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        found = array_elements(spark, str(tmp_path / "a.json"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert [json.loads(r.element) for r in found.orderBy("no").collect()] == data and [r.no for r in found.orderBy("no").collect()] == list(range(1, len(data) + 1))
    monkeypatch.setattr(queries_files, "ARRAY", 300)
    assert sorted(r.id for r in queries_files.read_array(spark, sf_dir).collect()) == list(range(spark.read.parquet(f"{sf_dir}/events.parquet").count()))


def test_ids_move_no_events(spark, tmp_path):
    """Ids of streams and text loads come from a broadcast table of blocks, whatever the planner knows of sizes; new ids are read without the events' texts."""
    (tmp_path / "a.log").write_text("one\ntwo\n\nthree\n")
    lines = text_lines(spark, str(tmp_path))
    batch = as_events(lines.select(F.col("path").alias("source"), F.col("value").alias("message"), F.col("block").alias("_block")), "_block")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows, n = streaming.number_batch(batch, 5)
        numbered = [rows, number_lines(lines)]
        assert all("SortMergeJoin" not in x._jdf.queryExecution().executedPlan().toString() for x in numbered)
        assert n == 3 and [sorted(r.row_id for r in x.collect()) for x in numbered] == [[5, 6, 7], [0, 1, 2]]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    new = renumbered(rows.withColumn("row_id", -F.col("row_id")))
    assert "message" not in new.select("row_id")._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.row_id, r.message) for r in new.collect()) == [(0, "one"), (1, "two"), (2, "three")] and new.columns == as_events(rows).columns


def test_csv_files_by_header(spark, tmp_path):
    for i in range(40):
        texts = [f'time,level,message\n2024-01-01 00:00:{i:02},error,"m, {i}"\n', f"Msg;pid\nm, {i};7\nshort\n", f"\n\na\t\tmsg\nx\ty\tm, {i}\n"]
        (tmp_path / f"{i}.csv").write_text(texts[i % 3])
    columns = ["log_time", "level", "message", "process_id", "searchable", "source"]
    got = read_csv_files(spark, str(tmp_path)).select(columns).collect()
    one_by_one = [tuple(r) for i in range(40) for r in read_csv_logs(spark, str(tmp_path / f"{i}.csv")).select(columns).collect()]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, one_by_one)) and len(one_by_one) == 53
    few = tmp_path / "few"
    few.mkdir()
    for i in range(3):
        (few / f"{i}.csv").write_text((tmp_path / f"{i}.csv").read_text())
    size = lambda path: read_folder(spark, str(path), "shallow")._jdf.queryExecution().optimizedPlan().toString().count("\n")
    assert size(tmp_path) == size(few)
    assert read_csv_files(spark, str(few / "0.csv")).first().fields == {"time": "2024-01-01 00:00:00", "level": "error", "message": "m, 0"}


def test_diagrams_of_groups(spark):
    rows = [(i, f"call get x{i % 4} end", "ab"[i % 2]) for i in range(30)] + [(100, "open", "c"), (101, "close", "c"), (102, "close", "c"), (103, "none", "d")]
    df = as_events(spark.createDataFrame(rows, "row_id long, message string, provider string")).repartition(4)
    d = {
        "title": "T", "participants": [{"id": "A"}, {"id": "B"}],
        "rules": [{"match": "^open", "action": {"type": "activate", "from": "B"}}, {"match": "call", "action": {"type": "message", "from": "A", "to": "B", "text": "{extract:get (\\w+)}"}}, {"match": "^close", "action": {"type": "deactivate", "from": "B"}}],
    }
    for more in ({}, {"maxElements": 4}, {"dedupe": True}, {"dedupe": True, "maxElements": 1}):
        for syntax in ("mermaid", "plantuml"):
            got = {r.provider: r.markup for r in sequence.diagram_texts(df, d | more, ["provider"], syntax).collect()}
            assert got == {p: sequence.diagram_text(df.where(F.col("provider") == p), d | more, syntax) for p in "abc"}


def test_synthetic_source(spark, tmp_path):
    """Rows are those of the batch function; bounds reach the reader; a restarted stream has no gaps."""
    register(spark)
    df = spark.read.format("synthetic_logs").option("rows", 60_000).load()
    columns = ["row_id", "log_time", "level", "message"]
    assert set(map(tuple, df.collect())) == set(map(tuple, synthetic_logs(spark, 60_000).select(columns).collect()))
    assert [(r.low, r.high) for r in ranges(0, 10, 3)] == [(0, 3), (3, 6), (6, 10)] and ranges(5, 5, 3) == []
    reader = SyntheticLogs({"rows": "1000"}).reader(None)
    left = list(reader.pushFilters([GreaterThan(("row_id",), 500), LessThanOrEqual(("row_id",), 510), EqualTo(("level",), 1)]))
    assert len(left) == 1 and [(p.low, p.high) for p in reader.partitions()] == [(501, 511)]
    few = df.where("row_id >= 500 AND row_id < 700 AND level = 1")
    kept = few._jdf.queryExecution().executedPlan().toString().split("Filter", 1)[1].splitlines()[0]  # what Spark itself still tests
    assert few.count() == 10 and "level" in kept and ">=" not in kept
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    for rows in (1000, 1700):
        stream = spark.readStream.format("synthetic_logs").option("rowsPerBatch", 300).option("rows", rows).load()
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(processingTime="50 milliseconds").start()
        end = time.monotonic() + 60
        while query.isActive and time.monotonic() < end and not (query.lastProgress and str(rows) in str(query.lastProgress["sources"][0]["endOffset"])):
            time.sleep(0.1)
        query.stop()
        assert spark.read.parquet(out).agg(F.count("row_id"), F.count_distinct("row_id"), F.max("row_id")).first()[:] == (rows, rows, rows - 1)


def test_diagram_actions(spark, tmp_path):
    """A diagram action takes the definition beside its rule file, a pack's by its name, or none; its rule's match picks no rows."""
    df = as_events(spark.createDataFrame([(1, "Client sending request to Broker req=7"), (2, "ping;"), (3, None)], "row_id long, searchable string"))
    (tmp_path / "own.json").write_text(json.dumps({"title": "O", "participants": [{"id": "A"}], "rules": [{"match": "ping", "useRegex": False, "action": {"type": "note", "from": "A", "text": "p{afterMatch}"}}]}))
    (tmp_path / "bad.json").write_text("[1")

    def drawn(action):
        section = {"purpose": "output", "_file": str(tmp_path / "x.rules.json"), "rules": [{"name": "d", "match": "nothing", "action": {"type": "UML"} | action}]}
        (path,) = sinks.run_output_rules(df, [section], str(tmp_path / "out"))
        return [r.value for r in spark.read.text(path).collect()]

    assert drawn({"rulesFile": "own.json", "syntax": "plant"}) == ["@startuml", "title O", "participant A", "note over A : p;", "@enduml"]
    assert drawn({"rulesFile": "rules\\own.json"}) == ["sequenceDiagram", "    title O", "    participant A", "    note over A: 'p#59;'"]
    assert drawn({"rulesFile": "CommonRules/process-interaction-uml.rules.json"})[-1] == "    Client->>Broker: 'request (req=7)'"
    for nowhere in ({"rulesFile": "bad.json"}, {"rulesFile": "gone.json"}):
        assert drawn(nowhere) == ["sequenceDiagram"]
