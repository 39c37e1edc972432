"""Smaller operators: reports, registries, stored index, hot sequences."""

import datetime as dt
import random

from pyspark.sql import functions as F

from logloom import sinks, streaming
from logloom.functions import text
from logloom.model import as_events
from logloom.operators import analysis, overlay, packs, paging, rewrite, rules, sequence, trigram
from logloom.plans.spec import SortSpec
from logloom.sources.folder import READERS, filter_source_types, read_folder
from logloom.sources.mapper import field_of, mapping_for
from logloom.sources.synth import synthetic_logs


def brute_runs(rows):
    out = []
    for key in rows:
        if out and out[-1][0] == key:
            out[-1][1] += 1
        else:
            out.append([key, 1])
    return [(k, n, i + 1) for i, (k, n) in enumerate(out)]


def test_runs_across_ranges(spark):
    """One sequence holds most rows, has long runs and NULL keys, and crosses all ranges of the order."""
    rng = random.Random(6)
    rows, at = [], 0
    for _ in range(400):
        k = rng.choice(["a", "b", None, "c"])
        for _ in range(rng.choice([1, 1, 2, 30])):
            rows.append(("hot" if rng.random() < 0.95 else None, at, k))
            at += rng.choice([0, 1, 3])
    df = spark.createDataFrame([(g, t, i, k) for i, (g, t, k) in enumerate(rows)], "g string, t long, i long, k string").repartition(5)
    got = sequence.collapse_runs(df, ["k"], ["g"], ["t", "i"]).collect()
    for g in ("hot", None):
        expected = brute_runs([k for x, _, k in rows if x == g])
        assert sorted(((r.k, r.n, r.seq) for r in got if r.g == g), key=lambda x: x[2]) == expected
    sums = sequence.running_sum(sequence.ranged(df.withColumn("one", F.lit(1)), "t"), ["g"], ["t", "i"], "one", "pos").where("g = 'hot'").orderBy("t", "i").collect()
    assert [r.pos for r in sums] == list(range(1, len(sums) + 1))


def test_aliases_and_cap(spark):
    df = as_events(spark.createDataFrame([(i, dt.datetime(2024, 1, 1, 0, i), p, "m") for i, p in enumerate(["B;x", "A", "B;x", "C"])], "row_id long, log_time timestamp_ntz, provider string, message string"))
    alias = sequence.actor_alias(df, "provider", ["source"]).orderBy("alias").collect()
    assert [(r.actor, r.alias) for r in alias] == [("B x", "p0"), ("A", "p1"), ("C", "p2")]
    runs = sequence.interactions(df, "provider", "message", ["source"])
    assert [(r.kind, r.from_actor, r.to_actor) for r in runs.orderBy("seq").collect()] == [("note", None, "B x"), ("message", "B x", "A"), ("message", "A", "B x"), ("message", "B x", "C")]
    assert sequence.cap_sequence(runs, ["source"], 3).orderBy("seq").collect()[-1].label == "… 1 more events (truncated)"
    assert sequence.interactions(df.limit(0), "provider", "message", ["source"]).count() == 0


def test_reports(spark):
    df = synthetic_logs(spark, 1000, 3)
    assert analysis.has_two_values(df, "level") and not analysis.has_two_values(df, "provider")
    sample, report = paging.sample_cap(df, 10)
    assert sample.count() == 10 and report == {"scanned": 10, "total": 1000, "truncated": True}
    assert analysis.run_report({"scan": (2.0, 100)}) == [{"step": "scan", "seconds": 2.0, "records": 100, "per_second": 50.0}]
    totals, each = analysis.inventory(df)
    t = totals.first()
    assert (t.events, t.providers, t.duration_micros) == (1000, 1, 999_000_000) and each.first().n == 1000
    assert analysis.top_patterns(df.limit(0)).count() == 0 and analysis.facets(df, "provider").first().n == 1000
    assert filter_source_types(df, ["Text"]).count() == 1000 and filter_source_types(df, ["CSV"]).count() == 0
    assert {r.column for r in rewrite.empty_columns(df).where("is_empty").collect()} >= {"channel", "username"}


def test_stored_index(spark, tmp_path):
    df = synthetic_logs(spark, 500, 2)
    trigram.save_trigrams(df, str(tmp_path / "tri"))
    stored = spark.read.parquet(str(tmp_path / "tri"))
    assert sorted(r.row_id for r in trigram.search_indexed(df, stored, "NEEDLE").collect()) == [0]


def test_store_round_trip(spark, tmp_path):
    df = synthetic_logs(spark, 200, 2)
    sinks.save_events(df, str(tmp_path / "store"))
    back = sinks.load_events(spark, str(tmp_path / "store"))
    assert back.columns == df.columns and sorted(r.row_id for r in back.collect()) == list(range(200))
    assert [r.row_id for r in paging.sort_events(back, SortSpec()).limit(3).collect()] == [0, 1, 2]


def test_stream_progress_and_ingest(spark, tmp_path):
    logs = tmp_path / "in"
    logs.mkdir()
    (logs / "a.log").write_text("error one\n")
    tagged = {"sections": [{"purpose": "enrichment", "rules": [{"match": "error", "action": {"type": "tag", "tag": "bad"}}]}]}
    store, check = str(tmp_path / "store"), str(tmp_path / "check")
    for n, more in ((1, None), (2, "error two\n")):
        if more:
            (logs / "b.log").write_text(more)
        q = streaming.ingest(streaming.stream_events(spark, str(logs)), store, check, enrich=lambda d: rules.enrich(d, tagged))
        q.awaitTermination()
        assert streaming.progress(q)["rows"] == 1 and not streaming.progress(q)["active"]
        assert spark.read.parquet(store).where("array_contains(tags, 'bad')").count() == n


def test_mapping_and_registry(spark, tmp_path):
    assert field_of("SourceContext") == "provider" and field_of("x", {"x": "pid"}) == "process_id" and field_of("msg", {"msg": ""}) is None
    assert mapping_for(["A", "b"], {frozenset({"a", "B"}): {"A": "message"}}) == {"A": "message"} and mapping_for(["c"], {}) is None
    (tmp_path / "x.odd").write_text("odd line\n")
    assert [r.message for r in read_folder(spark, str(tmp_path), readers=READERS | {"odd": READERS["txt"]}).collect()] == ["odd line"]


def test_packs(spark):
    def left(pack, *messages):
        df = as_events(spark.createDataFrame(list(enumerate(messages)), "row_id long, searchable string"))
        return [r.searchable for r in rules.rules_filter_view(df, pack).orderBy("row_id").collect()]

    assert left(packs.CRASH_FILTER, "Faulting Application Name: x", "fine") == ["Faulting Application Name: x"]
    assert left(packs.POWER_FILTER, "source kernel-power", "fine") == ["source kernel-power"]
    assert left(packs.NOISE_FILTER, "debug x", "debug error", "fine") == ["debug error", "fine"]


def test_overlay(spark):
    df = synthetic_logs(spark, 5, 1)
    tags = spark.createDataFrame([(1, "b", "n"), (1, "a", "m"), (9, "z", "")], "row_id long, tag string, note string")
    assert [(r.row_id, r.tag) for r in overlay.with_tags(df, tags).orderBy("row_id").collect()] == [(0, None), (1, "a"), (2, None), (3, None), (4, None)]
    assert overlay.tagged_rows(df, tags, "a").count() == 1


def test_text(spark):
    assert text.xml_name("machine name") == "machine_name" and text.xml_name("1a") == "_1a"
    row = spark.createDataFrame([('a,"b"', "Ann <x@y>", "a;b\n<c>", "C:\\x\\y.tar.gz", 'id 0x1F "q" 12')], "a string, b string, c string, d string, e string")
    r = row.select(text.csv_escape(F.col("a")), text.display_name(F.col("b")), text.mermaid_escape(F.col("c")), text.base_name(F.col("d")), text.template(F.col("e"))).first()
    assert list(r) == ['"a,""b"""', "Ann", "a#59;b #lt;c#gt;", "y.tar", "id {hex} {str} {n}"]
    files = spark.createDataFrame([("C:\\logs\\App.LOG",), ("/var/logs/app.txt",)], "p string")
    assert files.where(F.col("p").rlike(text.glob_to_regex("*/logs/*.log"))).count() == 1


def test_places_of_trigrams_are_rows(spark):
    """Every trigram of every text is in the index, a repeated one once; places are compiled rows, no lambda over a sequence."""
    texts = ["abcabcabc", "", "ab", "abc", "x\U0001f600yz\U0001f600yz", None, "Ünïcode ünïcode"]
    df = as_events(spark.createDataFrame(list(enumerate(texts)), "row_id long, message string"))
    index = trigram.build_trigrams(df)
    got = {(r.key, r.word * 64 + b) for r in index.where(F.col("kind") == trigram.TEXT).collect() for b in range(64) if r.bits >> b & 1}
    assert got == {(trigram._code(t.lower()[i : i + 3]), n) for n, t in enumerate(texts) if t for i in range(len(t) - 2)}
    plan = index._jdf.queryExecution().optimizedPlan().toString()
    assert "array_distinct" not in plan and "explode(sequence(" in plan


def test_batches_are_held_on_disk(spark, tmp_path):
    """A batch is read twice; between, it is on disk and not in the memory of its tasks."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("one\ntwo\n")
    levels = []

    def look(rows):
        levels.extend(r.getStorageLevel().useMemory() for r in spark.sparkContext._jsc.getPersistentRDDs().values())
        return rows

    spark.catalog.clearCache()
    streaming.ingest(streaming.stream_events(spark, str(tmp_path / "in")), str(tmp_path / "store"), str(tmp_path / "progress"), enrich=look).awaitTermination()
    assert levels and not any(levels) and spark.read.parquet(str(tmp_path / "store")).count() == 2
