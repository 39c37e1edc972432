from pyspark.sql import functions as F

from logloom.llm import queries, url_filter
from tests.oracle import assert_same, tables


def test_oracle(spark, sf_dir):
    assert_same(tables(sf_dir), queries.ORACLE["op9_url_filter"], queries.op9_url_filter(spark, sf_dir))


def test_rules(spark):
    cases = {
        "http://a.example.com/en/x": ("a.example.com", "/en/x", "example.com/en/", "block"),
        "https://WWW.Example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "https://x.www.example.com/en/a?b": ("x.www.example.com", "/en/a", "www.example.com/en/", "allow"),
        "https://example.com": ("example.com", "", None, "allow"),
        "https://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "ftp://b.net/es/q#f": ("b.net", "/es/q", "net/es/", "block"),
        "http://net/fr/": ("net", "/fr/", "net/fr/", "block"),
        "http://spam.org?x://y/z": ("spam.org", "", None, "block"),
        "http://h.org#a/b": ("h.org", "", None, "allow"),
        "no scheme.com/": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "://\nodd": ("\nodd", "", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(cases)] + [(None, None, "y")], "page_id long, url string, host string")
    got = url_filter.judge(pages, queries.URL_RULES, F.bool_or(url_filter.host_of(F.col("url")).rlike(queries.LISTED_HOSTS))).collect()
    assert len(got) == len(cases) + 1
    for i, expected in enumerate(cases.values()):
        r = next(x for x in got if x.page_id == i)
        assert (r.host, r.path, r.rule, r.verdict) == expected


def test_cascade_is_exact(spark):
    for share in (2, 3, 50, 100_000):
        universe = spark.range(20_000).select(F.concat(F.lit("host"), "id").alias("key"), (F.col("id") % share == 1).alias("listed"))
        cascade = url_filter.build(universe)
        assert universe.where(cascade.contains(F.col("key")) != F.col("listed")).count() == 0
        assert len(cascade.levels) > 1
    nothing = url_filter.build(universe.withColumn("listed", F.lit(False)))
    assert nothing.levels == [] and universe.where(nothing.contains(F.col("key"))).count() == 0
    everything = url_filter.build(universe.withColumn("listed", F.lit(True)))
    assert universe.where(~everything.contains(F.col("key"))).count() == 0
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string"), [], F.lit(True)).count() == 0


def test_shards_change_nothing(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    listed = F.count_if(F.char_length("html") < 2500) > 0
    one = url_filter.judge(pages, queries.URL_RULES, listed)
    many = url_filter.judge(pages, queries.URL_RULES, listed, shard_keys=5)
    assert sorted(map(repr, many.select(one.columns).collect())) == sorted(map(repr, one.collect()))
    assert len({r.listed for r in one.collect()}) == 2
    assert not any("Join" in x for x in (one._jdf.queryExecution().optimizedPlan().toString(), many._jdf.queryExecution().optimizedPlan().toString()))


def test_many_shards_and_a_hot_host(spark, monkeypatch):
    """Over many shards a host with a third of the pages, and null urls, come back whole."""
    steps, built = [], url_filter.Cascade.contains
    monkeypatch.setattr(url_filter.Cascade, "contains", lambda self, key: steps.append(self) or built(self, key))
    hot = spark.range(3000).select(F.col("id").alias("page_id"), F.when(F.col("id") % 3 == 0, "http://hot.org/a").when(F.col("id") % 100 == 1, None).otherwise(F.concat(F.lit("http://h"), F.col("id").cast("string"), F.lit(".net/es/"))).alias("url"))
    got = url_filter.judge(hot, queries.URL_RULES, F.count(F.lit(1)) > 1, shard_keys=20)
    expected = url_filter.judge(hot, queries.URL_RULES, F.count(F.lit(1)) > 1)
    assert len(steps) > 3 and got.columns == expected.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, expected.collect())) and got.count() == 3000


def test_native(spark, sf_dir):
    plan = queries.op9_url_filter(spark, sf_dir)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
