import __spark_entry__
import corpus_pipeline
from logloom.llm import decontam, queries
from tests.llm.test_neardup import brute_classes
from tests.llm.test_packing import check

from logloom.llm.packing import CAPACITY


def test_stages(spark, sf_dir, documents, tmp_path):
    """Each stage against brute force on what its predecessor kept."""
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontaminate", "secrets", "packing"]
    docs, kept = documents, []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(n)))
        docs = spark.read.parquet(str(tmp_path / str(n)))
        kept.append(docs)
        if n < 4:
            assert docs.columns == documents.columns
    texts = [{r.doc_id: r.text for r in d.collect()} for d in (documents, *kept[:4])]
    assert set(texts[1]) == {k for k, t in texts[0].items() if t and any(c.isalpha() for c in t)}
    assert set(texts[2]) == {k for k, c in brute_classes(texts[1]).items() if k == c}
    m = decontam.Matcher(tuple((r.item_id, decontam.fold(r.text)) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()))
    assert set(texts[3]) == {k for k, t in texts[2].items() if not list(m.matches(t))}
    assert set(texts[4]) == set(texts[3])
    assert {k for k in texts[3] if texts[3][k] != texts[4][k]} == {k for k, t in texts[4].items() if "[redacted]" in t}
    check(docs.collect(), list(texts[4].items()), CAPACITY)
    assert corpus_pipeline.run(spark, sf_dir).count() == docs.count()


def test_odd(spark, odd, empty, sf_dir):
    for start in (odd, empty):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf_dir)
            docs.count()
            if name != "packing":
                assert docs.columns == start.columns


def test_run_writes_each_stage(spark, sf_dir, monkeypatch):
    """Every stage after the first reads Parquet that run() has written."""
    seen = []
    follow = lambda s, docs, d: (seen.append(docs.inputFiles()), docs)[1]
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, follow) for n, _ in corpus_pipeline.STAGES])
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for (name, _), files in zip(corpus_pipeline.STAGES, seen[1:]):
        assert files and all(f"/{name}-" in f for f in files)


def test_entry():
    q = __spark_entry__.queries()
    assert {f"op{n}_" for n in range(1, 14)} == {x[: x.index("_") + 1] for x in queries.QUERIES} and set(queries.QUERIES) <= set(q) and "pipeline" in q
