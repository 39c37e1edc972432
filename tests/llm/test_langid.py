import random
import re
import time
import zlib
from collections import Counter

from pyspark.sql import functions as F

from logloom.llm import langid, queries

SAMPLE = {"en": ["the cat sat on the mat and the dog ran to the house " * 20] * 2, "fr": ["le chat est sur la table et le chien dans la maison " * 20] * 2}


def brute_phrases(text, code):
    """Phrases of a whole folded text: grown while they occur in the other text; unknown letters are in none."""
    phrase, n = "", 1
    for c in text:
        if phrase + c in code:
            phrase += c
        else:
            phrase, n = (c if c in code else ""), n + 1
    return n


def letters(folded):
    return "".join(chr(33 + x) for x in folded.tolist())


def test_phrases_are_longest_matches():
    p = langid.parser(tuple((k, tuple(v)) for k, v in SAMPLE.items()))
    mixed = " ".join(random.Random(3).choice("the cat chat zz sat sur la maison house 日本 dog".split()) for _ in range(900))
    for text in ("the dog sat in the maison", "le chat ran " * 60, "the", "zzz the", "Été, 12 the-house!", mixed, "a" * 3000, "a\U00030010b \U00030050"):
        folded = p.fold(text)
        for lang, n in zip(p.languages, p.phrases([folded])[:, 0].tolist()):
            code = "".join(letters(p.fold(t)) for t in SAMPLE[lang])
            assert n == brute_phrases(letters(folded), code[: langid.SAMPLE_CHARS])


def test_repetitive_texts_are_linear():
    """A million characters of repeated words, alone and among prose; phrases are those of one walk over the whole text."""
    p = langid.parser(tuple((k, tuple(v)) for k, v in SAMPLE.items()))
    rng = random.Random(4)
    odd = "".join(rng.choice("abdehlst ") for _ in range(37))
    texts = ["the " * 250_000, "de la " * 166_000, (odd * 30_000)[:1_000_000], "the cat sat on the mat " * 300 + "le chat " * 40_000 + "the dog " * 500]
    folded = [p.fold(t) for t in texts]
    began = time.process_time()
    got = p.phrases(folded)
    assert time.process_time() - began < 2 * len(texts)
    for row, (table, root, symbols) in enumerate(zip(p.tables, p.roots, p.symbols)):
        arcs, roots = memoryview(table), memoryview(root)
        for i, f in enumerate(folded):
            state, n = 0, 1
            for c in symbols[f].tolist():
                state = arcs[state + c]
                if state < 0:
                    state, n = roots[c], n + 1
            assert got[row, i] == n


def test_large_scripts_and_many_languages():
    """Two languages that share a large script, and a hundred languages: none is dropped, letters stay apart."""
    rng = random.Random(6)
    one, two = ([chr(0x4E00 + rng.randrange(3000)) for _ in range(400)] for _ in range(2))
    text = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(3)) for _ in range(n))
    pairs = {f"l{i:03}": ["".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(30)] for i in range(100)}
    sample = {"c1": [text(one, 1500)] * 2, "c2": [text(two, 1500)] * 2} | {k: [" ".join(rng.choice(w) for _ in range(300))] for k, w in pairs.items()}
    p = langid.parser(tuple((k, tuple(v)) for k, v in sorted(sample.items())))
    assert len(p.languages) == 102
    tests = {"c1": text(one, 60), "c2": text(two, 60)} | {k: " ".join(rng.choice(w) for _ in range(40)) for k, w in pairs.items()}
    got = p.judge(list(tests.values()))
    assert sum(a == b for a, b in zip(got[0], tests)) >= 100 and got[3][0] == 180


def test_odd(odd, empty):
    rows = langid.identify(odd, SAMPLE).collect()
    assert len(rows) == odd.count()
    by = {(r.doc_id, r.n_letters): r for r in rows}
    assert all(r.lang_pred == "und" and r.score == 0 for r in rows if r.n_letters == 0)
    assert all(0 <= r.score <= 1 for r in rows) and all(r.lang_pred in ("en", "fr") for r in rows if r.n_letters)
    assert [r.lang_pred for k, r in by.items() if k[0] == 1] == ["en"]
    assert langid.identify(empty, SAMPLE).count() == 0
    assert {r.lang_pred for r in langid.identify(odd, {}).collect()} == {"und"}
    assert langid.fit_sample(empty) == {} and langid.fit_sample(odd.where("lang is null")) == {}
    kept = langid.in_known_language(odd, SAMPLE)
    assert kept.columns == odd.columns and kept.where("text is null or text = ''").count() == 0


def test_held_out_accuracy(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()
    got = {r.doc_id: r for r in queries.op1_language_id(spark, sf).collect()}
    assert len(got) == len(docs)
    held = [d for d in docs if zlib.crc32(str(d.doc_id).encode()) % 5 == 0]
    assert all(got[d.doc_id].held_out == (zlib.crc32(str(d.doc_id).encode()) % 5 == 0) for d in docs)
    hits = Counter(got[d.doc_id].lang_pred == d.lang for d in held if d.lang)
    assert hits[True] >= 0.96 * len(held)


def plain(text):
    """Lower-case letters of a text, one blank for what lies between them."""
    return re.sub(" +", " ", "".join(c.lower() if c.isalpha() else " " for c in text or "")).lstrip(" ")


def test_query_is_brute_force(spark, sf_dir):
    """Languages and scores of the query's rows by growing phrases in the texts of the sample themselves, without automata."""
    sf = sf_dir.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()
    learned = [d for d in docs if zlib.crc32(str(d.doc_id).encode()) % 5]
    sample = langid.fit_sample(spark.createDataFrame(learned, "doc_id long, text string, lang string"))
    codes, rates = {}, {}
    for lang, texts in sorted(sample.items()):
        folded, total, head, tail = [plain(t) for t in texts], 0, [], []
        for f in folded:
            (head if total < langid.SAMPLE_CHARS else tail).append(f)
            total += len(f)
        codes[lang] = "".join(head)[: langid.SAMPLE_CHARS]
        assert tail and len(set(codes[lang])) <= langid.OWN_LETTERS
        rates[lang] = sum(brute_phrases(f, codes[lang]) for f in tail) / sum(map(len, tail))
    got = {r.doc_id: r for r in queries.op1_language_id(spark, sf).collect()}
    tried = 0
    for d in docs:
        text = plain(d.text)
        if d.doc_id % 12 or len(text) > 5000:
            continue
        tried += 1
        cost = sorted((brute_phrases(text, codes[lang]) / max(1, len(text)) / rates[lang], lang) for lang in codes)
        r = got[d.doc_id]
        if text.strip():
            assert r.lang_pred == cost[0][1] and abs(r.score - 1 / (1 + cost[0][0] / cost[1][0])) < 1e-9
        else:
            assert (r.lang_pred, r.score) == ("und", 0.0)
    assert tried >= 50


def test_long_texts_are_sampled(spark):
    """A language of long texts only, and one whose first letters come late, have a sample like any other."""
    fr = "le chat est sur la table et le chien dans la maison "
    rows = [(i, "the cat sat on the mat and the dog ran to the house " * 20, "en") for i in range(40)]
    rows += [(100 + i, f"{i} " + fr * 200, "fr") for i in range(60)]
    rows += [(200 + i, "1 " * 9000 + "die katze sitzt auf dem tisch und der hund im haus " * 3, "de") for i in range(60)]
    sample = langid.fit_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3))
    budget = langid.SAMPLE_CHARS + langid.CALIBRATION_CHARS
    assert set(sample) == {"en", "fr", "de"} and all(any(c.isalpha() for c in t) and len(t) <= langid.SAMPLE_TEXT_CHARS for ts in sample.values() for t in ts)
    assert budget <= sum(map(len, sample["fr"])) < budget + langid.SAMPLE_TEXT_CHARS
    got = langid.identify(spark.createDataFrame([(1, fr * 3), (2, "der hund sitzt auf dem tisch")], "doc_id long, text string"), sample).collect()
    assert {r.doc_id: r.lang_pred for r in got} == {1: "fr", 2: "de"}


def test_short_draws_are_topped_up(spark):
    """Rows without an id share one draw; the language still has its sample."""
    rows = [(None, f"le chat est sur la table {i} " * 40, "fr") for i in range(2000)]
    sample = langid.fit_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sum(map(len, sample["fr"])) >= langid.SAMPLE_CHARS + langid.CALIBRATION_CHARS


def test_label_is_no_input(spark, documents):
    sample = {"en": SAMPLE["en"], "fr": SAMPLE["fr"]}
    a = langid.identify(documents, sample).select("doc_id", "lang_pred", "score")
    b = langid.identify(documents.withColumn("lang", F.lit("xx")), sample).select("doc_id", "lang_pred", "score")
    assert a.exceptAll(b).count() == 0
