import re
import time

import pytest

from logloom.llm import license_scan
from logloom.llm.queries import op7_license_scan

BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def brute(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    hits = [(i, label) for p, label in BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in hits]
    return len(words), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in hits}))


def test_query_is_brute_force(spark, sf_dir, documents):
    got = {r.doc_id: r for r in op7_license_scan(spark, sf_dir).collect()}
    assert len(got) == documents.count()
    for d in documents.collect():
        r = got[d.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(d.text)
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
        assert r.labels == ",".join(sorted(set(filter(None, r.labels.split(",")))))


@pytest.mark.parametrize("text", ["MIT License mit license", "The GNU General\nPublic (License), MIT-License", "mit  licenses", "ÉMIT License", "İ MIT LICENSE é apache/license", "", None, "licence"])
def test_places(text):
    assert license_scan.judge(text)[:5] == brute(text)


@pytest.mark.parametrize(
    ("expression", "labels", "permissive"),
    [
        ("MIT", {"mit"}, True),
        ("MIT OR GPL-3.0-only", {"mit", "gpl"}, True),
        ("MIT AND GPL-2.0-or-later", {"mit", "gpl"}, False),
        ("GPL-2.0 WITH Classpath-exception-2.0 OR MIT AND Apache-2.0", {"gpl", "mit", "apache"}, True),
        ("(MIT OR Apache-2.0) AND LGPL-2.1", {"mit", "apache", "lgpl"}, False),
        ("MIT OR", {"mit"}, False),
        ("(MIT", {"mit"}, False),
        ("Unknown-1.0 AND MIT", {"mit"}, False),
    ],
)
def test_expressions(expression, labels, permissive):
    assert license_scan.evaluate(expression) == (labels, permissive)


def test_shunting_yard():
    assert license_scan.to_rpn("A or B and C with D") == ["A", "B", "C", "D", "with", "and", "or"]
    assert license_scan.to_rpn("(A or B) and C") == ["A", "B", "or", "C", "and"]
    assert license_scan.to_rpn("A B") is None and license_scan.to_rpn(")") is None and license_scan.to_rpn("") is None


def test_tags():
    got = license_scan.judge("// SPDX-License-Identifier: (MIT OR Apache-2.0) AND CC-BY-NC-4.0 */ code\nGPL is not in it")
    assert got[5] == "apache,cc-by-nc,mit" and got[7] is False and got[6] == pytest.approx(1 - 0.05 * 0.2)
    assert license_scan.judge("Licensed under CC BY-NC 4.0.")[5] == "cc-by-nc"


@pytest.mark.parametrize(
    ("text", "expression"),
    [
        ("Apache-2.0 and other things", "Apache-2.0"),
        ("MIT and the rest of it", "MIT"),
        (" 'MIT' or", "MIT"),
        ("MIT, GPL-2.0", "MIT"),
        ("MIT OR LicenseRef-own-1 */ AND GPL-2.0", "MIT OR LicenseRef-own-1"),
        ("(MIT OR Apache-2.0) AND ( words", "( MIT OR Apache-2.0 )"),
        ("GPL-2.0 WITH Classpath-exception-2.0 AND\nMIT", "GPL-2.0 WITH Classpath-exception-2.0"),
        ("MIT.", "MIT"),
        ("MIT SPDX-License-Identifier: GPL-2.0", "MIT"),
        ("prose alone", ""),
    ],
)
def test_expressions_end_where_prose_begins(text, expression):
    assert license_scan.expression_at(text, 0) == expression


@pytest.mark.parametrize("piece", ["SPDX-License-Identifier: MIT OR ", "SPDX-License-Identifier: ((((", "mit license ", "the general public license, apache license ", "@license @license "])
def test_long_lines_take_linear_time(piece):
    text = piece * (1_000_000 // len(piece))
    began = time.process_time()
    license_scan.judge(text)
    assert time.process_time() - began < 4


def test_odd(odd, empty):
    rows = license_scan.licenses(odd).collect()
    assert len(rows) == odd.count() and all(r.score == 0 and r.labels == "" for r in rows)
    assert license_scan.licenses(empty).count() == 0
