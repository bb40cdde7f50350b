from __future__ import annotations

import random

from embertrail.llm import licenses as L
from embertrail.llm.license_texts import TEMPLATES
from embertrail.llm.queries import QUERIES


def brute(text, least=L.LEAST):
    """Best coefficient of any run of sentences with any template."""
    import re

    parts = [s for line in text.split("\n") for s in L._SENTENCE.split(line) if s.strip()]
    best = 0.0
    for i in range(len(parts)):
        for j in range(i + 1, len(parts) + 1):
            g = L.bigrams(" ".join(parts[i:j]))
            best = max([best, *(L.dice(g, L.bigrams(t)) for _, t in TEMPLATES)])
    assert re
    return best if best >= least else 0.0


def test_each_template_is_found():
    t = L.Templates()
    for name, text in TEMPLATES:
        got = t.matches(f"Some words come first.\n{text}\nAnd some others after it.")
        assert name in {g[0] for g in got} and max(g[1] for g in got) == 1.0, name


def test_pruning_loses_no_match():
    r, t = random.Random(2), L.Templates()
    for _ in range(150):
        words = r.choice(TEMPLATES)[1].split()[:60]
        for _ in range(r.randint(0, len(words) // 4)):
            words[r.randrange(len(words))] = r.choice(["the", "of", "software.", "x"])
        text = "First words here. " + " ".join(words) + " Last words."
        got = max((g[1] for g in t.matches(text)), default=0.0)
        assert abs(got - brute(text)) < 1e-12, text


def test_plain_text_is_left_alone():
    t = L.Templates()
    for text in (None, "", "No licence here", "The software is provided for the users of the license", "a b " * 20_000):
        assert t.matches(text) == []


def test_places_are_code_points():
    s = "É😀 zwei.\nReleased under the MIT License.\nEnde."
    assert [s[a:b] for _, _, a, b in L.Templates().matches(s)] == ["Released under the MIT License."]


def test_query_and_odd_rows(spark, small):
    rows = [(1, "Licensed under CC BY-NC 4.0.", "x"), (1, "Licensed under CC BY-NC 4.0.", "x"), (None, None, "y"), (2, "", "z")]
    got = L.license_scan(spark.createDataFrame(rows, "doc_id long, text string, license string")).collect()
    assert sorted((r.doc_id or 0, r.license or "", r.n_matches) for r in got) == [(0, "", 0), (1, "CC-BY-NC-4.0", 1), (1, "CC-BY-NC-4.0", 1), (2, "", 0)]
    assert L.license_scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op5_license_scan"](spark, small).collect()}
    assert got.keys() == docs.keys()
    for i, text in docs.items():
        if any(w in text.lower() for w in ("license", "licence", "licensed", "rights reserved")):
            assert got[i].n_matches > 0 and got[i].license
        else:
            assert got[i].n_matches == 0


def test_a_long_text_of_licence_sentences():
    r = random.Random(5)
    text = " ".join(r.choice(TEMPLATES)[1] + " And so on." for _ in range(250))
    got = L.Templates().matches(text)
    assert len(got) >= 250 and all(a[3] <= b[2] for a, b in zip(got, got[1:]))


def test_ties_go_to_the_earlier_name_and_longer_passage():
    same = (("b", "one two three four five six."), ("a", "one two three four five six."))
    assert [m[0] for m in L.Templates(same).matches("One two three four five six.")] == ["a"]
