from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from embertrail.llm import multiset as M
from embertrail.llm.queries import QUERIES


def words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(1, 8))) + (". " if r.random() < 0.1 else "") for _ in range(n))


def test_order_insertion_and_deletion():
    a, b, c = words(1, 90), words(2, 5), words(3, 400)
    assert M.digest(M.vector(f"{a}\n{b}\n{c}")) == M.digest(M.vector(f"{c}\n{a}\n{b}"))
    assert M.digest(M.joined(M.vector(a), M.vector(b))) == M.digest(M.vector(f"{a}\n{b}"))
    assert M.digest(M.without(M.vector(f"{a}\n{b}"), M.vector(a))) == M.digest(M.vector(b))
    assert M.digest(M.vector(f"{a}\n{a}")) != M.digest(M.vector(a))
    assert M.digest(M.vector("one. two. ")) != M.digest(M.vector("two. one. "))
    assert M.digest(M.vector(None)) == M.digest(M.vector("")) == "00" * (M.LEVELS * M.BLOCKS // 8)


def test_many_repeats_count():
    assert M.digest(M.vector("foo\n" + "abc\n" * 65_535 + "abc")) != M.digest(M.vector("foo"))
    assert M.digest(M.vector("abc\n" * 65_536 + "abc")) != M.digest(M.vector("abc"))


@pytest.mark.parametrize("n", [30, 300, 20_000])
def test_likeness_follows_the_shared_part(n):
    text, other = words(4, n), words(5, n)
    v = M.vector(text)
    assert M.likeness(v, v) == 1.0
    assert M.likeness(v, M.vector(other)) < 0.1
    assert 0.2 < M.likeness(v, M.vector(M.edited(text, other))) < 0.9
    assert M.likeness(M.vector(""), M.vector("")) == 1.0 and M.likeness(v, M.vector("")) == 0.0


def expect(docs):
    order = sorted(docs, key=lambda d: (d[0] is None, -(d[0] or 0), d[1] is not None, d[1] or ""))
    out = []
    for i, (doc_id, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        k = len(text) // 3
        new = text[: len(text) - k] + after[:k]
        v = M.vector(text)
        out.append((doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), M.digest(v), M.digest(M.vector(new)), M.likeness(v, M.vector(new)), M.likeness(v, M.vector(after))))
    return sorted(out, key=str)


def run(spark, docs):
    df = spark.createDataFrame([(*d, 1, True) for d in docs], "doc_id long, text string, range int, head boolean").repartition(3)
    return sorted(map(tuple, M.document_fingerprints(df).collect()), key=str)


def test_neighbours(spark, monkeypatch):
    monkeypatch.setattr(M, "RANGE_ROWS", 5)
    r = random.Random(3)
    docs = [(i * 3, words(i, r.randint(0, 60))) for i in range(60)] + [(500, None), (501, ""), (502, "\U0001f600éa\n" * 9), (30, "again"), (30, "and again"), (None, "no id"), (None, None)]
    assert run(spark, docs) == expect(docs)
    assert run(spark, docs[:1]) == expect(docs[:1])
    assert run(spark, [(None, "a"), (None, "b")]) == expect([(None, "a"), (None, "b")])
    assert run(spark, []) == []


def test_query(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = QUERIES["op7_document_fingerprints"](spark, small)
    assert sorted(map(tuple, got.collect()), key=str) == expect(docs)


def test_lanes_wrap():
    v = np.full((M.LEVELS * M.BLOCKS, M.LANES), 2**32 - 1, np.uint32)
    assert not M.joined(v, np.ones_like(v)).any()
