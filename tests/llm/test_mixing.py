from __future__ import annotations

import re

import pytest

from embertrail.llm import mixing as M
from embertrail.llm.queries import QUERIES


def targets(sizes, weights=M.WEIGHTS, epochs=M.EPOCHS):
    """Pour, clamp and share the excess anew until no source is above its cap. sizes: source -> words."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, clamped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in clamped]
        rest = total - sum(clamped.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > epochs * sizes[s]]
        if not over:
            return clamped | share
        clamped |= {s: epochs * sizes[s] for s in over}


def held(rows, docs):
    sizes = {}
    for _, source, text in docs:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want = targets(sizes)
    by_id = {d: (s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for d, s, t in docs}
    taken = dict.fromkeys(sizes, 0)
    small = {}
    for r in rows:
        source, n = by_id[r.doc_id]
        assert r.size == n and r.source_size == sizes[source] and r.target == pytest.approx(want[source])
        assert 0 <= r.taken <= 3 * n and (n == 0 or r.taken % n == 0)
        taken[source] += r.taken
        small[source] = max(small.get(source, 0), n)
    assert len(rows) == len(docs)
    return {s: taken[s] - want[s] for s in sizes}, small


def frame(spark, docs):
    return spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, source string, text string, size int, _copies string")


def test_targets_and_repetitions(spark):
    docs = [(i, s, "w " * (1 + (i * 7) % 90)) for i, s in enumerate(["a"] * 40 + ["b"] * 300 + ["\U0001f600"] * 30 + ["￮"] * 90 + [None] * 25 + ["zz"] * 2)]
    docs += [(9001, "a", None), (9002, "a", " \n\t"), (9003, "empty", "")]
    rows = M.mix_report(frame(spark, docs)).collect()
    off, _ = held(rows, docs)
    assert all(-90 <= x <= 1e-6 for x in off.values())
    assert sorted(rows) == sorted(M.mix_report(frame(spark, docs).repartition(3)).collect())


def test_mixture_has_whole_copies(spark):
    docs = [(i, "s%d" % (i % 4), "w " * (i + 1)) for i in range(30)]
    want = {r.doc_id: r.taken // r.size for r in M.mix_report(frame(spark, docs)).collect()}
    got = M.mix_documents(frame(spark, docs))
    assert got.columns == ["doc_id", "source", "text", "size", "_copies"]
    count = {}
    for r in got.collect():
        count[r.doc_id] = count.get(r.doc_id, 0) + 1
    assert count == {d: n for d, n in want.items() if n}


def test_empty_and_repeated(spark):
    assert M.mix_report(frame(spark, [])).count() == 0
    assert M.mix_documents(frame(spark, [])).count() == 0
    assert [r.taken for r in M.mix_report(frame(spark, [(1, "a", "")])).collect()] == [0]
    rows = M.mix_report(frame(spark, [(1, "a", "x y"), (1, "a", "x y"), (None, "b", "p q r")])).collect()
    assert len(rows) == 3 and len({r.taken for r in rows if r.doc_id}) == 1


def test_query(spark, small):
    docs = [(r.doc_id, r.source, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    off, largest = held(QUERIES["op6_mixing"](spark, small).collect(), docs)
    assert all(abs(off[s]) <= largest[s] for s in off)
    plan = QUERIES["op6_mixing"](spark, small)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
