from __future__ import annotations

from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from embertrail.llm import whitening as W
from embertrail.llm.queries import QUERIES


def whole(v):
    return tuple(int(np.floor(64 * float(c))) + 1_000_000 for c in v)


def good(v):
    return v is not None and all(c is not None and np.isfinite(c) for c in v)


def check(rows, out, most=16):
    """Rows of the operator against sums, covariances and deviations in fractions."""
    kept = [(i, whole(v)) for i, v in rows if good(v)]
    got = defaultdict(list)
    for r in out:
        got[r["vec_id"]].append(r)
    by_dim = defaultdict(set)
    for _, x in kept:
        by_dim[len(x)].add(x)
    for d, fit in by_dim.items():
        if not d:
            continue
        fit = sorted(fit)
        n, S = len(fit), [sum(c) for c in zip(*fit)]
        mine = [(i, x) for i, x in kept if len(x) == d]
        y = [[n * a - s for a, s in zip(x, S)] for x in fit]
        V = np.array([[float(Fraction(sum(r[i] * r[j] for r in y), n**3)) for j in range(d)] for i in range(d)])
        values, vectors = np.linalg.eigh(V)
        values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
        scores = defaultdict(dict)
        for i, x in mine:
            rs = [r for r in got[i] if r["n"] == n]
            assert {r["deviation"] for r in rs} >= {v if v < 2**63 else None for v in [sum((n * a - s) ** 2 for a, s in zip(x, S))]}
            for r in rs:
                scores[r["component"]][x] = r["whitened"]
                assert abs(r["explained"] - max(values[r["component"] - 1], 0) / max(np.trace(V), 1e-300)) <= 1e-9
        assert sorted(scores) == list(range(1, min(most, d) + 1))
        for k, s in scores.items():
            if values[k - 1] <= 1e-12 * np.trace(V):
                assert set(s.values()) == {None}
                continue
            want = np.array([sum((float(Fraction(v, n))) * vectors[i, k - 1] for i, v in enumerate(r)) for r in y]) / np.sqrt(values[k - 1])
            have = np.array([s[x] for x in fit])
            gap = min(np.abs(values[k - 1] - np.delete(values, k - 1)), default=values[k - 1]) / values[0]
            if gap > 1e-4:
                assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-7
            assert abs((have**2).mean() - 1) < 1e-7 and abs(have.mean()) < 1e-7


def run(spark, rows, kind="double"):
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], f"vec_id long, embedding array<{kind}>, x int, n int").repartition(3)
    return W.whitened_embeddings(df).collect()


def test_query(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding").collect()]
    out = QUERIES["op11_whitening"](spark, small).collect()
    assert len(out) == 16 * len(rows)
    assert max(r["identity_error"] for r in out) < 1e-9
    check(rows, out)


def test_copies_count_once_and_odd_vectors_go(spark):
    r = np.random.default_rng(3)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(r.normal(size=(40, 5)) * [9, 5, 3, 2, 1])]
    odd = [(100, None), (101, [1.0, None, 1.0, 1.0, 1.0]), (102, [float("nan")] * 5), (103, [float("inf"), 0.0, 0.0, 0.0, 0.0])]
    copies = [(200 + i, rows[0][1]) for i in range(50)] + [(0, rows[7][1]), (None, rows[8][1])]
    out = run(spark, rows + odd + copies)
    assert {x["vec_id"] for x in out} == {i for i, _ in rows + copies}
    assert len(out) == 5 * len(rows + copies)
    assert {x["n"] for x in out} == {40}
    check(rows + copies[:50], [x for x in out if x["vec_id"] not in (0, None)] + [x for x in run(spark, rows) if x["vec_id"] == 0])


@pytest.mark.parametrize("rows", [[(1, [0.5, 2.0])], [(1, [1.0, 1.0]), (2, [3.0, 3.0]), (3, [7.0, 7.0])], [(1, [1e300, 0.0]), (2, [0.0, 1e17]), (3, [-1e18, 5.0])], [(1, []), (2, [1.0]), (3, [2.0]), (4, [1.0, 2.0]), (5, [2.0, 5.0]), (6, [9.0, 3.0])]])
def test_few_vectors_without_variance_huge_or_of_many_lengths(spark, rows):
    out = run(spark, rows)
    assert len(out) == sum(len(v) for _, v in rows)
    if abs(max((c for _, v in rows for c in v), key=abs)) < 1e15:
        check(rows, out)
    assert {r["deviation"] for r in run(spark, [(1, [1e17]), (2, [-1e17])])} == {None}


def test_empty_table_and_floats(spark):
    assert run(spark, []) == []
    check([(1, [0.25, 1.5]), (2, [0.5, 3.0]), (3, [0.125, 1.0])], run(spark, [(1, [0.25, 1.5]), (2, [0.5, 3.0]), (3, [0.125, 1.0])], "float"))


def test_squares_are_exact_at_any_size():
    r = np.random.default_rng(1)
    for high in (50, 1 << 28, 1 << 60):
        z = r.integers(-high, high, size=(100, 4))
        want = {(i, j): sum(int(a[i]) ** 2 if i == j else (int(a[i]) + int(a[j])) ** 2 for a in z) for i in range(4) for j in range(i, 4)}
        got = W._squares(z)
        assert {k: int(got[k]) for k in want} == want
    for v in (0, 5, -5, 3 << 190, -(7 << 150)):
        assert sum(x << 32 * k for k, x in enumerate(W._limbs(v))) == v
