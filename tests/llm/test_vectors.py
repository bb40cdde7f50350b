from __future__ import annotations

import numpy as np
import pytest

from embertrail.llm import vectors as V
from embertrail.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>, label int, k string, h string"


def brute(rows, least=0.98):
    """vec_id -> (links, smallest id reachable), by comparing all pairs."""
    good = []
    for i, e, label in rows:
        ok = label is not None and e and all(v is not None and np.isfinite(v) for v in e) and any(e)
        good.append(np.array(e) / np.linalg.norm(np.array(e) / max(map(abs, e))) / max(map(abs, e)) if ok else None)
    n = len(rows)
    link = [[j for j in range(n) if i != j and good[i] is not None and good[j] is not None and rows[i][2] == rows[j][2] and len(good[i]) == len(good[j]) and good[i] @ good[j] >= least] for i in range(n)]
    comp = [r[0] for r in rows]
    for _ in range(n):
        new = [min([comp[i], *(comp[j] for j in link[i])]) for i in range(n)]
        if new == comp:
            break
        comp = new
    return sorted((rows[i][0], len(link[i]), comp[i]) for i in range(n))


def run(spark, rows):
    got = V.embedding_groups(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)).collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    return sorted((r.vec_id, r.n_links, r.component_id) for r in got)


def test_lattice_points():
    assert len(V.roots()) == 240
    y = np.random.default_rng(2).normal(size=(500, 8)) * 3
    p = V.nearest_e8(y)
    assert np.all((2 * p) % 1 == 0) and np.all((p.sum(axis=1)) % 2 == 0)
    other = np.linalg.norm(y[:, None] - (p[:, None] + V.roots()), axis=2).min(axis=1)
    assert np.all(np.linalg.norm(y - p, axis=1) <= other + 1e-12)


def clustered(seed, n, copies, label=3):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        c = rng.normal(size=64)
        for _ in range(copies):
            out.append((c + rng.normal(size=64) * rng.choice([0.02, 0.1, 0.14, 0.2])).tolist())
    return [(1000 + i, e, label if i % 3 else 4) for i, e in enumerate(out)]


def test_against_all_pairs(spark):
    rows = clustered(1, 25, 12)
    rows += [(5000 + i, rows[7][1], rows[7][2]) for i in range(40)] + [(6000, [2 * v for v in rows[7][1]], rows[7][2])]
    assert run(spark, rows) == brute(rows)


def test_odd_vectors_link_with_nothing(spark):
    e = [1.0, 2.0, 3.0]
    rows = [(1, e, 1), (2, e, None), (3, None, 1), (4, [0.0] * 3, 1), (5, [], 1), (6, [1.0, None, 3.0], 1), (7, [1.0, float("nan"), 3.0], 1), (8, [float("inf"), 2.0, 3.0], 1), (9, [1.0, 2.0], 1), (10, e, 2), (11, [1e200, 2e200, 3e200], 1), (12, [1e-200, 2e-200, 3e-200], 1), (13, [-1.0, -2.0, -3.0], 1)]
    assert run(spark, rows) == brute(rows)
    assert V.embedding_groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeated_and_missing_ids(spark):
    e = [1.0, 0.5] * 32
    got = V.embedding_groups(spark.createDataFrame([(1, e, 1, "", ""), (1, e, 1, "", ""), (None, e, 1, "", ""), (None, [-v for v in e], 1, "", "")], SCHEMA)).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept or False) for r in got) == [(0, 0, 0, False), (0, 2, 1, False), (1, 2, 1, True), (1, 2, 1, True)]


def test_oversized_cells_lose_no_link(spark, monkeypatch):
    rows = clustered(9, 2, 60, 4)
    monkeypatch.setattr("embertrail.llm.common.GROUP_ROWS", 8)
    real = V._links
    monkeypatch.setattr(V, "_links", lambda *a: real(*a) if len(a) > 5 else real(*a, 16))
    assert run(spark, rows) == brute(rows)


def test_query_recall(spark, small):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = QUERIES["op9_embedding_near_dedup"](spark, small).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == brute(rows)


@pytest.mark.parametrize("batch", ["50", "1000", "10000"])
def test_oversized_cells_at_any_batch_size(spark, monkeypatch, batch):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, batch)
    try:
        test_oversized_cells_lose_no_link(spark, monkeypatch)
    finally:
        spark.conf.set(key, before)


def test_sketches_keep_what_links():
    rng = np.random.default_rng(4)
    a = rng.normal(size=(20_000, 64))
    b = a / np.linalg.norm(a, axis=1, keepdims=True) + rng.normal(size=a.shape) * 0.025
    cos = (a * b).sum(axis=1) / np.linalg.norm(a, axis=1) / np.linalg.norm(b, axis=1)
    bits = np.bitwise_count((V.sketches(a, 42) ^ V.sketches(b, 42)).view(np.uint64))
    assert bits[cos >= 0.98].max() <= V.most_bits(0.98) and (cos >= 0.98).sum() > 1000


def test_many_labels(spark):
    rows = [(i, e, i % 40) for i, (_, e, _) in enumerate(clustered(5, 4, 40))]
    assert run(spark, rows) == brute(rows)
