from __future__ import annotations

import zlib

import numpy as np
import pytest

from embertrail.llm import quality as Q
from embertrail.llm import toxicity as T
from embertrail.llm.queries import QUERIES


def test_statistics_of_odd_texts():
    assert Q.statistics(None) == Q.statistics("") == Q.statistics(" \n") == [0.0] * len(Q.STATISTICS)
    for t in ("a", "!!", "A\nA\n\n", "x" * 100_000, "é😀 " * 50):
        s = Q.statistics(t)
        assert len(s) == len(Q.STATISTICS) and np.isfinite(s).all()


def test_trees_learn_a_rule_and_flat_arrays_follow_it():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 5)).astype(np.float32)
    y = ((x[:, 1] > 0.3) & (x[:, 3] < 0.5) | (x[:, 0] > 1.5)).astype(float)
    m = Q.fit_trees(x[:3000], y[:3000])
    p = m.scores(x[3000:])
    assert ((p >= 0.5) == y[3000:]).mean() > 0.97
    for i in range(50):  # node by node
        total = m.start
        for t in range(len(m.feature)):
            node = 0
            while node < m.feature.shape[1]:
                node = 2 * node + (2 if x[3000 + i, m.feature[t, node]] > m.cut[t, node] else 1)
            total += m.leaf[t, node - m.feature.shape[1]]
        assert p[i] == pytest.approx(1 / (1 + np.exp(-total)))


def test_without_both_labels():
    assert Q.fit_trees(np.zeros((0, 3), np.float32), np.zeros(0)).scores(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    assert (Q.fit_trees(np.zeros((9, 3), np.float32), np.ones(9)).scores(np.zeros((2, 3))) > 0.8).all()


def test_ordinal_matches_grades():
    words = np.sort(np.random.default_rng(1).integers(-(1 << 60), 1 << 60, 30))
    rng = np.random.default_rng(2)
    rows, grade = [], []
    for _ in range(3000):
        pick = rng.random(30) < 0.3
        rows.append(words[pick])
        grade.append(min(3, int(pick[:4].sum())))
    grade = np.array(grade)
    m = T.fit_ordinal(rows, grade, words)
    assert np.all(np.diff(m.thresholds) >= 0)
    severity = m.above(rows).sum(axis=1)
    assert np.abs(severity - grade).mean() < 0.3
    assert [severity[grade == g].mean() for g in range(4)] == sorted(severity[grade == g].mean() for g in range(4))
    assert m.above([np.zeros(0, np.int64)]).shape == (1, 3)


def accuracy(got, labels, label, column, held):
    rows = [(labels[r.doc_id], r[column]) for r in got if r.held_out == held and r.doc_id in labels]
    kinds = [[p == y for y, p in rows if y == k] for k in (0, 1)]
    return [sum(k) / max(1, len(k)) for k in kinds]


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    labels = {r.doc_id: r for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    got = QUERIES["op3_quality"](spark, d).collect()
    assert len(got) == 10_000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert min(accuracy(got, {k: v.quality for k, v in labels.items()}, "quality", "predicted", True)) > 0.97
    got = QUERIES["op8_toxicity"](spark, d).collect()
    assert len(got) == 10_000 and all(0 <= r.severity <= T.GRADES for r in got)
    clean, toxic = accuracy(got, {k: v.toxic for k, v in labels.items()}, "toxic", "toxic", True)
    assert clean > 0.98 and toxic > 0.9


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b c", 0.5), (1, "a b c", 0.5), (2, None, 0.1), (None, "", 0.2), (3, "x " * 50_000, 0.3)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, None, None), (None, 1, 1), (3, 0, 1)], "doc_id long, quality int, toxic int")
    none = labels.limit(0)
    for f in (Q.quality_scores, T.toxicity_scores):
        assert f(docs, labels).count() == 5
        assert f(docs, none).count() == 5
        assert f(docs.limit(0), labels).count() == 0
    assert Q.keep_good(docs, none).count() == 5 and Q.keep_good(docs, none).columns == docs.columns


def test_first_split_is_the_best_of_all():
    rng = np.random.default_rng(8)
    x = rng.integers(0, 12, size=(300, 4)).astype(np.float32)
    y = (rng.random(300) < 0.2 + 0.6 * (x[:, 2] > 5)).astype(float)
    m = Q.fit_trees(x, y, trees=1, depth=1)
    p = 1 / (1 + np.exp(-m.start))
    g, h = y - p, np.full(300, p * (1 - p))

    def gain(j, c):
        right = x[:, j] > c
        part = [(g[s].sum(), h[s].sum()) for s in (right, ~right)]
        return sum(a**2 / (b + 1) for a, b in part) - g.sum() ** 2 / (h.sum() + 1) if min(b for _, b in part) >= 1 else 0

    best = max(gain(j, c) for j in range(4) for c in np.unique(x[:, j]))
    assert gain(m.feature[0, 0], m.cut[0, 0]) == pytest.approx(best)
    right = x[:, m.feature[0, 0]] > m.cut[0, 0]
    assert m.leaf[0] == pytest.approx([0.15 * g[s].sum() / (h[s].sum() + 1) for s in (~right, right)])


def test_ordinal_fit_is_near_the_best_likelihood():
    rng = np.random.default_rng(4)
    words = np.arange(8, dtype=np.int64)
    rows = [words[rng.random(8) < 0.4] for _ in range(800)]
    z = np.array([len(np.intersect1d(r, [0, 1, 2])) for r in rows]) + rng.logistic(size=800)
    grade = (z[:, None] > np.array([1.0, 2.5])).sum(axis=1)
    m = T.fit_ordinal(rows, grade, words, sparse=0.0)

    def loss(w, cut):
        s = np.array([w[r].sum() for r in rows])
        p = np.concatenate([np.ones((800, 1)), 1 / (1 + np.exp(-(s[:, None] - cut))), np.zeros((800, 1))], axis=1)
        return -np.log(np.maximum(p[np.arange(800), grade] - p[np.arange(800), grade + 1], 1e-12)).mean()

    w = np.zeros(8)
    w[m.vocabulary] = m.weights
    here = loss(w, m.thresholds)
    for i in range(8):
        for d in (-0.1, 0.1):
            assert loss(w + d * (np.arange(8) == i), m.thresholds) > here - 1e-3
    for i in range(2):
        for d in (-0.1, 0.1):
            assert loss(w, m.thresholds + d * (np.arange(2) == i)) > here - 1e-3
    assert here < loss(np.zeros(8), m.thresholds)
