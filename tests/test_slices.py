from __future__ import annotations

import random

import numpy as np

from embertrail.functions.intervals import islands
from embertrail.functions.quantiles import quantiles
from embertrail.operators import runs as R


def test_islands_across_slices(spark):
    r = random.Random(4)
    rows = [(k, s, s + r.choice([0, 1, 5, 40, 400])) for k in "abc" for s in (r.randrange(3000) for _ in range({"a": 1, "b": 30, "c": 400}[k]))]
    rows += [("d", 0, 1000), ("d", 10, 20), ("d", 990, 1000), ("d", 1000, 1001), ("d", 1002, 1002), ("e", None, 5), ("e", 3, None), ("f", 5, 4)]
    want = []
    for k in "abcd":
        for _, s, e in sorted(x for x in rows if x[0] == k):
            if want and want[-1][0] == k and s <= want[-1][2]:
                want[-1] = (k, want[-1][1], max(want[-1][2], e))
            else:
                want.append((k, s, e))
    df = spark.createDataFrame(rows, "k string, s long, e long").repartition(3)
    for width in (7, 100, 10**6):
        assert sorted(map(tuple, islands(df, ["k"], "s", "e", width).select("k", "s", "e").collect())) == sorted(want)


def test_quantiles_are_exact(spark):
    r = random.Random(5)
    groups = {f"g{n}": [r.choice([0, r.randrange(-50, 50), r.randrange(10**9), 10**15]) for _ in range(n)] for n in (1, 2, 3, 19, 20, 21, 100, 999)} | {"same": [7] * 50, "none": []}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs] + [("g1", None), ("none", None)], "k string, x long").repartition(3)
    got = {row.k: (row.n, row.p50, row.p95, row["max"]) for row in quantiles(df, ["k"], "x").collect()}
    assert got == {k: (len(v), float(np.median(v)), sorted(v)[-(-len(v) * 95 // 100) - 1], max(v)) for k, v in groups.items() if v}


def test_smallest_core_count(spark):
    r = random.Random(6)
    runs = {f"a{i}": (r.choice([1, 2, 7, 40, 300]), [(r.randrange(1, 10**6), r.choice([1, 2, 3, 10, 50, 400])) for _ in range(r.choice([1, 2, 9]))]) for i in range(25)}
    stages = spark.createDataFrame([(a, i, ms, n) for a, (_, s) in runs.items() for i, (ms, n) in enumerate(s)], "app_id string, stage_id long, task_ms long, tasks long")
    cores = spark.createDataFrame([(a, c) for a, (c, _) in runs.items()] + [("none", 0)], "app_id string, total_cores long")
    got = {row.app_id: row.cores for row in R.smallest_core_count(stages, cores).collect()}
    time = lambda s, c: sum(ms / min(c, n) for ms, n in s)
    for a, (total, s) in runs.items():
        full = time(s, total)
        assert time(s, got[a]) <= full * 1.1 * (1 + 1e-12) and (got[a] == 1 or time(s, got[a] - 1) > full * 1.1 * (1 - 1e-12)), (a, total, got[a])
