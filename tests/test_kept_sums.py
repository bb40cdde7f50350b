from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from embertrail.functions import quantiles as Q
from embertrail.operators import facts as T
from embertrail.operators import stages as A
from embertrail.queries import Run
from embertrail.sources.testdata import SHAPED, TABLES, Facts


def same(a, b):
    b = b.select(a.columns)
    assert a.dtypes == b.dtypes and sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Lines with null and negative keys, null prices and null return flags."""
    path = str(tmp_path_factory.mktemp("odd"))
    spark.sql(
        "SELECT id * 3 - 37 AS l_orderkey, id * 7 AS l_partkey, id % 23 AS l_suppkey, CAST(id % 7 + 1 AS INT) AS l_linenumber, CAST(id % 50 AS DOUBLE) AS l_quantity, CASE WHEN id % 19 <> 0 THEN id * 377.77D - 9000 END AS l_extendedprice,"
        " (id % 11) / 100D AS l_discount, CASE WHEN id % 5 <> 0 THEN CASE WHEN id % 3 = 0 THEN 'R' ELSE 'A' END END AS l_returnflag, TIMESTAMP '2020-01-01' AS l_shipdate FROM range(4000) UNION ALL SELECT NULL, 11, 1, 1, 1D, 995D, 0.1D, 'R', NULL"
    ).write.parquet(f"{path}/lineitem.parquet")
    return path


@pytest.mark.parametrize("tables", [TABLES, SHAPED], ids=["plain", "shaped"])
def test_only_attempts_of_tasks_with_several_are_compared(spark, small, odd, monkeypatch, tables):
    for folder in (small, odd):
        run, asked, losers = Run(spark, folder, True, tables), [], T.losers
        monkeypatch.setattr(T, "losers", lambda attempts: asked.append(attempts) or losers(attempts))
        got = run.lost
        monkeypatch.undo()
        same(losers(run.attempts), got)
        assert got.count() > 0 and asked[0].count() < run.attempts.count() / 2


@pytest.mark.parametrize("tables", [TABLES, SHAPED], ids=["plain", "shaped"])
def test_sums_of_parts_are_those_of_tasks(spark, small, odd, tables):
    for folder in (small, odd):
        kept, plain = Run(spark, folder, True, tables), Facts(spark, folder, tables=tables)
        tasks = kept.tasks
        for name in ("windows", "executors", "apps", "jobs"):
            same(plain[name], kept.t[name])
        same(A.stage_spans(tasks), A.span_parts(kept.t.parts))
        same(A.host_stats(tasks), A.host_parts(kept.t.parts))
        same(A.stage_cores(tasks, kept.executors), A.stage_cores(kept.t.parts, kept.executors))
        medians = A.with_medians(tasks).select(*A.STAGE, "p50").distinct()
        same(A.tail_attribution(tasks, 1, medians), A.tail_attribution(tasks, 1, medians, hosts=kept.hosts))


def test_kept_runs_work_out_windows_without_the_tasks(spark, small):
    run = Run(spark, small, True)
    whole, made = run.tasks, []
    run.t.made["tasks"] = whole.withColumn("launch_ms", F.raise_error("tasks were read"))
    run.t.parts = A.stage_parts(whole)
    made += run.windows.collect() + run.executors.collect() + run.hosts.collect()
    assert made


@pytest.mark.parametrize("most", [0, 50_000])
def test_quantiles_of_several_columns(spark, monkeypatch, most):
    monkeypatch.setattr(Q, "MOST_SENT", most)
    r = random.Random(8)
    draw = {"a": lambda: r.choice([0, 0, 0, r.randrange(-50, 50), r.randrange(10**9)]), "b": lambda: r.choice([None, 0, 7]), "c": lambda: r.randrange(1000, 1100), "d": lambda: None}
    rows = [(f"g{n}", *[f() for f in draw.values()]) for n in (1, 2, 19, 20, 21, 400) for _ in range(n)]
    df = spark.createDataFrame(rows, "k string, a long, b int, c long, d long").repartition(3)
    got = {(row.k, row.m): (row.n, row.p50, row.p95, row["max"]) for row in Q.quantiles_of(df, ["k"], list(draw)).collect()}
    want = {}
    for k in {row[0] for row in rows}:
        for m in range(len(draw)):
            v = sorted(row[m + 1] for row in rows if row[0] == k and row[m + 1] is not None)
            if v:
                want[k, m] = (len(v), float(np.median(v)), v[-(-len(v) * 95 // 100) - 1], v[-1])
    assert got == want


def test_findings_are_the_same_with_and_without_kept_sums(spark, small):
    same(Run(spark, small).reported, Run(spark, small, True).reported)
