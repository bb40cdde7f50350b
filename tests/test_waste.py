from __future__ import annotations

import pytest

from embertrail.operators import config as C
from embertrail.operators import detectors as D
from embertrail.operators import facts as T
from embertrail.operators import waste as W
from embertrail.plans import nodes as N

MIB = 1 << 20
FIGURES = ("tasks", "run_ms", "task_ms", "stage_ms", "gc_ms", "disk_spilled", "input_bytes", "shuffle_read", "fetch_wait_ms", "cpu_ns", "p50", "p95", "longest", "excess_ms", "longest_after_ms", "total_cores")
EXTRAS = ("executors", "peak_tasks", "active_ms", "chain", "retry_n", "retry_ms")


def claims(spark, findings, figures, extras, executors=()):
    kinds = lambda names: ", ".join(f"{n} {'double' if n in ('p50', 'excess_ms', 'longest_after_ms') else 'long'}" for n in names)
    f = spark.createDataFrame(findings, "app_id string, type string, rule string, stage_id long, value double")
    s = spark.createDataFrame([("a", i, *[float(v.get(n, 0)) if n in ("p50", "excess_ms", "longest_after_ms") else v.get(n, 0) for n in FIGURES]) for i, v in figures.items()], f"app_id string, stage_id long, {kinds(FIGURES)}")
    x = spark.createDataFrame([("a", i, *[v.get(n) for n in EXTRAS]) for i, v in extras.items()], f"app_id string, stage_id long, {kinds(EXTRAS)}")
    e = spark.createDataFrame(list(executors), "app_id string, executor_id string, removed_ms long")
    out = W.waste_claims(f, s, x, e)
    return {(r.type, r.stage_id): r for r in W.core_time(out, s).collect()}


def test_models(spark):
    figures = {
        1: {"tasks": 10, "run_ms": 8000, "task_ms": 10_000, "stage_ms": 2000, "gc_ms": 800, "disk_spilled": 400_000_000, "input_bytes": 800_000_000, "shuffle_read": 0, "p50": 500, "p95": 900, "longest": 4500, "excess_ms": 4000, "longest_after_ms": 600, "total_cores": 20},
        2: {"tasks": 100, "run_ms": 4000, "task_ms": 5000, "stage_ms": 1000, "shuffle_read": 500_000_000, "fetch_wait_ms": 2000, "cpu_ns": 10**9, "total_cores": 20},
        3: {"tasks": 5, "run_ms": 1000, "stage_ms": 1000, "cpu_ns": 10**6, "total_cores": 20},
        4: {"tasks": 5, "run_ms": 1000, "stage_ms": 1000, "input_bytes": 9, "cpu_ns": 10**6, "total_cores": 20},
    }
    extras = {1: {"executors": 2, "peak_tasks": 2, "active_ms": 2000, "chain": 2, "retry_n": 8, "retry_ms": 4000}, 2: {"executors": 1, "active_ms": 900}, 3: {"executors": 1, "active_ms": 900}, 4: {"executors": 1, "active_ms": 900}}
    kinds = [("skew", 1), ("straggler", 1), ("gc", 1), ("spill", 1), ("retryWaste", 1), ("shuffle", 2), ("tinyTask", 2), ("stageSlowness", 3), ("stageSlowness", 4), ("speculationWaste", 2), ("coldStart", None), ("coreLocality", None), ("autoscalingChurn", None), ("failures", 1)]
    values = {"speculationWaste": 70.0, "coldStart": 5000.0, "coreLocality": 0.5, "autoscalingChurn": 0.5}
    got = claims(spark, [("a", k, "r", s, values.get(k)) for k, s in kinds], figures, extras, [("a", str(i), 5 if i < 48 else None) for i in range(50)])
    assert {k: r.claim_ms for k, r in got.items()} == {
        ("skew", 1): 4000.0, ("straggler", 1): 3900.0, ("gc", 1): 200.0, ("spill", 1): 1000.0 + 2000 * 0.25, ("retryWaste", 1): 2000.0, ("shuffle", 2): 500.0, ("tinyTask", 2): 90 * 10 / 5.0, ("stageSlowness", 3): 0.0, ("stageSlowness", 4): 675.0,
        ("speculationWaste", 2): None, ("coldStart", None): 5000.0, ("coreLocality", None): None, ("autoscalingChurn", None): None, ("failures", 1): None,
    }
    assert (got["coreLocality", None].raw, got["coreLocality", None].unit) == (0.5 * 120 * 20, "coreMs") and got["autoscalingChurn", None].raw == pytest.approx(24 * 15000 / 3.6e6)
    assert [got[k].method for k in (("shuffle", 2), ("tinyTask", 2), ("retryWaste", 1), ("failures", 1))] == ["measured", "measured", "modeled", "none"]
    assert [got[k].core_low_ms for k in (("skew", 1), ("straggler", 1), ("spill", 1), ("gc", 1), ("shuffle", 2), ("speculationWaste", 2))] == [4000.0, None, 2000.0, 800.0, None, 70.0]
    assert got["stageSlowness", 3].stage_task_ms == 1000 and got["coldStart", None].stage_task_ms is None and got["gc", 1].unit == "coreMs"


def test_stages_without_time_claim_nothing(spark):
    got = claims(spark, [("a", "gc", "r", 1, 20.0), ("a", "spill", "r", 1, 1.0), ("a", "tinyTask", "r", 1, 1.0), ("a", "skew", "r", 9, 4.0)], {1: {"tasks": 20, "disk_spilled": 200_000_000}}, {1: {}})
    assert got["gc", 1].claim_ms is None and got["gc", 1].raw == 0.0 and got["spill", 1].claim_ms == 1000.0 and got["spill", 1].core_low_ms is None
    assert got["tinyTask", 1].claim_ms == 900.0 and got["tinyTask", 1].method == "modeled" and got["skew", 9].claim_ms is None and got["skew", 9].unit is None
    assert claims(spark, [], {}, {}) == {}


def test_chains(spark):
    rows = [("a", 1, 0, 0, 5, True, False), ("a", 1, 0, 1, 6, True, False), ("a", 1, 0, 2, 7, False, False), ("a", 1, 1, 3, 8, True, False), ("a", 1, 1, 4, 9, False, False), ("a", 2, 0, 5, 1, False, False)]
    got = T.retry_chains(spark.createDataFrame(rows, "app_id string, stage_id long, task_index long, seq long, duration_ms long, failed boolean, speculative boolean")).collect()
    assert [tuple(r) for r in got] == [("a", 1, 2, 3, 19)]


def test_memory(spark):
    model = spark.createDataFrame([("a", 0.505), ("b", 0.5), ("c", None), ("d", 0.1)], "app_id string, idle_share double")
    alloc = spark.createDataFrame([("a", 100.0), ("b", 100.0), ("c", 100.0)], "app_id string, executor_seconds double")
    held = spark.createDataFrame([("a", 1024 * MIB, 4), ("b", 1024 * MIB, 4), ("c", 1024 * MIB, None)], "app_id string, heap long, cores int")
    heap = spark.createDataFrame([("a", "1", 700 * MIB), ("a", "2", 600 * MIB), ("b", "1", 717 * MIB), ("c", "1", 10 * MIB)], "app_id string, executor_id string, peak long")
    work = spark.createDataFrame([("a", 159_000), ("b", 160_000), ("c", 1)], "app_id string, run_ms long")
    got = D.memory_utilization(model, alloc, held, heap, work, D.THRESHOLDS["memoryUtilization"]).collect()
    assert sorted((r.app_id, r.rule, r.value, r.band) for r in got) == [("a", "heapOverProvisioned", 68.0, "info"), ("a", "idleCores", 51.0, "warning"), ("a", "wasteModel", 61696.0, "info"), ("c", "heapOverProvisioned", 1.0, "info"), ("d", "heapUnknown", None, "info")]
    assert got[0].asDict().keys() == set(D.COLUMNS)


def test_listing(spark):
    ids = ["app-10", "app-9", "app-9", None, "application_1_0002", "app-010", "app-100"]
    df = spark.createDataFrame([(x, "n", f"/x/{x}", i) for i, x in enumerate(ids)], "app_id string, name string, source string, i int")
    for prefix in (1, 22, 48):
        got = sorted((r.i, r.app_id, r.name, r.source) for r in C.redact_listing(df, prefix=prefix).collect())
        assert [r[1] for r in got] == ["app-3", "app-1", "app-1", None, "app-5", "app-2", "app-4"] and all(r[1] == r[2] == r[3] for r in got)


def test_python_stages(spark):
    stages = spark.createDataFrame([("a", 1, "x", None), ("a", 2, "x at PythonRDD.scala", None), ("a", 3, None, "at org.apache.spark.api.python.P"), ("a", 4, None, None)], "app_id string, stage_id long, name string, details string")
    nodes = spark.createDataFrame([("a", 1, "Project"), ("a", 1, "*(3) ArrowEvalPython"), ("a", 4, "Project"), ("a", 4, None), ("a", 4, "Scan PythonRDD x")], "app_id string, stage_id long, name string")
    assert {r.stage_id: r.is_python for r in N.python_stages(stages, nodes).collect()} == {1: True, 2: True, 3: True, 4: False}


def test_slow_hosts_and_python_stages(spark):
    findings = spark.createDataFrame([("a", "slowHost", "mean", 1, 2.0), ("a", "slowHost", "durationShare", 1, 0.8), ("a", "slowHost", "multiDim", 1, 2.0), ("a", "slowHost", "mean", 9, 2.0), ("a", "stageSlowness", "duration", 1, 1.0), ("a", "stageSlowness", "duration", 2, 1.0)], "app_id string, type string, rule string, stage_id long, value double")
    stages = spark.createDataFrame([("a", i, *[600.0 if n == "p50" else 0.0 if n in ("excess_ms", "longest_after_ms") else {"tasks": 5, "run_ms": 1000, "stage_ms": 1000, "cpu_ns": 10**6, "total_cores": 20}.get(n, 0) for n in FIGURES]) for i in (1, 2)], "app_id string, stage_id long, " + ", ".join(f"{n} {'double' if n in ('p50', 'excess_ms', 'longest_after_ms') else 'long'}" for n in FIGURES))
    extras = spark.createDataFrame([("a", i, 1, 1, 900, None, None, None) for i in (1, 2)], "app_id string, stage_id long, " + ", ".join(f"{n} long" for n in EXTRAS))
    gone = spark.createDataFrame([], "app_id string, executor_id string, removed_ms long")
    hosts = spark.createDataFrame([("a", 1, "mean", "h", 1600.0), ("a", 1, "durationShare", "h", 500.0), ("a", 9, "mean", "h", 5000.0)], "app_id string, stage_id long, rule string, host string, host_ms double")
    python = spark.createDataFrame([("a", 1, True), ("a", 2, False)], "app_id string, stage_id long, is_python boolean")
    got = {(r.rule, r.stage_id): (r.claim_ms, r.raw, r.unit, r.method) for r in W.waste_claims(findings, stages, extras, gone, hosts, python).collect()}
    assert got["mean", 1] == (1000.0, 1000.0, "ms", "measured") and got["durationShare", 1] == (0.0, 0.0, "ms", "measured")
    assert got["multiDim", 1] == (None, None, None, "none") and got["mean", 9][0] is None  # no host's figure, no stage
    assert got["duration", 1][0] == 675.0 and got["duration", 2][0] == 0.0  # Python's CPU time isn't in the log, so it isn't idle
    assert {r.claim_ms for r in W.waste_claims(findings, stages, extras, gone).filter("type = 'slowHost'").collect()} == {None}
