from __future__ import annotations

import pytest

from embertrail.operators import detectors as D
from embertrail.operators import facts as T
from embertrail.operators import stages as A


def tasks(spark, rows):
    """rows: (stage, executor, duration, input bytes)."""
    full = [("a", s, i, f"h{e}", str(e), 0, d, d, False, False, 0, b, 0, 0, 0, None, 0, 0, 0, d, 0, 0, 0) for i, (s, e, d, b) in enumerate(rows)]
    return spark.createDataFrame(full, "app_id string, stage_id long, task_id long, host string, executor_id string, launch_ms long, finish_ms long, duration_ms long, failed boolean, speculative boolean, shuffle_read long, input_bytes long, shuffle_write long, records_read long, output_bytes long, output_records long, mem_spilled long, disk_spilled long, gc_ms long, run_ms long, cpu_ns long, fetch_wait_ms long, peak_mem long")


def test_one_slow_executor_stands_out(spark):
    rows = [(1, e, 2000 + 37 * (i % 11) + (9000 if e == 3 else 0), 10) for e in range(6) for i in range(30)] + [(2, e, 2000 + 37 * (i % 11), 10) for e in range(6) for i in range(30)]
    got = D.slow_host_multidim(A.executor_stats(tasks(spark, rows)), D.THRESHOLDS["slowHost"]).collect()
    assert [(r.stage_id, r.type, r.rule) for r in got] == [(1, "slowHost", "multiDim")] and got[0].value > 4


def test_tail_is_blamed_on_data(spark):
    mib = 1 << 20
    rows = [(1, i % 4, 1000, 4 * mib) for i in range(40)] + [(1, 0, 10_000, 40 * mib)] + [(2, i % 4, 1000, 4 * mib) for i in range(40)] + [(2, 0, 10_000, 4 * mib)]
    got = {r.stage_id: r for r in A.tail_attribution(tasks(spark, rows)).collect()}
    assert (got[1].excess_ms, got[1].data_ms, got[1].data_ratio) == (9000.0, 9000.0, 10.0)
    assert (got[2].excess_ms, got[2].data_ms) == (9000.0, 0.0)


def test_failed_stages(spark):
    rows = [("a", 1, 0, "x\ny", True), ("a", 2, 0, "x\nz", True), ("a", 3, 0, "q", False), ("a", 3, 1, None, True)]
    got = D.stage_failed(spark.createDataFrame(rows, "app_id string, stage_id long, attempt long, failure string, latest boolean")).collect()
    assert sorted((r.stage_id, r.value) for r in got) == [(1, 2.0), (2, 2.0)]


def test_thresholds_are_checked():
    assert D.threshold_table({"gc": {"pct": 20}})["gc"]["pct"] == 20
    for bad in ({"gc": {"no": 1}}, {"none": {"x": 1}}, {"gc": {"pct": "x"}}, {"gc": {"pct": -1}}, {"gc": {"pct": True}}):
        with pytest.raises(ValueError):
            D.threshold_table(bad)


def test_winners_and_waste(spark):
    rows = [("a", 1, 0, 1, 50, True, False), ("a", 1, 0, 2, 60, False, False), ("a", 1, 1, 3, 70, False, False), ("a", 1, 1, 4, 80, False, True), ("a", 1, 2, 5, 90, False, True), ("a", 1, 2, 6, 95, False, False), ("a", 1, None, 7, 5, False, False), ("a", 1, None, 8, 6, False, False)]
    df = spark.createDataFrame(rows, "app_id string, stage_id long, task_index long, seq long, duration_ms long, failed boolean, speculative boolean")
    assert sorted(r.seq for r in T.task_winners(df).collect()) == [2, 3, 5, 7, 8]
    w = T.wasted_attempts(df).first()
    assert (w.retry_ms, w.retry_n, w.spec_ms, w.spec_n) == (50, 1, 80, 1)


def stages(spark, **columns):
    """One stage with these figures; others are zero."""
    base = {"tasks": 20, "failed_tasks": 0, "speculative_tasks": 0, "p50": 10.0, "p95": 10, "longest": 10, "stage_ms": 1000, "duration_ms": 10_000, "task_ms": 1000, "mem_spilled": 0, "spill_max": 0, "spill_p50": 0.0, "disk_max": 0, "disk_p50": 0.0, "stage_cores": 4, "input_bytes": 0, "output_bytes": 0, "stragglers": 0, "recovery_ms": 0.0}
    row = base | columns
    return spark.createDataFrame([("a", 1, *row.values())], "app_id string, stage_id long, " + ", ".join(f"{k} {'double' if isinstance(base[k], float) else 'long'}" for k in row))


def test_spill_tiers(spark):
    mib, gib = 1 << 20, 1 << 30
    cases = [
        ({"tasks": 1, "spill_max": 4 * gib}, "severe"), ({"tasks": 1, "disk_max": gib}, "severe"), ({"tasks": 1, "disk_max": gib - 1, "spill_max": 4 * gib - 1}, "some"),
        ({"disk_max": gib}, "high"), ({"spill_max": 4 * gib}, "high"), ({"disk_max": 256 * mib}, "medium"), ({"spill_max": gib}, "medium"), ({"disk_max": 256 * mib - 1, "spill_max": gib - 1}, "some"),
        ({"disk_max": 128 * mib, "disk_p50": 25.0 * mib}, "high"), ({"disk_max": 128 * mib, "disk_p50": 26.0 * mib}, "some"), ({"spill_max": 256 * mib, "spill_p50": 51.0 * mib}, "medium"), ({"tasks": 9, "spill_max": 256 * mib, "spill_p50": 51.0 * mib}, "some"),
    ]
    for figures, rule in cases:
        got = D.spill(stages(spark, mem_spilled=1, **figures), D.THRESHOLDS["spill"]).collect()
        assert [(r.rule, r.band) for r in got] == [(rule, "warning")], figures
    assert not D.spill(stages(spark), D.THRESHOLDS["spill"]).count()
    assert not D.spill(stages(spark, mem_spilled=1, stage_ms=49), D.THRESHOLDS["spill"]).count()


def test_stage_shape_is_a_note(spark):
    t = D.THRESHOLDS["stageShape"]
    for figures, rules in (({"tasks": 1}, ["lowParallelism"]), ({"tasks": 2}, []), ({"input_bytes": 1, "output_bytes": 11, "stage_ms": 1}, ["expansion"]), ({"longest": 501}, ["longTask"]), ({"longest": 500}, []), ({"longest": 501, "p50": 167.0}, []), ({"longest": 501, "p50": 0.0}, []), ({"tasks": 1, "stage_ms": 49}, [])):
        assert [(r.rule, r.band) for r in D.stage_shape(stages(spark, **figures), t).collect()] == [(x, "info") for x in rules], figures


def test_cold_start_needs_an_executor_that_is_there(spark):
    windows = spark.createDataFrame([("a", 100_000), ("a", 200_000)], "app_id string, submitted_ms long")
    for rows, waits in (([(50_000, None)], []), ([(50_000, 99_000), (131_000, None)], [31_000]), ([(50_000, 100_001), (131_000, None)], []), ([(130_000, None)], []), ([(50_000, 60_000)], [])):
        ex = spark.createDataFrame([("a", *r) for r in rows], "app_id string, added_ms long, removed_ms long")
        assert [r.value for r in D.cold_start(ex, windows, D.THRESHOLDS["coldStart"]).collect()] == waits, rows


def test_locality_band_goes_by_cost(spark):
    for far, ms, want in ((40, 40_000, ["critical"]), (40, 40_001, ["warning"]), (20, 20_000, ["warning"]), (40, 160_000, ["warning"]), (40, 160_001, ["info"]), (14, 1000, [])):
        tiers = spark.createDataFrame([("a", 1, "ANY", far), ("a", 1, "NODE_LOCAL", 100 - far)], "app_id string, stage_id long, locality string, tasks long")
        assert [r.band for r in D.core_locality(tiers, stages(spark, task_ms=ms), D.THRESHOLDS["coreLocality"]).collect()] == want, (far, ms)


def test_straggler_gates(spark):
    cases = [
        ({"tasks": 100, "stragglers": 6}, 60.0, ("share", "warning")), ({"tasks": 100, "stragglers": 6}, 40.0, ("share", "info")), ({"tasks": 100, "stragglers": 3}, 50.0, ("share", "warning")), ({"tasks": 100, "stragglers": 3}, 49.0, None),
        ({"tasks": 100, "stragglers": 2}, 900.0, None), ({"tasks": 9, "stragglers": 9}, 900.0, None), ({"tasks": 100, "stragglers": 6, "stage_ms": 49}, 900.0, None),
        ({"tasks": 100, "speculative_tasks": 20}, 200.0, ("speculation", "critical")), ({"tasks": 100, "speculative_tasks": 20}, 199.0, ("speculation", "warning")), ({"tasks": 100, "speculative_tasks": 9}, 199.0, ("speculation", "info")), ({"tasks": 100, "speculative_tasks": 9, "stragglers": 6}, 60.0, ("share", "warning")),
    ]
    for figures, high, want in cases:
        claims = spark.createDataFrame([("a", 1, high)], "app_id string, stage_id long, high_ms double")
        got = [(r.rule, r.band) for r in D.straggler(stages(spark, **figures), claims, D.THRESHOLDS["straggler"]).collect()]
        assert got == ([want] if want else []), (figures, high)
