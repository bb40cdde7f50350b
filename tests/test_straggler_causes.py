from __future__ import annotations

from embertrail.operators import detectors as D

T, S = D.THRESHOLDS["straggler"], D.THRESHOLDS["skew"]
STAGES = "app_id string, stage_id long, tasks long, speculative_tasks long, stragglers long, p50 double, p95 long, longest long, longest_after_ms double, stage_ms long, duration_ms long, excess_ms double, recovery_ms double"
TAILS = "app_id string, stage_id long, excess_ms double, data_ms double, gc_ms double, fetch_ms double, host_ms double, host string, host_tasks long, data_ratio double, cpu_pct double"


def stage(i, p95=4000, stragglers=0, duration=100_000, copies=0, excess=0.0):
    return ("a", i, 100, copies, stragglers, 1000.0, p95, 9000, 1000.0, 20_000, duration, excess, 8000.0)


def found(spark, stages, tails, high=None):
    s = spark.createDataFrame(stages, STAGES)
    peaks = spark.createDataFrame([("a", x[1], 10) for x in stages], "app_id string, stage_id long, peak_tasks long")
    over = D.skew_claims(s, peaks, S).join(spark.createDataFrame(high or [], "app_id string, stage_id long, high_ms double"), D.STAGE, "left")
    claims = spark.createDataFrame([], "app_id string, stage_id long, high_ms double")
    return {r.stage_id: r for r in D.straggler_tails(s, claims, over, spark.createDataFrame(tails, TAILS), T, S).collect()}


def test_tails_that_only_the_ratio_admits(spark):
    gc = lambda i: ("a", i, 1000.0, 100.0, 800.0, 50.0, 0.0, None, None, 1.0, 79.5)
    stages = [stage(1), stage(2, p95=3000), stage(3), stage(4, duration=None), stage(5), stage(6, stragglers=8), stage(7, excess=30_000.0, duration=620_000)]
    data = ("a", 3, 1000.0, 500.0, 400.0, 50.0, 0.0, None, None, 3.0, 10.0)
    got = found(spark, stages, [gc(1), gc(2), data, gc(4), gc(6)], [("a", 1, 500.0), ("a", 5, 499.0)])
    # 2: a ratio of 3 isn't over 3; 3: skew reports what data explains; 5: saves under half a percent of the run; 7: 3,000 ms are under, too
    assert set(got) == {1, 4, 6}
    r = got[1]
    assert (r.rule, r.value, r.band, r.waste_ms, r.cause, r.cause_pct, r.cpu_pct, r.host) == ("ratio", 4.0, "info", 8000.0, "gc", 80, 80, None)
    assert (got[4].rule, got[6].rule, got[6].value) == ("ratio", "share", 8.0)


def test_causes(spark):
    tail = lambda i, data, gc, fetch, host, ratio=1.0, cpu=None: ("a", i, 1000.0, data, gc, fetch, host, "h" if host else None, 3 if host else None, ratio, cpu)
    tails = [tail(1, 0.0, 300.0, 300.0, 300.0), tail(2, 0.0, 200.0, 450.0, 0.0), tail(3, 100.0, 0.0, 0.0, 600.0), tail(4, 499.0, 0.0, 0.0, 0.0), tail(5, 0.0, 100.0, 0.0, 0.0, None), tail(6, 500.0, 0.0, 0.0, 0.0), ("a", 8, 0.0, 0.0, 0.0, 0.0, 0.0, None, None, 1.0, None)]
    # own gate without skew's (p95 under the ratio): what data explains is a straggler's then
    got = found(spark, [stage(i, p95=2000, stragglers=8) for i in range(1, 9)], tails)
    assert {i: (r.cause, r.cause_pct) for i, r in got.items()} == {1: ("gc", 30), 2: ("fetchWait", 45), 3: ("host", 60), 4: ("unexplained", 50), 5: ("unattributed", None), 6: ("data", 50), 7: ("unattributed", None), 8: ("unattributed", None)}
    assert (got[3].host, got[3].host_tasks, got[1].host) == ("h", 3, None)
    # with it, skew has that one
    assert 6 not in found(spark, [stage(i, stragglers=8) for i in range(1, 9)], tails)


def test_no_stages(spark):
    assert found(spark, [stage(1, p95=0)], []) == {}
