from __future__ import annotations

from embertrail import queries as Q
from embertrail.operators import report as P


def test_types_that_no_detector_runs_are_not_clean(spark):
    ledger = spark.createDataFrame([("a", k, 1, "present") for k in ("tasks", "executors")] + [("a", "jobs", 0, "notEmitted")], "app_id string, key string, n long, state string")
    findings = spark.createDataFrame([("a", "skew")], "app_id string, type string")
    got = {r.type: (r.state, r.reason) for r in P.check_coverage(P.detector_catalog(spark), findings, ledger, ("skew", "gc", "jobFailureRate")).collect()}
    assert "skew" not in got and got["gc"] == ("clean", None) and got["jobFailureRate"] == ("notRun", "no jobs") and got["straggler"] == ("notRun", "no detector")


def found(spark, monkeypatch):
    """All findings are one of skew, on a stage of app-0."""
    df = spark.createDataFrame([("app-0", "skew", "tail", 1, "ratio", 9.0, 1e9, "critical")], "app_id string, type string, rule string, stage_id long, metric string, value double, waste_ms double, band string")
    monkeypatch.setattr(Q.Run, "findings", property(lambda self: df))


def test_coverage_and_verdict_know_all_findings(spark, small, monkeypatch):
    found(spark, monkeypatch)
    cover = {(r.app_id, r.type): r.state for r in Q.QUERIES["r20_check_coverage"](spark, small).collect()}
    assert ("app-0", "skew") not in cover and cover["app-0", "straggler"] == "clean" and cover["app-0", "utilization"] == cover["app-0", "rightSizing"] == "notRun"
    verdict = {r.app_id: r for r in Q.QUERIES["k8_run_verdict"](spark, small).collect()}
    assert "First: skew. 17 checks clean, 2 not run." in verdict["app-0"].summary


def test_queries_without_sql_know_all_findings(spark, small, monkeypatch):
    found(spark, monkeypatch)
    assert [(r.app_id, r.type, r.n) for r in Q.QUERIES["k2_rollup"](spark, small).collect()] == [("app-0", "skew", 1)]
    assert [(r.app_id, r.step, r.stage_id, r.lead) for r in Q.QUERIES["k4_next_steps"](spark, small).collect()] == [("app-0", 1, 1, "skew")]
    assert [(r.base_app, r.status, r.type) for r in Q.QUERIES["x10_findings_delta"](spark, small).collect()] == [("app-0", "resolved", "skew")]
