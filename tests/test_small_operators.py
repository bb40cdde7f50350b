from __future__ import annotations

from pyspark.sql import functions as F

from embertrail.operators import alignment as X
from embertrail.operators import budgets as B
from embertrail.operators import compare as C
from embertrail.operators import facts as T
from embertrail.operators import ranking as K
from embertrail.operators import report as P

PAIRS = "base_app string, cand_app string"


def test_late_and_earlier_attempts(spark):
    cols = "log string, stage_id long, attempt long, seq long, speculative boolean, failed boolean, duration_ms long, " + ", ".join(f"{c} long" for c in ("run_ms", "cpu_ns", "gc_ms", "shuffle_read", "shuffle_write", "fetch_wait_ms", "mem_spilled", "disk_spilled", "input_bytes", "output_bytes", "output_records", "peak_mem"))
    task = lambda stage, attempt, seq, spec, failed, ms, out=None: ("l", stage, attempt, seq, spec, failed, ms, *[1] * 10, out, 5)
    tasks = spark.createDataFrame([task(1, 1, 3, False, False, 10), task(1, 1, 11, True, False, 20), task(1, 1, 12, True, True, 21), task(1, 0, 13, False, False, 30), task(1, 1, 14, False, True, 40), task(1, 1, 15, False, False, 50), task(1, 0, 2, False, False, 7, 4)], cols)
    stages = spark.createDataFrame([("l", 1, 0, False, 5), ("l", 1, 1, True, 10), ("l", 2, 0, False, 5)], "log string, stage_id long, attempt long, latest boolean, completed_seq long")
    assert {(r.kind, r.n, r.task_ms) for r in T.late_work(tasks, stages).collect()} == {("speculation", 2, 41), ("late", 2, 70)}
    got = {r.stage_id: (r.attempts, r.n, r.task_ms, r.run_ms, r.output_records) for r in T.earlier_attempts(tasks, stages).collect()}
    assert got == {1: (1, 2, 37, 2, 4), 2: (1, None, None, None, None)}


def test_report_and_evidence(spark, tmp_path):
    findings = spark.createDataFrame([("a", "gc", "high", 1, "m", 2.0), ("b", "gc", "high", None, "m", 3.0)], "app_id string, type string, rule string, stage_id long, metric string, value double")
    named = K.finding_ids(findings)
    P.write_report({"findings": named}, str(tmp_path))
    back = spark.read.parquet(str(tmp_path / "findings"))
    assert sorted(map(tuple, back.select(named.columns).collect())) == sorted(map(tuple, named.collect()))
    stages = spark.createDataFrame([("a", 1, 9)], "app_id string, stage_id long, tasks long")
    one = named.filter("app_id = 'a'").first().id
    assert [(r.app_id, r.tasks) for r in P.finding_evidence(one, named, stages).collect()] == [("a", 9)]
    assert not P.finding_evidence("x", named, stages).collect()


def test_pages_with_totals_and_cursors(spark):
    rows = spark.createDataFrame([(a, s, i, "x" * 40) for a in "ab" for s, n in (("steps", 7), ("findings", 2)) for i in range(n)], "app_id string, section string, rank int, text string")
    paged = K.pages(rows, 200).cache()
    first = paged.filter("app_id = 'a' AND section = 'steps' AND page = 0").collect()
    assert {r.total for r in first} == {7} and len({r.cursor for r in first}) == 1
    seen, cursor = [r["rank"] for r in first], first[0].cursor
    while cursor:
        page = K.page_at(paged, "a", cursor).collect()
        assert page
        seen, cursor = seen + [r["rank"] for r in page], page[0].cursor
    assert sorted(seen) == list(range(7))
    other = K.pages(rows.withColumn("text", F.when(F.col("rank") == 6, "y").otherwise(F.col("text"))), 200)
    assert not K.page_at(other, "a", first[0].cursor).collect()  # the result has changed
    assert not K.pages(rows.filter("false")).collect()


def test_settings_that_differ(spark):
    conf = spark.createDataFrame([("a", "k", "1"), ("b", "k", "2"), ("a", "same", "x"), ("b", "same", "x"), ("a", "only", "y"), ("b", "db.password", "p"), ("a", "spark.app.id", "1"), ("b", "spark.app.id", "2"), ("b", "noise.z", "1")], "app_id string, key string, value string")
    pairs = spark.createDataFrame([("a", "b")], PAIRS)
    assert {(r.key, r.base, r.cand) for r in C.conf_diff(conf, pairs, r"^noise\.").collect()} == {("k", "1", "2"), ("only", "y", None), ("db.password", None, "(withheld)")}


def test_bridge_caveats_and_verdict(spark):
    pairs = spark.createDataFrame([("a", "b")], PAIRS)
    alloc = spark.createDataFrame([("a", 10.0, 2.0), ("b", 10.0, 4.0)], "app_id string, core_hours double, executors_mean double")
    metrics = spark.createDataFrame([("a", 3_600_000, 100), ("b", 7_200_000, 90)], "app_id string, task_ms long, duration_ms long")
    bridge = X.wall_clock_bridge(alloc, metrics, pairs)
    assert {r.factor: (r.base, r.cand, r.ratio) for r in bridge.collect()} == {"task_ms": (3.6e6, 7.2e6, 2.0), "executors_mean": (2.0, 4.0, 2.0), "task_share": (0.1, 0.2, 2.0), "duration_ms": (100.0, 90.0, 0.9)}
    stages = spark.createDataFrame([(a, i) for a in "ab" for i in range(5)], "app_id string, stage_id long")
    left = spark.createDataFrame([("a", "b", "unmatched")] * 3 + [("a", "b", "replanned")], f"{PAIRS}, status string")
    assert {(r.caveat, r.value) for r in X.caveats(bridge, left, stages, pairs).collect()} == {("executors", 2.0), ("unmatched", 0.3)}
    assert {r.caveat for r in X.caveats(bridge, left.limit(2), stages, pairs).collect()} == {"executors"}  # a fifth isn't over a fifth
    deltas = spark.createDataFrame([("a", "b", "duration_ms", "better", -0.1), ("a", "b", "gc_ms", "worse", 0.5)], f"{PAIRS}, metric string, direction string, relative double")
    found = spark.createDataFrame([("a", "b", "introduced"), ("a", "b", "resolved"), ("a", "b", "introduced")], f"{PAIRS}, status string")
    cover = lambda ok: spark.createDataFrame([("a", "b", ok)], f"{PAIRS}, trusted boolean")
    r = X.comparison_verdict(deltas, found, cover(True)).first()
    assert (r.title, r.tone, r.sentences) == ("Faster by 10.0%", "good", "Worse: gc_ms. 2 new findings, 1 resolved.")
    assert X.comparison_verdict(deltas, found, cover(False)).first().title == "Runs do not compare"


def test_budgets_of_comparisons(spark):
    deltas = spark.createDataFrame([("a", "b", 1, 1, "task_ms", 100.0, 150.0), ("a", "b", 2, 2, "task_ms", 100.0, 90.0), ("a", "b", 3, 3, "task_ms", 0.0, 9.0), ("a", "b", 1, 1, "gc_ms", 1.0, 9.0)], f"{PAIRS}, base_stage long, cand_stage long, metric string, base double, cand double")
    assert [(r.app_id, r.status, r.detail) for r in B.max_stage_regression(deltas, "task_ms", 40).collect()] == [("b", "violation", 50.0)]
    assert [r.status for r in B.max_stage_regression(deltas, "task_ms", 50).collect()] == ["pass"]
    delta = spark.createDataFrame([("a", "b", "introduced", "critical", None), ("a", "b", "introduced", "info", None), ("a", "b", "changed", "critical", "warning"), ("a", "b", "changed", "warning", "critical"), ("a", "b", "resolved", "critical", "critical")], f"{PAIRS}, status string, band string, from_band string")
    runs = spark.createDataFrame([("a",), ("b",)], "app_id string")
    assert {(r.app_id, r.status, r.detail) for r in B.fail_on_introduced(delta, runs).collect()} == {("a", "pass", 0.0), ("b", "violation", 2.0)}
