from __future__ import annotations

from pyspark.sql import functions as F

from embertrail.operators import attempts as V
from embertrail.operators import budgets as B
from embertrail.operators import facts as T

TASK = "app_id string, stage_id long, attempt long, task_index long, seq long, failed boolean, speculative boolean, duration_ms long, " + ", ".join(f"{c} long" for c in (*V.SUMS, "output_records", "peak_mem"))
TRY = "app_id string, stage_id long, attempt long, submitted_ms long, completed_ms long, submitted_seq long, completed_seq long, failure string"


def task(stage, attempt, index, seq, failed=False, copy=False, ms=10, run=100, out=None, cpu=0):
    return ("a", stage, attempt, index, seq, failed, copy, ms, run, cpu, *[1] * (len(V.SUMS) - 2), out, 7)


def parts(spark, tasks, tries):
    return V.task_parts(spark.createDataFrame(tasks, TASK), spark.createDataFrame(tries, TRY))


def named(df):
    return {r.seq: (r.part, r.retried) for r in df.collect()}


def test_records_of_an_open_submission(spark):
    one = [("a", 1, 0, 0, 50, 1, 100, None)]
    rows = [
        task(1, 0, 0, 2, failed=True), task(1, 0, 0, 3, failed=True), task(1, 0, 0, 4),  # two failures, then the retry that counts
        task(1, 0, 1, 5, copy=True), task(1, 0, 1, 6, failed=True),  # a copy won: the original that is killed is no retry
        task(1, 0, 2, 7), task(1, 0, 2, 8, copy=True),  # a copy lost
        task(1, 0, 3, 9, failed=True, copy=True), task(1, 0, 3, 10, failed=True),  # both failed: the first counts
        task(1, 0, None, 11), task(1, 0, None, 12),  # no index: tasks of their own
    ]
    got = named(parts(spark, rows, one))
    lost, won = ("discarded", True), ("own", False)
    assert got == {2: lost, 3: lost, 4: won, 5: won, 6: ("discarded", False), 7: won, 8: ("discarded", False), 9: won, 10: lost, 11: won, 12: won}


def test_records_behind_a_completion(spark):
    sound, broken = [("a", 1, 0, 0, 50, 1, 10, None)], [("a", 1, 0, 0, 50, 1, 10, "lost")]
    rows = [task(1, 0, 0, 5, copy=True), task(1, 0, 0, 20), task(1, 0, 1, 6), task(1, 0, 1, 21, copy=True), task(1, 0, 1, 22), task(1, 0, None, 23, copy=True), task(1, 0, 9, 24), task(1, 3, 9, 25)]
    got = {k: v[0] for k, v in named(parts(spark, rows, sound)).items()}
    assert got == {5: "own", 6: "own", 20: "discarded", 21: "discarded", 22: None, 23: None, 24: None, 25: "late"}
    assert {k: v[0] for k, v in named(parts(spark, rows, broken)).items() if k > 10} == {20: "discarded", 21: "discarded", 22: "late", 23: "late", 24: "late", 25: "late"}


def test_replaced_submissions(spark):
    tries = [("a", 1, 0, 0, 40, 1, 10, "lost"), ("a", 1, 1, 100, 160, 20, 30, None), ("a", 2, 0, 0, None, 1, None, None), ("a", 2, 1, 10, 5, 20, 30, None), ("a", 3, 0, 0, None, 1, None, None), ("a", 4, 0, 7, 9, 1, 12, None)]
    rows = [task(1, 0, 0, 2, out=4), task(1, 0, 0, 15), task(1, 0, 0, 22), task(1, 1, 0, 23, failed=True), task(1, 1, 0, 24, out=5), task(1, 1, 0, 0), task(2, 0, 0, 3, failed=True), task(2, 0, 0, 4), task(2, 1, 0, 25), task(4, 0, 0, 5, cpu=2_000_000)]
    df = parts(spark, rows, tries)
    got = {(r.stage_id, r.seq): r.part for r in df.collect()}
    assert got == {(1, 2): "earlier", (1, 15): "late", (1, 22): "own", (1, 23): "discarded", (1, 24): "own", (2, 3): "discarded", (2, 4): None, (2, 25): "own", (4, 5): "own"}  # seq 0 is before any submission
    totals = V.stage_totals(V.attempt_work(df), spark.createDataFrame(tries, TRY))
    t = {r.stage_id: r for r in totals.collect()}
    assert [(t[1].tasks, t[1].failed_tasks, t[1].retried_tasks, t[1].run_ms, t[1].output_records, t[1].attempts, t[1].failed_attempts, t[1].duration_ms)] == [(4, 0, 1, 500, 9, 2, 1, 100)]
    # a submission replaced while it ran: its loser's work counts, its winner's and its retries don't; a clock that went back gives no duration
    assert (t[2].tasks, t[2].retried_tasks, t[2].run_ms, t[2].output_records, t[2].duration_ms) == (1, 0, 200, None, None)
    assert (t[3].tasks, t[3].run_ms, t[3].peak_mem) == (0, 0, None)

    described = totals.join(V.skew_ratios(df), V.STAGE, "left").withColumn("is_python", F.col("stage_id") == 4)
    timing = spark.createDataFrame([("a", True, 99), ("b", False, 1)], "app_id string, complete boolean, duration_ms long")
    runs = {r.app_id: r for r in V.run_totals(described, timing).collect()}
    a = runs["a"]
    assert (a.tasks, a.retried_tasks, a.cpu_ms, a.stages, a.failed_stage_attempts, a.retried_stages, a.python_share, a.stage_ms, a.wall_ms, a["skew"]) == (6, 1, 2.0, 4, 1, 2, 0.125, 102, 99, 1.0)
    assert runs["b"].tasks is None and runs["b"].stages is None
    names = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("a", 3, "y"), ("a", 4, "z")], "app_id string, stage_id long, identity string")
    f = {r.identity: r for r in V.fingerprint_rows(described, names).collect()}
    assert (f["x"].stage_ids, f["x"].failed, f["x"].retried, f["x"].python, f["x"].tasks) == ([1, 2], True, True, False, 5)
    assert (f["y"].tasks, f["y"].run_ms, f["y"].cpu_ms, f["y"].peak_mem, f["y"].failed) == (None, None, None, None, False) and f["z"].python
    rate = B.max_failed_attempt_rate(totals, 14).first()
    assert (rate.status, round(rate.detail, 6)) == ("violation", round(100 / 7, 6))
    assert B.max_failed_attempt_rate(totals.filter("stage_id = 3"), 1).first().status == "inconclusive"


def test_deltas_over_all_attempts(spark):
    tries = [(a, 1, 0, 0, 9, 1, 10, None) for a in "ab"]
    rows = [("a", *task(1, 0, 0, 2)[1:]), ("b", *task(1, 0, 0, 2, failed=True, run=30)[1:]), ("b", *task(1, 0, 0, 3, cpu=3_000_000)[1:])]
    df = spark.createDataFrame(tries, TRY)
    totals = V.stage_totals(V.attempt_work(V.task_parts(spark.createDataFrame(rows, TASK), df)), df)
    pairs = spark.createDataFrame([("a", "b", 1, 1)], "base_app string, cand_app string, base_stage long, cand_stage long")
    got = {r.metric: (r.base, r.cand, r.delta) for r in V.attempt_deltas(pairs, totals).collect()}
    assert got["run_ms"] == (100.0, 130.0, 30.0) and got["cpu_ms"] == (None, 3.0, None) and set(got) == set(V.PAIR_METRICS)


def test_no_rows(spark):
    tasks, tries = spark.createDataFrame([], TASK), spark.createDataFrame([], TRY)
    assert not V.stage_totals(V.attempt_work(V.task_parts(tasks, tries)), tries).collect()


def test_overtaken_originals_are_no_waste(spark):
    rows = [("a", 1, 0, 1, 50, False, True), ("a", 1, 0, 2, 60, True, False), ("a", 1, 1, 3, 70, True, False), ("a", 1, 1, 4, 80, False, True), ("a", 1, 2, 5, 90, True, True), ("a", 1, 2, 6, 95, True, False)]
    df = spark.createDataFrame(rows, "app_id string, stage_id long, task_index long, seq long, duration_ms long, failed boolean, speculative boolean")
    w = T.wasted_attempts(df).first()  # the killed original of task 0 isn't retried; the failures of tasks 1 and 2 are
    assert (w.retry_ms, w.retry_n, w.spec_ms, w.spec_n) == (165, 2, 0, 0)
