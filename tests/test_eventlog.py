from __future__ import annotations

import json

import pytest

from embertrail.plans import nodes as N
from embertrail.sources import eventlog as E


def line(event, **fields):
    return json.dumps({"Event": event, **fields})


def task(stage, index, launch, finish, task_id, attempt=0, **info):
    base = {"Task ID": task_id, "Index": index, "Attempt": 0, "Launch Time": launch, "Finish Time": finish, "Executor ID": "1", "Host": "h1", "Locality": "ANY", "Speculative": False, "Failed": False, "Killed": False}
    reason = info.pop("reason", {"Reason": "Success"})
    return line("SparkListenerTaskEnd", **{"Stage ID": stage, "Stage Attempt ID": attempt, "Task End Reason": reason, "Task Info": base | info, "Task Executor Metrics": {"JVMHeapMemory": 100 + index, "OnHeap": 0},
        "Task Metrics": {"Executor Run Time": 5, "JVM GC Time": 1, "Shuffle Read Metrics": {"Remote Bytes Read": 3, "Local Bytes Read": 4}, "Input Metrics": {"Bytes Read": 9, "Records Read": 2}}})


def stage(kind, id_, attempt, **info):
    return line(f"SparkListenerStage{kind}", **{"Stage Info": {"Stage ID": id_, "Stage Attempt ID": attempt, "Stage Name": "count", "Submission Time": 100, **info}})


PLAN = {"nodeName": "Project", "simpleString": "Project [a#1]", "metrics": [], "children": [{"nodeName": "Scan", "simpleString": "s", "metrics": [{"name": "rows", "accumulatorId": 7, "metricType": "sum"}, {"name": "peak", "accumulatorId": 8, "metricType": "average"}], "children": []}]}
LINES = [
    line("SparkListenerLogStart", **{"Spark Version": "4.1.2"}),
    line("SparkListenerApplicationStart", **{"App Name": "job", "App ID": "app-1", "Timestamp": 50, "Spark Version": "4.0"}),
    line("SparkListenerEnvironmentUpdate", **{"Spark Properties": [["spark.executor.cores", "2"], ["spark.x", "1"]]}),
    line("SparkListenerEnvironmentUpdate", **{"Spark Properties": {"spark.executor.cores": "4"}}),
    line("SparkListenerExecutorAdded", **{"Timestamp": 60, "Executor ID": "1", "Executor Info": {"Host": "h1", "Total Cores": 4}}),
    line("SparkListenerExecutorAdded", **{"Timestamp": 61, "Executor ID": "1", "Executor Info": {"Host": "h1", "Total Cores": 4}}),
    line("SparkListenerExecutorRemoved", **{"Timestamp": 20, "Executor ID": "1", "Removed Reason": "early"}),
    line("org.apache.spark.sql.execution.ui.SparkListenerSQLExecutionStart", executionId=3, rootExecutionId=3, description="q", physicalPlanDescription="", time=90, sparkPlanInfo={"nodeName": "Old", "children": []}, modifiedConfigs={}),
    line("SparkListenerJobStart", **{"Job ID": 0, "Submission Time": 95, "Stage IDs": [0, 1], "Properties": {"spark.sql.execution.id": "3"}}),
    stage("Submitted", 0, 0, **{"RDD Info": [{"RDD ID": 5, "Name": "r", "Number of Partitions": 4, "Number of Cached Partitions": 2, "Memory Size": 10, "Disk Size": 0}]}),
    task(0, 0, 100, 130, 1, reason={"Reason": "ExceptionFailure", "Class Name": "X", "Description": "Boom\nmore"}, Failed=True),
    stage("Completed", 0, 0, **{"Completion Time": 140, "Failure Reason": "lost"}),
    stage("Submitted", 0, 1),
    task(0, 0, 141, 150, 2, attempt=1),
    task(0, 1, 120, 160, 3, attempt=0),
    line("org.apache.spark.sql.execution.ui.SparkListenerSQLAdaptiveExecutionUpdate", executionId=3, physicalPlanDescription="", sparkPlanInfo=PLAN),
    line("org.apache.spark.sql.execution.ui.SparkListenerDriverAccumUpdates", executionId=3, accumUpdates=[[7, 2], [7, 3]]),
    stage("Completed", 0, 1, **{"Completion Time": 170, "RDD Info": [{"RDD ID": 5, "Name": "r", "Number of Partitions": 4, "Number of Cached Partitions": 0, "Memory Size": 0, "Disk Size": 0}], "Accumulables": [{"ID": 8, "Value": "12", "Metadata": "sql"}, {"ID": 9, "Value": "x", "Metadata": "sql"}]}),
    task(0, 2, 120, 180, 4, attempt=1),
    line("SparkListenerStageExecutorMetrics", **{"Stage ID": 0, "Executor ID": "1", "Executor Metrics": {"JVMHeapMemory": 500}}),
    line("SparkListenerJobEnd", **{"Job ID": 0, "Completion Time": 175, "Job Result": {"Result": "JobFailed", "Exception": {"Message": "m"}}}),
    line("org.apache.spark.sql.execution.ui.SparkListenerSQLExecutionEnd", executionId=3, time=176),
    "{broken", "", '{"no": "type"}', line("SparkListenerTaskStart"),
]


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("log")
    (d / "app-1").write_text("\n".join(LINES))
    return E.parse_events(E.read_event_lines(spark, str(d))).cache()


def test_lines_and_ledger(events):
    assert events.count() == len(LINES)
    assert [(r.skipped, r.unread_sql) for r in E.skipped_lines(events).collect()] == [(2, 0)]


def test_application_and_settings(events):
    a = E.applications(events).first()
    assert (a.app_id, a.name, a.start_ms, a.end_ms, a.version) == ("app-1", "job", 50, None, "4.1.2")
    assert [(r.key, r.value) for r in E.spark_properties(events).collect()] == [("spark.executor.cores", "4")]
    x = E.executor_events(events).collect()
    assert [(r.executor_id, r.added_ms, r.removed_ms, r.cores) for r in x] == [("1", 60, None, 4)]


def test_jobs_and_stages(events):
    j = E.jobs(events).first()
    assert (j.job_id, j.execution_id, j.start_ms, j.end_ms, j.succeeded, j.reason) == (0, 3, 95, 175, False, "m")
    assert {(r.stage_id, r.execution_id) for r in E.stage_execution_link(events).collect()} == {(0, 3), (1, 3)}
    s = {r.attempt: r for r in E.stage_attempts(events).collect()}
    assert (s[0].latest, s[1].latest, s[1].attempts, s[1].failed_attempts, s[0].failure) == (False, True, 2, 1, "lost")


def test_tasks_join_the_open_attempt(events):
    t = E.task_records(events)
    assert {(r.task_id, r.duration_ms, r.failed, r.shuffle_read, r.output_records) for r in t.collect()} == {(1, 30, True, 7, None), (2, 9, False, 7, None), (3, 40, False, 7, None), (4, 60, False, 7, None)}
    assert {r.task_id for r in E.tasks_of_latest(t, E.stage_attempts(events)).collect()} == {2, 3}
    f = E.task_failures(t).collect()
    assert [(r.reason, r.cls, r.message) for r in f] == [("ExceptionFailure", "X", "Boom")]


def test_storage_and_peaks(events):
    r = E.rdd_info(events).first()
    assert (r.rdd_id, r.cached, r.mem_bytes) == (5, 2, 10)
    assert {(x.metric, x.peak) for x in E.executor_peaks(events).collect()} == {("JVMHeapMemory", 102)}
    assert [x.bytes for x in E.heap_peaks(E.executor_peaks(events), E.stage_executor_metrics(events)).collect()] == [500]


def test_plans(events):
    x = E.sql_executions(events)
    r = x.first()
    assert (r.execution_id, r.start_ms, r.end_ms, r.adaptive) == (3, 90, 176, True)
    nodes = N.plan_nodes(x)
    assert [(r.path, r.name) for r in nodes.orderBy("path").collect()] == [("0", "Project"), ("0.0", "Scan")]
    acc = E.accumulators(events)
    assert {(a.acc_id, a.value, a.side) for a in acc.collect()} == {(7, 5.0, "driver"), (8, 12.0, "executor"), (9, None, "executor")}
    assert [(m.path, m.metric, m.value) for m in N.plan_metrics(nodes, acc).collect()] == [("0.0", "rows", 5.0)]


def test_rolling_members(spark):
    files = [("l", f"l/{f}") for f in ("appstatus_x", "events_1_x", "events_2_x.compact", "events_3_x", "events_5_x")]
    got = E.rolling_members(spark.createDataFrame(files, "log string, path string")).orderBy("index").collect()
    assert [(r["index"], r.gap) for r in got] == [(2, False), (3, False), (5, True)]


def test_round_trip_of_derived_tasks(spark, small):
    from embertrail.sources.testdata import facts

    tasks = facts(spark, small)["tasks"]
    back = E.task_records(E.parse_events(E.as_lines(tasks)))
    keep = ["stage_id", "task_id", "host", "duration_ms", "failed", "shuffle_read", "output_records", "gc_ms", "cpu_ns"]
    a = tasks.select(tasks.app_id.alias("log"), *keep)
    b = back.select("log", *keep)
    assert a.count() == b.count() and a.exceptAll(b).count() == 0


def test_own_session_log(spark, tmp_path):
    runs = E.list_runs(spark.createDataFrame([("l1", "a", 5), ("l2", "ab", 9), ("l3", "c", 7)], "log string, name string, start_ms long"), most=2).collect()
    assert [(r.log, r.truncated) for r in runs] == [("l2", True), ("l3", True)]


def test_rolling_parts_are_read_in_order(spark, tmp_path):
    d = tmp_path / "eventlog_v2_app-9"
    d.mkdir()

    def write(name, app, lines):
        (d / name).write_text("\n".join([line("SparkListenerApplicationStart", **{"App Name": app, "App ID": "app-9", "Timestamp": 1})] + [line("SparkListenerTaskStart")] * lines) + "\n")

    for sizes in ((100, 5000, 1000), (5000, 1000, 100), (100, 1000, 5000)):
        for i, n in enumerate(sizes, 1):
            write(f"events_{i}_app-9", f"part {i}", n)
        (d / "appstatus_app-9").write_text("")
        events = E.parse_events(E.read_event_lines(spark, str(d)))
        assert E.applications(events).first().name == "part 3" and events.count() == sum(sizes) + 3
    write("events_2_app-9.compact", "compacted", 7)
    events = E.parse_events(E.read_event_lines(spark, str(d)))
    assert sorted({r.part for r in events.collect()}) == [2, 3] and events.count() == 8 + 5001
    assert E.applications(events).first().name == "part 3"
    write("events_5_app-9", "part 5", 1)
    with pytest.raises(ValueError, match="events_5_app-9"):
        E.read_event_lines(spark, str(d))


def test_lines_are_written_and_parsed_once(spark, small):
    tasks = spark.range(3).selectExpr("'a' AS app_id", "1L AS stage_id", "id AS task_id", "id AS launch_ms", "id + 5 AS finish_ms", "'e' AS executor_id", "'h' AS host", "'ANY' AS locality", "FALSE AS speculative", "id = 1 AS failed",
        *[f"7L AS {c}" for c in ("run_ms", "cpu_ns", "gc_ms", "peak_mem", "mem_spilled", "disk_spilled", "input_bytes", "records_read", "output_bytes", "output_records", "shuffle_read", "fetch_wait_ms", "shuffle_write")])
    x = E.task_records(E.parse_events(E.as_lines(tasks)))
    plan = x._jdf.queryExecution().optimizedPlan()
    tests = [at for at in plan.toString().split("\n") if "Filter " in at]
    assert tests and all("raw#" in at and "json" not in at.lower() for at in tests)
    assert sorted((r.task_id, r.failed, r.duration_ms, r.shuffle_read) for r in x.collect()) == [(0, False, 5, 7), (1, True, 5, 7), (2, False, 5, 7)]
