from __future__ import annotations

import json
import os
import subprocess
import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from embertrail.plans import nodes as N
from embertrail.plans import skew_queries as Q


def node(name, *children, **more):
    return {"nodeName": name, "simpleString": name, "children": list(children), "metrics": [], **more}


PLANS = [
    node("Exchange", node("Union", node("Sort", node("Exchange", node("BroadcastExchange", node("Scan")))), *[node("Exchange", node("Scan"))] * 11)),
    node("Project", node("Join", node("Scan"), node("Exchange", node("Join", node("Exchange"), node("Exchange", node("Exchange", node("Scan"))))))),
    node("Project", node("Scan")),
]


def texts(spark, plans):
    return spark.createDataFrame([("a", i, p) for i, p in enumerate(plans)], "log string, execution_id long, plan string")


def test_segments_of_a_plan_are_those_of_its_nodes(spark):
    x = texts(spark, [json.dumps(p) for p in PLANS] + ["{", None])
    plans = N.plan_arrays(x).withColumnRenamed("log", "app_id")
    want = N.segments(N.split_exchanges(N.node_rows(plans).drop("metrics"))).select("app_id", "execution_id", "segment", "depth", "parent").distinct()
    got = N.plan_segments(plans).select("app_id", "execution_id", F.inline("segments"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 15 + 5 + 1


def test_segments_meet_their_stages_without_nodes_being_shuffled(spark, small):
    plan = Q.QUERIES["p11_segment_stages"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(app_id#") == 3  # the orders, for their plans and for their stages, and a row a plan


def test_texts_that_are_no_usual_plans_are_walked(spark):
    odd = ['{"nodeName":"a","nodeName":"b"}', '{"nodeName":"\\ud83d\\ude00"}', '{"nodeName":"x","metrics":[{"accumulatorId":9223372036854775808}]}', '{"nodeName":1.50,"children":[{"nodeName":true}]}', '{"nodeName":"x","children":{}}', '{"nodeName":NaN}', '{"nodeName":"x"} rest', " ", "null"]
    odd += ['{"nodeName":"x","metrics":[null,{"name":"m","accumulatorId":null}],"children":[null,{"simpleString":null}]}', '{"nodeName":"x","metrics":"m"}', "[" * 5000, '{"children":[' * 3000]
    x = texts(spark, odd)
    want = x.select("log", "execution_id", F.explode(N._walk(F.col("plan"))).alias("n")).select("log", "execution_id", "n.*")
    assert sorted(map(str, N.plan_nodes(x).collect())) == sorted(map(str, want.collect()))


def test_plans_are_read_where_workers_have_no_package():
    code = "import sys; from pyspark import cloudpickle; f = cloudpickle.loads(sys.stdin.buffer.read()); assert 'embertrail' not in sys.modules; print(f.__name__)"
    done = subprocess.run([sys.executable, "-c", code], input=cloudpickle.dumps(N._plan_reader()), capture_output=True, cwd="/", env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert done.returncode == 0, done.stderr


def test_joins_meet_what_their_execution_has_once(spark, small):
    # Joins, accumulators and their nodes, values, links, stages and settings; before, each step over nodes and those above them had its own.
    plan = Q.QUERIES["p16_skew_join_cases"](spark, small)._jdf.queryExecution()
    assert plan.executedPlan().toString().count("Exchange hashpartitioning(") <= 18
    plan = Q.QUERIES["f32_missed_broadcasts"](spark, small)._jdf.queryExecution()
    few, text = plan.executedPlan().toString().count("Exchange hashpartitioning(app_id#"), plan.optimizedPlan().toString()
    assert few <= 16
    assert text.count("replace(substring(") == 2  # once a side: no filter works it out again


def test_cases_and_broadcasts_of_plans_are_those_of_their_nodes(spark, small):
    from embertrail.plans import detectors as D
    from embertrail.plans import plan_texts as T
    from embertrail.plans import skew_joins as S

    t = T.plan_tables(T.order_executions(spark, small).filter("execution_id < 400"), (*S.SETTINGS, *D.THRESHOLDS))
    rows = t["nodes"].select("app_id", "execution_id", "path", "name", "detail")
    for of in (lambda n: S.skew_join_cases(n, t["metrics"], t["links"], t["stages"], t["settings"]), lambda n: D.missed_broadcasts(n, t["metrics"], t["settings"])):
        whole = sorted(map(str, of(t["plans"]).collect()))
        assert whole and whole == sorted(map(str, of(rows).collect()))
    read = D.missed_broadcasts_of(t["plans"], spark.sql(T.METRICS_SQL, shapes=t["shapes"]), t["settings"])
    assert sorted(map(str, read.collect())) == whole


def test_a_word_that_an_escape_hides_is_found(spark):
    x = texts(spark, ['{"nodeName":"Sort\\u004dergeJoin"}', '{"nodeName":"Scan","children":[{"nodeName":"SortMergeJoin"}]}', '{"nodeName":"Scan"}', None])
    assert sorted((r.execution_id, len(r.nodes), r.nodes[-1].name) for r in N.plan_arrays(x, "SortMergeJoin").filter("size(nodes) > 0").collect()) == [(0, 1, "SortMergeJoin"), (1, 2, "SortMergeJoin")]
