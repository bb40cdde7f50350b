from __future__ import annotations

import json

from embertrail.plans import nodes as N
from embertrail.plans import plan_texts as T


def test_executions_of_one_file_are_dealt_out(spark, small):
    orders = spark.read.parquet(f"{small}/orders.parquet")
    dealt = T.order_executions(spark, small)
    assert orders.rdd.getNumPartitions() == 1 and dealt.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
    assert dealt.count() == orders.count()


def test_a_node_is_read_once_and_what_is_no_object_has_none(spark):
    node = lambda name, *children, **more: {"nodeName": name, "simpleString": f"{name} [a, \"b]\"]", "children": list(children), **more}
    deep = node("n0")
    for i in range(1, 40):
        deep = node(f"n{i}", deep)
    metric = {"name": "rows", "accumulatorId": "7", "metricType": "sum"}
    mixed = node("top", 5, None, "text", [node("lost")], node("kept", metrics=[metric, 3]), {"nodeName": 8, "children": "none"})
    plans = [json.dumps(deep), json.dumps(mixed), "[]", "{", "5", None, '{"nodeName":"bare"}']
    x = spark.createDataFrame([("a", i, p) for i, p in enumerate(plans)], "log string, execution_id long, plan string")
    nodes = N.plan_nodes(x)
    assert "schema_of_variant" not in nodes._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.execution_id, r.path): r for r in nodes.collect()}
    assert len(got) == 40 + 3 + 1 and got[0, ".".join("0" * 40)].name == "n0"
    assert [p for i, p in sorted(got) if i == 1] == ["0", "0.4", "0.5"] and got[1, "0.5"].name == "8" and got[1, "0.5"].detail is None
    assert [None if m.name is None else (m.name, m.id, m.type) for m in got[1, "0.4"].metrics] == [("rows", 7, "sum"), None] and got[6, "0"].metrics == []
