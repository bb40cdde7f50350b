from __future__ import annotations

import json

from embertrail.operators import alignment as L
from embertrail.operators import storage as S
from embertrail.sources.eventlog import parse_events

PAIRS = [("a", "b")]


def test_executions_and_stages_pair(spark):
    pairs = spark.createDataFrame(PAIRS, "base_app string, cand_app string")
    tokens = [(app, ex, "structure", t) for app, ex, ts in (("a", 1, "pqrs"), ("a", 2, "uvw"), ("b", 5, "pqrt"), ("b", 6, "uvw"), ("b", 7, "xyz")) for t in ts]
    sim = L.execution_similarity(spark.createDataFrame(tokens, "app_id string, execution_id long, kind string, token string"), pairs, 0.5)
    assert {(r.base_execution_id, r.cand_execution_id, round(r.score, 2)) for r in sim.collect()} == {(1, 5, 0.6), (2, 6, 1.0)}
    ex = spark.createDataFrame([("a", 1, "s1"), ("a", 2, "s2"), ("b", 5, "s9"), ("b", 6, "s2"), ("b", 7, "s7")], "app_id string, execution_id long, signature string")
    al = L.align_executions(sim, ex, pairs)
    assert {(r.base_execution_id, r.cand_execution_id) for r in al.collect()} == {(2, 6), (1, 5)}
    stages = spark.createDataFrame(
        [("a", 1, 10, "e1", "t1", "n"), ("a", 1, 11, "e2", "t2", "n"), ("a", 1, 12, "e3", "t3", "m"), ("a", 1, 13, "e4", "t4", "z"), ("b", 5, 20, "e1", "t1", "n"), ("b", 5, 21, "f2", "t2", "n"), ("b", 5, 22, "f3", "u3", "m"), ("b", 5, 23, "f4", "u4", "z"), ("b", 7, 24, "f5", "u5", "q")],
        "app_id string, execution_id long, stage_id long, exact string, structural string, name string",
    )
    toks = spark.createDataFrame([(a, s, t) for a, s, ts in (("a", 12, "abc"), ("b", 22, "abcd"), ("a", 13, "q"), ("b", 23, "r")) for t in ts], "app_id string, stage_id long, token string")
    got = L.pair_stages(al, stages, toks)
    assert {(r.base_stage_id, r.cand_stage_id, r.quality) for r in got.collect()} == {(10, 20, "exact"), (11, 21, "structural"), (12, 22, "similar"), (13, 23, "position")}
    left = L.leftovers(got, stages, pairs, al)
    assert {(r.side, r.stage_id, r.status) for r in left.collect()} == {("cand", 24, "unmatched")}
    times = spark.createDataFrame([(r.app_id, r.stage_id, 10) for r in stages.collect()], "app_id string, stage_id long, run_ms long")
    c = L.coverage(got, left, times, pairs).first()
    assert (round(c.coverage, 3), c.trusted) == (round(8 / 9, 3), False)
    assert not L.plan_equal(left, pairs).first().equal


def test_identity_forgets_what_differs(spark):
    stages = spark.createDataFrame([("a", 1, "count at X.scala:12"), ("b", 9, "count at X.scala:99")], "app_id string, stage_id long, name string")
    nodes = spark.createDataFrame([("a", 1, "Scan", "s#1"), ("b", 9, "Scan", "s#77L")], "app_id string, stage_id long, name string, detail string")
    assert len({r.identity for r in L.stage_identity(stages, nodes).collect()}) == 1


def block(executor, part, held, size):
    return json.dumps({"Event": "SparkListenerBlockUpdated", "Block Updated Info": {"Block Manager ID": {"Executor ID": executor}, "Block ID": f"rdd_3_{part}", "Storage Level": {"Use Memory": held, "Use Disk": False}, "Memory Size": size, "Disk Size": 0}})


def test_block_residency(spark):
    raw = [block("1", 0, True, 10), block("2", 0, True, 10), block("1", 1, True, 20), block("1", 0, False, 0), block("2", 2, True, 5), json.dumps({"Event": "SparkListenerExecutorRemoved", "Timestamp": 1, "Executor ID": "2"}), block("1", 3, True, 7)]
    events = parse_events(spark.createDataFrame([("l", i, r) for i, r in enumerate(raw)], "log string, seq long, raw string"))
    assert [(r.rdd_id, r.peak_parts, r.peak_bytes) for r in S.block_residency(events).collect()] == [(3, 3, 35)]
    rdds = spark.createDataFrame([("l", 1, 10, 4, 100, 0), ("l", 2, 10, 10, 50, 50), ("l", 3, 5, 0, 0, 0), ("l", 4, 5, 5, 9, 1)], "log string, rdd_id long, partitions long, cached long, mem_bytes long, disk_bytes long")
    assert {(r.rdd_id, r.rule, r.band) for r in S.cache_utilization(rdds).collect()} == {(1, "partial", "warning"), (2, "disk", "warning"), (3, "unseen", "info")}
