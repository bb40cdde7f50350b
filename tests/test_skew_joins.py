from __future__ import annotations

from embertrail.functions.units import GIB, MIB
from embertrail.operators import config as C
from embertrail.plans import detectors as D
from embertrail.plans import skew_joins as S

FINAL = "AdaptiveSparkPlan isFinalPlan=true"


def plan(spark, *plans):
    """Nodes, metrics and links of executions 1, 2 and so on, each from (path, name, detail, metrics, stage ids)."""
    flat = [(i, *row) for i, rows in enumerate(plans, 1) for row in rows]
    nodes = spark.createDataFrame([("a", i, p, n, d) for i, p, n, d, _, _ in flat], "app_id string, execution_id long, path string, name string, detail string")
    metrics = spark.createDataFrame([("a", i, p, m, float(v)) for i, p, _, _, ms, _ in flat for m, v in ms.items()], "app_id string, execution_id long, path string, metric string, value double")
    links = spark.createDataFrame([("a", i, p, k) for i, p, _, _, _, ids in flat for k in ids], "app_id string, execution_id long, path string, stage_id long")
    return nodes, metrics, links


def settings(spark, *each, version="3.5.0"):
    """A row for each execution, with what it set, and one for the run."""
    apps = spark.createDataFrame([("a", version)], "app_id string, version string")
    over = spark.createDataFrame([("a", i, k, v) for i, set_ in enumerate(each, 1) for k, v in set_], "app_id string, execution_id long, key string, value string")
    conf = spark.createDataFrame([], "app_id string, key string, value string")
    return C.execution_settings(apps, C.effective_conf(apps, conf, over, C.default_settings(spark)), spark.createDataFrame([("a", i) for i in range(1, len(each) + 1)], "app_id string, execution_id long"), (*S.SETTINGS, *D.THRESHOLDS))


STAGE = "app_id string, execution_id long, stage_id long, read_max long, read_p50 long, shuffle_read long, data_tail boolean"


def join(name="SortMergeJoin", type_="Inner", left="ENSURE_REQUIREMENTS", right="ENSURE_REQUIREMENTS", read="", above=(), sides=(100, 1), root=FINAL):
    rows, at = [("0", "AdaptiveSparkPlan", root, {}, [])], "0"
    for n, d in above:
        at += ".0"
        rows.append((at, n, d, {}, []))
    at += ".0"
    rows.append((at, name, f"{name} [a#1], [b#2], {type_}", {}, [5]))
    for i, (origin, size) in enumerate(zip((left, right), sides)):
        p = f"{at}.{i}"
        if origin.startswith("="):
            rows.append((p, origin[1:], origin[1:], {}, []))
            continue
        rows += [(p, "Sort", "Sort [a#1]", {}, []), (f"{p}.0", "InputAdapter", "InputAdapter", {}, []), (f"{p}.0.0", "AQEShuffleRead", f"AQEShuffleRead {read if i == 0 else ''}", {"number of skewed partitions": 2, "number of skewed partition splits": 9} if read == "skewed" and i == 0 else {}, [])]
        rows += [(f"{p}.0.0.0", "ShuffleQueryStage", "ShuffleQueryStage 0", {}, []), (f"{p}.0.0.0.0", "Exchange", f"Exchange hashpartitioning(a#1, 200), {origin}", {"shuffle bytes written": size * MIB, "data size": size * MIB}, [])]
    return rows


AGG, PARTIAL = ("HashAggregate", "HashAggregate(keys=[a#1], functions=[sum(b#2)])"), ("HashAggregate", "HashAggregate(keys=[a#1], functions=[partial_sum(b#2)])")
BIG = dict(read_max=600 * MIB, read_p50=50 * MIB)


CASES = [
    (join("SortMergeJoin(skew=true)"), BIG, ("split", None)),
    (join(read="skewed"), BIG, ("split", "2 into 9")),
    (join(), dict(read_max=99 * MIB, read_p50=50 * MIB), ("evenReads", None)),
    (join(), dict(read_max=100 * MIB, read_p50=50 * MIB), ("belowThreshold", "both")),  # twice the median isn't even
    (join(sides=(100, 6)), dict(read_max=99 * MIB, read_p50=50 * MIB), ("belowThreshold", "threshold")),  # the other side has over 5 % of the bytes
    (join(), dict(read_max=99 * MIB, read_p50=50 * MIB, data_tail=True), ("belowThreshold", "both")),
    (join(left="=HashAggregate"), BIG, ("planShape", "left: HashAggregate")),
    (join(right="=Scan parquet t"), BIG, ("planShape", "right: Scan parquet t")),
    (join(left="REPARTITION_BY_COL"), BIG, ("userRepartition", "repartition")),
    (join(right="REBALANCE_PARTITIONS_BY_NONE"), BIG, ("userRepartition", "rebalance")),
    (join(type_="FullOuter"), BIG, ("joinType", "FullOuter")),
    (join(type_="LeftOuter"), BIG, ("joinType", "LeftOuter, left only")),
    (join(type_="RightOuter", above=[AGG]), BIG, ("joinType", "RightOuter, right only, aggregate")),
    (join(), dict(read_max=256 * MIB, read_p50=10 * MIB), ("belowThreshold", "threshold")),
    (join(), dict(read_max=400 * MIB, read_p50=80 * MIB), ("belowThreshold", "factor")),
    (join(), dict(read_max=401 * MIB, read_p50=80 * MIB), ("notSplit", None)),
    (join(above=[AGG]), BIG, ("extraShuffle", "aggregate")),
    (join(above=[("Window", "Window [a#1]")]), BIG, ("extraShuffle", "window")),
    (join(above=[PARTIAL]), BIG, ("notSplit", None)),
    (join(above=[AGG, ("Exchange", "Exchange hashpartitioning(a#1, 200)")]), BIG, ("notSplit", None)),
    (join(read="coalesced"), dict(read_max=128 * MIB, read_p50=1), ("belowThreshold", "threshold")),
    (join(root="AdaptiveSparkPlan isFinalPlan=false"), BIG, None),
    (join("BroadcastHashJoin"), BIG, None),
]


def test_cases(spark):
    stages = spark.createDataFrame([("a", i, 5, s["read_max"], s["read_p50"], 10**9, s.get("data_tail", False)) for i, (_, s, _) in enumerate(CASES, 1)], STAGE)
    got = {r.execution_id: (r["case"], r.detail) for r in S.skew_join_cases(*plan(spark, *[rows for rows, _, _ in CASES]), stages, settings(spark, *[()] * len(CASES))).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(CASES, 1) if want is not None}


def test_unclear_read_and_force(spark):
    stages = spark.createDataFrame([("a", i, 5, 500 * MIB, 50 * MIB, 10**9, False) for i in (1, 2, 3)], STAGE)
    p = plan(spark, join(read="coalesced"), join(read="coalesced"), join(above=[AGG]))
    set_ = ((S.ADVISORY, "250m"),), ((S.ADVISORY, "249m"),), ((S.FORCE, "true"),)
    assert {r.execution_id: r["case"] for r in S.skew_join_cases(*p, stages, settings(spark, *set_)).collect()} == {2: "notSplit", 3: "notSplit"}
    old = S.skew_join_cases(*p, stages.filter("execution_id = 3"), settings(spark, *set_, version="3.2.0")).collect()  # that version doesn't know it
    assert [(r["case"], r.can_force) for r in old] == [("extraShuffle", False)]


LEVERS = [
    (200, 200 * 128 * MIB, (), ("sufficient", "property", 200)), (200, 200 * 128 * MIB + 1, (), ("raise", "property", 200)), (50, 200 * 128 * MIB, (), ("aqeCoalesced", "aqeCoalesced", 200)), (50, 200 * 128 * MIB, ((S.COALESCE, "false"),), ("ownPartitioning", "ownPartitioning", 200)),
    (50, 201 * 128 * MIB, ((S.AQE, "false"),), ("raise", "ownPartitioning", 200)), (400, 10 * GIB * 10, (), ("raise", "aqeAdjusted", 200)), (30, 40 * GIB, ((S.INITIAL, "30"),), ("raise", "property", 30)), (30, 40 * GIB, ((S.PARTITIONS, "many"),), ("raise", "property", None)),
]


def test_levers(spark):
    n = len(LEVERS)
    nodes, _, links = plan(spark, *[join()] * n, [("0", "AdaptiveSparkPlan", FINAL, {}, []), ("0.0", "Exchange", "Exchange x, REPARTITION_BY_NUM", {}, [3, 7])])
    rows = [("a", i, 7, tasks, read) for i, (tasks, read, _, _) in enumerate(LEVERS, 1)] + [("a", n + 1, 7, 50, 40 * GIB), ("a", None, 8, 50, 40 * GIB)]
    stages = spark.createDataFrame(rows, "app_id string, execution_id long, stage_id long, tasks long, shuffle_read long")
    got = {r.execution_id: r for r in S.partition_levers(stages, nodes, links, settings(spark, *[set_ for _, _, set_, _ in LEVERS], ())).collect()}
    assert len(got) == len(rows)
    for i, (*_, want) in enumerate(LEVERS, 1):
        assert (got[i].partitions, got[i].lever, got[i]["count"]) == want
    assert [(got[i].partitions, got[i].lever, got[i].asked) for i in (n + 1, None)] == [("ownPartitioning", "ownPartitioning", True), ("raise", "ownPartitioning", False)]


BROADCASTS = [
    ("Inner", 5 * MIB, 50 * MIB, (), ("notLimiting", "left", 5 * MIB)), ("LeftOuter", 5 * MIB, 50 * MIB, (), None), ("LeftOuter", 50 * MIB, 5 * MIB, (), ("notLimiting", "right", 5 * MIB)), ("RightOuter", 5 * MIB, 50 * MIB, (), ("notLimiting", "left", 5 * MIB)), ("FullOuter", 5 * MIB, 50 * MIB, (), None),
    ("Inner", 50 * MIB, GIB, ((D.AUTO_BROADCAST, "100MB"),), ("notLimiting", "left", 50 * MIB)), ("Inner", 10 * MIB, GIB, ((D.AUTO_BROADCAST, "5MB"),), None), ("Inner", 10 * MIB - 1, GIB, ((D.AUTO_BROADCAST, "5MB"),), ("limits", "left", 10 * MIB - 1)),
    ("Inner", 50 * MIB, 10 * GIB, (), None), ("Inner", 50 * MIB, 10 * GIB + 1, (), ("limits", "left", 50 * MIB)), ("Inner", MIB, GIB, (), ("notLimiting", "left", MIB)), ("Inner", MIB - 1, GIB, (), None), ("Inner", 5 * MIB, GIB, ((D.AUTO_BROADCAST, "-1"),), ("disabled", "left", 5 * MIB)),
    ("Inner", 50 * MIB, GIB, ((D.ADAPTIVE_BROADCAST, "64m"),), ("notLimiting", "left", 50 * MIB)), ("Inner", 2 * GIB, 3 * GIB, ((D.AUTO_BROADCAST, "9g"),), None),
]


def test_missed_broadcasts(spark):
    nodes, metrics, _ = plan(spark, *[join(type_=t, sides=(left / MIB, right / MIB)) for t, left, right, _, _ in BROADCASTS])
    got = {r.execution_id: (r.rule, r.build_side, int(r.value)) for r in D.missed_broadcasts(nodes, metrics, settings(spark, *[set_ for *_, set_, _ in BROADCASTS])).collect()}
    assert got == {i: want for i, (*_, want) in enumerate(BROADCASTS, 1) if want is not None}


def test_reader_of_both_sides(spark):
    rows = [(p, n, d, m, [5] if n == "SortMergeJoin" else [3 + int(p[4]), 5] if n == "Exchange" else []) for p, n, d, m, _ in join(sides=(5, 50))]
    nodes, metrics, links = plan(spark, rows)
    assert [(r.path, r.stage_id) for r in D.join_readers(D.missed_broadcasts(nodes, metrics), links).collect()] == [("0.0", 5)]
    assert not D.join_readers(D.missed_broadcasts(nodes, metrics), links.filter("stage_id <> 4")).collect()
