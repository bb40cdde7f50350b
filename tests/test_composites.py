from __future__ import annotations

from embertrail.plans import composites as C

NODE = "app_id string, execution_id long, path string, name string, detail string"
METRIC = "app_id string, execution_id long, path string, metric string, value double"


def scan(e, path, table):
    return (e, path, f"Scan parquet {table}", "FileScan")


def frames(spark, nodes, metrics=()):
    return spark.createDataFrame([("a", *n) for n in nodes], NODE), spark.createDataFrame([("a", *m) for m in metrics], METRIC)


def inner(e, at, build="BuildRight", equal="x#1 = y#2"):
    return [(e, at, "BroadcastHashJoin", f"BroadcastHashJoin [x#{e}], [y#{e + 5}L], Inner, {build}, ({equal}) [codegen id : {e}]"), scan(e, f"{at}.0", "t"), scan(e, f"{at}.1", "u")]


def outer(e, at="0"):
    return [(e, at, "SortMergeJoin", f"SortMergeJoin [k#{e}], [j#9], Inner, plan_id={e}"), *inner(e, f"{at}.0"), scan(e, f"{at}.1", "v")]


def run(spark, nodes, metrics=()):
    n, m = frames(spark, nodes, metrics)
    found, inside = C.caching_composites(C.composites(n, m))
    rows = sorted((r.operator, r.relations, r.executions, r.bytes) for r in found.collect())
    return rows, sorted((r.relation, r.executions) for r in C.uncovered_relations(n, inside).collect())


def test_equal_composites(spark):
    nodes = inner(1, "0") + inner(2, "0", "BuildLeft", "y#8 = x#9") + [scan(3, "0", "t"), scan(4, "0", "t")]
    rows = [(e, p, "size of files read", 10.0) for e in (1, 2) for p in ("0.0", "0.1")]
    assert run(spark, nodes, rows) == ([("join", "parquet:t,parquet:u", 2, 40.0)], [("parquet:t", 2)])
    assert run(spark, inner(1, "0") + inner(2, "0", equal="x#1 = z#2")) == ([], [("parquet:t", 2), ("parquet:u", 2)])


def test_a_composite_above_covers(spark):
    whole = ("join", "parquet:t,parquet:u,parquet:v", 2, 0.0)
    assert run(spark, outer(1) + outer(2)) == ([whole], [])
    assert run(spark, outer(1) + outer(2) + inner(3, "0")) == ([whole], [])  # one left over is too few
    assert run(spark, outer(1) + outer(2) + inner(3, "0") + inner(4, "0"))[0] == [("join", "parquet:t,parquet:u", 2, 0.0), whole]
    twice = [(1, "0", "Union", "Union"), *inner(1, "0.0"), *inner(1, "0.1")]
    assert run(spark, twice) == ([], [])
    assert run(spark, [])[0] == []


def test_nested_loop_rows(spark):
    nodes = [
        (1, "0", "BroadcastNestedLoopJoin", "BroadcastNestedLoopJoin BuildRight, LeftOuter, (a#1 < b#2L)"), (1, "0.0", "WholeStageCodegen (1)", ""), (1, "0.0.0", "Project", ""), (1, "0.0.0.0", "Filter", ""), (1, "0.0.0.0.0", "Scan", ""), (1, "0.1", "BroadcastExchange", ""), (1, "0.1.0", "Expand", ""), (1, "0.1.0.0", "Scan", ""),
        (2, "0", "CartesianProduct", "CartesianProduct"), (2, "0.0", "Sort", ""), (2, "0.1", "Scan", None), (3, "0", "BroadcastNestedLoopJoin", None),
    ]
    rows = [(1, "0", 9.0), (1, "0.0.0.0", 4.0), (1, "0.0.0.0.0", 7.0), (1, "0.1.0.0", 3.0), (2, "0.1", 5.0)]
    n, m = frames(spark, nodes, [(e, p, "number of output rows", v) for e, p, v in rows])
    got = {r.execution_id: (r.operator[:4], r.type, r.condition, r.out, r.left, r.right) for r in C.nested_loop_rows(n, m).collect()}
    assert got == {1: ("Broa", "LeftOuter", "(a < b)", 9.0, 4.0, None), 2: ("Cart", "Inner", None, None, None, 5.0), 3: ("Broa", None, None, None, None, None)}
