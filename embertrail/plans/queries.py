"""Registered plan queries, over plans made from templates by execution: the same tables in SQL for another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import composites as C
from . import detectors as D
from . import nodes as N
from . import skew_queries, write_queries

#: (template, path, name, detail, {metric: value}): values grow with the execution's id.
TEMPLATES = (
    (0, "0", "WriteFiles", "WriteFiles", {"number of written files": 150, "written output": 200_000_000}),
    (0, "0.0", "SortMergeJoin", "SortMergeJoin [a#1, b#2L], [c#3, d#4L], Inner", {"number of output rows": 500_000}),
    (0, "0.0.0", "Exchange", "Exchange hashpartitioning(a#1, b#2L, 200), ENSURE_REQUIREMENTS, [plan_id=7]", {"data size": 50_000_000_000}),
    (0, "0.0.0.0", "Scan parquet sales.orders", "FileScan parquet sales.orders[a#1,b#2L] PartitionFilters: [], DataFilters: [isnotnull(a#1), (b#2L > 5)]", {"number of partitions read": 12, "size of files read": 3_000_000_000, "number of files read": 40}),
    (0, "0.0.1", "Exchange", "Exchange hashpartitioning(c#3, d#4L, 200), ENSURE_REQUIREMENTS, [plan_id=9]", {"data size": 60_000_000}),
    (0, "0.0.1.0", "Scan csv", "FileScan csv [c#3,d#4L] Location: InMemoryFileIndex(1 paths)[file:/data/raw/items], PartitionFilters: [(d#4L = 1)], DataFilters: [(c#3 IN (1,2))]", {"number of files read": 5000, "size of files read": 90_000_000}),
    (0, "0.1", "Scan orc logs", "FileScan orc logs[x#8]", {}),
    (1, "0", "Union", "Union", {}),
    (1, "0.0", "HashAggregate", "HashAggregate(keys=[k#5], functions=[sum(x#6), count(1), max(coalesce(y#7, 0))])", {}),
    (1, "0.0.0", "Exchange", "Exchange rangepartitioning(k#5 ASC NULLS FIRST, 50), ENSURE_REQUIREMENTS", {"data size": 1000}),
    (1, "0.0.0.0", "HashAggregate", "HashAggregate(keys=[k#5], functions=[partial_sum(x#6), partial_count(1)])", {}),
    (1, "0.0.0.0.0", "Scan parquet sales.orders", "FileScan parquet sales.orders[k#5] PartitionFilters: [(p#9 = 3)], DataFilters: [(x#6 > 1)]", {"size of files read": 2_000_000_000, "number of partitions read": 4}),
    (1, "0.1", "HashAggregate", "HashAggregate(keys=[k#5], functions=[sum(x#6)])", {}),
    (1, "0.1.0", "Exchange", "Exchange rangepartitioning(k#5 ASC NULLS FIRST, 50), ENSURE_REQUIREMENTS", {}),
    (1, "0.1.0.0", "HashAggregate", "HashAggregate(keys=[k#5], functions=[partial_sum(x#6)])", {}),
    (1, "0.1.0.0.0", "Scan parquet sales.orders", "FileScan parquet sales.orders[k#5] PartitionFilters: [], DataFilters: []", {}),
    (2, "0", "BatchEvalPython", "BatchEvalPython [f(x#8)]", {"data sent to Python workers": 100_000_000}),
    (2, "0.0", "CartesianProduct", "CartesianProduct", {"number of output rows": 2_000_000}),
    (2, "0.0.0", "BroadcastNestedLoopJoin", "BroadcastNestedLoopJoin BuildRight, Cross", {"number of output rows": 1_500_000}),
    (2, "0.0.0.0", "Scan JDBCRelation(public.users) [numPartitions=1]", "Scan JDBCRelation(public.users) [numPartitions=1] [x#8]", {"number of output rows": 1_400_000}),
    (2, "0.0.0.1", "BroadcastExchange", "BroadcastExchange IdentityBroadcastMode", {"data size": 1_500_000_000}),
    (2, "0.0.1", "Exchange", "Exchange SinglePartition, ENSURE_REQUIREMENTS", {}),
)


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_EXECUTIONS = "SELECT DISTINCT CAST(floor(o_orderkey / 100.0) AS BIGINT) AS execution_id FROM {orders}"
_NODE_ROWS = ", ".join(f"({t}, {_quote(p)}, {_quote(n)}, {_quote(d)})" for t, p, n, d, _ in TEMPLATES)
_METRIC_ROWS = ", ".join(f"({t}, {_quote(p)}, {_quote(m)}, {v})" for t, p, _, _, ms in TEMPLATES for m, v in ms.items())
_APP = "'app-' || CAST(execution_id % 4 AS STRING) AS app_id, execution_id"
NODES_SQL = f"SELECT {_APP}, path, name, detail FROM ({_EXECUTIONS}) AS e JOIN (SELECT * FROM (VALUES {_NODE_ROWS}) AS v(template, path, name, detail)) AS n ON n.template = e.execution_id % 3"
METRICS_SQL = f"SELECT {_APP}, path, metric, CAST(value AS DOUBLE) + execution_id AS value FROM ({_EXECUTIONS}) AS e JOIN (SELECT * FROM (VALUES {_METRIC_ROWS}) AS v(template, path, metric, value)) AS n ON n.template = e.execution_id % 3"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
_KEY = "app_id, execution_id, path"
_WITH = f"WITH nodes AS ({NODES_SQL.format(orders='orders')}), metrics AS ({METRICS_SQL.format(orders='orders')}) "


def tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return spark.sql(NODES_SQL, orders=orders), spark.sql(METRICS_SQL, orders=orders)


def _add(name: str, f: Callable[[DataFrame, DataFrame], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: f(*tables(spark, sf_dir))
    if sql:
        ORACLE_SQL[name] = _WITH + sql


def _metric(name: str) -> str:
    return f"(SELECT {_KEY}, value FROM metrics WHERE metric = '{name}')"


def _finding(type_: str, metric: str, source: str, value: str = "value") -> str:
    band = "warning" if type_ in ("smallFiles", "overBroadcast") else "info"
    return f"SELECT {_KEY}, '{type_}' AS type, '{metric}' AS metric, CAST({value} AS DOUBLE) AS value, '{band}' AS band FROM {source}"


_CLEAN = "regexp_replace({0}, '#[0-9]+L?', '', 'g')"
_SCAN = "name LIKE 'Scan %'"

_add("p1_scan_relations", lambda n, m: N.scan_relations(n), f"""SELECT {_KEY}, CASE WHEN name LIKE '%JDBCRelation(%' THEN 'jdbc' ELSE regexp_extract(name, '^Scan (\\w+)', 1) END AS format,
 CASE WHEN name LIKE '%JDBCRelation(%' THEN regexp_extract(name, 'JDBCRelation\\(([^)\\s]+)\\)', 1) WHEN regexp_matches(name, '^Scan \\w+ [\\w.]+$') THEN regexp_extract(name, '^Scan \\w+ ([\\w.]+)$', 1) ELSE regexp_extract(detail, 'Location: [^\\[]*\\[[^\\]]*/([^/\\]]+)\\]', 1) END AS relation FROM nodes WHERE {_SCAN}""")
_add("p2_scan_filters", lambda n, m: N.scan_filters(n))
_add("p3_join_keys", lambda n, m: N.join_keys(n), f"SELECT {_KEY}, name AS operator, CASE WHEN name = 'SortMergeJoin' THEN 'Inner' WHEN name = 'BroadcastNestedLoopJoin' THEN 'BuildRight' ELSE '' END AS type, CASE WHEN name = 'SortMergeJoin' THEN 'a, b' ELSE '' END AS left_keys, CASE WHEN name = 'SortMergeJoin' THEN 'c, d' ELSE '' END AS right_keys FROM nodes WHERE name LIKE '%Join' OR name = 'CartesianProduct'")
_add("p4_aggregates", lambda n, m: N.aggregates(n), f"SELECT {_KEY}, {_CLEAN.format(chr(39).join(('regexp_extract(detail, ', 'keys=[[]([^]]*)[]]', ', 1)')))} AS keys, {_CLEAN.format(chr(39).join(('regexp_extract(detail, ', 'functions=[[]([^]]*)[]]', ', 1)')))} AS functions FROM nodes WHERE name LIKE '%Aggregate' AND detail NOT LIKE '%[partial_%'")
_add("p5_partitioning", lambda n, m: N.partitioning(n), f"SELECT {_KEY}, CASE WHEN detail LIKE '%hashp%' THEN 'hash' WHEN detail LIKE '%rangep%' THEN 'range' ELSE 'single' END AS kind, {_CLEAN.format(chr(39).join(('regexp_extract(detail, ', 'artitioning[(](.*), [0-9]+[)]', ', 1)')))} AS keys, CASE WHEN detail LIKE '%SinglePartition%' THEN 1 ELSE CAST(regexp_extract(detail, ', ([0-9]+)[)]', 1) AS BIGINT) END AS n FROM nodes WHERE name = 'Exchange'")
_add("p6_plan_summary", lambda n, m: N.plan_summary(n))
_add("p7_subtree_sizes", lambda n, m: N.subtree_shapes(n).drop("fingerprint"), f"SELECT a.app_id, a.execution_id, a.path, count(*) AS size FROM nodes AS a JOIN nodes AS b ON a.app_id = b.app_id AND a.execution_id = b.execution_id AND (b.path = a.path OR starts_with(b.path, a.path || '.')) GROUP BY ALL")
_add("p8_duplicate_subtrees", lambda n, m: N.duplicate_subtrees(N.subtree_shapes(n)).drop("fingerprint"), "SELECT DISTINCT app_id, execution_id, 4 AS size, 2 AS n FROM nodes WHERE execution_id % 3 = 1")
_add("p15_join_side_bytes", lambda n, m: N.join_side_bytes(n, m), "SELECT app_id, execution_id, '0.0' AS path, CAST(substr(path, 5, 1) AS INT) AS side, value AS bytes FROM metrics WHERE metric = 'data size' AND execution_id % 3 = 0 UNION ALL SELECT app_id, execution_id, '0.0.0', 1, value FROM metrics WHERE metric = 'data size' AND execution_id % 3 = 2")
_add("p22_plan_edges", lambda n, m: N.plan_edges(n, m), f"SELECT n.app_id, n.execution_id, regexp_replace(n.path, '\\.[0-9]+$', '') AS parent, n.path AS child, m.value AS shuffle_bytes FROM nodes AS n LEFT JOIN {_metric('data size')} AS m USING (app_id, execution_id, path) WHERE n.path LIKE '%.%'")
_add("t19_split_exchanges", lambda n, m: N.split_exchanges(n).select("app_id", "execution_id", "path", "name", "half"))
#: Scans outside a join or union count; inside one they do where it is in one execution only, as orders then are in one of each kind.
_add("f25_caching_relations", lambda n, m: D.caching_relations(n, m), """SELECT app_id, unnest(CASE WHEN j >= 2 THEN ['orc:logs'] WHEN j = 1 AND u = 1 THEN ['parquet:sales.orders'] END) AS relation, CASE WHEN j >= 2 THEN j ELSE 2 END AS executions
 FROM (SELECT app_id, count(*) FILTER (execution_id % 3 = 0) AS j, count(*) FILTER (execution_id % 3 = 1) AS u FROM (SELECT DISTINCT app_id, execution_id FROM nodes) GROUP BY app_id)""")
_add("f29_nested_loop_joins", lambda n, m: D.nested_loop_joins(n, m), _finding("nestedLoopJoin", "output rows", f"nodes JOIN {_metric('number of output rows')} USING ({_KEY}) WHERE name = 'CartesianProduct' AND value >= 1000000"))
_add("f30_duplicate_plan_subtrees", lambda n, m: D.duplicate_plan_subtrees(n).drop("fingerprint"), "SELECT DISTINCT app_id, execution_id, 4 AS size, 2 AS n FROM nodes WHERE execution_id % 3 = 1")
_add("f31_small_files", lambda n, m: D.small_files(n, m), _finding("smallFiles", "files read", f"{_metric('number of files read')} JOIN (SELECT {_KEY}, value AS b FROM metrics WHERE metric = 'size of files read') USING ({_KEY}) WHERE value > 100 AND b / value < 3145728") + " UNION ALL " + _finding("smallFiles", "files written", f"{_metric('number of written files')} JOIN (SELECT {_KEY}, value AS b FROM metrics WHERE metric = 'written output') USING ({_KEY}) WHERE value > 100 AND b / value < 3145728"))
_add("f32_under_broadcast", lambda n, m: D.under_broadcast(n, m), _finding("underBroadcast", "smaller side bytes", "(SELECT app_id, execution_id, '0.0' AS path, value FROM metrics WHERE metric = 'data size' AND path = '0.0.1' AND execution_id % 3 = 0)"))
_add("f33_over_broadcast", lambda n, m: D.over_broadcast(n, m), _finding("overBroadcast", "broadcast bytes", f"nodes JOIN {_metric('data size')} USING ({_KEY}) WHERE name = 'BroadcastExchange' AND value > 1073741824"))
_add("f34_python_udfs", lambda n, m: D.python_udfs(n, m), _finding("pythonUdf", "bytes sent to Python", f"{_metric('data sent to Python workers')} WHERE value >= 67108864"))
_STAGE_MS = "SELECT 'app-' || CAST(l_orderkey % 4 AS STRING) AS app_id, CAST(floor(l_orderkey / 4.0) AS BIGINT) % 50 AS stage_id, CAST(max(floor(l_extendedprice)) AS BIGINT) AS stage_ms FROM {lineitem} GROUP BY l_orderkey % 4, CAST(floor(l_orderkey / 4.0) AS BIGINT) % 50"


def _f34(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each execution with such a node ran it in the stage of its number modulo 50, and in the next one; the first of each run in none."""
    nodes, metrics = tables(spark, sf_dir)
    links = nodes.filter("name = 'BatchEvalPython' AND execution_id >= 4").selectExpr("app_id", "execution_id", "path", "explode(array(execution_id % 50, (execution_id + 1) % 50)) AS stage_id")
    stages = spark.sql(_STAGE_MS, lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    return D.python_udfs(nodes, metrics, links, stages, least_ms=185_000)


QUERIES["f34_python_udf_stages"] = _f34
ORACLE_SQL["f34_python_udf_stages"] = _WITH + _finding("pythonUdf", "bytes sent to Python", f"{_metric('data sent to Python workers')} AS p WHERE value >= 67108864 AND execution_id >= 4 AND (SELECT sum(stage_ms) FROM ({_STAGE_MS.format(lineitem='lineitem')}) AS s WHERE s.app_id = p.app_id AND s.stage_id IN (p.execution_id % 50, (p.execution_id + 1) % 50)) >= 185000")
_add("f36_unpruned_scans", lambda n, m: D.unpruned_scans(n, m), _finding("unprunedScan", "bytes read", f"{_metric('size of files read')} WHERE path = '0.0.0.0' AND execution_id % 3 = 0 AND value >= 1073741824"))

_CHOSEN = f"""SELECT app_id, execution_id, path, CASE path WHEN '0' THEN 'union' ELSE 'join' END AS operator, CASE execution_id % 3 WHEN 0 THEN 'csv:items,parquet:sales.orders' WHEN 1 THEN 'parquet:sales.orders' ELSE 'jdbc:public.users' END AS relations, coalesce(b, 0) AS bytes
 FROM nodes LEFT JOIN (SELECT app_id, execution_id, sum(value) AS b FROM metrics WHERE metric = 'size of files read' GROUP BY app_id, execution_id) USING (app_id, execution_id) WHERE name IN ('Union', 'SortMergeJoin', 'BroadcastNestedLoopJoin')"""
_add("p9_composites", lambda n, m: C.composites(n, m).selectExpr("app_id", "execution_id", "path", "operator", "array_join(relations, ',') AS relations", "bytes"), _CHOSEN)
_add("f26_caching_composites", lambda n, m: C.caching_composites(C.composites(n, m))[0].drop("fingerprint"), f"SELECT app_id, operator, relations, count(*) AS executions, sum(bytes) AS bytes FROM ({_CHOSEN}) GROUP BY app_id, operator, relations HAVING count(*) >= 2")
_add("p18_nested_loop_rows", lambda n, m: C.nested_loop_rows(n, m), f"SELECT {_KEY}, name AS operator, CASE path WHEN '0.0' THEN 'Inner' ELSE 'Cross' END AS type, CAST(NULL AS VARCHAR) AS condition, value AS out, CASE path WHEN '0.0' THEN 1500000::DOUBLE ELSE 1400000::DOUBLE END + execution_id AS left, CAST(NULL AS DOUBLE) AS right FROM nodes JOIN {_metric('number of output rows')} USING ({_KEY}) WHERE name IN ('CartesianProduct', 'BroadcastNestedLoopJoin')".replace("AS left", 'AS "left"').replace("AS right", 'AS "right"'))

QUERIES |= write_queries.QUERIES | skew_queries.QUERIES
ORACLE_SQL |= write_queries.ORACLE_SQL | skew_queries.ORACLE_SQL
