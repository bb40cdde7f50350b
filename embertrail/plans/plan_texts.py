"""Plan JSON, settings, stages and links made from the orders: each order is an execution with a join, shaped by its columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import written
from ..operators import config as C
from . import nodes as N

#: Executions and the numbers that shape them, from the orders; any table with these columns does.
ORDERS_SQL = "SELECT 'app-' || CAST(o_orderkey % 4 AS STRING) AS app_id, o_orderkey AS execution_id, CAST(floor(o_orderkey / 4.0) AS BIGINT) % 50 + 1 AS stage_id, o_custkey AS a, CAST(floor(o_totalprice) AS BIGINT) AS b, CAST(floor(o_totalprice / 7.0) AS BIGINT) + o_custkey AS c, CAST(floor(o_orderkey / 4.0) AS BIGINT) AS m FROM {orders}"
#: The same for stages, each an execution of its own.
STAGES_OF_RUNS_SQL = "SELECT app_id, stage_id AS execution_id, stage_id, stage_id * 7 + n AS a, stage_id * 13 + n * 5 AS b, stage_id * 3 + n AS c, stage_id + n AS m FROM (SELECT app_id, stage_id, CAST(substr(app_id, 5) AS BIGINT) AS n FROM {windows}) AS w"
#: The shape of each execution; the same text runs in other engines. k: stage links; jt: join type; li, ri: inputs; up: what stands above; lb, rb: bytes that the sides wrote; ld, rd: their data sizes.
SHAPES_SQL = """SELECT app_id, execution_id, stage_id, a % 4 AS k, a % 9 AS jt, b % 5 AS jn, b % 13 = 0 AS marked, a % 11 > 0 AS final, m % 8 AS li, a % 6 AS ri, b % 7 = 0 AS merged, b % 3 > 0 AS resized, b % 17 = 0 AS skewed, a % 3 AS parts, c % 6 AS up, c % 7 = 0 AS data_tail,
 (b % 1000 + 1) * 16777216 AS lb, CASE WHEN a % 3 = 0 THEN (b % 1000 + 1) * 16777216 ELSE 4194304 END AS rb, CASE c % 5 WHEN 0 THEN 60000000 WHEN 1 THEN 100000000 WHEN 2 THEN 200000000 WHEN 3 THEN 400000000 ELSE 2000000000 END AS read_max, CASE WHEN b % 29 = 0 THEN 0 ELSE 50000000 END AS read_p50,
 (b % 1000 + 1) * 16777216 * CASE WHEN b % 41 < 3 THEN 64 ELSE 1 END AS ld, CASE WHEN a % 3 = 0 THEN (b % 1000 + 1) * 16777216 WHEN b % 4 = 0 THEN 4194304 WHEN b % 4 = 1 THEN 10485760 WHEN b % 4 = 2 THEN 83886080 ELSE 536870912 END AS rd,
 CASE WHEN b % 19 = 0 THEN '64MB' END AS threshold_set, CASE WHEN b % 11 = 0 THEN 'true' END AS force_set, CASE WHEN b % 31 = 0 THEN '30' END AS initial_set, CASE WHEN c % 37 = 0 THEN '-1' WHEN c % 37 < 6 THEN '100MB' END AS auto_set, CASE WHEN c % 23 = 0 THEN '1g' END AS adaptive_set,
 CASE c % 4 WHEN 0 THEN 200 WHEN 1 THEN 50 WHEN 2 THEN 400 ELSE 30 END AS tasks FROM {source}"""
#: Versions of the runs; the last one is unknown. Each run sets what its version has no default for.
VERSIONS = ("2.4.8", "3.1.2", "3.5.0", None)
PROPERTIES = (("app-0", "spark.sql.adaptive.enabled", "true"), ("app-1", "spark.sql.adaptive.enabled", "true"), ("app-1", "spark.sql.shuffle.partitions", "100"), ("app-2", "spark.sql.shuffle.partitions", "lots"))
JOIN_TYPES = ("", "Inner", "Cross", "LeftOuter", "RightOuter", "FullOuter", "LeftSemi", "LeftAnti", "ExistenceJoin")


def _node(name: str, detail: str, *children: str, metrics: tuple[tuple[str, int], ...] = ()) -> str:
    """SQL for the JSON of a node; name and detail are SQL, metrics (name, slot) have the slot in their accumulator's id."""
    made = " || ',' || ".join(f"'{{{{\"name\":\"{m}\",\"accumulatorId\":' || CAST(execution_id * 8 + {i} AS STRING) || ',\"metricType\":\"size\"}}}}'" for m, i in metrics)
    return f"'{{{{\"nodeName\":\"' || {name} || '\",\"simpleString\":\"' || {detail} || '\",\"children\":[' || {' || chr(44) || '.join(children) or repr('')} || '],\"metrics\":[' || {made or repr('')} || ']}}}}'"


def _choice(by: str, *texts: str) -> str:
    return f"CASE {by} " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(texts[:-1])) + f" ELSE {texts[-1]} END"


def _shuffle(origin: str, slot: int) -> str:
    return _node("'ShuffleQueryStage'", "'ShuffleQueryStage 0'", _node("'Exchange'", f"'Exchange hashpartitioning(a#1, 200), ' || {origin} || ', [plan_id=' || CAST(execution_id AS STRING) || ']'", _node("'Scan parquet t'", "'FileScan parquet t[a#1]'"), metrics=(("shuffle bytes written", slot), ("data size", slot + 4))))


_ORIGIN = _choice("li - 5", "'REPARTITION_BY_NUM'", "'REBALANCE_PARTITIONS_BY_NONE'", "'ENSURE_REQUIREMENTS'")
_LEFT = f"CASE WHEN li = 7 THEN {_node(repr('HashAggregate'), repr('HashAggregate(keys=[a#1], functions=[])'), _shuffle('\'ENSURE_REQUIREMENTS\'', 1))} ELSE {_shuffle(_ORIGIN, 1)} END"
_READ = f"CASE WHEN resized THEN {_node(repr('AQEShuffleRead'), 'CASE WHEN merged THEN \'AQEShuffleRead coalesced\' ELSE \'AQEShuffleRead\' END', _LEFT)} ELSE {_LEFT} END"
_RIGHT = f"CASE WHEN ri = 5 THEN {_node(repr('Scan parquet u'), repr('FileScan parquet u[b#2]'))} WHEN skewed THEN {_node(repr('AQEShuffleRead'), repr('AQEShuffleRead skewed'), _shuffle('\'ENSURE_REQUIREMENTS\'', 2), metrics=(('number of skewed partitions', 3), ('number of skewed partition splits', 4)))} ELSE {_shuffle('\'ENSURE_REQUIREMENTS\'', 2)} END"
_NAME = _choice("jn", "'ShuffledHashJoin'", "'BroadcastHashJoin'", "'SortMergeJoin'") + " || CASE WHEN marked AND jn <> 1 THEN '(skew=true)' ELSE '' END"
_TYPE = _choice("jt", *[f"'{t}'" for t in JOIN_TYPES])
_JOIN = _node(f"({_NAME})", f"'Join [a#1], [b#2]' || CASE WHEN jt = 0 THEN '' ELSE ', ' || {_TYPE} END", _node("'Sort'", "'Sort [a#1 ASC]'", _READ), _node("'WholeStageCodegen (3)'", "'WholeStageCodegen (3)'", _node("'Sort'", "'Sort [b#2 ASC]'", _RIGHT)))
_ABOVE = f"CASE up WHEN 1 THEN {_node(repr('HashAggregate'), repr('HashAggregate(keys=[a#1], functions=[sum(b#2)])'), 'j')} WHEN 2 THEN {_node(repr('HashAggregate'), repr('HashAggregate(keys=[a#1], functions=[partial_sum(b#2)])'), 'j')} WHEN 3 THEN {_node(repr('Window'), repr('Window [a#1]'), 'j')} WHEN 4 THEN {_node(repr('SortMergeJoin'), repr('SortMergeJoin [a#1], [z#9], Inner'), 'j', _node(repr('Scan parquet z'), repr('FileScan parquet z[z#9]')))} WHEN 5 THEN {_node(repr('HashAggregate'), repr('HashAggregate(keys=[a#1], functions=[sum(b#2)])'), _node(repr('Exchange'), repr('Exchange hashpartitioning(a#1, 200), ENSURE_REQUIREMENTS'), 'j'))} ELSE {_node(repr('Project'), repr('Project [a#1]'), 'j')} END"
PLANS_SQL = f"SELECT app_id AS log, execution_id, {_node(_choice('CAST(final AS INT)', repr('Project'), repr('AdaptiveSparkPlan')), repr('AdaptiveSparkPlan isFinalPlan=true'), 'p')} AS plan FROM (SELECT *, {_ABOVE} AS p FROM (SELECT *, {_JOIN} AS j FROM {{shapes}}))"
#: Depth of the join: the adaptive root, what stands above it, with up = 5 also an exchange.
_AT = "CASE WHEN up = 5 THEN '0.0.0.0' ELSE '0.0.0' END"
LINKS_SQL = f"""SELECT app_id, execution_id, {_AT} AS path, stage_id FROM {{shapes}} WHERE k = 0 UNION ALL SELECT app_id, execution_id, {_AT} || '.0.0' || CASE WHEN resized THEN '.0' ELSE '' END || CASE WHEN li = 7 THEN '.0' ELSE '' END || '.0' AS path, stage_id - s AS stage_id FROM {{shapes}}, (SELECT explode(array(0, 1)) AS s) WHERE k = 1
 UNION ALL SELECT app_id, execution_id, {_AT} || '.1.0.0' || CASE WHEN skewed THEN '.0' ELSE '' END || '.0' AS path, stage_id - s AS stage_id FROM {{shapes}}, (SELECT explode(array(0, 1)) AS s) WHERE k = 1 AND ri < 5"""
METRICS_SQL = "SELECT app_id AS log, execution_id * 8 + slot AS acc_id, CAST(CASE slot WHEN 1 THEN lb WHEN 2 THEN rb WHEN 3 THEN parts WHEN 4 THEN parts * 4 WHEN 5 THEN ld ELSE rd END AS DOUBLE) AS value, 'executor' AS side FROM {shapes}, (SELECT explode(array(1, 2, 3, 4, 5, 6)) AS slot)"
STAGES_SQL = "SELECT app_id, execution_id, stage_id, CAST(read_max AS BIGINT) AS read_max, CAST(read_p50 AS BIGINT) AS read_p50, CASE WHEN k = 3 THEN 2 * (lb + rb) ELSE lb + rb END AS shuffle_read, data_tail, tasks FROM {shapes}"


#: Settings that an execution changes, by the column of its shape.
CHANGED = {
    "threshold_set": "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "force_set": "spark.sql.adaptive.forceOptimizeSkewedJoin", "initial_set": "spark.sql.adaptive.coalescePartitions.initialPartitionNum",
    "auto_set": "spark.sql.autoBroadcastJoinThreshold", "adaptive_set": "spark.sql.adaptive.autoBroadcastJoinThreshold",
}


def execution_settings(shapes: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Settings of the executions of the shapes, with a column for each of `keys`."""
    spark = shapes.sparkSession
    apps = spark.createDataFrame([(f"app-{i}", v) for i, v in enumerate(VERSIONS)], "app_id string, version string")
    conf = spark.createDataFrame(PROPERTIES, "app_id string, key string, value string")
    over = shapes.select("app_id", "execution_id", F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(c).alias("value")) for c, k in CHANGED.items()])).alias("s")).select("app_id", "execution_id", "s.*").filter("value IS NOT NULL")
    return C.execution_settings(apps, C.effective_conf(apps, conf, over, C.default_settings(spark)), shapes, keys)


def plan_tables(source: DataFrame, keys: tuple[str, ...]) -> dict[str, DataFrame]:
    """shapes, plans with an array of nodes, nodes, metrics, links, stages, and settings with a column for each of `keys`, of the executions in `source`."""
    spark = source.sparkSession
    shapes = spark.sql(SHAPES_SQL, source=source)
    out = {name: spark.sql(sql, shapes=shapes) for name, sql in (("plans", PLANS_SQL), ("links", LINKS_SQL), ("accumulators", METRICS_SQL), ("stages", STAGES_SQL))}
    plans = written(N.plan_arrays(out["plans"]))
    nodes = N.node_rows(plans)
    metrics = N.plan_metrics(nodes, out["accumulators"]).withColumnRenamed("log", "app_id")
    return {"shapes": shapes, "plans": plans.withColumnRenamed("log", "app_id"), "nodes": nodes.drop("metrics").withColumnRenamed("log", "app_id"), "metrics": metrics, "links": out["links"], "stages": out["stages"], "settings": execution_settings(shapes, keys)}


def order_executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Executions of the orders. Their plans are long beside the orders, so few files are dealt out to all cores before the texts are made."""
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return spark.sql(ORDERS_SQL, orders=spark.read.parquet(f"{sf_dir}/orders.parquet")).repartition(parts, "app_id", "execution_id")


def order_plans(spark: SparkSession, sf_dir: str, keys: tuple[str, ...]) -> dict[str, DataFrame]:
    return plan_tables(order_executions(spark, sf_dir), keys)
