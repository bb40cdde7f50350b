"""Registered queries of skewed joins, partition levers and missed broadcasts, over plans made from the orders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import detectors as D
from . import nodes as N
from . import plan_texts as T
from . import skew_joins as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _p16(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.order_plans(spark, sf_dir, S.SETTINGS)
    return S.skew_join_cases(t["plans"], t["metrics"], t["links"], t["stages"], t["settings"]).select(*S.EXEC, "stage_id", "path", "case", "detail")


def _p17(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.order_plans(spark, sf_dir, S.SETTINGS)
    return S.partition_levers(t["stages"], t["nodes"], t["links"], t["settings"])


def _f32(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = spark.sql(T.SHAPES_SQL, source=T.order_executions(spark, sf_dir))
    plans = N.plan_arrays(spark.sql(T.PLANS_SQL, shapes=shapes), "SortMergeJoin").withColumnRenamed("log", "app_id")
    missed = D.missed_broadcasts_of(plans, spark.sql(T.METRICS_SQL, shapes=shapes), T.execution_settings(shapes, D.THRESHOLDS))
    return missed.select(*S.EXEC, "path", "rule", "join_type", "build_side", "value", "larger", "setting")


def _t16(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = spark.sql(T.SHAPES_SQL, source=T.order_executions(spark, sf_dir))
    nodes = N.plan_nodes(spark.sql(T.PLANS_SQL, shapes=shapes))
    return nodes.select("log", "execution_id", "path", "name", F.size("metrics").alias("n_metrics"))


def _p11(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = spark.sql(T.SHAPES_SQL, source=T.order_executions(spark, sf_dir))
    plans = N.plan_arrays(spark.sql(T.PLANS_SQL, shapes=shapes)).withColumnRenamed("log", "app_id")
    two = shapes.select("app_id", "execution_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("stage_id"), (F.col("execution_id") * 0).alias("zero")).withColumn("submitted_ms", F.col("stage_id") + F.col("zero"))
    return N.paired_segments(N.plan_segments(plans), two)


QUERIES |= {"t16_plan_nodes": _t16, "p11_segment_stages": _p11}
QUERIES |= {"p16_skew_join_cases": _p16, "p17_partition_levers": _p17, "f32_missed_broadcasts": _f32}

_TYPE = f"CASE jt {' '.join(f'WHEN {i} THEN {chr(39)}{t}{chr(39)}' for i, t in enumerate(T.JOIN_TYPES) if t)} END"


def shaped(source: str, stages: str = "") -> dict[str, str]:
    """The shapes as a table of another engine, with the settings worked out from them: before 3.0 nothing has a default, an unknown version has the latest ones.

    `stages`: a join that brings tasks, read_max, read_p50, data_tail and shuffle_read of stages in place of those of the shape.
    """
    own = "read_max, read_p50, data_tail, tasks, CASE WHEN k = 3 THEN 2 * (lb + rb) ELSE lb + rb END AS shuffle_read" if not stages else "z.read_max, z.read_p50, z.data_tail, z.tasks, z.shuffle_read"
    return {
        "px_shape": T.SHAPES_SQL.replace("{source}", f"({source}) AS source"),
        "px_s": f"""SELECT x.* EXCLUDE (read_max, read_p50, data_tail, tasks), {own}, CASE x.app_id WHEN 'app-0' THEN 204 WHEN 'app-1' THEN 301 WHEN 'app-2' THEN 305 END AS v, CASE WHEN threshold_set IS NOT NULL THEN 67108864 WHEN x.app_id <> 'app-0' THEN 268435456 END AS th, CASE WHEN x.app_id <> 'app-0' THEN 5 END AS fa,
 CASE WHEN x.app_id <> 'app-0' THEN 67108864 END AS ad, coalesce(force_set, CASE WHEN x.app_id IN ('app-2', 'app-3') THEN 'false' END) AS fo, {_TYPE} AS type FROM px_shape AS x {stages}""",
        "px_f": """SELECT *, coalesce(type IN ('Inner', 'Cross', 'LeftOuter', 'LeftSemi', 'LeftAnti'), FALSE) AS le, coalesce(type IN ('Inner', 'Cross', 'RightOuter'), FALSE) AS ri_, merged AND resized AND li < 7 AS me, ri < 5 AND least(lb, rb) <= 0.05 * (lb + rb) AS alone, CASE up WHEN 1 THEN 'aggregate' WHEN 3 THEN 'window' WHEN 4 THEN 'join' END AS above,
 coalesce(v >= 303 OR (v IS NULL AND fo IS NOT NULL), FALSE) AS can FROM px_s WHERE final AND jn <> 1 AND (k = 0 OR (up <> 4 AND (k = 1 OR (k >= 2 AND ri < 5 AND abs(shuffle_read - lb - rb) <= 0.1 * (lb + rb)))))""",
        "px_g": "SELECT *, above IS NOT NULL AND NOT (can AND coalesce(fo, '') = 'true') AS held, read_max <= coalesce(th, -1) AS small, NOT me AND alone AND read_p50 > 0 AND read_max <= coalesce(fa, -1) * read_p50 AS flat FROM px_f",
        "px_h": """SELECT *, CASE WHEN marked OR (skewed AND ri < 5) THEN 'split' WHEN NOT me AND alone AND NOT data_tail AND read_p50 > 0 AND read_max < 2 * read_p50 THEN 'evenReads' WHEN li = 7 OR ri = 5 THEN 'planShape' WHEN li IN (5, 6) THEN 'userRepartition' WHEN type IS NOT NULL AND NOT le AND NOT ri_ THEN 'joinType'
 WHEN small OR flat THEN 'belowThreshold' WHEN me AND read_max <= coalesce(2 * ad, -1) THEN NULL WHEN le <> ri_ THEN 'joinType' WHEN held THEN 'extraShuffle' ELSE 'notSplit' END AS c FROM px_g""",
        "px_cases": """SELECT app_id, execution_id, stage_id, CASE WHEN up = 5 THEN '0.0.0.0' ELSE '0.0.0' END AS path, c AS "case", CASE c WHEN 'split' THEN CASE WHEN skewed AND ri < 5 AND parts > 0 THEN CAST(parts AS VARCHAR) || ' into ' || CAST(parts * 4 AS VARCHAR) END WHEN 'planShape' THEN CASE WHEN li = 7 THEN 'left: HashAggregate' ELSE 'right: Scan parquet u' END
 WHEN 'userRepartition' THEN CASE li WHEN 5 THEN 'repartition' ELSE 'rebalance' END WHEN 'belowThreshold' THEN CASE WHEN small AND flat THEN 'both' WHEN small THEN 'threshold' ELSE 'factor' END WHEN 'extraShuffle' THEN above
 WHEN 'joinType' THEN type || CASE WHEN le THEN ', left only' WHEN ri_ THEN ', right only' ELSE '' END || CASE WHEN (le OR ri_) AND held THEN ', ' || above ELSE '' END END AS detail, can, held FROM px_h WHERE c IS NOT NULL
 UNION ALL SELECT app_id, execution_id, stage_id, '0.0', 'planShape', 'left: BroadcastHashJoin', FALSE, FALSE FROM px_s WHERE final AND jn = 1 AND up = 4 AND k = 1""",
        "px_b": """SELECT *, CASE WHEN k = 1 THEN resized OR (ri < 5 AND skewed) END AS rs, CASE WHEN final THEN skewed AND ri < 5 END AS sp, li IN (5, 6) AS asked, app_id <> 'app-0' AS mg, CASE WHEN app_id <> 'app-0' AND initial_set IS NOT NULL THEN 30 WHEN app_id = 'app-1' THEN 100 WHEN app_id <> 'app-2' THEN 200 END AS n0 FROM px_s""",
        "px_l": """SELECT *, CASE WHEN n0 IS NULL OR tasks = n0 THEN 'property' WHEN mg AND tasks < n0 AND coalesce(rs, TRUE) THEN 'aqeCoalesced' WHEN tasks > n0 AND coalesce(rs, coalesce(sp, TRUE) OR NOT asked) THEN 'aqeAdjusted' ELSE 'ownPartitioning' END AS lever, CAST(ceil(shuffle_read / 134217728.0) AS BIGINT) AS needed FROM px_b""",
        "px_levers": f"""SELECT app_id, execution_id, stage_id, CASE WHEN shuffle_read / CAST(tasks AS DOUBLE) <= 134217728 THEN 'sufficient' WHEN lever = 'aqeCoalesced' THEN 'aqeCoalesced' WHEN lever = 'ownPartitioning' AND NOT coalesce(rs, TRUE) THEN 'ownPartitioning' WHEN n0 >= needed AND lever <> 'aqeAdjusted' THEN 'ownPartitioning' ELSE 'raise' END AS partitions, lever,
 CASE WHEN app_id <> 'app-0' AND initial_set IS NOT NULL THEN '{S.INITIAL}' ELSE '{S.PARTITIONS}' END AS key, CAST(n0 AS BIGINT) AS count, needed, asked FROM px_l""",
    }


_SHAPED = shaped(T.ORDERS_SQL.format(orders="orders"))
_WITH = "WITH " + ", ".join(f"{k} AS ({v})" for k, v in _SHAPED.items()) + " "
ORACLE_SQL["p16_skew_join_cases"] = _WITH + 'SELECT app_id, execution_id, stage_id, path, "case", detail FROM px_cases'
ORACLE_SQL["p17_partition_levers"] = _WITH + "SELECT * FROM px_levers"
ORACLE_SQL["f32_missed_broadcasts"] = _WITH + f""", e AS (SELECT *, CASE WHEN final AND adaptive_set IS NOT NULL THEN 1073741824 WHEN auto_set = '-1' THEN -1 WHEN auto_set = '100MB' THEN 104857600 ELSE 10485760 END AS th2, type IN ('Inner', 'Cross', 'RightOuter') AS bl, type IN ('Inner', 'Cross', 'LeftOuter', 'LeftSemi', 'LeftAnti', 'ExistenceJoin') AS br FROM px_s WHERE jn >= 2 AND NOT marked AND li < 7 AND ri < 5)
, o AS (SELECT *, CASE WHEN bl AND (NOT br OR ld <= rd) THEN 'left' ELSE 'right' END AS side FROM e WHERE bl OR br), w AS (SELECT *, CASE side WHEN 'left' THEN ld ELSE rd END AS build, CASE side WHEN 'left' THEN rd ELSE ld END AS stream FROM o)
SELECT app_id, execution_id, CASE WHEN up = 5 THEN '0.0.0.0' ELSE '0.0.0' END AS path, CASE WHEN th2 < 0 THEN 'disabled' WHEN th2 >= build THEN 'notLimiting' ELSE 'limits' END AS rule, type AS join_type, side AS build_side, CAST(build AS DOUBLE) AS value, CAST(stream AS DOUBLE) AS larger, CASE WHEN final AND adaptive_set IS NOT NULL THEN '{D.ADAPTIVE_BROADCAST}' ELSE '{D.AUTO_BROADCAST}' END AS setting
 FROM w WHERE build BETWEEN 1048576 AND 1073741824 AND build <= stream AND ((th2 >= build) OR build < 10485760 OR (build < 104857600 AND stream > 10737418240) OR (build < 1073741824 AND stream > 322122547200))"""
#: Paths in the shapes: of the join, of what its sides read, of the exchanges there.
_PATHS = """, y AS (SELECT *, CASE WHEN up = 5 THEN '0.0.0.0' ELSE '0.0.0' END AS j FROM px_s), z AS (SELECT *, j || '.0.0' || CASE WHEN resized THEN '.0' ELSE '' END AS l, j || '.1.0.0' || CASE WHEN skewed AND ri < 5 THEN '.0' ELSE '' END AS r FROM y), q AS (SELECT *, l || CASE WHEN li = 7 THEN '.0' ELSE '' END AS lq FROM z) """
_NODE_SQL = (
    ("'0'", "CASE WHEN final THEN 'AdaptiveSparkPlan' ELSE 'Project' END", 0, "TRUE"), ("'0.0'", "CASE up WHEN 1 THEN 'HashAggregate' WHEN 2 THEN 'HashAggregate' WHEN 3 THEN 'Window' WHEN 4 THEN 'SortMergeJoin' WHEN 5 THEN 'HashAggregate' ELSE 'Project' END", 0, "TRUE"),
    ("'0.0.0'", "'Exchange'", 0, "up = 5"), ("'0.0.1'", "'Scan parquet z'", 0, "up = 4"), ("j", "CASE jn WHEN 0 THEN 'ShuffledHashJoin' WHEN 1 THEN 'BroadcastHashJoin' ELSE 'SortMergeJoin' END || CASE WHEN marked AND jn <> 1 THEN '(skew=true)' ELSE '' END", 0, "TRUE"),
    ("j || '.0'", "'Sort'", 0, "TRUE"), ("j || '.1'", "'WholeStageCodegen (3)'", 0, "TRUE"), ("j || '.1.0'", "'Sort'", 0, "TRUE"), ("j || '.0.0'", "'AQEShuffleRead'", 0, "resized"), ("l", "'HashAggregate'", 0, "li = 7"), ("lq", "'ShuffleQueryStage'", 0, "TRUE"), ("lq || '.0'", "'Exchange'", 2, "TRUE"), ("lq || '.0.0'", "'Scan parquet t'", 0, "TRUE"),
    ("j || '.1.0.0'", "'AQEShuffleRead'", 2, "skewed AND ri < 5"), ("r", "'Scan parquet u'", 0, "ri = 5"), ("r", "'ShuffleQueryStage'", 0, "ri < 5"), ("r || '.0'", "'Exchange'", 2, "ri < 5"), ("r || '.0.0'", "'Scan parquet t'", 0, "ri < 5"),
)
ORACLE_SQL["t16_plan_nodes"] = _WITH + _PATHS + " UNION ALL ".join(f"SELECT app_id AS log, execution_id, {p} AS path, {n} AS name, {m} AS n_metrics FROM q WHERE {w}" for p, n, m, w in _NODE_SQL)
#: Two stages: the deepest segments by place get them, the others that of the nearest one with a stage. Each exchange above adds an ordinal for its own write half.
ORACLE_SQL["p11_segment_stages"] = _WITH + _PATHS + """, jj AS (SELECT *, CASE WHEN up = 5 THEN '0.0.0.0' ELSE '' END AS x, CASE WHEN up = 5 THEN '0.0.0.0' || substr(lq, 6) ELSE lq END AS a, CASE WHEN up = 5 THEN '0.0.0.0' || substr(r, 6) ELSE r END AS b FROM q), seg AS (SELECT app_id, execution_id, '0' AS segment, 0 AS d, up = 5 AND ri = 5 AS lone FROM jj UNION ALL SELECT app_id, execution_id, x, 1, FALSE FROM jj WHERE up = 5 UNION ALL SELECT app_id, execution_id, a || '.0.0', CASE WHEN up = 5 THEN 2 ELSE 1 END, FALSE FROM jj UNION ALL SELECT app_id, execution_id, b || '.0.0', CASE WHEN up = 5 THEN 2 ELSE 1 END, FALSE FROM jj WHERE ri < 5)
SELECT app_id, execution_id, segment, CASE WHEN i <= 2 THEN i WHEN lone THEN 2 ELSE 1 END AS stage_id, i > 2 AS inherited FROM (SELECT *, row_number() OVER (PARTITION BY app_id, execution_id ORDER BY d DESC, segment) AS i FROM seg)"""
