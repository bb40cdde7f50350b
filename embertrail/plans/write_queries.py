"""Registered queries of what executions wrote, over executions made from the orders: each names its own target and figures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import writes as W

#: Executions of a run come in eights, by what they do (k): a path, a Hive table, a JDBC table, a Delta merge, its scan, two executions of a merge through the API, a V2 table.
EXECUTIONS_SQL = """SELECT 'app-' || CAST(CAST(floor(o_orderkey / 64.0) AS BIGINT) % 4 AS STRING) AS app_id, o_orderkey AS execution_id, CASE WHEN o_orderkey % 8 = 4 THEN o_orderkey - 1 ELSE o_orderkey END AS root_execution_id, o_orderkey % 8 AS k,
 CAST(floor(o_orderkey / 8.0) AS BIGINT) AS block, CAST(o_custkey AS STRING) AS c, o_orderstatus AS s, CAST(floor(o_totalprice) AS BIGINT) AS b, CASE WHEN o_custkey % 7 > 0 THEN o_orderkey * 1000 END AS start_ms,
 CASE WHEN o_orderkey % 8 = 5 THEN 'MERGE operation - scanning files for matches' WHEN o_orderkey % 8 = 6 AND o_custkey % 5 > 0 THEN 'Delta: MERGE operation - writing new files' WHEN o_orderkey % 8 = 6 THEN 'MERGE operation - collecting source' ELSE 'save' END AS description FROM {orders}"""
NODES_SQL = """SELECT app_id, execution_id, '0' AS path, CASE k WHEN 0 THEN 'Execute InsertIntoHadoopFsRelationCommand' WHEN 1 THEN 'Execute InsertIntoHiveTable' WHEN 2 THEN 'Execute SaveIntoDataSourceCommand' WHEN 3 THEN 'Execute MergeIntoCommand' WHEN 7 THEN 'AtomicCreateTableAsSelect' ELSE 'Scan parquet' END AS name,
 CASE k WHEN 0 THEN 'Execute InsertIntoHadoopFsRelationCommand s3://lake/' || s || '/c' || c || CASE WHEN s = 'P' THEN '... 3 more fields' ELSE ', [dt=' || c || '], false, Parquet, [a, b], Append' END WHEN 1 THEN 'Execute InsertIntoHiveTable `db`.`t' || c || '`, org.Serde, [x=(1, 2)], true'
 WHEN 2 THEN 'Execute SaveIntoDataSourceCommand org.Provider@1a, Map(url -> jdbc:x, dbtable -> s' || s || '.t' || c || '), Append' WHEN 3 THEN 'Execute MergeIntoCommand' WHEN 7 THEN 'AtomicCreateTableAsSelect org.Catalog@1f2e, ' || CASE WHEN s = 'F' THEN 'main.' ELSE '' END || 'ns.t' || c || ', Project [a#1, b#2], x'
 ELSE 'Delta Table State #0 - file:/lake/m' || CAST(block AS STRING) || '/_delta_log[a#1]' END AS detail FROM {e}"""
METRICS_SQL = """SELECT app_id, execution_id, '0' AS path, 'number of inserted rows' AS metric, CAST(b AS DOUBLE) AS value FROM {e} WHERE k = 3 UNION ALL SELECT app_id, execution_id, '0', 'number of updated rows', 10.0D FROM {e} WHERE k = 3
 UNION ALL SELECT app_id, execution_id, '0', 'number of rows copied', 5.0D FROM {e} WHERE k = 3 AND s <> 'O' UNION ALL SELECT app_id, execution_id, '0', 'number of output rows', CAST(b AS DOUBLE) FROM {e} WHERE k = 1"""
TEXTS_SQL = """SELECT app_id, execution_id, CASE WHEN k = 3 THEN '== Physical Plan ==\\nExecute MergeIntoCommand (1)\\n\\n(2) MergeIntoCommand\\nArguments: `spark_catalog`.`db`.`m' || c || '`, x\\n' WHEN k = 1 THEN '== Physical Plan ==\\nSort (3)\\n\\n(4) Exchange\\nInput [' || c || ']: [a#1]\\nArguments: hashpartitioning(a#1, 200), [plan_id=' || CAST(block AS STRING) || ']\\n' END AS description FROM {e}"""
STAGES_SQL = "SELECT app_id, execution_id, b AS output_bytes, execution_id % 100 AS output_records FROM {e} WHERE k IN (0, 1, 2, 7) AND s <> 'F'"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
_E = "WITH e AS (" + EXECUTIONS_SQL.format(orders="orders") + ") "


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    e = spark.sql(EXECUTIONS_SQL, orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))
    out = {k: spark.sql(sql, e=e) for k, sql in (("nodes", NODES_SQL), ("metrics", METRICS_SQL), ("texts", TEXTS_SQL), ("stages", STAGES_SQL))}
    return out | {"executions": e.select("app_id", "execution_id", "root_execution_id", "description", "start_ms"), "parts": W.plan_description_parts(out["texts"].filter("execution_id % 16 < 8"))}


def _add(name: str, f: Callable[[dict[str, DataFrame]], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: f(tables(spark, sf_dir))
    ORACLE_SQL[name] = _E + sql


_COMMANDS = "CASE k WHEN 0 THEN 'InsertIntoHadoopFsRelationCommand' WHEN 1 THEN 'InsertIntoHiveTable' WHEN 2 THEN 'SaveIntoDataSourceCommand' WHEN 3 THEN 'MergeIntoCommand' ELSE 'AtomicCreateTableAsSelect' END"
#: A merge is named by its plan text in every other eight, else by its one scan, if that is in the same run.
_SCANNED = "EXISTS (SELECT 1 FROM e AS x WHERE x.app_id = e.app_id AND x.execution_id = e.execution_id + 1)"
_TARGETS = f"""SELECT app_id, execution_id, {_COMMANDS} AS command, CASE WHEN k = 0 AND s = 'P' THEN NULL WHEN k = 0 THEN 'path' WHEN k = 1 THEN 'table' WHEN k = 2 THEN 'jdbcTable' WHEN k = 3 AND execution_id % 16 < 8 THEN 'table' WHEN k = 3 AND {_SCANNED} THEN 'path' WHEN k = 7 AND s = 'F' THEN 'table' WHEN k = 7 THEN 'unqualifiedTable' END AS kind,
 CASE WHEN k = 0 AND s = 'P' THEN NULL WHEN k = 0 THEN 's3://lake/' || s || '/c' || c WHEN k = 1 THEN 'db.t' || c WHEN k = 2 THEN 's' || s || '.t' || c WHEN k = 3 AND execution_id % 16 < 8 THEN 'db.m' || c WHEN k = 3 AND {_SCANNED} THEN 'file:///lake/m' || CAST(block AS VARCHAR) WHEN k = 7 AND s = 'F' THEN 'main.ns.t' || c WHEN k = 7 THEN 'ns.t' || c END AS target FROM e WHERE k IN (0, 1, 2, 3, 7)"""

_add("p19_write_targets", lambda t: W.write_targets(t["nodes"], t["executions"], t["parts"]).select("app_id", "execution_id", "command", "kind", "target"), _TARGETS)
_add("p20_api_merges", lambda t: W.api_merges(t["executions"], t["nodes"]).select("app_id", "execution_id", "kind", "target", "raw"), """SELECT app_id, execution_id, CASE WHEN why IS NULL THEN 'path' END AS kind, CASE WHEN why IS NULL THEN 'file:///lake/m' || CAST(block AS VARCHAR) END AS target, 'merge through the API in ' || CAST(execution_id AS VARCHAR) || CASE WHEN n > 1 THEN ' to ' || CAST(execution_id + n - 1 AS VARCHAR) ELSE '' END || CASE WHEN why IS NULL THEN '' ELSE ': ' || why END AS raw
 FROM (SELECT app_id, block, min(execution_id) AS execution_id, count(*) AS n, CASE WHEN count(start_ms) < count(*) THEN 'no start time' WHEN NOT bool_or(description LIKE '%writing%') THEN 'nothing written' END AS why FROM e WHERE k IN (5, 6) GROUP BY app_id, block)""")
_add("p21_write_figures", lambda t: W.write_figures(W.write_targets(t["nodes"], t["executions"], t["parts"]), t["metrics"], t["stages"], t["executions"]).select("app_id", "execution_id", "output_rows", "rows_source", "output_bytes", "inserted", "copied"), """SELECT app_id, execution_id, CASE WHEN k = 3 AND s <> 'O' THEN b + 15.0 WHEN k = 3 THEN NULL WHEN k = 1 THEN b WHEN s <> 'F' THEN execution_id % 100 END::DOUBLE AS output_rows,
 CASE WHEN k = 3 THEN CASE WHEN s <> 'O' THEN 'commandMetric' END WHEN k = 1 THEN 'nodeMetric' WHEN s <> 'F' THEN 'stageSum' END AS rows_source, CASE WHEN k <> 3 AND s <> 'F' THEN b END::DOUBLE AS output_bytes, CASE WHEN k = 3 THEN b END::DOUBLE AS inserted, CASE WHEN k = 3 AND s <> 'O' THEN 5 END::DOUBLE AS copied FROM e WHERE k IN (0, 1, 2, 3, 7)""")
_add("t25_plan_description_parts", lambda t: W.plan_description_parts(t["texts"]).selectExpr("app_id", "execution_id", "command", "args", "array_join(transform(map_entries(exchange_columns), x -> x.key || ':' || x.value), ',') AS columns"), "SELECT app_id, execution_id, CASE WHEN k = 3 THEN 'MergeIntoCommand' END AS command, CASE WHEN k = 3 THEN '`spark_catalog`.`db`.`m' || c || '`, x' END AS args, CASE WHEN k = 1 THEN CAST(block AS VARCHAR) || ':' || c ELSE '' END AS columns FROM e")
