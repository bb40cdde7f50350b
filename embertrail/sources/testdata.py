"""Job-log tables derived from the order tables: the same SQL text runs in Spark and in other engines."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Table -> SQL over {lineitem} and the tables before it.
TABLES = {
    "tasks": """
SELECT *, launch_ms + duration_ms AS finish_ms, CAST(floor(duration_ms * 0.9) AS BIGINT) AS run_ms,
       CAST(floor(duration_ms * 0.7) AS BIGINT) * 1000000 AS cpu_ns
FROM (SELECT 'app-' || CAST(l_orderkey % 4 AS STRING) AS app_id,
       CAST(floor(l_orderkey / 4.0) AS BIGINT) % 50 AS stage_id,
       row_number() OVER (PARTITION BY l_orderkey % 4, CAST(floor(l_orderkey / 4.0) AS BIGINT) % 50
           ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS task_id,
       'host-' || CAST(l_suppkey % 10 AS STRING) AS host,
       CAST(l_suppkey % 20 AS STRING) AS executor_id,
       CASE l_linenumber % 5 WHEN 0 THEN 'PROCESS_LOCAL' WHEN 1 THEN 'NODE_LOCAL'
            WHEN 2 THEN 'NO_PREF' WHEN 3 THEN 'RACK_LOCAL' ELSE 'ANY' END AS locality,
       1000000 + (CAST(floor(l_orderkey / 4.0) AS BIGINT) % 50) * 20000 + (l_partkey % 1000) * 10 AS launch_ms,
       CAST(floor(l_extendedprice / 10) AS BIGINT) * CASE WHEN l_partkey % 97 = 0
            OR (CAST(floor(l_orderkey / 4.0) AS BIGINT) % 7 = 0 AND l_partkey % 5 = 0) THEN 20 ELSE 1 END AS duration_ms,
       (l_returnflag = 'R' AND l_partkey % 11 = 0) AS failed,
       (l_partkey % 50 = 0) AS speculative,
       CASE WHEN CAST(floor(l_orderkey / 4.0) AS BIGINT) % 2 = 1
            THEN CAST(floor(l_quantity) AS BIGINT) * 1048576 ELSE 0 END AS shuffle_read,
       CASE WHEN CAST(floor(l_orderkey / 4.0) AS BIGINT) % 2 = 0
            THEN CAST(floor(l_quantity) AS BIGINT) * 524288 ELSE 0 END AS input_bytes,
       CASE WHEN CAST(floor(l_orderkey / 4.0) AS BIGINT) % 2 = 0
            THEN CAST(floor(l_quantity) AS BIGINT) * 262144 ELSE 0 END AS shuffle_write,
       CAST(floor(l_quantity) AS BIGINT) * 1000 AS records_read,
       CASE WHEN CAST(floor(l_orderkey / 4.0) AS BIGINT) % 10 = 9
            THEN CAST(floor(l_quantity) AS BIGINT) * 65536 ELSE 0 END AS output_bytes,
       CASE WHEN CAST(floor(l_orderkey / 4.0) AS BIGINT) % 10 = 9
            THEN CAST(floor(l_quantity) AS BIGINT) * 10 END AS output_records,
       CASE WHEN l_discount >= 0.08 THEN CAST(floor(l_extendedprice) AS BIGINT) * 1024 ELSE 0 END AS mem_spilled,
       CASE WHEN l_discount >= 0.08 THEN CAST(floor(l_extendedprice) AS BIGINT) * 256 ELSE 0 END AS disk_spilled,
       CAST(floor(l_quantity) AS BIGINT) * 3 AS gc_ms,
       CASE WHEN CAST(floor(l_orderkey / 4.0) AS BIGINT) % 2 = 1
            THEN CAST(floor(l_quantity) AS BIGINT) * CASE WHEN l_partkey % 13 = 0 THEN 200 ELSE 2 END ELSE 0 END AS fetch_wait_ms,
       CAST(floor(l_extendedprice) AS BIGINT) * 2048 AS peak_mem
FROM {lineitem}) AS t""",
    "windows": "SELECT app_id, stage_id, min(launch_ms) AS submitted_ms, max(finish_ms) AS completed_ms FROM {tasks} GROUP BY app_id, stage_id",
    "apps": "SELECT app_id, min(submitted_ms) - 5000 AS start_ms, CASE WHEN app_id = 'app-3' THEN NULL ELSE max(completed_ms) + 3000 END AS end_ms FROM {windows} GROUP BY app_id",
    "executors": """
SELECT app_id, executor_id, host, min(launch_ms) - 1000 * CAST(executor_id AS INT) AS added_ms,
       CASE WHEN CAST(executor_id AS INT) % 3 = 0 THEN max(finish_ms) END AS removed_ms, CAST(4 AS BIGINT) AS cores
FROM {tasks} GROUP BY app_id, executor_id, host""",
    "jobs": """
SELECT app_id, CAST(floor(stage_id / 5.0) AS BIGINT) AS job_id, CAST(floor(stage_id / 10.0) AS BIGINT) AS execution_id,
       min(submitted_ms) AS start_ms, max(completed_ms) AS end_ms, (floor(stage_id / 5.0) <> 3) AS succeeded
FROM {windows} GROUP BY app_id, CAST(floor(stage_id / 5.0) AS BIGINT), CAST(floor(stage_id / 10.0) AS BIGINT), (floor(stage_id / 5.0) <> 3)""",
    "attempts": """
SELECT app_id, stage_id, task_id AS task_index, 2 * task_id AS seq, duration_ms, failed, FALSE AS speculative FROM {tasks}
UNION ALL SELECT app_id, stage_id, task_id, 2 * task_id + 1, duration_ms, FALSE, FALSE FROM {tasks} WHERE failed
UNION ALL SELECT app_id, stage_id, task_id, 2 * task_id + 2, duration_ms + 7, FALSE, TRUE FROM {tasks} WHERE task_id % 40 = 0""",
    "stage_attempts": """
SELECT app_id, stage_id, attempt, submitted_ms + 5000 * attempt AS submitted_ms,
       CASE WHEN attempt = 0 AND stage_id % 7 = 3 THEN submitted_ms + 4000 WHEN stage_id = 49 OR (attempt = 0 AND stage_id % 7 = 5) THEN NULL ELSE completed_ms + 9000 END AS completed_ms,
       attempt * 1000000000000 AS submitted_seq,
       CASE WHEN stage_id = 49 OR (attempt = 0 AND stage_id % 7 = 5) THEN NULL ELSE attempt * 1000000000000 + 500000000000 END AS completed_seq,
       CASE WHEN (attempt = 0 AND stage_id % 7 = 3) OR stage_id % 7 = 6 THEN 'an executor was lost' END AS failure
FROM (SELECT *, CAST(0 AS BIGINT) AS attempt FROM {windows} UNION ALL SELECT *, CAST(1 AS BIGINT) AS attempt FROM {windows} WHERE stage_id % 7 IN (3, 5)) AS w""",
    "attempt_tasks": """
SELECT app_id, stage_id, attempt, CASE WHEN task_id % 41 <> 0 THEN task_id END AS task_index, record * 1000000000000 + late * 600000000000 + 10 * task_id + 5 + shift AS seq, failed, speculative,
       duration_ms, run_ms, cpu_ns, gc_ms, mem_spilled, disk_spilled, shuffle_read, shuffle_write, input_bytes, output_bytes, output_records, peak_mem
FROM (SELECT t.*, CAST(CASE WHEN stage_id % 7 IN (3, 5) AND task_id % 3 > 0 THEN 1 ELSE 0 END AS BIGINT) AS attempt, CAST(CASE WHEN stage_id % 7 IN (3, 5) AND task_id % 6 > 0 THEN 1 ELSE 0 END AS BIGINT) AS record
      FROM (SELECT app_id, stage_id, task_id, duration_ms, run_ms, cpu_ns, gc_ms, mem_spilled, disk_spilled, shuffle_read, shuffle_write, input_bytes, output_bytes, output_records, peak_mem,
                   failed, FALSE AS speculative, 0 AS shift, CASE WHEN task_id % 6 = 4 OR task_id % 20 = 5 THEN 1 ELSE 0 END AS late FROM {tasks}
            UNION ALL SELECT app_id, stage_id, task_id, duration_ms, run_ms, cpu_ns, gc_ms, mem_spilled, disk_spilled, shuffle_read, shuffle_write, input_bytes, output_bytes, output_records, peak_mem,
                   FALSE, FALSE, 1, 0 FROM {tasks} WHERE failed
            UNION ALL SELECT app_id, stage_id, task_id, duration_ms, run_ms, cpu_ns, gc_ms, mem_spilled, disk_spilled, shuffle_read, shuffle_write, input_bytes, output_bytes, output_records, peak_mem,
                   task_id % 15 = 0, TRUE, CASE WHEN task_id % 10 = 0 THEN -3 ELSE 2 END, CASE WHEN task_id % 25 = 10 THEN 1 ELSE 0 END FROM {tasks} WHERE task_id % 5 = 0) AS t) AS x""",
}

#: The same tables with stages and executors shaped by their number, so that detectors have cases on both sides of their thresholds.
SHAPED = TABLES | {
    "plain_tasks": TABLES["tasks"],
    "plain_executors": TABLES["executors"].replace("{tasks}", "{plain_tasks}"),
    "tasks": """
SELECT app_id, stage_id, task_id, host, executor_id, locality, launch_ms, duration_ms, failed, speculative, shuffle_read, input_bytes, shuffle_write, records_read, output_bytes, output_records, mem_spilled, disk_spilled,
       CASE WHEN k = 1 THEN CAST(floor(duration_ms * 0.9 * CASE WHEN stage_id % 20 = 1 THEN 0.12 ELSE 0.05 END) AS BIGINT) ELSE gc_ms END AS gc_ms, fetch_wait_ms, peak_mem,
       launch_ms + duration_ms AS finish_ms, CAST(floor(duration_ms * 0.9) AS BIGINT) AS run_ms, CAST(floor(duration_ms * 0.7) AS BIGINT) * 1000000 AS cpu_ns
FROM (SELECT app_id, stage_id, task_id, executor_id, locality, failed, speculative, shuffle_write, output_bytes, output_records, mem_spilled, disk_spilled, gc_ms, fetch_wait_ms, peak_mem, k,
       CASE WHEN k = 2 THEN CASE task_id % 3 WHEN 0 THEN 'host-0' WHEN 1 THEN 'host-1' ELSE 'host-2' END WHEN k = 3 AND task_id % 4 > CASE WHEN stage_id % 20 = 13 THEN 1 ELSE 0 END THEN 'host-0' ELSE host END AS host,
       launch_ms + CASE WHEN k = 4 AND task_id = 0 THEN 900000 ELSE 0 END AS launch_ms,
       CASE k WHEN 2 THEN 3000 + task_id % 7 + CASE WHEN task_id % 3 = 0 THEN stage_id * 200 ELSE 0 END WHEN 3 THEN 4000 + task_id % 7 WHEN 5 THEN 50 + task_id % 400 + CASE WHEN stage_id % 20 = 15 THEN 400 ELSE 0 END
            WHEN 7 THEN 2000 + task_id % 7 + CASE WHEN task_id % 12 = 0 THEN 18000 ELSE 0 END ELSE duration_ms END AS duration_ms,
       CASE WHEN stage_id = 46 THEN 167772160 WHEN k = 6 AND task_id = 0 THEN CASE WHEN stage_id % 20 = 6 THEN 6442450944 ELSE 268435456 END WHEN k = 6 THEN 1048576 WHEN k = 7 THEN 0 ELSE shuffle_read END AS shuffle_read,
       CASE WHEN k = 7 THEN 4194304 * CASE WHEN task_id % 12 = 0 AND stage_id % 20 = 7 THEN 10 ELSE 1 END ELSE input_bytes END AS input_bytes,
       CASE WHEN k = 7 THEN 0 ELSE records_read END AS records_read
      FROM (SELECT *, stage_id % 10 AS k FROM {plain_tasks} WHERE stage_id <> 46 OR task_id < 7) AS t) AS x""",
    "executors": """
SELECT app_id, executor_id, host, CASE WHEN app_id = 'app-1' THEN first_ms + 31000 ELSE added_ms END AS added_ms,
       CASE WHEN app_id = 'app-1' THEN NULL WHEN app_id = 'app-2' AND CAST(executor_id AS INT) % 2 = 0 THEN added_ms + 60000 ELSE removed_ms END AS removed_ms, CASE WHEN app_id = 'app-3' THEN cores * 1000 ELSE cores END AS cores
FROM {plain_executors} JOIN (SELECT app_id, min(submitted_ms) AS first_ms FROM {windows} GROUP BY app_id) AS f USING (app_id)""",
}

#: Holds for all records of derived attempts whose task has more than one: a failed record is followed by another, each fortieth task has a copy, and only a task's first record has twice its number.
SEVERAL = "failed OR task_index % 40 = 0 OR seq > 2 * task_index"

#: Tables that take no more of tasks than the first launch and the last end of some, so that rows which have these of many tasks do as well.
EXTENTS = ("windows", "executors")

#: Columns of tasks that follow from others at once: kept rows leave them out, and whoever reads them works them out.
FOLLOWING = {"finish_ms": "launch_ms + duration_ms", "run_ms": "CAST(floor(duration_ms * 0.9) AS BIGINT)", "cpu_ns": "CAST(floor(duration_ms * 0.7) AS BIGINT) * 1000000"}


def _number_first(sql: str) -> str:
    """The same rows with task_id numbered before the other columns are worked out: the window then shuffles and sorts the columns that were read, not all that follow from them."""
    start, end = sql.find("row_number() OVER (PARTITION BY l_orderkey"), sql.find(" AS task_id")
    if start < 0:
        return sql
    number = sql[start:end]
    return sql.replace(f"{number} AS task_id", "task_id").replace("{lineitem}", f"(SELECT *, {number} AS task_id FROM {{lineitem}})")


def _by_whole_numbers(sql: str) -> str:
    """The same whole numbers without decimals, which Spark divides and multiplies slowly: floor(x / 4.0), and floor(x * 0.9) from x's tens and its last digit."""
    sql = re.sub(r"floor\((\w+) / 4\.0\)", r"shiftright(\1, 2)", sql)
    return re.sub(r"CAST\(floor\((\w+) \* 0\.(\d)\) AS BIGINT\)", r"(\2 * ((\1 - pmod(\1, 10)) div 10) + (\2 * pmod(\1, 10)) div 10)", sql)


class Facts:
    """The derived tables by name, made when first asked for; `keep` is applied to a table's rows the first time, by name.

    parts: tasks -> rows of `stages.stage_parts`, from which the tables of `EXTENTS` are made in place of tasks.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, keep: dict[str, Callable[[DataFrame], DataFrame]] | None = None, tables: dict[str, str] = TABLES, parts: Callable[[DataFrame], DataFrame] | None = None) -> None:
        self.spark, self.keep, self.tables, self._parts = spark, keep or {}, tables, parts
        self.made = {"lineitem": spark.read.parquet(f"{sf_dir}/lineitem.parquet")}

    @cached_property
    def parts(self) -> DataFrame:
        return self._parts(self["tasks"])

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.made:
            sql = _by_whole_numbers(_number_first(self.tables[name]))
            whole = self._parts is None or name not in EXTENTS
            df = self.spark.sql(sql, **{k: self[k] if whole or k != "tasks" else self.parts for k in ("lineitem", *self.tables) if "{" + k + "}" in sql})
            later = {c: F.expr(_by_whole_numbers(x)) for c, x in FOLLOWING.items() if name in self.keep and f"{x} AS {c}" in self.tables[name]}
            self.made[name] = self.keep.get(name, lambda x: x)(df.drop(*later)).withColumns(later).select(df.columns)
        return self.made[name]


def facts(spark: SparkSession, sf_dir: str) -> Facts:
    """All derived tables, lazily."""
    return Facts(spark, sf_dir)


def with_tables(body: str, *more: tuple[str, str], tables: dict[str, str] = TABLES) -> str:
    """`body` behind WITH clauses for the derived tables, and for `more` (name, SQL), that it uses."""
    parts = {k: v.format(**{n: n for n in ("lineitem", *tables)}) for k, v in tables.items()} | dict(more)
    used: dict[str, None] = {}

    def need(text: str) -> None:
        for name in re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", text):
            if name in parts and name not in used:
                need(parts[name])
                used[name] = None

    need(body)
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in ((k, parts[k]) for k in used)) + "\n" + body
