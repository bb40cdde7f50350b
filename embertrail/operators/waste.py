"""What each finding wastes: a model by type, and the task time that its fix would free."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .facts import retry_chains
from .stages import STAGE, concurrency

#: Assumed bytes a second of one executor's disk and link.
DISK_BPS, LINK_BPS = 200_000_000, 125_000_000
#: Share of a stage's time that one pass of its bytes through spill costs, and the most it can.
PASS_SHARE, PASS_SHARE_MOST = 0.5, 0.6
#: Milliseconds of starting a task, of a fetch from another host, of starting an executor.
TASK_MS, FETCH_MS, STARTUP_MS = 50, 20, 15_000
#: Share of run time on the CPU under which tasks idle; tasks from which the 95th percentile stands for the longest.
IDLE_CPU, TASKS_FOR_P95 = 0.01, 20
#: Types whose discarded or collecting time was measured, and types that claim the tail of a stage, in the order they count it.
MEASURED, TAILS = ("gc", "retryWaste", "speculationWaste"), ("skew", "straggler")


def stage_extras(tasks: DataFrame, attempts: DataFrame, peaks: DataFrame | None = None, lost: DataFrame | None = None) -> DataFrame:
    """(stage, executors, peak_tasks, active_ms, chain, retry_n, retry_ms): what the models read beside the stage table. peaks: `concurrency`, lost: `losers`, where they are known."""
    n = tasks.groupBy(STAGE).agg(F.count_distinct("executor_id").alias("executors"))
    return n.join(concurrency(tasks) if peaks is None else peaks, STAGE, "left").join(retry_chains(attempts, lost), STAGE, "left")


def _case(kind: Column, cases: dict[str, Column]) -> Column:
    out = F.when(F.lit(False), F.lit(None))
    for name, value in cases.items():
        out = out.when(kind == name, value)
    return out


def waste_claims(findings: DataFrame, stages: DataFrame, extras: DataFrame, executors: DataFrame, hosts: DataFrame | None = None, python: DataFrame | None = None) -> DataFrame:
    """Findings gain claim_ms (wall clock), raw and unit (what was wasted), method, core_ms (task time the fix frees), tail,
    removed_ms and longest_after_ms, as `estimate_stage` reads them.

    A type without a model has method none and nulls; a stage without run time or duration has no wall clock claim where
    the model converts by concurrency, and a stage that isn't in the stage table claims nothing. hosts: `slow_host_times`; without
    it a slow host claims nothing, with it the host's mean task over the median one. python: (stage, is_python); its stages never
    count as idle, as their workers' CPU time isn't in the log; without it idle tasks are told by CPU time alone.
    """
    own = stages.join(extras, STAGE).select(*STAGE, F.struct("*").alias("s"))
    run = stages.groupBy("app_id").agg(F.sum("tasks").alias("_run_tasks"))
    gone = executors.filter("removed_ms IS NOT NULL").groupBy("app_id").agg(F.count("*").alias("_gone"))
    x = findings.join(own, STAGE, "left").join(run, ["app_id"], "left").join(gone, ["app_id"], "left")
    x = x.withColumn("_host_ms", F.lit(None).cast("double")) if hosts is None else x.join(hosts.select(*STAGE, "rule", F.lit("slowHost").alias("type"), F.col("host_ms").alias("_host_ms")), [*STAGE, "type", "rule"], "left")
    x = x.withColumn("_python", F.lit(False)) if python is None else x.join(python.select(*STAGE, F.col("is_python").alias("_python")), STAGE, "left")
    c, kind, zero = lambda name: F.col(f"s.{name}"), F.col("type"), F.lit(0.0)

    devices = F.greatest(F.lit(1), c("executors"))
    at_once = F.when((c("run_ms") > 0) & (c("stage_ms") > 0), c("run_ms") / c("stage_ms"))
    read, disk = c("input_bytes") + c("shuffle_read"), c("disk_spilled")
    passes = F.when((read > 0) & (disk > 0), F.least(F.lit(PASS_SHARE_MOST), disk / read * PASS_SHARE))
    link, wait = c("shuffle_read") / (LINK_BPS * devices) * 1000, c("fetch_wait_ms") / at_once
    fewer = F.greatest(F.lit(0), c("tasks") - F.round(c("tasks") / 10))
    overhead = F.when((c("tasks") > 0) & (c("stage_ms") > 0) & (c("task_ms") > c("run_ms")), (c("task_ms") - c("run_ms")) / c("tasks"))
    idle = ~F.coalesce("_python", F.lit(False)) & (read <= 0) & (c("run_ms") > 0) & (c("cpu_ns") > 0) & (c("cpu_ns") / 1e6 / c("run_ms") < IDLE_CPU)
    unused = F.when(c("total_cores") > 0, F.when(idle, zero).otherwise(c("active_ms") * F.greatest(zero, 1 - c("tasks") / c("total_cores"))))
    retries = F.least(c("retry_ms"), F.greatest(c("chain") * c("retry_ms") / c("retry_n"), c("retry_ms") / F.greatest(F.lit(1), c("peak_tasks"))))

    over = F.when(kind == "straggler", c("longest") - c("longest_after_ms")).when(c("tasks") >= TASKS_FOR_P95, c("p95") - c("p50")).otherwise(c("longest") - c("p50"))
    delta = F.when(over.isNotNull(), F.greatest(zero, over))
    tail = F.when((c("excess_ms") > 0) & (c("peak_tasks") > 0), F.greatest(delta, c("excess_ms") / c("peak_tasks"))).otherwise(delta)
    removed = F.greatest(delta, c("excess_ms"))

    claim = _case(kind, {
        "skew": tail, "straggler": tail, "gc": c("gc_ms") / at_once, "retryWaste": retries, "spill": disk / (DISK_BPS * devices) * 1000 + c("stage_ms") * F.coalesce(passes, zero),
        "shuffle": F.least(link, wait), "tinyTask": F.coalesce(fewer * overhead / F.greatest(F.lit(1.0), F.try_divide(c("task_ms"), c("stage_ms"))), fewer * TASK_MS), "stageSlowness": unused, "coldStart": F.col("value"),
        "slowHost": F.when(c("p50").isNotNull() & F.col("_host_ms").isNotNull(), F.greatest(zero, F.col("_host_ms") - c("p50"))),
    }).cast("double")
    x = x.withColumn("claim_ms", claim)
    raw = _case(kind, {
        "gc": c("gc_ms"), "retryWaste": c("retry_ms"), "speculationWaste": F.col("value"), "spill": disk, "shuffle": c("shuffle_read"), "coreLocality": F.col("value") * F.col("_run_tasks") * FETCH_MS,
        "autoscalingChurn": F.col("value") * F.col("_gone") * STARTUP_MS / 3.6e6, **{k: F.col("claim_ms") for k in (*TAILS, "tinyTask", "stageSlowness", "slowHost")},
    }).cast("double")
    unit = _case(kind, {k: F.lit(u) for u, kinds in {"coreMs": ("gc", "coreLocality"), "ms": ("retryWaste", "speculationWaste", *TAILS, "tinyTask", "stageSlowness", "slowHost"), "bytes": ("spill", "shuffle"), "coreHours": ("autoscalingChurn",)}.items() for k in kinds})
    found = lambda test: F.when(test, "measured").otherwise("modeled")
    method = _case(kind, {
        **{k: F.lit("measured") for k in (*TAILS, "speculationWaste", "coldStart")}, **{k: F.lit("modeled") for k in ("gc", "spill", "stageSlowness", "coreLocality", "autoscalingChurn")},
        "slowHost": F.when(F.col("_host_ms").isNotNull(), "measured"), "retryWaste": found(F.col("claim_ms") == c("retry_ms")), "shuffle": found(wait < link), "tinyTask": found(overhead.isNotNull()),
    })
    core = F.when(kind.isin(*TAILS), removed).when(kind == "spill", c("run_ms") * passes).when(kind.isin(*MEASURED), raw).cast("double")
    at_tail = kind.isin(*TAILS)
    return x.select(
        *findings.columns, "claim_ms", raw.alias("raw"), F.when(raw.isNotNull(), unit).alias("unit"), F.coalesce(method, F.lit("none")).alias("method"), core.alias("core_ms"),
        at_tail.alias("tail"), F.when(at_tail, removed).when(kind == "spill", c("run_ms") * F.coalesce(passes, zero)).otherwise(0.0).alias("removed_ms"), F.when(at_tail, c("longest_after_ms")).otherwise(0.0).alias("longest_after_ms"),
    )


def core_time(claims: DataFrame, stages: DataFrame) -> DataFrame:
    """Claims gain core_low_ms, core_high_ms and stage_task_ms: the task time a fix frees, a stage's tail once (skew before straggler),
    and its stage's task time, else run time."""
    work = stages.select(*STAGE, F.when(F.col("task_ms") > 0, F.col("task_ms")).otherwise(F.when(F.col("run_ms") > 0, F.col("run_ms"))).alias("stage_task_ms"))
    first = F.row_number().over(Window.partitionBy(*STAGE, "tail").orderBy(F.col("core_ms").isNull(), "type", "rule"))
    x = claims.withColumn("_i", first).join(work, STAGE, "left")
    core = F.when(~F.col("tail") | (F.col("_i") == 1), F.col("core_ms"))
    return x.select(*claims.columns, core.alias("core_low_ms"), core.alias("core_high_ms"), "stage_task_ms")
