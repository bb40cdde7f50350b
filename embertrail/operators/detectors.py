"""Detectors: one function a finding type, each a filter over the fact tables with thresholds from one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.units import GIB, MIB, half_up
from .stages import STAGE, host_stats, median

#: Default thresholds by detector.
THRESHOLDS: dict[str, dict[str, float]] = {
    "skew": {"ratio": 3, "tasks_for_p95": 20, "floor_pct": 0.5, "data_share": 0.5},
    "straggler": {"tasks": 10, "share_pct": 5, "share_at_floor_pct": 2.5, "copies_pct": 10, "copies_critical_pct": 20, "floor_pct": 0.5, "floor_critical_pct": 2},
    "spill": {"floor_pct": 0.5, "disk": GIB, "memory": 4 * GIB, "task_disk": 512 * MIB, "some_disk": 256 * MIB, "some_memory": GIB, "ratio": 5, "ratio_disk": 128 * MIB, "ratio_memory": 256 * MIB, "ratio_tasks": 10},
    "shuffle": {"bytes": 50 * MIB, "floor_pct": 0.5},
    "partitionSizing": {"ratio": 5, "bytes": 256 * MIB, "single_key_share": 0.9, "total": GIB, "tasks": 7, "huge": 5 * GIB},
    "stageShape": {"tasks_per_core": 0.5, "growth": 10, "one_task_share": 0.5, "one_task_ratio": 3, "floor_pct": 0.5},
    "failures": {"tasks": 10, "share_pct": 5, "critical_pct": 20},
    "retryWaste": {"attempts": 3, "ms": 30_000},
    "gc": {"pct": 10, "run_ms": 10_000, "low_pct": 5, "floor_pct": 0.5},
    "slowHost": {"hosts": 3, "tasks": 15, "ratio": 2, "host_share": 0.2, "ms": 1000, "time_share": 0.75, "task_share": 0.5},
    "stageSlowness": {"ms": 900_000},
    "speculationWaste": {"attempts": 5, "ms": 60_000},
    "tinyTask": {"tasks": 100, "p50_ms": 500, "p95_ms": 1000, "floor_pct": 0.5},
    "coldStart": {"ms": 30_000},
    "utilization": {"share": 0.6, "critical": 0.3},
    "rightSizing": {"tolerance": 0.1, "share": 0.75, "cores": 8, "error_pct": 20},
    "coreLocality": {"tasks": 50, "ratio": 0.15, "critical": 0.35, "fetch_ms": 20, "cost_pct": 0.5, "cost_critical_pct": 2},
    "autoscalingChurn": {"removed": 5, "life_ms": 120_000, "warn": 0.3, "critical": 0.6},
    "memoryUtilization": {"idle": 0.5, "heap": 0.7, "unused_over_used": 1.5},
    "jobFailureRate": {"warn": 0.1, "high": 0.3, "critical": 0.5},
}

COLUMNS = ["app_id", "type", "rule", "stage_id", "metric", "value", "waste_ms", "band"]


def threshold_table(overrides: dict[str, dict[str, float]] | None = None) -> dict[str, dict[str, float]]:
    """Defaults with overrides applied; an unknown detector, name or a value that is no number is an error."""
    out = {k: dict(v) for k, v in THRESHOLDS.items()}
    for kind, values in (overrides or {}).items():
        for name, value in values.items():
            if name not in out.get(kind, {}):
                raise ValueError(f"no threshold {kind}.{name}")
            if isinstance(value, bool) or not isinstance(value, (int, float)) or value < 0:
                raise ValueError(f"{kind}.{name} must be a number that isn't negative")
            out[kind][name] = value
    return out


def _found(df: DataFrame, type_: str, rule: Column | str, metric: str, value: Column, waste: Column | None = None, band: Column | str = "warning", stage: bool = True) -> DataFrame:
    return df.select(
        "app_id", F.lit(type_).alias("type"), (F.lit(rule) if isinstance(rule, str) else rule).alias("rule"), (F.col("stage_id") if stage else F.lit(None).cast("long")).alias("stage_id"), F.lit(metric).alias("metric"),
        value.cast("double").alias("value"), (F.lit(None) if waste is None else waste).cast("double").alias("waste_ms"), (F.lit(band) if isinstance(band, str) else band).alias("band"),
    )


def _long_enough(pct: float) -> Column:
    """Whether a stage lasts at least this percentage of its run; a run of unknown duration passes."""
    return F.col("duration_ms").isNull() | (F.col("stage_ms") * 100 >= F.col("duration_ms") * pct)


def _ratio(tasks_for_p95: float) -> Column:
    return F.when(F.col("p50") > 0, F.when(F.col("tasks") >= tasks_for_p95, F.col("p95")).otherwise(F.col("longest")) / F.col("p50"))


def tail_cause(stages: DataFrame, tails: DataFrame, data_share: float) -> DataFrame:
    """Stages with the cause of their tail: data from `data_share` of its excess on, else the largest of the others; cause_pct is its share of the excess, null where nothing tells the cause."""
    t = tails.select(*STAGE, F.col("excess_ms").alias("_excess"), "data_ms", F.col("gc_ms").alias("_gc"), "fetch_ms", "host_ms", "data_ratio")
    x = stages.join(t, STAGE, "left")
    rest = F.greatest(F.lit(0.0), F.col("_excess") - F.col("data_ms") - F.col("_gc") - F.col("fetch_ms") - F.col("host_ms"))
    other = F.when(F.col("data_ratio").isNull(), "unattributed").otherwise("unexplained")
    most = F.greatest("_gc", "fetch_ms", "host_ms", rest)
    cause = F.when(F.col("_excess").isNull() | (F.col("_excess") <= 0), "unattributed").when(F.col("data_ms") / F.col("_excess") >= data_share, "data").when(F.col("_gc") == most, "gc").when(F.col("fetch_ms") == most, "fetchWait").when(F.col("host_ms") == most, "host").otherwise(other)
    own = F.when(cause == "data", F.col("data_ms")).when(cause == "gc", F.col("_gc")).when(cause == "fetchWait", F.col("fetch_ms")).when(cause == "host", F.col("host_ms")).when(cause == "unexplained", rest)
    return x.withColumn("cause_pct", own / F.col("_excess") * 100).withColumn("cause", cause).drop("_excess", "data_ms", "_gc", "fetch_ms", "host_ms", "data_ratio")


def skew(stages: DataFrame, tails: DataFrame, t: dict) -> DataFrame:
    x = tail_cause(stages, tails, t["data_share"]).withColumn("ratio", _ratio(t["tasks_for_p95"]))
    worth = F.col("duration_ms").isNull() | (F.col("recovery_ms") * 100 >= F.col("duration_ms") * t["floor_pct"])
    return _found(x.filter((F.col("ratio") > t["ratio"]) & (F.col("cause") == "data") & worth), "skew", "data", "duration ratio", F.col("ratio"), F.col("recovery_ms"))


def straggler(stages: DataFrame, claims: DataFrame, t: dict) -> DataFrame:
    """Stages with many tasks over four medians, or with speculative copies; the band goes by their share and by what removing the
    tail would save of the run. claims: (stage, high_ms), from `estimate_stage`."""
    x = stages.join(claims.select(*STAGE, F.col("high_ms").alias("_high")), STAGE, "left").withColumn("claim", F.coalesce("_high", "recovery_ms"))
    share, copies = F.col("stragglers") / F.col("tasks") * 100, F.col("speculative_tasks") / F.col("tasks") * 100
    unknown = F.col("duration_ms").isNull()
    saves = lambda pct: unknown | (F.col("claim") * 100 >= F.col("duration_ms") * pct)
    worth = saves(t["floor_pct"])
    fires = (share > t["share_pct"]) | ((share > t["share_at_floor_pct"]) & ~unknown & worth)
    by_copies = F.when(copies == 0, 4).when((copies >= t["copies_critical_pct"]) & saves(t["floor_critical_pct"]), 1).when((copies >= t["copies_pct"]) & worth, 2).otherwise(3)
    by_share = F.when(fires & worth, 2).otherwise(3)
    x = x.filter((F.col("tasks") >= t["tasks"]) & _long_enough(t["floor_pct"]) & ((copies > 0) | fires)).withColumn("_copies", by_copies).withColumn("_share", by_share)
    told = F.col("_copies") <= F.col("_share")
    band = F.element_at(F.array(F.lit("critical"), F.lit("warning"), F.lit("info")), F.least("_copies", "_share"))
    some = _found(x.filter(told), "straggler", "speculation", "tasks that ended on a copy", F.col("speculative_tasks"), F.col("claim"), band)
    return some.unionByName(_found(x.filter(~told), "straggler", "share", "straggler share", share, F.col("claim"), band))


def skew_claims(stages: DataFrame, peaks: DataFrame, t: dict) -> DataFrame:
    """Stages over the skew ratio with what their tail costs, as `estimate_stage` reads it: the 95th percentile's (of few tasks the longest's) time over the median, or all stragglers' spread over the tasks at once."""
    x = stages.join(peaks.select(*STAGE, "peak_tasks"), STAGE, "left").withColumn("ratio", _ratio(t["tasks_for_p95"])).filter(F.col("ratio") > t["ratio"])
    over = F.greatest(F.lit(0.0), F.when(F.col("tasks") >= t["tasks_for_p95"], F.col("p95")).otherwise(F.col("longest")) - F.col("p50"))
    cost = F.when((F.col("excess_ms") > 0) & (F.col("peak_tasks") > 0), F.greatest(over, F.col("excess_ms") / F.col("peak_tasks"))).otherwise(over)
    return x.select(*STAGE, "ratio", cost.alias("waste_ms"), F.lit(True).alias("tail"), F.greatest(over, "excess_ms").alias("removed_ms"), "longest_after_ms")


def straggler_tails(stages: DataFrame, claims: DataFrame, skewed: DataFrame, tails: DataFrame, t: dict, skew_t: dict) -> DataFrame:
    """Straggler findings with the cause of their tail: those of `straggler`, and tails that skew's gate admits though data doesn't explain them (rule ratio); tails that skew reports are left out.

    skewed: `skew_claims` with high_ms (null: the raw claim counts). Added columns: cause, cause_pct (null where nothing
    tells the cause), host and host_tasks (where the cause is one), cpu_pct of the tail's run time (null without CPU time).
    """
    run = stages.select(*STAGE, "duration_ms", "recovery_ms")
    cost = F.coalesce("high_ms", "waste_ms")
    worth = F.col("duration_ms").isNull() | (cost * 100 >= F.col("duration_ms") * skew_t["floor_pct"])
    admitted = skewed.join(run, STAGE).filter(worth).select(*STAGE, F.col("ratio").alias("_ratio"))
    why = tail_cause(stages.select(*STAGE), tails, skew_t["data_share"]).join(tails.select(*STAGE, "host", "host_tasks", "cpu_pct"), STAGE, "left").join(admitted, STAGE, "left")
    why = why.filter((F.col("cause") != "data") | F.col("_ratio").isNull())
    own = straggler(stages, claims, t)
    claim = stages.join(claims.select(*STAGE, F.col("high_ms").alias("_high")), STAGE, "left").select(*STAGE, F.coalesce("_high", "recovery_ms").alias("claim"))
    rest = why.filter("_ratio IS NOT NULL").join(own, STAGE, "left_anti").join(claim, STAGE)
    found = own.unionByName(_found(rest, "straggler", "ratio", "duration ratio", F.col("_ratio"), F.col("claim"), "info"))
    at_host = lambda c: F.when(F.col("cause") == "host", F.col(c)).alias(c)
    return found.join(why, STAGE).select(*COLUMNS, "cause", half_up(F.col("cause_pct")).alias("cause_pct"), at_host("host"), at_host("host_tasks"), half_up(F.col("cpu_pct")).alias("cpu_pct"))


def spill(stages: DataFrame, t: dict) -> DataFrame:
    """Stages that spill; the rule tells how much the largest task does: severe (a lone task), high, medium, else some."""
    disk, mem = F.col("disk_max"), F.col("spill_max")
    much = (disk >= t["disk"]) | (mem >= t["memory"])
    enough = F.col("tasks") >= t["ratio_tasks"]
    uneven = lambda x, mid, floor: enough & (F.col(mid) > 0) & (x > t["ratio"] * F.col(mid)) & (x >= floor)
    rule = (
        F.when((F.col("tasks") == 1) & much, "severe").when((F.col("tasks") > 1) & (much | (disk / F.col("tasks") >= t["task_disk"])), "high")
        .when((F.col("tasks") > 1) & ((disk >= t["some_disk"]) | (mem >= t["some_memory"])), "medium")
        .when(uneven(disk, "disk_p50", t["ratio_disk"]), "high").when(uneven(mem, "spill_p50", t["ratio_memory"]), "medium").otherwise("some")
    )
    return _found(stages.filter((F.col("mem_spilled") > 0) & _long_enough(t["floor_pct"])), "spill", rule, "memory bytes spilled", F.col("mem_spilled"))


def shuffle(stages: DataFrame, t: dict) -> DataFrame:
    return _found(stages.filter((F.col("shuffle_read") > t["bytes"]) & _long_enough(t["floor_pct"])), "shuffle", "volume", "shuffle bytes read", F.col("shuffle_read"), F.col("fetch_wait_ms").cast("double"), "info")


def partition_sizing(stages: DataFrame, t: dict) -> DataFrame:
    big, p50 = F.col("shuffle_max"), F.col("shuffle_p50")
    uneven = stages.filter((big > t["bytes"]) & (big > t["ratio"] * p50))
    few = stages.filter((F.col("shuffle_read") >= t["total"]) & (F.col("tasks") <= t["tasks"]))
    huge = stages.filter(big >= t["huge"])
    return _found(uneven, "partitionSizing", "uneven", "largest partition", big).unionByName(_found(few, "partitionSizing", "few", "tasks", F.col("tasks"))).unionByName(_found(huge, "partitionSizing", "huge", "largest partition", big, None, "critical"))


def stage_shape(stages: DataFrame, t: dict) -> DataFrame:
    """Stages with fewer tasks than half their executors' cores, that write far more than they read, or that wait for one task."""
    s = stages.filter(_long_enough(t["floor_pct"]))
    few = s.filter((F.col("stage_cores") > 0) & (F.col("tasks") / F.col("stage_cores") < t["tasks_per_core"]))
    grown = stages.filter((F.col("input_bytes") > 0) & (F.col("output_bytes") / F.col("input_bytes") > t["growth"]))
    one = s.filter((F.col("tasks") > 1) & (F.col("stage_ms") > 0) & (F.col("p50") > 0) & (F.col("longest") > t["one_task_share"] * F.col("stage_ms")) & (F.col("longest") > t["one_task_ratio"] * F.col("p50")))
    out = _found(few, "stageShape", "lowParallelism", "tasks per core", F.col("tasks") / F.col("stage_cores"), band="info")
    out = out.unionByName(_found(grown, "stageShape", "expansion", "output over input", F.col("output_bytes") / F.col("input_bytes"), band="info"))
    return out.unionByName(_found(one, "stageShape", "longTask", "longest task share", F.col("longest") / F.col("stage_ms"), band="info"))


def failures(stages: DataFrame, t: dict) -> DataFrame:
    pct = F.col("failed_tasks") / F.col("tasks") * 100
    return _found(stages.filter((F.col("tasks") >= t["tasks"]) & (pct > t["share_pct"])), "failures", "share", "failed task share", pct, None, F.when(pct > t["critical_pct"], "critical").otherwise("warning"))


def wasted(waste: DataFrame, t: dict, type_: str, ms: str, n: str) -> DataFrame:
    """Retried (or speculated) attempts that were thrown away, from `wasted_attempts`."""
    return _found(waste.filter((F.col(n) >= t["attempts"]) & (F.col(ms) >= t["ms"])), type_, "attempts", "discarded task time", F.col(ms), F.col(ms).cast("double"))


def gc(stages: DataFrame, t: dict) -> DataFrame:
    pct = F.col("gc_ms") / F.col("run_ms") * 100
    return _found(stages.filter((F.col("run_ms") >= t["run_ms"]) & (pct > t["pct"])), "gc", "high", "GC share of run time", pct, F.col("gc_ms").cast("double"))


def gc_low(stages: DataFrame, measured: DataFrame, t: dict) -> DataFrame:
    """Stages that hardly collected garbage, in runs (app_id) without measured heap peaks: their executors may hold too much memory."""
    pct = F.col("gc_ms") / F.col("run_ms") * 100
    x = stages.filter((F.col("run_ms") >= t["run_ms"]) & (F.col("failed_tasks") == 0) & (pct < t["low_pct"]) & _long_enough(t["floor_pct"])).join(measured.select("app_id").distinct(), ["app_id"], "left_anti")
    return _found(x, "gc", "low", "GC share of run time", pct, band="info")


def _slow_by_mean(hosts: DataFrame, t: dict) -> DataFrame:
    """Hosts of a stage whose mean task takes twice the median host's, with mean_ms and ratio. hosts: `host_stats`."""
    h = hosts.withColumn("mean_ms", F.col("total_ms") / F.col("tasks"))
    all_ = h.groupBy(STAGE).agg(F.count("*").alias("hosts"), F.sum("tasks").alias("all_tasks"), median("mean_ms").alias("mid_ms"))
    x = h.join(all_, STAGE).filter((F.col("hosts") >= t["hosts"]) & (F.col("all_tasks") >= t["tasks"]) & (F.col("mid_ms") > 0) & (F.col("mean_ms") >= t["ratio"] * F.col("mid_ms")) & (F.col("tasks") >= t["host_share"] * F.col("all_tasks")) & (F.col("mean_ms") >= t["ms"]))
    return x.select(*STAGE, "host", "mean_ms", (F.col("mean_ms") / F.col("mid_ms")).alias("ratio"))


def _slow_by_share(h: DataFrame, t: dict) -> DataFrame:
    """Hosts with most of a stage's task time and at least half of its tasks, with mean_ms and share. h: `host_stats`."""
    all_ = h.groupBy(STAGE).agg(F.sum("tasks").alias("all_tasks"), F.sum("total_ms").alias("all_ms"), F.count("*").alias("hosts"))
    x = h.join(all_, STAGE).filter((F.col("hosts") > 1) & (F.col("total_ms") >= t["time_share"] * F.col("all_ms")) & (F.col("tasks") >= t["task_share"] * F.col("all_tasks")))
    return x.select(*STAGE, "host", (F.col("total_ms") / F.col("tasks")).alias("mean_ms"), (F.col("total_ms") / F.col("all_ms")).alias("share"))


def slow_host_mean(tasks: DataFrame, stages: DataFrame, t: dict, hosts: DataFrame | None = None) -> DataFrame:
    """Stages with a host whose mean task takes twice the median host's. hosts: `host_stats`, where they are known."""
    worst = _slow_by_mean(host_stats(tasks) if hosts is None else hosts, t).groupBy(STAGE).agg(F.max("ratio").alias("ratio")).join(stages.select(*STAGE, "stage_ms", "duration_ms"), STAGE).filter(_long_enough(0.5))
    return _found(worst, "slowHost", "mean", "host mean over median", F.col("ratio"))


def slow_host_share(tasks: DataFrame, t: dict, hosts: DataFrame | None = None) -> DataFrame:
    """One host with most of a stage's task time and at least half of its tasks. hosts: `host_stats`, where they are known."""
    return _found(_slow_by_share(host_stats(tasks) if hosts is None else hosts, t), "slowHost", "durationShare", "host share of task time", F.col("share"))


def slow_host_times(tasks: DataFrame, t: dict) -> DataFrame:
    """(stage, rule, host, host_ms): the host that a slow host finding is about, and its mean task; of several by the mean, the slowest, then the last by name."""
    hosts = host_stats(tasks)
    mean = _slow_by_mean(hosts, t).groupBy(STAGE).agg(F.max_by(F.struct("host", "mean_ms"), F.struct("ratio", "host")).alias("h")).select(*STAGE, F.lit("mean").alias("rule"), "h.host", F.col("h.mean_ms").alias("host_ms"))
    return mean.unionByName(_slow_by_share(hosts, t).select(*STAGE, F.lit("durationShare").alias("rule"), "host", F.col("mean_ms").alias("host_ms")))


def stage_slowness(stages: DataFrame, slow_hosts: DataFrame, t: dict) -> DataFrame:
    """Long stages that no slow host explains."""
    x = stages.filter(F.col("stage_ms") >= t["ms"]).join(slow_hosts.select(STAGE).distinct(), STAGE, "left_anti")
    return _found(x, "stageSlowness", "duration", "stage duration", F.col("stage_ms"))


def tiny_task(stages: DataFrame, t: dict) -> DataFrame:
    x = stages.filter((F.col("tasks") >= t["tasks"]) & (F.col("p50") <= t["p50_ms"]) & (F.col("p95") <= t["p95_ms"]) & _long_enough(t["floor_pct"]))
    return _found(x, "tinyTask", "duration", "median task", F.col("p50"), band="info")


def incomplete_run(timing: DataFrame) -> DataFrame:
    return _found(timing.filter("incomplete"), "incompleteRun", "noEnd", "ended", F.lit(0), stage=False)


def cold_start(executors: DataFrame, windows: DataFrame, t: dict) -> DataFrame:
    """Runs whose first stage waits for an executor: none added before it is still there, and the next one comes well after."""
    first = windows.filter("submitted_ms > 0").groupBy("app_id").agg(F.min("submitted_ms").alias("s"))
    early = F.col("added_ms") <= F.col("s")
    there = early & (F.col("removed_ms").isNull() | (F.col("removed_ms") > F.col("s")))
    x = executors.join(first, ["app_id"]).groupBy("app_id", "s").agg(F.bool_or(there).alias("there"), F.min(F.when(~early, F.col("added_ms"))).alias("e"))
    wait = F.col("e") - F.col("s")
    return _found(x.filter(~F.col("there") & (wait > t["ms"])), "coldStart", "wait", "wait for executors", wait, wait.cast("double"), stage=False)


def utilization(model: DataFrame, t: dict) -> DataFrame:
    x = model.filter(F.col("utilization") < t["share"])
    return _found(x, "utilization", "busyShare", "busy over allocated", F.col("utilization"), None, F.when(F.col("utilization") < t["critical"], "critical").otherwise("warning"), stage=False)


def right_sizing(smallest: DataFrame, what_if: DataFrame, t: dict) -> DataFrame:
    """Runs that would take hardly longer on far fewer cores, where the model fits what was seen."""
    error = what_if.groupBy("app_id").agg(F.max("model_error_pct").alias("error"))
    x = smallest.join(error, ["app_id"]).filter((F.col("total_cores") >= t["cores"]) & (F.col("cores") <= t["share"] * F.col("total_cores")) & (F.col("error") <= t["error_pct"]))
    return _found(x, "rightSizing", "fewerCores", "sufficient cores", F.col("cores"), stage=False)


def core_locality(locality: DataFrame, stages: DataFrame, t: dict) -> DataFrame:
    """Runs with many tasks away from their data; the band goes by what that costs, at a fixed time a task, of all task time."""
    far = F.sum(F.when(F.col("locality").isin("RACK_LOCAL", "ANY"), F.col("tasks")).otherwise(0))
    x = locality.groupBy("app_id").agg(far.alias("far"), (far / F.sum("tasks")).alias("ratio"), F.sum("tasks").alias("n")).filter((F.col("n") >= t["tasks"]) & (F.col("ratio") >= t["ratio"]))
    x = x.join(stages.groupBy("app_id").agg(F.sum("task_ms").alias("task_ms")), ["app_id"], "left")
    cost = F.when(F.col("task_ms") > 0, F.col("far") * t["fetch_ms"] * 100 / F.col("task_ms"))
    band = F.when(cost.isNull(), "warning").when((F.col("ratio") >= t["critical"]) & (cost >= t["cost_critical_pct"]), "critical").when(cost >= t["cost_pct"], "warning").otherwise("info")
    return _found(x, "coreLocality", "nonLocal", "non-local share", F.col("ratio"), None, band, stage=False)


def autoscaling_churn(executors: DataFrame, t: dict) -> DataFrame:
    gone = executors.filter("removed_ms IS NOT NULL").groupBy("app_id").agg(F.count("*").alias("n"), F.avg((F.col("removed_ms") - F.col("added_ms") < t["life_ms"]).cast("int")).alias("share"))
    x = gone.filter((F.col("n") >= t["removed"]) & (F.col("share") > t["warn"]))
    return _found(x, "autoscalingChurn", "shortLived", "short-lived share", F.col("share"), None, F.when(F.col("share") > t["critical"], "critical").otherwise("warning"), stage=False)


def memory_utilization(model: DataFrame, alloc: DataFrame, resources: DataFrame, heap: DataFrame, work: DataFrame, t: dict) -> DataFrame:
    """Runs whose cores idle, whose fullest executor leaves much of its heap, whose heap was not measured, or that hold far more memory-time than tasks used.

    resources: (app_id, heap bytes, cores of an executor); heap: (app_id, executor_id, peak bytes); work: (app_id, run_ms).
    What is unknown of a run fires no rule that needs it.
    """
    peak = heap.groupBy("app_id").agg(F.max("peak").alias("peak"))
    x = model.select("app_id", "idle_share").join(alloc.select("app_id", "executor_seconds"), ["app_id"], "left").join(resources.select("app_id", F.col("heap").alias("held"), "cores"), ["app_id"], "left")
    x = x.join(peak, ["app_id"], "left").join(work.select("app_id", "run_ms"), ["app_id"], "left")
    held, used = F.col("held") / MIB * F.col("executor_seconds"), F.when(F.col("cores") > 0, F.col("held") / MIB * (F.col("run_ms") / 1000 / F.col("cores")))
    full = F.when(F.col("held") > 0, F.col("peak") / F.col("held"))
    row = lambda rule, metric, value, band: F.struct(F.lit(rule).alias("rule"), F.lit(metric).alias("metric"), value.cast("double").alias("value"), F.lit(band).alias("band"))
    rules = F.array_compact(F.array(
        F.when(F.col("idle_share") > t["idle"], row("idleCores", "idle share, percent", half_up(F.col("idle_share") * 100), "warning")),
        F.when(F.col("peak").isNull(), row("heapUnknown", "heap share, percent", F.lit(None), "info")),
        F.when(full < t["heap"], row("heapOverProvisioned", "heap share, percent", half_up(full * 100), "info")),
        F.when((F.col("executor_seconds") > 0) & (held - used > t["unused_over_used"] * used), row("wasteModel", "unused MB-seconds", half_up(held - used), "info")),
    ))
    x = x.select("app_id", F.explode(rules).alias("r")).select("app_id", "r.*")
    return x.select("app_id", F.lit("memoryUtilization").alias("type"), "rule", F.lit(None).cast("long").alias("stage_id"), "metric", "value", F.lit(None).cast("double").alias("waste_ms"), "band")


def job_failure_rate(outcome: DataFrame, t: dict) -> DataFrame:
    share = F.col("failed") / F.col("total")
    band = F.when(share >= t["critical"], "critical").when(share >= t["high"], "warning").otherwise("info")
    return _found(outcome.filter(share >= t["warn"]), "jobFailureRate", "share", "failed job share", share, None, band, stage=False)


def slow_host_multidim(executors: DataFrame, t: dict, error: float = 0.005, ratio: float = 1.33, floors: tuple[float, float] = (1000.0, 64.0 * MIB)) -> DataFrame:
    """Executors whose tasks took longer, or read or shuffled more, than chance allows among a stage's executors.

    On log scale an executor's mean is compared with the median executor's in standard errors of the pooled variance; the
    limit grows with the number of executors, sqrt(2 ln(N / (2 error))). Its figure per task must also be `ratio` times
    the median one and above a floor. executors: from `executor_stats`.
    """
    bytes_ = F.col("shuffle_read") + F.col("shuffle_write")
    figures = {"taskTime": ("duration", F.col("total_ms"), floors[0]), "inputBytes": ("input", F.col("input_bytes"), floors[1]), "shuffleBytes": ("shuffle", bytes_, floors[1])}
    dims = F.array(*[F.struct(F.lit(k).alias("dim"), F.col(f"log_{c}_sum").alias("s"), F.col(f"log_{c}_m2").alias("m2"), (v / F.col("tasks")).alias("per_task"), F.lit(f).alias("floor")) for k, (c, v, f) in figures.items()])
    x = executors.select(*STAGE, "executor_id", "tasks", F.explode(dims).alias("d")).select(*STAGE, "executor_id", "tasks", "d.*").withColumn("mean", F.col("s") / F.col("tasks"))
    mid = x.groupBy(*STAGE, "dim").agg(F.count("*").alias("n"), F.sum("tasks").alias("all_tasks"), F.sum("m2").alias("m2_all"), median("mean").alias("mid"), median("per_task").alias("mid_per_task"))
    x = x.drop("m2").join(mid, [*STAGE, "dim"]).filter((F.col("n") >= t["hosts"]) & (F.col("all_tasks") > F.col("n")) & (F.col("m2_all") > 0))
    z = (F.col("mean") - F.col("mid")) / F.sqrt(F.col("m2_all") / (F.col("all_tasks") - F.col("n")) / F.col("tasks"))
    hit = x.withColumn("z", z).filter((F.col("z") > F.sqrt(2 * F.log(F.col("n") / (2 * error)))) & (F.col("mid_per_task") > 0) & (F.col("per_task") >= ratio * F.col("mid_per_task")) & (F.col("per_task") >= F.col("floor")))
    worst = hit.groupBy(*STAGE, "dim").agg(F.max(F.col("per_task") / F.col("mid_per_task")).alias("times"))
    return _found(worst, "slowHost", "multiDim", "executor over median", F.col("times"))


def stage_failed(attempts: DataFrame) -> DataFrame:
    """Stages whose latest attempt states a failure, and how often others of their run state the same first line.

    attempts: (app_id, stage_id, attempt, failure, latest).
    """
    line = F.element_at(F.split("failure", "\n"), 1)
    failed = attempts.filter("latest AND failure IS NOT NULL").withColumn("line", line)
    alike = failed.groupBy("app_id", "line").agg(F.count("*").alias("same"))
    return _found(failed.join(alike, ["app_id", "line"]), "stageFailed", "failure", "stages with this failure", F.col("same"), None, "critical")
