"""Run-level accounting, grouped by application."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.intervals import islands, overlaps, sweep
from ..functions.units import MS_PER_HOUR, half_up

APP = ["app_id"]
#: Percentages of the present cores in the what-if table, and score limits of the scorecard.
WHAT_IF = (10, 20, 50, 80, 100, 110, 120, 150, 200, 300, 400, 500)
GOOD_EFFICIENCY, FAIR_EFFICIENCY = 90, 75


def run_timing(apps: DataFrame, windows: DataFrame) -> DataFrame:
    """Whether a run is complete, its duration, and the last stage end that stands in for a missing end."""
    last = windows.groupBy(APP).agg(F.max("completed_ms").alias("fallback_end_ms"))
    x = apps.join(last, APP, "left")
    end = F.coalesce("end_ms", "fallback_end_ms")
    return x.select("app_id", F.col("end_ms").isNotNull().alias("complete"), (end - F.col("start_ms")).alias("duration_ms"), "fallback_end_ms", (F.col("start_ms").isNotNull() & F.col("end_ms").isNull()).alias("incomplete"))


def wall_clock(apps: DataFrame, windows: DataFrame) -> DataFrame:
    """Run time split into start-up, stages, gaps between them and idle time behind the last."""
    parts = islands(windows, APP, "submitted_ms", "completed_ms")
    own = Window.partitionBy("app_id").orderBy("submitted_ms")
    parts = parts.withColumn("gap", F.col("submitted_ms") - F.lag("completed_ms").over(own))
    s = parts.groupBy(APP).agg(F.sum(F.col("completed_ms") - F.col("submitted_ms")).alias("active_ms"), F.coalesce(F.sum("gap"), F.lit(0)).alias("gaps_ms"), F.min("submitted_ms").alias("first"), F.max("completed_ms").alias("last"))
    x = apps.join(s, APP, "left").withColumn("_start", F.coalesce("start_ms", F.lit(0))).withColumn("_end", F.coalesce("end_ms", "last", "start_ms", F.lit(0)))
    total, zero = F.greatest(F.lit(0), F.col("_end") - F.col("_start")), F.lit(0)
    none = F.col("first").isNull()
    return x.select(
        "app_id", total.alias("total_ms"), F.when(none, total).otherwise(F.greatest(zero, F.col("first") - F.col("_start"))).alias("startup_ms"), F.coalesce("active_ms", zero).alias("active_ms"),
        F.coalesce("gaps_ms", zero).alias("gaps_ms"), F.when(none, zero).otherwise(F.greatest(zero, F.col("_end") - F.col("last"))).alias("idle_ms"),
    )


def core_histogram(tasks: DataFrame) -> DataFrame:
    """(app, cores, ms): wall time at each number of busy cores, every number from 0 to the most."""
    seen = sweep(tasks, APP, "launch_ms", "finish_ms").groupBy("app_id", F.col("busy").alias("cores")).agg(F.sum(F.col("to_ms") - F.col("from_ms")).alias("ms"))
    every = seen.groupBy(APP).agg(F.max("cores").alias("_most")).select("app_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_most"))).alias("cores"))
    return every.join(seen, ["app_id", "cores"], "left").select("app_id", "cores", F.coalesce("ms", F.lit(0)).alias("ms"))


def busy_cores_by_time(tasks: DataFrame, width_ms: int = 60_000, max_cores: int | None = None) -> DataFrame:
    """(app, bucket, busy_ms, avg_cores) over buckets of `width_ms` from 0, those with work. `max_cores` clamps each instant."""
    s = sweep(tasks, APP, "launch_ms", "finish_ms").filter("busy > 0")
    busy = F.col("busy") if max_cores is None else F.least("busy", F.lit(max_cores))
    s = s.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("from_ms") / width_ms), F.floor((F.col("to_ms") - 1) / width_ms))))
    part = F.least("to_ms", (F.col("bucket") + 1) * width_ms) - F.greatest("from_ms", F.col("bucket") * width_ms)
    out = s.groupBy("app_id", "bucket").agg(F.sum(part * busy).alias("busy_ms"))
    return out.withColumn("avg_cores", F.col("busy_ms") / width_ms)


def run_aggregates(tasks: DataFrame) -> DataFrame:
    """(app, stage, task_ms, tasks) and, on each row, the run's busy core time."""
    per = tasks.groupBy("app_id", "stage_id").agg(F.sum("duration_ms").alias("task_ms"), F.count("*").alias("tasks"))
    total = per.groupBy(APP).agg(F.sum("task_ms").alias("busy_core_ms"))
    return per.join(total, APP)


def peak_cores(executors: DataFrame) -> DataFrame:
    """Most cores and executors at once (a removal counts before an addition at the same time), and cores ever added."""
    far = F.lit(1 << 60).cast("long")
    ends = executors.withColumn("_end", F.coalesce("removed_ms", far))
    cores = sweep(ends, APP, "added_ms", "_end", F.col("cores"), 1 << 61).groupBy(APP).agg(F.max("busy").alias("peak_cores"))
    count = sweep(ends, APP, "added_ms", "_end", None, 1 << 61).groupBy(APP).agg(F.max("busy").alias("peak_executors"))
    return cores.join(count, APP).join(executors.groupBy(APP).agg(F.sum("cores").alias("total_cores")), APP)


def alive_intervals(executors: DataFrame, apps: DataFrame, windows: DataFrame) -> DataFrame:
    """(app, executor, start_ms, end_ms, cores): until the removal, else the run's end, else the last time known."""
    seen = windows.select("app_id", F.greatest("submitted_ms", "completed_ms").alias("t")).unionByName(executors.select("app_id", F.greatest("added_ms", "removed_ms").alias("t"))).unionByName(apps.select("app_id", F.greatest("start_ms", "end_ms").alias("t")))
    close = apps.select("app_id", "end_ms").join(seen.groupBy(APP).agg(F.max("t").alias("last")), APP, "left").select("app_id", F.coalesce("end_ms", "last").alias("close_ms"))
    x = executors.groupBy("app_id", "executor_id").agg(F.min_by(F.struct("added_ms", "removed_ms", "cores"), "added_ms").alias("e")).select("app_id", "executor_id", "e.*").join(close, APP, "left")
    removal = F.when(F.col("removed_ms") >= F.col("added_ms"), F.col("removed_ms"))
    return x.select("app_id", "executor_id", F.col("added_ms").alias("start_ms"), F.greatest("added_ms", F.coalesce(removal, "close_ms", "added_ms")).alias("end_ms"), "cores")


def allocation(alive: DataFrame) -> DataFrame:
    """Core-hours, executor seconds, most and mean executors; core-hours are null if any executor's cores are unknown."""
    ms = F.col("end_ms") - F.col("start_ms")
    core = F.when(F.count_if(F.col("cores").isNull()) == 0, F.sum(ms * F.col("cores")) / MS_PER_HOUR)
    per = alive.groupBy(APP).agg(core.alias("core_hours"), (F.sum(ms) / 1000).alias("executor_seconds"), (F.sum(ms) / (F.max("end_ms") - F.min("start_ms"))).alias("executors_mean"))
    peak = sweep(alive, APP, "start_ms", "end_ms").groupBy(APP).agg(F.max("busy").alias("executors_peak"))
    return per.join(peak, APP, "left")


def efficiency(alive: DataFrame, windows: DataFrame, tasks: DataFrame, executors: DataFrame) -> DataFrame:
    """Allocated against busy core time, inside and outside the stages' windows."""
    total = alive.groupBy(APP).agg(F.when(F.count_if(F.col("cores").isNull()) == 0, F.sum((F.col("end_ms") - F.col("start_ms")) * F.col("cores"))).alias("allocated"))
    parts = islands(windows, APP, "submitted_ms", "completed_ms")
    inside = overlaps(alive, parts, APP, "start_ms", "end_ms", "submitted_ms", "completed_ms").groupBy(APP).agg(F.sum(F.col("overlap_ms") * F.col("cores")).alias("inside"))
    busy = tasks.groupBy(APP).agg(F.sum("duration_ms").alias("busy"))
    x = total.join(inside, APP, "left").join(busy, APP, "left").join(peak_cores(executors).select("app_id", "peak_cores"), APP, "left").na.fill(0, ["inside", "busy"])
    has = F.col("allocated") > 0
    driver, executor = F.greatest(F.lit(0), F.col("allocated") - F.col("inside")) / MS_PER_HOUR, F.greatest(F.lit(0), F.col("inside") - F.col("busy")) / MS_PER_HOUR
    idle = F.when(has, 1 - F.col("busy") / F.col("allocated"))
    return x.select(
        "app_id", F.when(has, F.col("allocated")).alias("allocated_core_ms"), driver.alias("driver_waste_hours"), executor.alias("executor_waste_hours"), F.when(has, F.col("busy") / F.col("allocated")).alias("utilization"),
        idle.alias("idle_share"), half_up(F.greatest(F.lit(0.0), idle) * 100).alias("wastage_pct"), F.when(F.col("peak_cores") > 0, F.col("busy") / F.col("peak_cores")).otherwise(0.0).alias("floor_zero_skew_ms"),
        F.when((driver > 0) | (executor > 0), F.when(driver >= executor, "driver").otherwise("executor")).alias("dominant_waste"),
    )


def wasted_core_hours(alloc: DataFrame, aggregates: DataFrame, top: int = 5) -> DataFrame:
    """Allocated less busy core-hours, beside the `top` stages by task time."""
    order = F.row_number().over(Window.partitionBy("app_id").orderBy(F.desc("task_ms"), "stage_id"))
    best = aggregates.withColumn("rank", order).filter(F.col("rank") <= top)
    waste = F.greatest(F.lit(0.0), F.col("core_hours") - F.col("busy_core_ms") / MS_PER_HOUR)
    return best.join(alloc.select("app_id", "core_hours"), APP).select("app_id", waste.alias("wasted_core_hours"), "rank", "stage_id", "task_ms")


def _estimate(stages: DataFrame, cores: DataFrame) -> DataFrame:
    """Sum over stages of task time over the slots each can use, for every (app, cores) of `cores`."""
    each = F.col("task_ms") / F.least("cores", "tasks")
    return stages.join(cores, APP).groupBy("app_id", "cores").agg(F.sum(each).alias("model_ms"))


def core_what_if(aggregates: DataFrame, cores: DataFrame, active: DataFrame) -> DataFrame:
    """(app, pct, cores, est_ms, model_error_pct): run time in stages at other core counts, scaled to what was seen.

    cores: (app, total_cores); active: (app, active_ms). Stages meet only their own run's twelve counts.
    """
    base = cores.filter("total_cores > 0").select("app_id", "total_cores")
    grid = base.select("app_id", "total_cores", F.explode(F.array(*map(F.lit, WHAT_IF))).alias("pct"))
    grid = grid.withColumn("cores", F.greatest(F.lit(1), half_up(F.col("total_cores") * F.col("pct") / 100).cast("long")))
    stages = aggregates.select("app_id", "task_ms", "tasks")
    now = _estimate(stages, base.withColumnRenamed("total_cores", "cores")).select("app_id", F.col("model_ms").alias("now_ms"))
    at = grid.join(_estimate(stages, grid.select("app_id", "cores").distinct()), ["app_id", "cores"]).join(now, APP).join(active, APP)
    error = F.when(F.col("active_ms") > 0, half_up(F.abs(F.col("now_ms") - F.col("active_ms")) / F.col("active_ms") * 100))
    scale = F.when(F.col("now_ms") > 0, F.col("active_ms") / F.col("now_ms")).otherwise(1.0)
    return at.select("app_id", "pct", "cores", (F.col("model_ms") * scale).alias("est_ms"), error.alias("model_error_pct"))


def smallest_core_count(aggregates: DataFrame, cores: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """(app, total_cores, cores): the fewest cores at which the modelled time is within `tolerance` of that at all cores.

    With c cores a stage of n tasks takes its task time over min(c, n). So the time is fixed + shared / c from one task
    count to the next, with fixed the sum of task_ms / n over stages of up to that many tasks and shared the task time of
    the larger ones: a row for each task count of a run, in place of one for each core count and stage, has the answer.
    """
    base = cores.filter("total_cores > 0").select("app_id", "total_cores")
    work = aggregates.join(base, APP).select("app_id", "total_cores", F.least("tasks", "total_cores").alias("n"), "task_ms")
    steps = work.groupBy("app_id", "total_cores", "n").agg(F.sum("task_ms").cast("double").alias("ms"))
    upto, own = Window.partitionBy("app_id").orderBy("n"), Window.partitionBy("app_id")
    fixed = F.sum(F.col("ms") / F.col("n")).over(upto.rowsBetween(Window.unboundedPreceding, 0))
    shared = F.sum("ms").over(own) - F.sum("ms").over(upto.rowsBetween(Window.unboundedPreceding, 0))
    x = steps.select("app_id", "total_cores", "n", fixed.alias("fixed"), shared.alias("shared"), F.lead("n").over(upto).alias("_next"), F.sum(F.col("ms") / F.col("n")).over(own).alias("full_ms"))
    zero = x.groupBy("app_id", "total_cores").agg(F.min("n").alias("_next"), F.max("full_ms").alias("full_ms"))
    first = zero.join(steps.groupBy("app_id").agg(F.sum("ms").alias("shared")), APP).select("app_id", "total_cores", F.lit(1).cast("long").alias("n"), F.lit(0.0).alias("fixed"), "shared", "_next", "full_ms").filter("_next > 1")
    x = x.unionByName(first)
    allowed = F.col("full_ms") * (1 + tolerance)
    # Within a step the least c with fixed + shared / c <= allowed.
    least = F.when(F.col("shared") <= 0, F.when(F.col("fixed") <= allowed, F.col("n"))).when(allowed > F.col("fixed"), F.greatest(F.col("n"), F.ceil(F.col("shared") / (allowed - F.col("fixed")))))
    near = F.explode(F.array(F.greatest(F.col("n"), F.col("least") - 1), F.col("least"), F.col("least") + 1))  # rounding may be off by one
    x = x.withColumn("least", least).filter("least IS NOT NULL").withColumn("cores", near)
    good = (F.col("cores") <= F.coalesce("_next", "total_cores")) & (F.col("fixed") + F.col("shared") / F.col("cores") <= allowed)
    return x.filter(good & (F.col("cores") <= F.col("total_cores"))).groupBy("app_id", "total_cores").agg(F.min("cores").alias("cores"))


def non_local_ratio(locality: DataFrame, top: int = 5, least_tasks: int = 10) -> DataFrame:
    """Share of tasks at rack distance or further, by run, beside the `top` stages of at least `least_tasks` tasks."""
    far = F.sum(F.when(F.col("locality").isin("RACK_LOCAL", "ANY"), F.col("tasks")).otherwise(0))
    run = locality.groupBy(APP).agg((far / F.sum("tasks")).alias("ratio"))
    stages = locality.groupBy("app_id", "stage_id").agg(far.alias("non_local"), F.sum("tasks").alias("tasks")).filter(F.col("tasks") >= least_tasks)
    stages = stages.withColumn("stage_ratio", F.col("non_local") / F.col("tasks"))
    order = F.row_number().over(Window.partitionBy("app_id").orderBy(F.desc("stage_ratio"), F.desc("non_local"), "stage_id"))
    return stages.withColumn("rank", order).filter(F.col("rank") <= top).join(run, APP).select("app_id", "ratio", "rank", "stage_id", "stage_ratio")


def etl_phases(tasks: DataFrame, windows: DataFrame) -> DataFrame:
    """(app, phase, ms): extract reads input and no shuffle, transform shuffles, load writes output; each an interval union."""
    s = tasks.groupBy("app_id", "stage_id").agg(*[F.sum(c).alias(c) for c in ("input_bytes", "shuffle_read", "shuffle_write", "output_bytes")]).join(windows, ["app_id", "stage_id"])
    phases = F.array_compact(F.array(
        F.when((F.col("input_bytes") > 0) & (F.col("shuffle_read") == 0), "extract"), F.when((F.col("shuffle_read") > 0) | (F.col("shuffle_write") > 0), "transform"), F.when(F.col("output_bytes") > 0, "load"),
    ))
    rows = s.select("app_id", F.explode(phases).alias("phase"), "submitted_ms", "completed_ms")
    return islands(rows, ["app_id", "phase"], "submitted_ms", "completed_ms").groupBy("app_id", "phase").agg(F.sum(F.col("completed_ms") - F.col("submitted_ms")).alias("ms"))


def scorecard(clock: DataFrame, model: DataFrame) -> DataFrame:
    """Share of the run in stages, wastage, a flag for each, and why a figure is missing."""
    x = clock.join(model, APP, "left")
    good = F.when(F.col("total_ms") > 0, half_up(F.col("active_ms") / F.col("total_ms") * 100))

    def flag(v: Column) -> Column:
        return F.when(v >= GOOD_EFFICIENCY, "good").when(v >= FAIR_EFFICIENCY, "fair").when(v.isNotNull(), "poor")

    return x.select("app_id", good.alias("efficiency_pct"), "wastage_pct", flag(good).alias("efficiency_flag"), flag(100 - F.col("wastage_pct")).alias("wastage_flag"), F.when(F.col("allocated_core_ms").isNull(), "no executor cores in the log").alias("unavailable"))


def job_outcome(jobs: DataFrame) -> DataFrame:
    ended = jobs.filter("end_ms IS NOT NULL")
    failed = ~F.col("succeeded")
    return ended.groupBy(APP).agg(F.count_if(failed).alias("failed"), F.count("*").alias("total"), F.array_join(F.sort_array(F.collect_set(F.when(failed, F.col("job_id")))), ",").alias("failed_ids"))


def overlapping_job_groups(jobs: DataFrame) -> DataFrame:
    """(app, group_a, group_b): groups of jobs, by execution, whose time spans overlap; found by time slices."""
    g = jobs.filter("start_ms IS NOT NULL AND end_ms IS NOT NULL").groupBy("app_id", "execution_id").agg(F.min("start_ms").alias("s"), F.max("end_ms").alias("e"))
    a, b = g.select("app_id", F.col("execution_id").alias("group_a"), F.col("s").alias("a_s"), F.col("e").alias("a_e")), g.select("app_id", F.col("execution_id").alias("group_b"), F.col("s").alias("b_s"), F.col("e").alias("b_e"))
    return overlaps(a, b, APP, "a_s", "a_e", "b_s", "b_e").filter("group_a < group_b").select("app_id", "group_a", "group_b")


def locality_by_time(stages: DataFrame, locality: DataFrame, timing: DataFrame, apps: DataFrame, least_ms: int = 60_000, buckets: int = 60) -> DataFrame:
    """(app, bucket, tier, cores): mean cores busy at each locality over even buckets from the run's start.

    A bucket is a 60th of the run, a minute at least. A stage's mean concurrency is spread over its window and split by
    the localities of its tasks; the last bucket is averaged over the part the run fills.
    """
    run = timing.join(apps.select("app_id", "start_ms"), APP).filter("duration_ms > 0").select("app_id", "start_ms", "duration_ms", F.greatest(F.lit(least_ms), F.ceil(F.col("duration_ms") / buckets)).alias("width"))
    own = ["app_id", "stage_id"]
    share = locality.join(locality.groupBy(own).agg(F.sum("tasks").alias("_all")), own).select(*own, F.col("locality").alias("tier"), (F.col("tasks") / F.col("_all")).alias("share"))
    s = stages.filter("completed_ms > submitted_ms").select(*own, "submitted_ms", "completed_ms", (F.col("run_ms") / (F.col("completed_ms") - F.col("submitted_ms"))).alias("busy")).join(run, APP)
    at = lambda c: F.floor((F.col(c) - F.col("start_ms")) / F.col("width"))
    s = s.withColumn("bucket", F.explode(F.sequence(at("submitted_ms"), F.floor((F.col("completed_ms") - 1 - F.col("start_ms")) / F.col("width")))))
    begin = F.col("start_ms") + F.col("bucket") * F.col("width")
    end = F.least(begin + F.col("width"), F.col("start_ms") + F.col("duration_ms"))
    part = F.greatest(F.lit(0), F.least("completed_ms", end) - F.greatest("submitted_ms", begin))
    s = s.withColumn("mean", part * F.col("busy") / F.greatest(F.lit(1), end - begin))
    return s.join(share, own).groupBy("app_id", "bucket", "tier").agg(F.sum(F.col("mean") * F.col("share")).alias("cores"))
