"""Stage statistics: every figure grouped by application and stage over the winning task records."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.intervals import sweep, union_ms
from ..functions.quantiles import quantiles, quantiles_of
from ..functions.units import MIB

STAGE = ["app_id", "stage_id"]

#: Multiples of the median task from which a task is in the tail, or a straggler.
TAIL_FACTOR, STRAGGLER_FACTOR = 3, 4
#: Shares of tasks without spill that make a spill one of skew, or of volume.
SKEW_SHARE, VOLUME_SHARE = 0.8, 0.2
#: Volume floors of a median task, and what concentrates a tail on one host.
VOLUME_BYTES, VOLUME_RECORDS, HOST_TASKS, HOST_SHARE, HOST_MULTIPLE = MIB, 1000, 3, 0.5, 2

SUMS = ("shuffle_read", "shuffle_write", "fetch_wait_ms", "mem_spilled", "disk_spilled", "gc_ms", "run_ms", "cpu_ns", "input_bytes", "output_bytes")


def median(x: Column | str) -> Column:
    return F.percentile(x, F.lit(0.5))


def nearest_rank(x: str, p: float) -> Column:
    return F.expr(f"CAST(percentile_disc({p}) WITHIN GROUP (ORDER BY {x}) AS BIGINT)")


def stage_sums(tasks: DataFrame) -> DataFrame:
    """Counts and sums of a stage; output_records is null when no task states any."""
    return tasks.groupBy(STAGE).agg(
        F.count("*").alias("tasks"), F.count_if("failed").alias("failed_tasks"), F.count_if("speculative").alias("speculative_tasks"),
        *[F.sum(c).alias(c) for c in SUMS], F.sum("output_records").alias("output_records"), F.max("peak_mem").alias("peak_mem"),
    )


def stage_quantiles(tasks: DataFrame, cols: Sequence[str] = ("duration_ms", "shuffle_read", "mem_spilled", "disk_spilled")) -> DataFrame:
    """(stage, metric, p50, p95, max): the textbook median, the nearest rank and the largest value of each column."""
    names = F.array(*map(F.lit, cols))
    return quantiles_of(tasks, STAGE, cols).select(*STAGE, F.get(names, F.col("m")).alias("metric"), "p50", "p95", "max")


def stage_parts(tasks: DataFrame) -> DataFrame:
    """Counts, sums and first and last times of a stage's tasks by executor, host and locality: `stage_spans`, `host_stats`, `locality_stats` and the stages' and executors' times follow from these."""
    return tasks.groupBy(*STAGE, "executor_id", "host", "locality").agg(
        F.count("*").alias("tasks"), F.count_if("failed").alias("failed_tasks"), F.count_if(~F.col("failed")).alias("good_tasks"), F.count_if("speculative").alias("speculative_tasks"),
        *[F.sum(c).alias(c) for c in SUMS], F.sum("output_records").alias("output_records"), F.sum("duration_ms").alias("task_ms"),
        F.min("launch_ms").alias("launch_ms"), F.max("finish_ms").alias("finish_ms"),
    )


def host_parts(parts: DataFrame) -> DataFrame:
    """`host_stats` from `stage_parts`, with good_tasks, those that didn't fail."""
    return parts.filter("host <> ''").groupBy(*STAGE, "host").agg(F.sum("tasks").alias("tasks"), F.sum("task_ms").alias("total_ms"), F.sum("good_tasks").alias("good_tasks"))


def host_stats(tasks: DataFrame) -> DataFrame:
    return tasks.filter("host <> ''").groupBy(*STAGE, "host").agg(F.count("*").alias("tasks"), F.sum("duration_ms").alias("total_ms"))


def executor_stats(tasks: DataFrame) -> DataFrame:
    """Counts and byte sums by executor, and the sum and squared deviations of ln(1 + x) for time, input and shuffle."""
    shuffled = F.col("shuffle_read") + F.col("shuffle_write")
    logs = {"duration": F.log1p("duration_ms"), "input": F.log1p("input_bytes"), "shuffle": F.log1p(shuffled)}
    return tasks.groupBy(*STAGE, "executor_id").agg(
        F.count("*").alias("tasks"), F.sum("duration_ms").alias("total_ms"), *[F.sum(c).alias(c) for c in ("input_bytes", "shuffle_read", "shuffle_write")],
        *[x for k, v in logs.items() for x in (F.sum(v).alias(f"log_{k}_sum"), (F.var_pop(v) * F.count("*")).alias(f"log_{k}_m2"))],
    )


def locality_stats(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy(*STAGE, "locality").agg(F.count("*").alias("tasks"))


def failure_stats(failures: DataFrame, samples: int = 20) -> DataFrame:
    """(stage, reason, n, sample task ids, the first `samples`) of failed tasks, most frequent reason first by rank.

    Samples are taken by a running number within each reason, after which at most `samples` rows of a reason are gathered.
    """
    count = failures.groupBy(*STAGE, "reason").agg(F.count("*").alias("n"), F.min("task_id").alias("first"))
    first = failures.withColumn("_i", F.row_number().over(Window.partitionBy(*STAGE, "reason").orderBy("task_id"))).filter(F.col("_i") <= samples)
    picked = first.groupBy(*STAGE, "reason").agg(F.sort_array(F.collect_list("task_id")).alias("samples"))
    rank = F.row_number().over(Window.partitionBy(*STAGE).orderBy(F.desc("n"), "first"))
    return count.join(picked, [*STAGE, "reason"]).withColumn("rank", rank).select(*STAGE, "reason", "n", "rank", "samples")


def spill_class(tasks: DataFrame) -> DataFrame:
    share = F.avg((F.col("mem_spilled") == 0).cast("int"))
    named = F.when(F.sum("mem_spilled") <= 0, "unclassified").when(share >= SKEW_SHARE, "skew").when(share < VOLUME_SHARE, "volume").otherwise("unclassified")
    return tasks.groupBy(STAGE).agg(named.alias("spill_class"))


def with_medians(tasks: DataFrame, medians: DataFrame | None = None) -> DataFrame:
    """Tasks with their stage's median duration as p50: a join with one row a stage, which adaptive execution can split."""
    p50 = quantiles(tasks, STAGE, "duration_ms") if medians is None else medians
    return tasks.join(p50.select(*STAGE, "p50"), STAGE)


def stragglers(tasks: DataFrame, factor: int = STRAGGLER_FACTOR, medians: DataFrame | None = None) -> DataFrame:
    """Tasks over `factor` medians: count, their time over the median, and the longest task that isn't one. Zeros with a median of 0."""
    slow = (F.col("p50") > 0) & (F.col("duration_ms") > factor * F.col("p50"))
    fine = (F.col("p50") > 0) & ~slow
    zero = F.lit(0.0)
    return with_medians(tasks, medians).groupBy(STAGE).agg(
        F.count_if(slow).alias("stragglers"), F.coalesce(F.sum(F.when(slow, F.col("duration_ms") - F.col("p50"))), zero).alias("excess_ms"),
        F.coalesce(F.max(F.when(fine, F.col("duration_ms"))), F.lit(0)).alias("longest_ok_ms"),
    )


def _medians(tasks: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(stage, n, m_<column>): rows and medians of a stage. Rows alike in all columns are counted first, then equal values, so that the percentiles see one row a value."""
    alike = tasks.groupBy(*STAGE, *[F.col(c).cast("double").alias(c) for c in cols]).agg(F.count("*").alias("c"))
    values = alike.select(*STAGE, "c", F.explode(F.array(*[F.struct(F.lit(i).alias("m"), F.col(c).alias("x")) for i, c in enumerate(cols)])).alias("v"))
    counts = values.groupBy(*STAGE, "v.m", "v.x").agg(F.sum("c").alias("c"))
    own = lambda i: F.percentile(F.when(F.col("m") == i, F.col("x")), F.lit(0.5), F.col("c"))
    return counts.groupBy(STAGE).agg(F.sum(F.when(F.col("m") == 0, F.col("c"))).alias("n"), *[own(i).alias(f"m_{c}") for i, c in enumerate(cols)])


def tail_attribution(tasks: DataFrame, factor: int = TAIL_FACTOR, medians: DataFrame | None = None, keep: Callable[[DataFrame], DataFrame] = lambda df: df, hosts: DataFrame | None = None) -> DataFrame:
    """What explains the time of tasks over `factor` medians, by stage with such a tail.

    Each tail task's time over the median goes to the data it read, compared with the median task's, to garbage
    collection and to fetch waits over the medians', in this order; with a median task that read next to nothing, data
    takes what the two others leave, if the task read any. What remains goes to one host, if most of the tail is there.
    Failed tasks are left out. medians: a frame with each stage's p50, where it is known. `keep` is applied to the medians, which tasks are joined with, and to the tail's tasks. hosts: `host_parts`, where they are known.
    """
    good = tasks.filter(~F.col("failed")).withColumn("bytes", F.col("input_bytes") + F.col("shuffle_read"))
    p50 = tasks.groupBy(STAGE).agg(median("duration_ms").alias("p50")) if medians is None else medians.select(*STAGE, "p50")
    meds = keep(p50.join(_medians(good, ("bytes", "records_read", "gc_ms", "fetch_wait_ms")), STAGE))
    t = good.join(meds, STAGE).filter((F.col("p50") > 0) & (F.col("duration_ms") > factor * F.col("p50")))
    by_bytes, by_records = F.col("m_bytes") >= VOLUME_BYTES, F.col("m_records_read") >= VOLUME_RECORDS
    ratio = F.greatest(F.when(by_bytes, F.col("bytes") / F.col("m_bytes")).otherwise(0.0), F.when(by_records, F.col("records_read") / F.col("m_records_read")).otherwise(0.0))
    t = t.withColumn("excess", F.col("duration_ms") - F.col("p50")).withColumn("compared", by_bytes | by_records).withColumn("ratio", F.when(F.col("compared"), ratio))
    t = t.withColumn("data1", F.when(F.col("compared"), F.least(F.col("excess"), F.greatest(F.lit(0.0), F.col("p50") * (F.col("ratio") - 1)))).otherwise(0.0))
    t = t.withColumn("gc", F.least(F.col("excess") - F.col("data1"), F.greatest(F.lit(0.0), F.col("gc_ms") - F.col("m_gc_ms"))))
    t = t.withColumn("fetch", F.least(F.col("excess") - F.col("data1") - F.col("gc"), F.greatest(F.lit(0.0), F.col("fetch_wait_ms") - F.col("m_fetch_wait_ms"))))
    reads = (F.col("bytes") >= VOLUME_BYTES) | (F.col("records_read") >= VOLUME_RECORDS)
    rest = F.col("excess") - F.col("data1") - F.col("gc") - F.col("fetch")
    t = t.withColumn("data", F.col("data1") + F.when(~F.col("compared") & reads, rest).otherwise(0.0)).withColumn("left", F.col("excess") - F.col("data") - F.col("gc") - F.col("fetch"))
    t = keep(t.select(*STAGE, "host", "n", "excess", "data", "gc", "fetch", "left", "ratio", "run_ms", "cpu_ns"))

    on_host = t.filter("host <> ''").groupBy(*STAGE, "host").agg(F.count("*").alias("tail_here"), F.sum("left").alias("left_here"))
    everywhere = good.filter("host <> ''").groupBy(*STAGE, "host").agg(F.count("*").alias("all_here")) if hosts is None else hosts.select(*STAGE, "host", F.col("good_tasks").alias("all_here"))
    top = on_host.join(everywhere, [*STAGE, "host"]).groupBy(STAGE).agg(F.max_by(F.struct("host", "tail_here", "left_here", "all_here"), F.struct("tail_here", "host")).alias("top"))
    sums = t.groupBy(STAGE).agg(
        F.count("*").alias("tail_tasks"), F.first("n").alias("n"), F.sum("excess").alias("excess_ms"), F.sum("data").alias("data_ms"), F.sum("gc").alias("gc_ms"),
        F.sum("fetch").alias("fetch_ms"), median("ratio").alias("data_ratio"),
        F.when(F.sum("run_ms") > 0, F.sum("cpu_ns") / 1e6 / F.sum("run_ms") * 100).alias("cpu_pct"),
    )
    share = F.col("top.tail_here") / F.col("tail_tasks")
    held = (F.col("top.tail_here") >= HOST_TASKS) & (share >= HOST_SHARE) & (share / (F.col("top.all_here") / F.col("n")) >= HOST_MULTIPLE)
    out = sums.join(top, STAGE, "left").withColumn("held", F.coalesce(held, F.lit(False)))
    return out.select(*STAGE, "tail_tasks", "excess_ms", "data_ms", "gc_ms", "fetch_ms", F.when(F.col("held"), F.col("top.left_here")).otherwise(0.0).alias("host_ms"), F.when(F.col("held"), F.col("top.host")).alias("host"), F.when(F.col("held"), F.col("top.tail_here")).alias("host_tasks"), "data_ratio", "cpu_pct")


def active_ms(tasks: DataFrame) -> DataFrame:
    """Time with at least one task running."""
    return union_ms(tasks.filter("launch_ms > 0 AND finish_ms > launch_ms"), STAGE, "launch_ms", "finish_ms", "active_ms")


def peak_concurrency(tasks: DataFrame) -> DataFrame:
    """Most tasks at once; a task that ends as another starts makes room first."""
    return sweep(tasks.filter("launch_ms > 0"), STAGE, "launch_ms", "finish_ms").groupBy(STAGE).agg(F.max("busy").alias("peak_tasks"))


def concurrency(tasks: DataFrame) -> DataFrame:
    """(stage, peak_tasks, active_ms), as of `peak_concurrency` and `active_ms`, from one sweep."""
    length = F.when(F.col("busy") > 0, F.col("to_ms") - F.col("from_ms"))
    return sweep(tasks.filter("launch_ms > 0"), STAGE, "launch_ms", "finish_ms").groupBy(STAGE).agg(F.max("busy").alias("peak_tasks"), F.sum(length).alias("active_ms"))


def _recovery() -> list[Column]:
    """recovery_ms, removed_ms and longest_after_ms from longest, p50, peak_tasks and the columns of `stragglers`."""
    single = F.greatest(F.lit(0.0), F.col("longest") - F.col("p50"))
    spread = F.when((F.col("excess_ms") > 0) & (F.col("peak_tasks") > 0), F.greatest(single, F.col("excess_ms") / F.col("peak_tasks"))).otherwise(single)
    after = F.when(F.col("stragglers") > 0, F.greatest(F.col("p50"), F.col("longest_ok_ms"))).otherwise(F.col("p50"))
    return [spread.alias("recovery_ms"), F.greatest(single, "excess_ms").alias("removed_ms"), after.alias("longest_after_ms")]


def tail_recovery(tasks: DataFrame) -> DataFrame:
    """What removing the tail gives: wall clock, task time, and the longest task left.

    The closed form: the longest task's excess, or all straggler excess spread over the slots the stage had.
    """
    peaks = quantiles(tasks, STAGE, "duration_ms").select(*STAGE, F.col("max").alias("longest"), "p50")
    x = peaks.join(stragglers(tasks, medians=peaks), STAGE).join(peak_concurrency(tasks), STAGE, "left")
    return x.select(*STAGE, *_recovery())


def stage_ratios(tasks: DataFrame) -> DataFrame:
    gc = F.when(F.sum("run_ms") > 0, F.sum("gc_ms") / F.sum("run_ms") * 100).otherwise(0.0)
    return tasks.groupBy(STAGE).agg(gc.alias("gc_pct"), F.when(F.sum("shuffle_read") > 0, "REDUCE").otherwise("MAP").alias("stage_type"))


def duration_histogram(tasks: DataFrame, bins: int = 20) -> DataFrame:
    """(stage, bin from 1, n): counts of durations in `bins` even bins from 0 to the longest; the longest is in the last bin."""
    x = tasks.join(tasks.groupBy(STAGE).agg(F.max("duration_ms").alias("longest")), STAGE)
    i = F.when(F.col("longest") > 0, F.least(F.lit(bins), F.floor(F.col("duration_ms") * bins / F.col("longest")) + 1)).otherwise(1)
    return x.groupBy(*STAGE, i.cast("bigint").alias("bin")).agg(F.count("*").alias("n"))


def stage_cores(tasks: DataFrame, executors: DataFrame) -> DataFrame:
    """(stage, stage_cores): cores of the executors that ran the stage's tasks."""
    own = executors.groupBy("app_id", "executor_id").agg(F.max("cores").alias("cores"))
    return tasks.select(*STAGE, "executor_id").distinct().join(own, ["app_id", "executor_id"]).groupBy(STAGE).agg(F.sum("cores").alias("stage_cores"))


def stage_spans(tasks: DataFrame) -> DataFrame:
    """Sums of a stage, as of `stage_sums`, with its task time and the time from its first launch to its last end, in one pass."""
    return tasks.groupBy(STAGE).agg(
        F.count("*").alias("tasks"), F.count_if("failed").alias("failed_tasks"), F.count_if("speculative").alias("speculative_tasks"),
        *[F.sum(c).alias(c) for c in SUMS], F.sum("output_records").alias("output_records"), F.sum("duration_ms").alias("task_ms"),
        F.min("launch_ms").alias("submitted_ms"), F.max("finish_ms").alias("completed_ms"),
    )


def span_parts(parts: DataFrame) -> DataFrame:
    """`stage_spans` from `stage_parts`."""
    added = ("tasks", "failed_tasks", "speculative_tasks", *SUMS, "output_records", "task_ms")
    return parts.groupBy(STAGE).agg(*[F.sum(c).alias(c) for c in added], F.min("launch_ms").alias("submitted_ms"), F.max("finish_ms").alias("completed_ms"))


#: Columns of the stage table that are quantiles: metric, then (quantile, name).
_QUANTILES = {"duration_ms": (("p50", "p50"), ("p95", "p95"), ("max", "longest")), "shuffle_read": (("p50", "shuffle_p50"), ("max", "shuffle_max")), "mem_spilled": (("p50", "spill_p50"), ("max", "spill_max")), "disk_spilled": (("p50", "disk_p50"), ("max", "disk_max"))}


def stage_table(tasks: DataFrame, windows: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda df: df, peaks: DataFrame | None = None, spans: DataFrame | None = None) -> DataFrame:
    """One wide row a stage: what the detectors and estimates read.

    One pass over the tasks for the sums, one for the quantiles, one for the stragglers, one for the sweep. `keep` is
    applied to sums and quantiles, which the stragglers read too. peaks: `concurrency`, spans: `stage_spans`, where they are known.
    """
    q = stage_quantiles(tasks)
    wide = q.groupBy(STAGE).agg(*[F.max(F.when(F.col("metric") == m, F.col(c))).alias(name) for m, names in _QUANTILES.items() for c, name in names])
    one = keep((stage_spans(tasks) if spans is None else spans).drop("submitted_ms", "completed_ms").join(wide, STAGE))
    peaks = peak_concurrency(tasks) if peaks is None else peaks.select(*STAGE, "peak_tasks")
    x = one.join(stragglers(tasks, medians=one), STAGE).join(peaks, STAGE, "left")
    return x.select(*one.columns, "stragglers", "excess_ms", "longest_ok_ms", *_recovery()).join(windows, STAGE).withColumn("stage_ms", F.col("completed_ms") - F.col("submitted_ms"))
