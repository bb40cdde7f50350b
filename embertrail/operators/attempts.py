"""Work of every attempt of a stage: what its last record counts, and what that record leaves out.

tasks: task ends with seq, attempt, task_index; attempts: one row a submission with submitted_seq, completed_seq (null while it runs), failure.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import quantiles

STAGE = ["app_id", "stage_id"]
SUMS = ("run_ms", "cpu_ns", "gc_ms", "mem_spilled", "disk_spilled", "shuffle_read", "shuffle_write", "input_bytes", "output_bytes")
COUNTS = ("tasks", "failed_tasks", "retried_tasks")
#: Metrics of paired stages; CPU time is in ms, and null where no task states any.
PAIR_METRICS = ("run_ms", "cpu_ms", "mem_spilled", "disk_spilled", "input_bytes", "output_bytes", "shuffle_read", "shuffle_write")


def submissions(attempts: DataFrame) -> DataFrame:
    """Attempts with next_seq (the submission that replaces them) and closed_seq: their completion, if it came before that."""
    nxt = F.lead("submitted_seq").over(Window.partitionBy(*STAGE).orderBy("submitted_seq"))
    done = (F.col("completed_seq") > F.col("submitted_seq")) & (F.col("next_seq").isNull() | (F.col("completed_seq") < F.col("next_seq")))
    return attempts.withColumn("next_seq", nxt).withColumn("closed_seq", F.when(done, F.col("completed_seq")))


def task_parts(tasks: DataFrame, attempts: DataFrame) -> DataFrame:
    """Task ends with `part`, by the submission that was the last one when they came, and `retried`.

    own: counted by the stage's last submission; earlier: by one that was complete before the next; discarded: another record
    of the same task counts, or a copy that lost a race came behind the completion; late: behind the completion, of a
    submission that failed or of another attempt; null: counted nowhere (others that came late, and winners of a submission
    that was replaced while it ran). A record without index is a task of its own. retried: it lost without a race.
    """
    r = submissions(attempts).select(*STAGE, F.col("attempt").alias("_attempt"), "submitted_seq", "next_seq", "closed_seq", "failure")
    came = (F.col("seq") > F.col("submitted_seq")) & (F.col("next_seq").isNull() | (F.col("seq") < F.col("next_seq")))
    x = tasks.join(r, STAGE).filter(came).withColumn("_late", F.coalesce(F.col("seq") > F.col("closed_seq"), F.lit(False)))
    alone = F.when(F.col("task_index").isNull(), F.col("seq"))
    task = Window.partitionBy(*STAGE, "submitted_seq", "attempt", "task_index", alone).orderBy("_late", "failed", "seq")
    first = F.struct(*[F.first(c).over(task).alias(c) for c in ("_late", "failed", "speculative", "seq")])
    x = x.withColumn("_w", first)
    won = ~F.col("_w._late")
    kept = F.when(F.col("next_seq").isNull(), "own").when(F.col("closed_seq").isNotNull(), "earlier")
    raced = F.col("task_index").isNotNull() & (F.col("speculative") | (won & F.col("_w.speculative") & ~F.col("_w.failed")))
    strayed = F.col("failure").isNotNull() | (F.col("attempt") != F.col("_attempt"))
    behind = F.when(raced, "discarded").when(strayed, "late")
    part = F.when(F.col("_late"), behind).when(F.col("seq") == F.col("_w.seq"), kept).otherwise("discarded")
    beaten = ~F.col("speculative") & ((F.col("seq") < F.col("_w.seq")) | ~F.col("_w.speculative") | F.col("_w.failed"))
    retried = ~F.col("_late") & (F.col("seq") != F.col("_w.seq")) & beaten & kept.isNotNull()
    return x.withColumn("part", part).withColumn("retried", retried).drop("_w", "_late", "_attempt", "submitted_seq", "next_seq", "closed_seq", "failure")


def attempt_work(parts: DataFrame) -> DataFrame:
    """(app, stage, part, counts, sums, output_records, peak_mem): output_records is null if no task states any; discarded records count as retried, not as tasks."""
    whole = F.col("part") != "discarded"
    return parts.filter("part IS NOT NULL").groupBy(*STAGE, "part").agg(
        F.count_if(whole).alias("tasks"), F.count_if(whole & F.col("failed")).alias("failed_tasks"), F.count_if("retried").alias("retried_tasks"),
        *[F.sum(c).alias(c) for c in SUMS], F.sum("output_records").alias("output_records"), F.max("peak_mem").alias("peak_mem"),
    )


def skew_ratios(parts: DataFrame, tasks_for_p95: int = 20) -> DataFrame:
    """(app, stage, skew): of the last submission, the 95th percentile (the longest of few tasks) over the median; null without a median."""
    q = quantiles(parts.filter("part = 'own'"), STAGE, "duration_ms")
    return q.select(*STAGE, F.when(F.col("p50") > 0, F.when(F.col("n") >= tasks_for_p95, F.col("p95")).otherwise(F.col("max")) / F.col("p50")).alias("skew"))


def stage_totals(work: DataFrame, attempts: DataFrame) -> DataFrame:
    """One row a stage, over all its attempts: counts, sums, output_records, peak_mem, attempts, failed_attempts, and duration_ms of the last submission and of those complete before the next.

    Stages without tasks have counts and sums of 0; a duration that isn't known is null.
    """
    sums = work.groupBy(STAGE).agg(*[F.sum(c).alias(c) for c in (*COUNTS, *SUMS, "output_records")], F.max("peak_mem").alias("peak_mem"))
    took = F.col("completed_ms") - F.col("submitted_ms")
    counted = (F.col("next_seq").isNull() | F.col("closed_seq").isNotNull()) & (took >= 0)
    tries = submissions(attempts).groupBy(STAGE).agg(F.count("*").alias("attempts"), F.count("failure").alias("failed_attempts"), F.sum(F.when(counted, took)).alias("duration_ms"))
    return tries.join(sums, STAGE, "left").na.fill(0, [*COUNTS, *SUMS])


def _block(totals: DataFrame, keys: Sequence[str], *more: Column) -> DataFrame:
    """Figures of groups of stages: null, not 0, where no task ended or none states the figure."""
    seen = F.sum("tasks") > 0
    known = lambda c: F.when(seen, F.sum(c)).alias(c)
    cpu = F.when(seen & (F.sum("cpu_ns") > 0), F.sum("cpu_ns") / 1e6).alias("cpu_ms")
    peak = F.when(seen & (F.max("peak_mem") > 0), F.max("peak_mem")).alias("peak_mem")
    return totals.groupBy(*keys).agg(known("tasks"), known("failed_tasks"), known("retried_tasks"), cpu, *[known(c) for c in SUMS if c != "cpu_ns"], known("output_records"), peak, F.sum("duration_ms").alias("stage_ms"), F.max("skew").alias("skew"), *more)


def run_totals(totals: DataFrame, timing: DataFrame) -> DataFrame:
    """One row a run: its figures over all attempts, stages, failed attempts, stages with more than one, the largest skew, Python's share of run time (null without any), wall clock and whether the log ends.

    totals: `stage_totals` with skew and is_python.
    """
    python = F.when(F.col("is_python"), F.col("run_ms")).otherwise(0)
    share = F.when(F.sum("run_ms") > 0, F.sum(python) / F.sum("run_ms")).alias("python_share")
    block = _block(totals, ["app_id"], F.count("*").alias("stages"), F.sum("failed_attempts").alias("failed_stage_attempts"), F.count_if(F.col("attempts") > 1).alias("retried_stages"), share)
    return timing.select("app_id", "complete", F.col("duration_ms").alias("wall_ms")).join(block, ["app_id"], "left")


def fingerprint_rows(totals: DataFrame, identity: DataFrame) -> DataFrame:
    """One row a run and identity, over all attempts of the stages that share it, with their ids in order and whether any failed, was repeated, or ran Python."""
    flags = [F.bool_or(c).alias(n) for n, c in (("failed", F.col("failed_attempts") > 0), ("retried", F.col("attempts") > 1), ("python", F.coalesce("is_python", F.lit(False))))]
    return _block(totals.join(identity, STAGE), ["app_id", "identity"], F.array_sort(F.collect_list("stage_id")).alias("stage_ids"), *flags)


def attempt_deltas(matches: DataFrame, totals: DataFrame) -> DataFrame:
    """(pair, metric, base, cand, delta) of paired stages over all their attempts; delta is null where a side states nothing."""
    figures = totals.withColumn("cpu_ms", F.when(F.col("cpu_ns") > 0, F.col("cpu_ns") / 1e6))
    long = figures.select(*STAGE, F.explode(F.create_map(*[x for m in PAIR_METRICS for x in (F.lit(m), F.col(m).cast("double"))])).alias("metric", "v"))
    b = long.select(F.col("app_id").alias("base_app"), F.col("stage_id").alias("base_stage"), "metric", F.col("v").alias("base"))
    c = long.select(F.col("app_id").alias("cand_app"), F.col("stage_id").alias("cand_stage"), "metric", F.col("v").alias("cand"))
    x = matches.join(b, ["base_app", "base_stage"]).join(c, ["cand_app", "cand_stage", "metric"])
    return x.select("base_app", "cand_app", "base_stage", "cand_stage", "metric", "base", "cand", (F.col("cand") - F.col("base")).alias("delta"))
