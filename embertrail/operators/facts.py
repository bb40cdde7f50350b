"""Facts about attempts: which record of a task counts, and what the others cost."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TASK = ["app_id", "stage_id", "task_index"]


def task_winners(attempts: DataFrame) -> DataFrame:
    """One record for each (app, stage, task_index): the first that succeeded, else the first. A null index is a task of its own."""
    numbered = attempts.filter("task_index IS NOT NULL").withColumn("_i", F.row_number().over(Window.partitionBy(TASK).orderBy("failed", "seq")))
    return numbered.filter("_i = 1").drop("_i").unionByName(attempts.filter("task_index IS NULL"))


def losers(attempts: DataFrame) -> DataFrame:
    """Records of a task behind the one that counts; _retry: one that came before it, or that no speculative copy beat."""
    order = Window.partitionBy(TASK).orderBy("failed", "seq")
    x = attempts.filter("task_index IS NOT NULL").withColumn("_i", F.row_number().over(order)).withColumn("_w", F.struct(*[F.first(c).over(order).alias(c) for c in ("seq", "failed", "speculative")])).filter("_i > 1")
    return x.withColumn("_retry", ~F.col("speculative") & ((F.col("seq") < F.col("_w.seq")) | F.col("_w.failed") | ~F.col("_w.speculative"))).drop("_w")


def wasted_attempts(attempts: DataFrame, lost: DataFrame | None = None) -> DataFrame:
    """(app, stage, retry_ms, retry_n, spec_ms, spec_n) of records that lost.

    A speculative loser is speculation waste. Another loser is retry waste, unless a speculative copy that succeeded came
    before it: that one overtook it, and the loser, killed or not, is neither. lost: `losers`, where they are known.
    """
    x = losers(attempts) if lost is None else lost
    retry, spec = F.col("_retry"), F.col("speculative")
    zero = F.lit(0).cast("long")
    return x.groupBy("app_id", "stage_id").agg(
        F.coalesce(F.sum(F.when(retry, F.col("duration_ms"))), zero).alias("retry_ms"), F.count_if(retry).alias("retry_n"),
        F.coalesce(F.sum(F.when(spec, F.col("duration_ms"))), zero).alias("spec_ms"), F.count_if(spec).alias("spec_n"),
    )


def retry_chains(attempts: DataFrame, lost: DataFrame | None = None) -> DataFrame:
    """(app, stage, chain, retry_n, retry_ms): most retries that one task of a stage wasted, and all of the stage's. Stages without any have no row."""
    per = (losers(attempts) if lost is None else lost).filter("_retry").groupBy(TASK).agg(F.count("*").alias("n"), F.sum("duration_ms").alias("ms"))
    return per.groupBy("app_id", "stage_id").agg(F.max("n").alias("chain"), F.sum("n").alias("retry_n"), F.sum("ms").alias("retry_ms"))


def late_work(tasks: DataFrame, stages: DataFrame) -> DataFrame:
    """(log, stage_id, kind, n, task_ms) of task ends that came after their stage was complete: speculation, or late work of failed or older attempts.

    tasks: task records with seq and attempt; stages: stage attempts with completed_seq.
    """
    last = stages.filter("latest AND completed_seq IS NOT NULL").select("log", "stage_id", F.col("attempt").alias("_latest"), "completed_seq")
    x = tasks.join(last, ["log", "stage_id"]).filter("seq > completed_seq")
    kind = F.when(F.col("speculative"), "speculation").when(F.col("failed") | (F.col("attempt") < F.col("_latest")), "late")
    return x.withColumn("kind", kind).filter("kind IS NOT NULL").groupBy("log", "stage_id", "kind").agg(F.count("*").alias("n"), F.sum("duration_ms").alias("task_ms"))


def earlier_attempts(tasks: DataFrame, stages: DataFrame) -> DataFrame:
    """(log, stage_id, attempts, n, task_ms, ...): what the attempts before the latest did; output_records null if none states them."""
    old = stages.filter("NOT latest").select("log", "stage_id", "attempt")
    x = tasks.join(old, ["log", "stage_id", "attempt"])
    sums = ("run_ms", "cpu_ns", "gc_ms", "shuffle_read", "shuffle_write", "fetch_wait_ms", "mem_spilled", "disk_spilled", "input_bytes", "output_bytes")
    work = x.groupBy("log", "stage_id").agg(F.count("*").alias("n"), F.sum("duration_ms").alias("task_ms"), *[F.sum(c).alias(c) for c in sums], F.sum("output_records").alias("output_records"), F.max("peak_mem").alias("peak_mem"))
    return old.groupBy("log", "stage_id").agg(F.count("*").alias("attempts")).join(work, ["log", "stage_id"], "left")
