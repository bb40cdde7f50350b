"""Budgets: each a row (app, name, status, detail); status is pass, violation or inconclusive."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.units import GIB


def _budget(df: DataFrame, name: str, value: Column, limit: float, least: bool = False) -> DataFrame:
    """Violation beyond the limit, inconclusive without a value."""
    over = value < limit if least else value > limit
    return df.select("app_id", F.lit(name).alias("name"), F.when(value.isNull(), "inconclusive").when(over, "violation").otherwise("pass").alias("status"), value.cast("double").alias("detail"))


def max_runtime(timing: DataFrame, limit_ms: float) -> DataFrame:
    return _budget(timing, "max-runtime", F.when(F.col("complete"), F.col("duration_ms")), limit_ms)


def max_spill(stages: DataFrame, limit_gb: float) -> DataFrame:
    """The largest disk spill of a stage, in GB."""
    return _budget(stages.groupBy("app_id").agg(F.max("disk_spilled").alias("v")), "max-spill", F.col("v") / GIB, limit_gb)


def max_skew(stages: DataFrame, limit: float, tasks_for_p95: int = 20) -> DataFrame:
    """The largest skew ratio of a stage, computed anew, as findings have floors."""
    ratio = F.when(F.col("p50") > 0, F.when(F.col("tasks") >= tasks_for_p95, F.col("p95")).otherwise(F.col("longest")) / F.col("p50"))
    return _budget(stages.groupBy("app_id").agg(F.max(ratio).alias("v")), "max-skew", F.col("v"), limit)


def max_failed_task_rate(stages: DataFrame, pct: float) -> DataFrame:
    rate = F.sum("failed_tasks") / F.sum("tasks") * 100
    return _budget(stages.groupBy("app_id").agg(rate.alias("v")), "max-failed-task-rate", F.col("v"), pct)


def max_failed_attempt_rate(totals: DataFrame, pct: float) -> DataFrame:
    """Failed records of tasks over all of them, every attempt of a stage included; `totals` is `attempts.stage_totals`. A record that was tried again counts as failed."""
    tries = F.sum("tasks") + F.sum("retried_tasks")
    rate = F.when(tries > 0, (F.sum("failed_tasks") + F.sum("retried_tasks")) / tries * 100)
    return _budget(totals.groupBy("app_id").agg(rate.alias("v")), "max-failed-task-rate", F.col("v"), pct)


def no_failed_jobs(outcome: DataFrame) -> DataFrame:
    return _budget(outcome, "no-failed-jobs", F.col("failed"), 0)


def min_efficiency(model: DataFrame, pct: float) -> DataFrame:
    return _budget(model, "min-efficiency", F.col("utilization") * 100, pct, least=True)


def max_regression(deltas: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Of compared pairs (app_id is the candidate): relative change of each metric against its limit in percent."""
    parts = [_budget(deltas.filter(F.col("metric") == m).withColumnRenamed("cand_app", "app_id"), f"max-regression:{m}", F.col("relative") * 100, v) for m, v in limits.items()]
    return evaluate(*parts)


def max_stage_regression(deltas: DataFrame, metric: str, pct: float) -> DataFrame:
    """The largest relative growth of a metric over the paired stages."""
    grown = F.when(F.col("base") > 0, (F.col("cand") - F.col("base")) / F.col("base") * 100)
    return _budget(deltas.filter(F.col("metric") == metric).groupBy(F.col("cand_app").alias("app_id")).agg(F.max(grown).alias("v")), f"max-stage-regression:{metric}", F.col("v"), pct)


def fail_on_introduced(delta: DataFrame, runs: DataFrame, bands: tuple[str, ...] = ("critical",)) -> DataFrame:
    """Findings of these bands that only the candidate has, or that had another band in the base."""
    new = delta.filter((F.col("status") == "introduced") | ((F.col("status") == "changed") & ~F.col("from_band").isin(*bands))).filter(F.col("band").isin(*bands)).groupBy(F.col("cand_app").alias("app_id")).agg(F.count("*").alias("v"))
    return _budget(runs.select("app_id").join(new, ["app_id"], "left").na.fill(0, ["v"]), "fail-on-introduced", F.col("v"), 0)


def evaluate(*budgets: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, budgets)
