"""What a stage's time is worth: shares of contended time, floors under a fix, savings and bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.intervals import islands, overlaps, sweep

STAGE = ["app_id", "stage_id"]
#: Gate from which a stage counts as alone, and shares of the run at which savings warn or are critical.
SERIAL_GATE, WARN_SHARE, CRITICAL_SHARE, CORE_SHARE = 0.999, 0.005, 0.02, 0.02
#: Types whose band comes from what happened, not from savings.
FAILURE_TYPES = ("failures", "stageFailed", "jobFailureRate", "incompleteRun")


def occupancy(stages: DataFrame) -> DataFrame:
    """(app, stage, occupancy_ms): each instant with stages split among them by mean concurrency, evenly if all have none."""
    s = stages.filter("completed_ms > submitted_ms").select(*STAGE, "submitted_ms", "completed_ms", (F.col("run_ms") / (F.col("completed_ms") - F.col("submitted_ms"))).alias("w"))
    segments = sweep(s, ["app_id"], "submitted_ms", "completed_ms").filter("busy > 0").select("app_id", "from_ms", "to_ms")
    pairs = overlaps(segments, s, ["app_id"], "from_ms", "to_ms", "submitted_ms", "completed_ms")
    totals = pairs.groupBy("app_id", "from_ms").agg(F.sum("w").alias("w_all"), F.count("*").alias("n_all"))
    share = F.when(F.col("w_all") > 0, F.col("w") / F.col("w_all")).otherwise(1 / F.col("n_all"))
    return pairs.join(totals, ["app_id", "from_ms"]).groupBy(STAGE).agg(F.sum(F.col("overlap_ms") * share).alias("occupancy_ms"))


def gate(stages: DataFrame) -> DataFrame:
    """(app, stage, gate): occupancy over duration, at most 1; how much of a stage's saved time the run saves."""
    own = stages.filter("completed_ms > submitted_ms").select(*STAGE, (F.col("completed_ms") - F.col("submitted_ms")).alias("ms"))
    return own.join(occupancy(stages), STAGE, "left").select(*STAGE, F.least(F.lit(1.0), F.coalesce("occupancy_ms", F.lit(0.0)) / F.col("ms")).alias("gate"))


def ceiling(stages: DataFrame, cores: DataFrame) -> DataFrame:
    """(app, stage, ceiling, core_floor): no fix makes a stage shorter than its longest task or its work over all cores."""
    x = stages.join(cores.select("app_id", "total_cores"), ["app_id"], "left")
    floor = F.when(F.col("total_cores") > 0, F.col("run_ms") / F.col("total_cores")).otherwise(0.0)
    return x.select(*STAGE, F.greatest(F.col("longest").cast("double"), floor).alias("ceiling"), floor.alias("core_floor"))


def estimate_stage(claims: DataFrame, stages: DataFrame, gates: DataFrame, ceilings: DataFrame) -> DataFrame:
    """Claims (app, stage, waste_ms, tail boolean, removed_ms, longest_after_ms, ...) gain basis, low_ms and high_ms.

    A tail claim shortens the longest task, down to what the fix leaves; any other is limited by that task. Of a stage
    that shares its time, at least the gate's part is saved.
    """
    facts = stages.select(*STAGE, F.col("run_ms").alias("_run"), F.col("longest").alias("_longest"), (F.col("completed_ms") - F.col("submitted_ms")).alias("_ms"))
    x = claims.join(facts, STAGE).join(gates, STAGE).join(ceilings.select(*STAGE, "core_floor"), STAGE)
    floor = F.when((F.col("removed_ms") > 0) & (F.col("_run") > 0), F.col("core_floor") * F.greatest(F.lit(0.0), 1 - F.col("removed_ms") / F.col("_run"))).otherwise(F.col("core_floor"))
    low_end = F.when(F.col("tail"), F.greatest(F.col("_longest") - F.col("waste_ms"), "longest_after_ms", floor)).otherwise(F.greatest(F.col("_longest").cast("double"), floor))
    high = F.least("waste_ms", F.greatest(F.lit(0.0), F.col("_ms") - low_end))
    serial = F.col("gate") >= SERIAL_GATE
    return x.select(*claims.columns, F.when(serial, "serial").otherwise("contended").alias("basis"), F.when(serial, high).otherwise(high * F.col("gate")).alias("low_ms"), high.alias("high_ms"))


def estimate_stages(estimates: DataFrame, stages: DataFrame, keys: list[str]) -> DataFrame:
    """Estimates of single stages summed by `keys`, at most the union of the stages' windows; serial only if all are."""
    sums = estimates.groupBy(keys).agg(F.sum("low_ms").alias("low"), F.sum("high_ms").alias("high"), F.bool_and(F.col("basis") == "serial").alias("serial"))
    spans = estimates.select(*keys, *[k for k in STAGE if k not in keys]).distinct().join(stages.select(*STAGE, "submitted_ms", "completed_ms"), STAGE)
    union = islands(spans, keys, "submitted_ms", "completed_ms").groupBy(keys).agg(F.sum(F.col("completed_ms") - F.col("submitted_ms")).alias("union_ms"))
    return sums.join(union, keys).select(*keys, F.when(F.col("serial"), "serial").otherwise("contended").alias("basis"), F.least("low", "union_ms").alias("low_ms"), F.least("high", "union_ms").alias("high_ms"))


def savings_band(saved: Column, run_ms: Column, core_share: Column) -> Column:
    """info, warning or critical by the share of the run saved; critical only for stages with enough of the task time."""
    share = saved / run_ms
    return F.when(run_ms.isNull() | (run_ms <= 0) | saved.isNull(), "info").when((share >= CRITICAL_SHARE) & (core_share >= CORE_SHARE), "critical").when(share >= WARN_SHARE, "warning").otherwise("info")


def grade(findings: DataFrame, stages: DataFrame, timing: DataFrame) -> DataFrame:
    """Findings (app, stage, type, high_ms, band, ...) with the band their savings give; failures keep theirs."""
    every = Window.partitionBy("app_id")
    work = stages.groupBy(STAGE).agg(F.sum("task_ms").alias("_task_ms")).withColumn("_core_share", F.col("_task_ms") / F.sum("_task_ms").over(every))
    x = findings.join(work, STAGE, "left").join(timing.select("app_id", F.col("duration_ms").alias("_run_ms")), ["app_id"], "left")
    band = F.when(F.col("type").isin(*FAILURE_TYPES) | F.col("high_ms").isNull(), F.col("band")).otherwise(savings_band(F.col("high_ms"), F.col("_run_ms"), F.coalesce("_core_share", F.lit(1.0))))
    return x.select(*[c for c in findings.columns if c != "band"], band.alias("band"))
