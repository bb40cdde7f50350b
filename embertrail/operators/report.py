"""What a reader gets: the catalog of checks, what ran clean, verdicts, drill-downs, and files of it all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .detectors import THRESHOLDS

#: What each check is about, and the evidence it needs.
SCOPES = {"skew": "stage", "straggler": "stage", "spill": "stage", "shuffle": "stage", "partitionSizing": "stage", "stageShape": "stage", "failures": "stage", "retryWaste": "stage", "gc": "stage", "slowHost": "stage", "stageSlowness": "stage", "speculationWaste": "stage", "tinyTask": "stage", "coldStart": "app", "utilization": "app", "rightSizing": "app", "coreLocality": "app", "autoscalingChurn": "app", "jobFailureRate": "app", "incompleteRun": "app"}
NEEDS = {"coldStart": "executors", "utilization": "executors", "rightSizing": "executors", "autoscalingChurn": "executors", "jobFailureRate": "jobs"}


def detector_catalog(spark: SparkSession) -> DataFrame:
    """(type, scope, place, needs, thresholds): one row a check."""
    rows = [(k, s, i, NEEDS.get(k, "tasks"), {n: float(v) for n, v in THRESHOLDS.get(k, {}).items()}) for i, (k, s) in enumerate(SCOPES.items())]
    return spark.createDataFrame(rows, "type string, scope string, place int, needs string, thresholds map<string,double>")


def evidence(apps: DataFrame, **tables: DataFrame) -> DataFrame:
    """(app_id, key, n, state): rows of each table by run; present, or notEmitted where there is none."""
    parts = []
    for key, df in tables.items():
        n = apps.select("app_id").join(df.groupBy("app_id").agg(F.count("*").alias("n")), ["app_id"], "left").na.fill(0, ["n"])
        parts.append(n.select("app_id", F.lit(key).alias("key"), "n", F.when(F.col("n") > 0, "present").otherwise("notEmitted").alias("state")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def check_coverage(catalog: DataFrame, findings: DataFrame, ledger: DataFrame, ran: Sequence[str]) -> DataFrame:
    """(app_id, type, state, reason): checks without a finding, clean where they are among `ran` and their evidence is there, else not run."""
    every = ledger.join(F.broadcast(catalog.select("type", F.col("needs").alias("key"))), ["key"])  # a row for each check
    none = every.join(findings.select("app_id", "type").distinct(), ["app_id", "type"], "left_anti")
    there, run = F.col("state") == "present", F.col("type").isin(*ran)
    return none.select("app_id", "type", F.when(there & run, "clean").otherwise("notRun").alias("state"), F.when(~there, F.concat(F.lit("no "), "key")).when(~run, "no detector").alias("reason"))


def run_summary(apps: DataFrame, timing: DataFrame, windows: DataFrame, jobs: DataFrame) -> DataFrame:
    """Counts of a run: stages, jobs, executions, failed jobs, and its duration."""
    s = windows.groupBy("app_id").agg(F.count("*").alias("stages"))
    j = jobs.groupBy("app_id").agg(F.count("*").alias("jobs"), F.count_distinct("execution_id").alias("executions"), F.count_if(~F.col("succeeded")).alias("failed_jobs"))
    return apps.select("app_id").join(timing.select("app_id", "complete", "duration_ms"), ["app_id"]).join(s, ["app_id"], "left").join(j, ["app_id"], "left").na.fill(0, ["stages", "jobs", "executions", "failed_jobs"])


def run_verdict(summary: DataFrame, steps: DataFrame, coverage: DataFrame) -> DataFrame:
    """(app_id, title, summary): how the run ended, the first thing to look at, and what could not be checked."""
    first = steps.filter("step = 1").select("app_id", "lead")
    gaps = coverage.groupBy("app_id").agg(F.count_if(F.col("state") == "notRun").alias("gaps"), F.count_if(F.col("state") == "clean").alias("clean"))
    x = summary.join(first, ["app_id"], "left").join(gaps, ["app_id"], "left")
    title = F.when(~F.col("complete"), "Run has no end").when(F.col("failed_jobs") > 0, F.concat("failed_jobs", F.lit(" of "), "jobs", F.lit(" jobs failed"))).when(F.col("lead").isNull(), "Nothing found").otherwise(F.concat(F.lit("Look at "), "lead", F.lit(" first")))
    text = F.concat_ws(" ", F.concat("stages", F.lit(" stages, "), "jobs", F.lit(" jobs.")), F.concat(F.lit("First: "), "lead", F.lit(".")), F.concat("clean", F.lit(" checks clean, "), "gaps", F.lit(" not run.")))
    return x.select("app_id", title.alias("title"), text.alias("summary"))


def finding_evidence(finding_id: str, findings: DataFrame, stages: DataFrame) -> DataFrame:
    """The finding with its stage's row."""
    return findings.filter(F.col("id") == finding_id).join(stages, ["app_id", "stage_id"], "left")


def confidence(findings: DataFrame, stages: DataFrame, enough: int = 100, few: int = 20) -> DataFrame:
    """Findings gain confidence by the number of tasks behind them; those about a run are high."""
    n = stages.select("app_id", "stage_id", F.col("tasks").alias("_n"))
    level = F.when(F.col("stage_id").isNull() | (F.col("_n") >= enough), "high").when(F.col("_n") >= few, "medium").otherwise("low")
    return findings.join(n, ["app_id", "stage_id"], "left").select(*findings.columns, level.alias("confidence"))


def write_report(tables: dict[str, DataFrame], path: str, format_: str = "parquet") -> None:
    """Each table under `path`, by run."""
    for name, df in tables.items():
        df.write.mode("overwrite").partitionBy("app_id").format(format_).save(f"{path}/{name}")
