"""Running stage statistics over event logs that are still being written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.eventlog import parse_events, task_records


def task_stream(spark: SparkSession, path: str) -> DataFrame:
    """Task records of the files under `path`, each file read once as it appears; log is the file."""
    lines = spark.readStream.text(path).select(F.col("_metadata.file_path").alias("log"), F.col("value").alias("raw"), F.lit(0).cast("long").alias("seq"))
    return task_records(parse_events(lines))


def running_stage_sums(tasks: DataFrame) -> DataFrame:
    """Per log and stage: tasks, failed ones, task time, spill and shuffle so far. State is one row a stage."""
    return tasks.groupBy("log", "stage_id").agg(
        F.count("*").alias("tasks"), F.count_if("failed").alias("failed_tasks"), F.sum("duration_ms").alias("task_ms"),
        F.max("duration_ms").alias("longest"), F.sum("mem_spilled").alias("mem_spilled"), F.sum("shuffle_read").alias("shuffle_read"),
    )


def windowed_stage_sums(tasks: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Task time by finish window; a window closes once records are later than `late`, and its state goes."""
    timed = tasks.withColumn("finished", F.timestamp_millis("finish_ms")).withWatermark("finished", late)
    return timed.groupBy("log", F.window("finished", width).alias("w")).agg(F.count("*").alias("tasks"), F.sum("duration_ms").alias("task_ms")).select("log", F.unix_millis("w.start").alias("from_ms"), "tasks", "task_ms")
