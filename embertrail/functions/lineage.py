"""Cutting lineage where a step would otherwise repeat all steps before it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession) -> SparkContext:
    """The context, with its checkpoint folder set: the session's spark.checkpoint.dir; where that is unset, a folder is made on a local master only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and sc.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return sc


def cut(df: DataFrame) -> DataFrame:
    """Write `df` as a checkpoint and read it from there."""
    _folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Write `df` as columns into the checkpoint folder: a later pass reads the columns it needs alone, and the planner knows the table's size."""
    path = f"{_folder(df.sparkSession).getCheckpointDir()}/{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
