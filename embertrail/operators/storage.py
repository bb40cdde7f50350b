"""Cached data: which blocks were where over time, and how well persisted data fit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.eventlog import of_type

#: Cached shares below which to warn or note, and disk shares above which to.
CACHED_WARN, CACHED_NOTE, DISK_WARN, DISK_NOTE = 0.5, 0.9, 0.4, 0.15


def block_changes(events: DataFrame) -> DataFrame:
    """(log, seq, rdd_id, part, executor_id, held, bytes): updates of RDD blocks, and a last one with nothing held when the executor goes."""
    up = of_type(events, "SparkListenerBlockUpdated", F.col("raw").contains('"rdd_')).select("log", "seq", F.col("e.Block Updated Info").alias("b"))
    up = up.withColumn("id", F.split("b.Block ID", "_")).filter(F.size("id") == 3)
    size = F.coalesce("b.Memory Size", F.lit(0)) + F.coalesce("b.Disk Size", F.lit(0))
    held = F.coalesce("b.Storage Level.Use Memory", F.lit(False)) | F.coalesce("b.Storage Level.Use Disk", F.lit(False))
    rows = up.select("log", "seq", F.col("id")[1].cast("long").alias("rdd_id"), F.col("id")[2].cast("long").alias("part"), F.col("b.Block Manager ID.Executor ID").alias("executor_id"), held.alias("held"), F.when(held, size).otherwise(0).alias("bytes"))
    gone = of_type(events, "SparkListenerExecutorRemoved").select("log", F.col("seq").alias("gone"), F.col("e.Executor ID").alias("executor_id"))
    lost = rows.join(gone, ["log", "executor_id"]).filter("seq < gone").select("log", F.col("gone").alias("seq"), "rdd_id", "part", "executor_id", F.lit(False).alias("held"), F.lit(0).cast("long").alias("bytes")).distinct()
    return rows.unionByName(lost)


def block_residency(events: DataFrame) -> DataFrame:
    """(log, rdd_id, peak_parts, peak_bytes): the most distinct partitions held at once, and the bytes at the last such moment.

    Block states become signed changes; a partition counts while any replica of it is held.
    """
    own = Window.partitionBy("log", "rdd_id", "part", "executor_id").orderBy("seq")
    x = block_changes(events).withColumn("d", F.col("held").cast("int") - F.coalesce(F.lag("held").over(own).cast("int"), F.lit(0))).withColumn("db", F.col("bytes") - F.coalesce(F.lag("bytes").over(own), F.lit(0)))
    by_part = Window.partitionBy("log", "rdd_id", "part").orderBy("seq", "executor_id").rowsBetween(Window.unboundedPreceding, 0)
    copies = F.sum("d").over(by_part)
    x = x.withColumn("copies", copies).withColumn("dp", (F.col("copies") > 0).cast("int") - ((F.col("copies") - F.col("d")) > 0).cast("int"))
    at = x.groupBy("log", "rdd_id", "seq").agg(F.sum("dp").alias("dp"), F.sum("db").alias("db"))
    run = Window.partitionBy("log", "rdd_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    at = at.withColumn("parts", F.sum("dp").over(run)).withColumn("bytes", F.sum("db").over(run))
    return at.groupBy("log", "rdd_id").agg(F.max("parts").alias("peak_parts"), F.max_by("bytes", F.struct("parts", "seq")).alias("peak_bytes"))


def cache_utilization(rdds: DataFrame) -> DataFrame:
    """(log, rdd_id, rule, value, band) for RDDs that are held only in part, or largely on disk, or persisted without a trace of it.

    rdds: (log, rdd_id, partitions, cached, mem_bytes, disk_bytes).
    """
    share, all_ = F.col("cached") / F.col("partitions"), F.col("mem_bytes") + F.col("disk_bytes")
    disk = F.when(all_ > 0, F.col("disk_bytes") / all_)
    found = F.array_compact(F.array(
        F.when((F.col("cached") > 0) & (share < CACHED_NOTE), F.struct(F.lit("partial").alias("rule"), share.alias("value"), F.when(share < CACHED_WARN, "warning").otherwise("info").alias("band"))),
        F.when(disk > DISK_NOTE, F.struct(F.lit("disk").alias("rule"), disk.alias("value"), F.when(disk > DISK_WARN, "warning").otherwise("info").alias("band"))),
        F.when((F.col("cached") == 0) & (F.col("partitions") > 0), F.struct(F.lit("unseen").alias("rule"), F.lit(0.0).alias("value"), F.lit("info").alias("band"))),
    ))
    return rdds.select("log", "rdd_id", F.explode(found).alias("f")).select("log", "rdd_id", "f.*")
