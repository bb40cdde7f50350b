"""Interval algebra on DataFrames: unions, sweeps and overlaps, keyed by any columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of the time slices in which a sweep runs, so that one very long run is many tasks.
SLICE_MS = 600_000


def islands(df: DataFrame, keys: Sequence[str], start: str, end: str, slice_ms: int = SLICE_MS) -> DataFrame:
    """Unions of touching or overlapping [start, end) intervals: keys, start, end of each. Null ends, and ends before the start, are left out.

    Intervals are united within the time slices in which they start, so that a key with very many is many tasks. What is left, at
    most a chain of pieces for each slice, is joined by the latest end of all slices before; pieces that do not touch
    what came before are numbered by slice, so that no task sees all of them.
    """
    rows = df.filter(F.col(end) >= F.col(start)).select(*keys, start, end).withColumn("_slice", F.floor(F.col(start) / slice_ms))
    per = Window.partitionBy(*keys).orderBy("_slice")
    slices = rows.groupBy(*keys, "_slice").agg(F.max(end).alias("_end"))
    slices = slices.select(*keys, "_slice", F.max("_end").over(per.rowsBetween(Window.unboundedPreceding, -1)).alias("_reach"))
    within = Window.partitionBy(*keys, "_slice").orderBy(start, end)
    rows = rows.join(slices, [*keys, "_slice"])
    before = F.greatest(F.max(end).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.col("_reach"))
    rows = rows.withColumn("_new", (before.isNull() | (F.col(start) > before)).cast("int"))
    rows = rows.withColumn("_at", F.sum("_new").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = rows.groupBy(*keys, "_slice", "_at").agg(F.min(start).alias(start), F.max(end).alias(end))
    # A piece numbered 0 goes on from an earlier slice: it belongs to the last one that began before.
    began = slices.select(*keys, "_slice").join(pieces.groupBy(*keys, "_slice").agg(F.max("_at").alias("_began")), [*keys, "_slice"])
    last = F.last(F.when(F.col("_began") > 0, F.struct("_slice", F.col("_began").alias("_at"))), ignorenulls=True).over(per.rowsBetween(Window.unboundedPreceding, -1))
    began = began.select(*keys, "_slice", last.alias("_last"))
    owned = pieces.join(began, [*keys, "_slice"]).withColumn("_own", F.when(F.col("_at") > 0, F.struct("_slice", "_at")).otherwise(F.col("_last")))
    return owned.groupBy(*keys, "_own").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_own")


def union_ms(df: DataFrame, keys: Sequence[str], start: str, end: str, name: str) -> DataFrame:
    """Length of the union of the intervals of each key."""
    return islands(df, keys, start, end).groupBy(*keys).agg(F.sum(F.col(end) - F.col(start)).alias(name))


def sweep(df: DataFrame, keys: Sequence[str], start: str, end: str, weight: Column | None = None, slice_ms: int = SLICE_MS) -> DataFrame:
    """Segments (keys, from_ms, to_ms, busy) between neighbouring events; busy is the weight of the intervals open there.

    An interval that ends when another starts frees its place first. Events of equal time are summed before the shuffle;
    the running sum goes over time slices, each of which adds what was open before it. Empty intervals are left out.
    """
    w = F.lit(1).cast("long") if weight is None else weight
    rows = df.filter(F.col(end) > F.col(start)).withColumn("_w", w)
    events = rows.select(*keys, F.explode(F.array(F.struct(F.col(start).alias("ts"), F.col("_w").alias("d")), F.struct(F.col(end).alias("ts"), (-F.col("_w")).alias("d")))).alias("e"))
    events = events.filter(F.floor(F.col("e.ts") / slice_ms).isNotNull())  # always so; the join below asks it of one side alone, and only equal sides share their shuffle
    events = events.groupBy(*keys, F.col("e.ts").alias("ts")).agg(F.sum("e.d").alias("d")).withColumn("_slice", F.floor(F.col("ts") / slice_ms))
    per = Window.partitionBy(*keys).orderBy("_slice")
    slices = events.groupBy(*keys, "_slice").agg(F.sum("d").alias("_d"), F.min("ts").alias("_first"))
    slices = slices.select(*keys, "_slice", F.coalesce(F.sum("_d").over(per.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_open"), F.lead("_first").over(per).alias("_next"))
    within = Window.partitionBy(*keys, "_slice").orderBy("ts")
    out = events.join(slices, [*keys, "_slice"])
    busy = F.col("_open") + F.sum("d").over(within.rowsBetween(Window.unboundedPreceding, 0))
    out = out.select(*keys, F.col("ts").alias("from_ms"), F.coalesce(F.lead("ts").over(within), "_next").alias("to_ms"), busy.alias("busy"))
    return out.filter("to_ms IS NOT NULL")


def overlaps(left: DataFrame, right: DataFrame, keys: Sequence[str], l_start: str, l_end: str, r_start: str, r_end: str, slice_ms: int = SLICE_MS) -> DataFrame:
    """Pairs of overlapping intervals of a key, each once, with overlap_ms: an equality join on time slices, not a theta join."""

    def sliced(df: DataFrame, a: str, b: str) -> DataFrame:
        last = F.floor((F.greatest(F.col(b) - 1, F.col(a))) / slice_ms)
        return df.withColumn("_slice", F.explode(F.sequence(F.floor(F.col(a) / slice_ms), last)))

    both = sliced(left, l_start, l_end).join(sliced(right, r_start, r_end), [*keys, "_slice"])
    common = F.least(l_end, r_end) - F.greatest(l_start, r_start)
    first = F.floor(F.greatest(l_start, r_start) / slice_ms)
    return both.withColumn("overlap_ms", common).filter((F.col("overlap_ms") > 0) & (F.col("_slice") == first)).drop("_slice")
