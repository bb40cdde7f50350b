"""Exact quantiles whose work is spread over slices of the values, so that no task holds all values of a key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

#: Slices that values share from one power of two to the next, and rows that are broadcast at most.
SLICES, MOST_SENT = 16, 50_000


def _slice(x: Column) -> Column:
    """A number that never falls as a whole number rises."""
    size = F.floor(F.log2(F.abs(x)) * SLICES).cast("int") + 1
    return F.when(x > 0, size).when(x < 0, -size).otherwise(0)


def quantiles(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, n, p50, p95, max) of whole numbers: the textbook median, the nearest rank and the largest value. Nulls don't count."""
    return quantiles_of(df, keys, [value]).drop("m")


def quantiles_of(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """(keys, m, n, p50, p95, max): `quantiles` of several columns, m being the column's place among them, from 0.

    A first pass counts values by slice, at most some hundreds a key and summed before the shuffle; these counts tell in which
    slices the ranks lie. A slice of one value tells it at once. A second pass meets the bounds of the others, one row a key, and counts and
    numbers the values within them alone. The bounds are broadcast where they are few, counted; else the passes meet by shuffle.
    """
    rows = df.select(*keys, *[F.col(c).cast("long").alias(f"_{i}") for i, c in enumerate(cols)])

    def apart(rows: DataFrame, values: Sequence[Column]) -> DataFrame:
        each = F.explode(F.array(*[F.struct(F.lit(i).alias("m"), x.alias("_x")) for i, x in enumerate(values)]))
        return rows.select(*keys, each.alias("_v")).select(*keys, "_v.m", "_v._x").filter("_x IS NOT NULL").withColumn("_slice", _slice(F.col("_x")))

    each = [*keys, "m"]
    slices = apart(rows, [F.col(f"_{i}") for i in range(len(cols))]).groupBy(*each, "_slice").agg(F.count("*").alias("_c"), F.min("_x").alias("_least"), F.max("_x").alias("_top"))
    own = Window.partitionBy(*each)
    before = F.coalesce(F.sum("_c").over(own.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slices = slices.select(*each, "_slice", "_c", "_least", "_top", before.alias("_before"), F.sum("_c").over(own).alias("_all"), F.max("_top").over(own).alias("_max"))
    ranks = {"_low": F.floor((F.col("_all") + 1) / 2), "_high": F.floor(F.col("_all") / 2) + 1, "_p95": F.expr("(_all * 95 + 99) div 100")}
    slices = slices.withColumns(ranks)
    here = {r: (F.col(r) > F.col("_before")) & (F.col(r) <= F.col("_before") + F.col("_c")) for r in ranks}
    hits = cut(slices.filter(here["_low"] | here["_high"] | here["_p95"]))
    sent = F.broadcast if hits.count() <= MOST_SENT else lambda df: df

    at = lambda i, r: (F.col("m") == i) & here[r]
    ends = [x for i in range(len(cols)) for r in ranks for x in (F.min(F.when(at(i, r), F.col("_least"))).alias(f"_from{i}{r}"), F.max(F.when(at(i, r), F.col("_top"))).alias(f"_upto{i}{r}"))]
    near = rows.join(sent(hits.filter("_least < _top").groupBy(*keys).agg(*ends)), keys)
    within = [F.when(reduce(Column.__or__, [F.col(f"_{i}").between(F.col(f"_from{i}{r}"), F.col(f"_upto{i}{r}")) for r in ranks]), F.col(f"_{i}")) for i in range(len(cols))]
    values = apart(near.filter(F.coalesce(*within).isNotNull()), within).groupBy(*each, "_slice", "_x").agg(F.count("*").alias("_n"))
    values = values.unionByName(hits.filter("_least = _top").select(*each, "_slice", F.col("_top").alias("_x"), F.col("_c").alias("_n")))
    upto = F.col("_before") + F.sum("_n").over(Window.partitionBy(*each, "_slice").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0))
    values = values.join(sent(hits), [*each, "_slice"]).withColumn("_upto", upto)
    first = lambda r: F.min(F.when(F.col("_upto") >= F.col(r), F.col("_x")))
    return values.groupBy(*each).agg(F.first("_all").alias("n"), ((first("_low") + first("_high")) / 2).alias("p50"), first("_p95").alias("p95"), F.first("_max").alias("max"))
