"""Mixing sources to target weights by capped water-filling, with whole and fractional repetitions. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, small

#: Weights by rank of the source, repeating, and the epochs at which a source is clamped.
WEIGHTS, EPOCHS, SEED = (5.0, 2.0, 1.0), 3, 42
#: Documents per bucket of the sampling order, and buckets a source has at most.
BUCKET_DOCS, BUCKETS = 64, 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _ordered(df: DataFrame, *order: Column) -> DataFrame:
    """`df` in a total order over range partitions: _p is the partition, _i rises within it."""
    return saved(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()))


def _running(df: DataFrame, **sums: Column) -> DataFrame:
    """Add to _ordered rows the sums over all rows before each; a window over rows of one partition, then over one row a partition."""
    inner = Window.partitionBy("_p").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy("_p").agg(*[F.sum(c).alias(f"_{k}") for k, c in sums.items()])
    totals = totals.select("_p", *[F.coalesce(F.sum(f"_{k}").over(outer), F.lit(0)).alias(f"_{k}") for k in sums])
    rows = df.select("*", *[F.coalesce(F.sum(c).over(inner), F.lit(0)).alias(k) for k, c in sums.items()])
    rows = rows.join(totals, "_p")
    return rows.select(*df.columns, *[(F.col(k) + F.col(f"_{k}")).alias(k) for k in sums])


def source_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, n_docs) gains weight and target.

    Sources in code point order, null last, take the weights in turn and share the sum of all sizes by them. A target
    stops at `epochs` times its source's size; what that leaves over is shared anew by weight until none is above. With
    sources sorted by size per weight, the water level is the largest of (total - caps before) / (weights from here on).
    """
    ranked = _running(_ordered(sources, F.col("source").asc_nulls_last()), rank=F.lit(1).cast("long"))
    turn = F.pmod(F.col("rank"), F.lit(len(weights))).cast("int")
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1)).drop("_p", "_i", "rank")
    total, all_weights = saved(ranked).agg(F.sum("source_size"), F.sum("weight")).first()
    if total is None:
        return ranked.withColumn("target", F.lit(0.0))
    capped = _ordered(ranked.withColumn("cap", epochs * F.col("source_size")), F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = _running(capped, caps=F.col("cap"), poured=F.col("weight"))
    level = before.agg(F.max((F.lit(total) - F.col("caps")) / (F.lit(all_weights) - F.col("poured")))).first()[0]
    return before.select(*ranked.columns, F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight")).alias("target"))


class Mix:
    """The choice of documents for a mixture, from `sizes` (doc_id, source, size): a few rows a source, and the picks.

    Every document of a source is taken floor(target / source_size) times. For the fraction left, documents come in
    seeded hash order, in buckets: whole buckets while they fit, then documents of the next bucket, largest first, as
    far as each fits, in four passes. So a source misses its target by less than the smallest document passed over
    there, and no document is taken more than `epochs` times. Rows that repeat one doc_id in a source are taken
    together. A null source is a source; a null or empty text has size 0; an empty table gives no rows. The choice
    depends on ids, sizes and the seed alone, so reruns agree.
    """

    def __init__(self, sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, epochs: int = EPOCHS, seed: int = SEED) -> None:
        self.hash = F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"))
        sizes = sizes.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "size")
        totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
        plan = source_targets(saved(totals), weights, epochs)
        whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(epochs))).otherwise(0).cast("long")
        buckets = F.least(F.lit(BUCKETS), F.greatest(F.lit(1), F.floor(F.col("n_docs") / BUCKET_DOCS))).cast("long")
        plan = plan.withColumn("whole", whole).withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))
        self.plan = small(saved(plan.select(F.col("source").alias("_source"), "source_size", "target", "whole", "need", buckets.alias("buckets"))))
        self.edge = small(saved(self._edge(sizes)))
        self.picks = small(saved(self._picks(sizes)))

    def _placed(self, docs: DataFrame) -> DataFrame:
        return docs.join(self.plan, F.col("source").eqNullSafe(F.col("_source"))).withColumn("_bucket", F.pmod(self.hash, F.col("buckets")))

    def _edge(self, sizes: DataFrame) -> DataFrame:
        """By source, the first bucket that does not fit whole and the words still needed there."""
        filled = self._placed(sizes).groupBy("_source", "need", "_bucket").agg(F.sum("size").alias("words"))
        upto = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        filled = filled.withColumn("upto", F.sum("words").over(upto)).filter("upto > need")
        left = F.max(F.col("need") - F.col("upto") + F.col("words"))  # earlier buckets leave more
        return filled.groupBy(F.col("_source").alias("_edge_source")).agg(F.min("_bucket").alias("edge"), left.alias("left"))

    def _picks(self, sizes: DataFrame) -> DataFrame:
        """Documents taken from the edge buckets."""
        rows = self._placed(sizes).withColumn("_h", self.hash).join(self.edge, F.col("source").eqNullSafe(F.col("_edge_source")))
        rest = saved(rows.filter("_bucket = edge AND size > 0").groupBy("_source", "doc_id", "_h", "left").agg(F.sum("size").alias("words")))
        largest = Window.partitionBy("_source").orderBy(F.desc("words"), "_h", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        took = None
        for _ in range(4):
            row = rest.filter("words <= left").withColumn("upto", F.sum("words").over(largest))
            spent = F.coalesce(F.max(F.when(F.col("upto") <= F.col("left"), F.col("upto"))).over(Window.partitionBy("_source")), F.lit(0))
            row = saved(row.withColumn("spent", spent))
            now = row.filter("upto <= left").select(F.col("_source").alias("_pick_source"), F.col("doc_id").alias("_pick_id"), F.lit(1).alias("_pick"))
            took = now if took is None else took.unionByName(now)
            rest = row.filter("upto > left").select("_source", "doc_id", "_h", (F.col("left") - F.col("spent")).alias("left"), "words")
        return took

    def taken(self, docs: DataFrame) -> DataFrame:
        """`docs` (doc_id, source, ...) gains _source_size, _target and _copies, the times the mix takes the row. Moves no row."""
        rows = self._placed(docs).join(self.edge, F.col("source").eqNullSafe(F.col("_edge_source")), "left")
        rows = rows.join(self.picks, F.col("source").eqNullSafe(F.col("_pick_source")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_pick_id")), "left")
        extra = F.when(F.col("need") <= 0, 0).when(F.col("edge").isNull() | (F.col("_bucket") < F.col("edge")), 1).otherwise(F.coalesce("_pick", F.lit(0)))
        return rows.select(*docs.columns, F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), (F.col("whole") + extra).alias("_copies"))


def mix_report(documents: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken (words, repeats counted) for every row of `documents`: see `Mix`."""
    sizes = saved(documents.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    out = Mix(sizes).taken(sizes)
    return out.select("doc_id", "size", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_copies") * F.col("size")).alias("taken"))


def mix_documents(documents: DataFrame) -> DataFrame:
    """The mixture itself: each row of `documents` as many times as it is taken, with the same columns."""
    sizes = saved(documents.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    slim = Mix(sizes).taken(documents.select("doc_id", "source", F.struct("*").alias("_row")))
    copies = slim.filter("_copies > 0").select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return copies.select("_row.*")
