"""Detectors that read plans; findings name the execution and node they are about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.units import GIB, MIB, byte_size
from ..operators.config import column_of
from .composites import caching_composites, composites, nested_loop_rows, uncovered_relations
from .nodes import EXEC, NODE, chain, duplicate_subtrees, is_over, ordinals, plans_of, scan_filters, scan_relations, subtree_shapes, value_at, values_of, with_ancestors, with_metrics

#: Default thresholds.
ROWS, GROWTH, FILES, FILE_BYTES, SCAN_BYTES = 1_000_000, 10, 100, 3 * MIB, GIB
#: Fixed values: (bytes of the small side up to, bytes of the large side from) at which a sort-merge join could broadcast.
BROADCAST_TIERS = ((10 * MIB, 0), (100 * MIB, 10 * GIB), (GIB, 300 * GIB))


def _found(df: DataFrame, type_: str, metric: str, value: Column, band: Column | str = "warning") -> DataFrame:
    return df.select(*EXEC, "path", F.lit(type_).alias("type"), F.lit(metric).alias("metric"), value.cast("double").alias("value"), (F.lit(band) if isinstance(band, str) else band).alias("band"))


def caching_relations(nodes: DataFrame, metrics: DataFrame, times: int = 2) -> DataFrame:
    """(app, relation, executions): relations that several executions of a run scan outside the joins and unions worth caching as a whole."""
    return uncovered_relations(nodes, caching_composites(composites(nodes, metrics), times)[1], times)


def nested_loop_joins(nodes: DataFrame, metrics: DataFrame) -> DataFrame:
    """Nested loops and Cartesian products with many rows out: any product, else at least GROWTH times the larger side, where both are known."""
    x = nested_loop_rows(nodes, metrics).filter(F.col("out") >= ROWS)
    hit = x.filter((F.col("operator") == "CartesianProduct") | (F.col("left").isNotNull() & F.col("right").isNotNull() & (F.col("out") >= GROWTH * F.greatest("left", "right", F.lit(1)))))
    return _found(hit, "nestedLoopJoin", "output rows", F.col("out"), "info")


def duplicate_plan_subtrees(nodes: DataFrame) -> DataFrame:
    return duplicate_subtrees(subtree_shapes(nodes))


def small_files(nodes: DataFrame, metrics: DataFrame) -> DataFrame:
    """Scans and writes of many files that are small on average."""
    x = with_metrics(nodes, metrics, "number of files read", "size of files read", "number of written files", "written output")
    read = x.filter((F.col("number_of_files_read") > FILES) & (F.col("size_of_files_read") / F.col("number_of_files_read") < FILE_BYTES))
    write = x.filter((F.col("number_of_written_files") > FILES) & (F.col("written_output") / F.col("number_of_written_files") < FILE_BYTES))
    return _found(read, "smallFiles", "files read", F.col("number_of_files_read")).unionByName(_found(write, "smallFiles", "files written", F.col("number_of_written_files")))


def over_broadcast(nodes: DataFrame, metrics: DataFrame) -> DataFrame:
    x = with_metrics(nodes.filter(F.col("name") == "BroadcastExchange"), metrics, "data size").filter(F.col("data_size") > GIB)
    return _found(x, "overBroadcast", "broadcast bytes", F.col("data_size"))


#: Settings that bound a broadcast; with adaptive execution the second one counts where it is set.
AUTO_BROADCAST, ADAPTIVE_BROADCAST = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
THRESHOLDS = (AUTO_BROADCAST, ADAPTIVE_BROADCAST)
#: Join types whose left, and right, side can be built from; operators between a join and its shuffle; join types as plans print them.
BUILD_LEFT, BUILD_RIGHT = ("Inner", "Cross", "RightOuter"), ("Inner", "Cross", "LeftOuter", "LeftSingle", "LeftSemi", "LeftAnti", "ExistenceJoin")
BETWEEN = ("Sort", "InputAdapter", "ShuffleQueryStage", "AQEShuffleRead", "CustomShuffleReader")
JOIN_TYPES = (*BUILD_RIGHT, "RightOuter", "FullOuter")


def side_shuffles(plans: DataFrame, *more: str) -> DataFrame:
    """(join node, join_type, _aqe, shuffles0, shuffles1): sort-merge joins with, for each side, the shuffles (path and `more` of the node) that it may read, nearest first, as only operators that pass rows on unchanged are between.

    Only joins of which both sides have some and whose type lets a side be built. _aqe: whether adaptive execution is above. plans: with an array of nodes.
    """
    x = plans.select(*EXEC, "nodes", F.explode(F.filter("nodes", lambda n: n["name"] == "SortMergeJoin")).alias("_j"))
    type_ = F.get(F.filter(F.regexp_extract_all("_j.detail", F.lit(r"(\w+)"), F.lit(1)), lambda w: w.isin(*JOIN_TYPES)), F.lit(0))
    x = x.select(*EXEC, "nodes", F.col("_j.path").alias("path"), type_.alias("join_type"), *[F.concat("_j.path", F.lit(f".{i}")).alias(f"_top{i}") for i in (0, 1)]).filter(F.col("join_type").isin(*BUILD_LEFT, *BUILD_RIGHT))
    above = F.exists("nodes", lambda n: (n["name"] == "AdaptiveSparkPlan") & is_over(n["path"], F.col("path")))
    x = x.select(*NODE, "join_type", above.alias("_aqe"), *[chain(F.col(f"_top{i}"), *more).alias(f"_chain{i}") for i in (0, 1)])
    shuffle = lambda s: s["name"].endswith("Exchange") & (s["name"] != "ReusedExchange")
    passes = lambda s: shuffle(s) | s["name"].isin(*BETWEEN) | s["name"].startswith("WholeStageCodegen")
    x = x.withColumns({f"_end{i}": F.get(F.filter(f"_chain{i}", lambda s: ~passes(s)), F.lit(0))["d"] for i in (0, 1)})
    within = lambda i: F.filter(f"_chain{i}", lambda s: shuffle(s) & ~s["name"].startswith("Broadcast") & (F.col(f"_end{i}").isNull() | (s["d"] < F.col(f"_end{i}"))))
    # Rows are dropped by exploding arrays of one or none: a filter would be pushed below what it reads, and that worked out again.
    both = F.array(F.struct(*[F.transform(within(i), lambda s: F.struct(*[s[c].alias(c) for c in ("path", *more)])).alias(f"shuffles{i}") for i in (0, 1)]))
    return x.select(*NODE, "join_type", "_aqe", F.inline(F.filter(both, lambda b: (F.size(b["shuffles0"]) > 0) & (F.size(b["shuffles1"]) > 0))))


def missed_broadcasts(nodes: DataFrame, metrics: DataFrame, settings: DataFrame | None = None) -> DataFrame:
    """(join node, rule, join_type, build_side, value, larger, setting, exchanges): sort-merge joins that could have been a broadcast.

    A side reads its nearest shuffle with a data size. The build side is the smaller of those that the join's type allows; it must be MIB to GIB and no larger than the
    other. rule is notLimiting where the setting admits it already, disabled where it is negative, else limits; the last two count only
    within BROADCAST_TIERS, below each bound. settings: from `execution_settings` with THRESHOLDS; without it Spark's default holds. nodes: a row each, or plans with an array of them.
    """
    x = side_shuffles(plans_of(nodes)).join(values_of(metrics, "data size").hint("merge"), EXEC)
    sized = lambda i: F.filter(F.transform(f"shuffles{i}", lambda s: F.struct(s["path"].alias("exchange"), value_at(s["path"], "data size").alias("bytes"))), lambda s: s["bytes"].isNotNull())
    return _missed(x.withColumns({f"_s{i}": F.get(sized(i), F.lit(0)) for i in (0, 1)}), settings)


def missed_broadcasts_of(plans: DataFrame, accumulators: DataFrame, settings: DataFrame | None = None) -> DataFrame:
    """The same from plans with an array of nodes that name their accumulators: only those of the shuffles in question meet their values, so each plan is read once. accumulators: (log, acc_id, value, side), log being the app_id."""
    x = side_shuffles(plans, "metrics")

    def sizes(i: int) -> Column:
        own = lambda s, k: F.transform(F.filter(s["metrics"], lambda m: m["name"] == "data size"), lambda m: F.struct(F.lit(i).alias("i"), k.alias("k"), s["path"].alias("exchange"), m["id"].alias("acc_id"), m["type"].alias("type")))
        return F.flatten(F.transform(f"shuffles{i}", own))

    x = x.select(*NODE, "join_type", "_aqe", F.inline(F.concat(sizes(0), sizes(1))))
    x = x.join(accumulators.select(F.col("log").alias("app_id"), "acc_id", F.col("value").alias("bytes"), F.col("side").alias("_by")).hint("merge"), ["app_id", "acc_id"]).filter(~((F.col("type") == "average") & (F.col("_by") == "executor")))
    near = [F.min_by(F.struct("exchange", "bytes"), F.when((F.col("i") == i) & F.col("bytes").isNotNull(), F.struct("k", -F.col("bytes")))).alias(f"_s{i}") for i in (0, 1)]
    return _missed(x.groupBy(*NODE, "join_type", "_aqe").agg(*near), settings)


def _missed(x: DataFrame, settings: DataFrame | None) -> DataFrame:
    """`missed_broadcasts` among joins with the shuffle (exchange, bytes) that each side reads, as _s0 and _s1."""
    left, right = F.col("join_type").isin(*BUILD_LEFT), F.col("join_type").isin(*BUILD_RIGHT)
    x = x.withColumn("_left", left & (~right | (F.col("_s0.bytes") <= F.col("_s1.bytes"))))
    one = lambda a, b: F.when(F.col("_left"), F.col(a)).otherwise(F.col(b))
    hit = F.struct(one("_s0.bytes", "_s1.bytes").alias("value"), one("_s1.bytes", "_s0.bytes").alias("larger"), F.array("_s0.exchange", "_s1.exchange").alias("exchanges"))
    x = x.select(*NODE, "join_type", "_aqe", F.when(F.col("_left"), "left").otherwise("right").alias("build_side"), F.inline(F.filter(F.array(hit), lambda h: (h["value"] >= MIB) & (h["value"] <= GIB) & (h["value"] <= h["larger"]))))
    if settings is None:
        x = x.withColumn("setting", F.lit(AUTO_BROADCAST)).withColumn("_text", F.lit("10MB"))
    else:
        auto, own = (column_of(k) for k in THRESHOLDS)
        use = F.col("_aqe") & F.col(own).isNotNull()
        x = x.join(settings.select(*EXEC, auto, own).hint("merge"), EXEC, "left").withColumn("setting", F.when(use, ADAPTIVE_BROADCAST).otherwise(AUTO_BROADCAST)).withColumn("_text", F.when(use, F.col(own)).otherwise(F.col(auto)))
    limit = F.when(F.col("_text").rlike("^-[0-9]+$"), -1).otherwise(byte_size(F.col("_text")))
    fits = F.lit(False)
    for most, least in BROADCAST_TIERS:
        fits = fits | ((F.col("value") < most) & (F.col("larger") > least))
    rule = F.when(limit < 0, "disabled").when(limit >= F.col("value"), "notLimiting").otherwise("limits")
    x = x.withColumn("rule", rule)
    return x.filter((F.col("rule") == "notLimiting") | fits).select(*NODE, "rule", "join_type", "build_side", "value", "larger", "setting", "exchanges")


def under_broadcast(nodes: DataFrame, metrics: DataFrame, settings: DataFrame | None = None) -> DataFrame:
    return _found(missed_broadcasts(nodes, metrics, settings), "underBroadcast", "smaller side bytes", F.col("value"), "info")


def join_readers(missed: DataFrame, links: DataFrame) -> DataFrame:
    """(join node, stage_id): the one stage that reads both shuffles of a join. An exchange is linked to the stage that wrote it, the least, and those that read it."""
    ends = missed.select(*NODE, F.explode("exchanges").alias("_x")).join(links.withColumnRenamed("path", "_x"), [*EXEC, "_x"])
    each = ends.groupBy(*NODE, "_x").agg(F.sort_array(F.collect_set("stage_id")).alias("ids")).filter(F.size("ids") == 2)
    both = each.groupBy(NODE).agg(F.count("*").alias("n"), F.min(F.col("ids")[1]).alias("stage_id"), F.max(F.col("ids")[1]).alias("last"))
    return both.filter("n = 2 AND stage_id = last").select(*NODE, "stage_id")


def unpruned_scans(nodes: DataFrame, metrics: DataFrame) -> DataFrame:
    """Large scans of partitioned tables that filter data but no partition: one finding a table, at its first scan, with the bytes of all such scans. A table is its relation and location."""
    x = with_metrics(nodes, metrics, "number of partitions read", "size of files read").join(scan_filters(nodes), NODE).join(scan_relations(nodes).filter("relation IS NOT NULL"), NODE)
    hit = x.filter((F.col("number_of_partitions_read") >= 2) & (F.col("size_of_files_read") >= SCAN_BYTES) & (F.col("data_filters") != "") & (F.col("partition_filters") == ""))
    place = F.regexp_extract("detail", r"Location: ([^\]]*\])", 1)
    table = hit.groupBy(*EXEC, "format", "relation", place.alias("place")).agg(F.min_by("path", ordinals(F.col("path"))).alias("path"), F.sum("size_of_files_read").alias("bytes"))
    return _found(table, "unprunedScan", "bytes read", F.col("bytes"), "info")


def python_udfs(nodes: DataFrame, metrics: DataFrame, links: DataFrame | None = None, stages: DataFrame | None = None, least: int = 64 * MIB, least_ms: int = 30_000) -> DataFrame:
    """Executions whose row-at-a-time Python functions were sent much data over much stage time: one finding, at the first such node.

    Nodes without a stage don't count, and the time is that of all stages that ran one of the others. links: (app_id, execution_id,
    path, stage_id); stages: (app_id, stage_id, stage_ms). Without them every node counts, whatever its time.
    """
    x = with_metrics(nodes.filter(F.col("name") == "BatchEvalPython"), metrics, "data sent to Python workers").filter("data_sent_to_Python_workers IS NOT NULL")
    if links is None or stages is None:
        sums = x.groupBy(EXEC).agg(F.min_by("path", ordinals(F.col("path"))).alias("path"), F.sum("data_sent_to_Python_workers").alias("sent"))
    else:
        ran = x.join(links.select(NODE).distinct(), NODE, "left_semi")
        spent = ran.select(NODE).join(links, NODE).select(*EXEC, "stage_id").distinct().join(stages.select("app_id", "stage_id", "stage_ms"), ["app_id", "stage_id"]).groupBy(EXEC).agg(F.sum(F.greatest(F.lit(0), "stage_ms")).alias("spent_ms"))
        sums = ran.groupBy(EXEC).agg(F.min_by("path", ordinals(F.col("path"))).alias("path"), F.sum("data_sent_to_Python_workers").alias("sent")).join(spent.filter(F.col("spent_ms") >= least_ms), EXEC)
    return _found(sums.filter(F.col("sent") >= least), "pythonUdf", "bytes sent to Python", F.col("sent"), "info")


#: Counters of a Delta merge as logs name them; of several names in a row, one release or another has one.
MERGE_COUNTERS = {
    "copied": ("number of target rows rewritten unmodified", "number of rows copied"), "updated": ("number of updated rows",), "deleted": ("number of deleted rows",),
    "inserted": ("number of inserted rows",), "files_before": ("number of target files before skipping",), "files_after": ("number of target files after skipping",),
    "partitions": ("number of target partitions after skipping",), "removed_from": ("number of target partitions from which files were removed",), "added_to": ("number of target partitions to which files were added",),
}


def merge_rewrites(nodes: DataFrame, metrics: DataFrame, copied: int = 100_000, files: int = 8) -> DataFrame:
    """Merges that rewrite far more rows than they change, or that keep nearly all files although what they change lies in half of
    the partitions or fewer."""
    x = with_metrics(nodes, metrics, *[n for names in MERGE_COUNTERS.values() for n in names])
    for key, names in MERGE_COUNTERS.items():
        x = x.withColumn(key, F.coalesce(*[F.col(n.replace(" ", "_")) for n in names]))
    x = x.filter("copied IS NOT NULL").withColumn("changed", sum((F.coalesce(c, F.lit(0.0)) for c in ("inserted", "updated", "deleted")), F.lit(0.0)))
    rows = x.filter((F.col("copied") >= copied) & (F.col("copied") >= 2 * F.col("changed")))
    touched = F.greatest("removed_from", "added_to")
    kept = x.filter((F.col("files_before") >= files) & (F.col("files_after") >= 0.9 * F.col("files_before")) & (F.col("partitions") > 1) & (touched <= 0.5 * F.col("partitions")))
    return _found(rows, "mergeRewrite", "rows copied", F.col("copied"), "info").unionByName(_found(kept, "mergeRewrite", "files kept", F.col("files_after"), "info"))


def join_key_casts(nodes: DataFrame) -> DataFrame:
    """Shuffled joins on a cast key whose plain column a later exchange, added by Spark, hashes again."""
    joins = nodes.filter(F.col("name").isin("SortMergeJoin", "ShuffledHashJoin")).withColumn("cast", F.explode(F.array_distinct(F.regexp_extract_all(F.regexp_replace("detail", r"#[0-9]+L?", ""), F.lit(r"cast\((\w+) as"), F.lit(1)))))
    later = nodes.filter((F.col("name") == "Exchange") & F.col("detail").contains("ENSURE_REQUIREMENTS")).select(*EXEC, F.col("path").alias("_p"), F.split(F.regexp_replace(F.regexp_extract("detail", r"hashpartitioning\((.*), [0-9]+\)", 1), r"#[0-9]+L?", ""), ", ").alias("_keys"))
    hit = with_ancestors(joins, later.withColumnRenamed("_p", "path")).filter(F.expr("array_contains(up._keys, cast)"))
    return _found(hit.groupBy(NODE).agg(F.count_distinct("cast").alias("n")), "joinKeyCast", "cast keys hashed again", F.col("n"))
