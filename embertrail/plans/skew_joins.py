"""Why adaptive execution did, or did not, split a skewed partition of a stage's join; and what sized a stage's shuffle.

Nodes and metrics are those of `nodes`; links are (app_id, execution_id, path, stage_id): stages that ran a node, for an
exchange those that wrote and read it. Settings come from `config.execution_settings`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.units import MIB, byte_size
from .nodes import EXEC, NODE, chain, is_over, ordinals, plans_of, value_at, values_of, with_ancestors

#: Setting names.
THRESHOLD, FACTOR, FORCE = "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "spark.sql.adaptive.skewJoin.skewedPartitionFactor", "spark.sql.adaptive.forceOptimizeSkewedJoin"
ADVISORY, INITIAL, PARTITIONS = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.shuffle.partitions"
AQE, COALESCE = "spark.sql.adaptive.enabled", "spark.sql.adaptive.coalescePartitions.enabled"
SETTINGS = (THRESHOLD, FACTOR, FORCE, ADVISORY, INITIAL, PARTITIONS, AQE, COALESCE)
#: Plan operators by name.
JOINS, SPLIT_MARK = ("SortMergeJoin", "ShuffledHashJoin"), "(skew=true)"
READS = ("AQEShuffleRead", "CustomShuffleReader")
WRAPPERS = ("InputAdapter", "ColumnarToRow", *READS)
USER_ORIGINS = ("REPARTITION_BY_COL", "REPARTITION_BY_NUM", "REBALANCE_PARTITIONS_BY_NONE", "REBALANCE_PARTITIONS_BY_COL")
#: Sides that a split may duplicate rows of, by join type; types of a join as plans print them.
LEFT_SPLITS, RIGHT_SPLITS = ("Inner", "Cross", "LeftSemi", "LeftAnti", "LeftOuter"), ("Inner", "Cross", "RightOuter")
TYPES = ("Inner", "Cross", "LeftOuter", "RightOuter", "FullOuter", "LeftSemi", "LeftAnti", "ExistenceJoin")
#: Reads below this ratio are even; the share of bytes up to which the other side doesn't count; how near bytes must be to tie a stage to a join; the size partitions should have.
EVEN, ISOLATED, NEAR, IDEAL = 2, 0.05, 0.1, 128 * MIB


def is_join(name: Column) -> Column:
    return F.replace(name, F.lit(SPLIT_MARK), F.lit("")).isin(*JOINS)


def _origin(detail: Column, *origins: str) -> Column:
    """Whether an exchange's text has one of these words as its origin."""
    return F.arrays_overlap(F.split(F.coalesce(detail, F.lit("")), "[^A-Z_]+"), F.array(*map(F.lit, origins)))


def _word(detail: Column, word: str) -> Column:
    return F.array_contains(F.split(F.coalesce(detail, F.lit("")), r"\W+"), word)


def is_final(nodes: DataFrame) -> DataFrame:
    """Executions (app_id, execution_id) whose plan is the final one of adaptive execution."""
    return nodes.filter((F.col("path") == "0") & (F.col("name") == "AdaptiveSparkPlan") & F.col("detail").contains("isFinalPlan=true")).select(EXEC)


def join_sides(plans: DataFrame) -> DataFrame:
    """(join node, name, detail, n, needing, side0, side1): the joins of final plans, how many their plan has, what is above each and what its inputs read.

    needing is what above a join, before the next exchange, needs its partitioning: aggregate, window, join or null. A partial
    aggregate needs none. Of a side: input is shuffle (one that Spark added), user (one that the job asked for; hint says which kind) or
    operator (name). Down from the join, wrappers and the first sort are passed; the shuffle reads among them tell coalesced and
    splits, those that say skewed; exchanges are all below, in the order of the plan. plans: with an array of nodes; all is worked out in a plan's row.
    """
    final = F.exists("nodes", lambda n: (n["path"] == "0") & (n["name"] == "AdaptiveSparkPlan") & n["detail"].contains("isFinalPlan=true"))
    x = plans.filter(final).select(*EXEC, "nodes", F.filter("nodes", lambda n: is_join(n["name"])).alias("_joins"))
    x = x.select(*EXEC, "nodes", F.size("_joins").alias("n"), F.explode("_joins").alias("_j"))
    x = x.select(*EXEC, "nodes", "n", F.col("_j.path").alias("path"), F.col("_j.name").alias("name"), F.col("_j.detail").alias("detail"), *[F.concat("_j.path", F.lit(f".{i}")).alias(f"_top{i}") for i in (0, 1)])
    kind = lambda n: (
        F.when(n["name"].endswith("Exchange") | (n["name"] == "ShuffleQueryStage"), "exchange").when(n["name"].endswith("Aggregate") & ~F.coalesce(n["detail"].contains("partial_"), F.lit(False)), "aggregate")
        .when(n["name"].startswith("Window"), "window").when(is_join(n["name"]), "join")
    )
    over = F.transform(F.filter("nodes", lambda n: is_over(n["path"], F.col("path")) & kind(n).isNotNull()), lambda n: F.struct(F.length(n["path"]).alias("d"), kind(n).alias("kind")))
    below = lambda i: F.filter("nodes", lambda n: n["name"].endswith("Exchange") & (is_over(F.col(f"_top{i}"), n["path"]) | (n["path"] == F.col(f"_top{i}"))))
    exchanges = lambda i: F.array_sort(F.transform(below(i), lambda n: F.struct(ordinals(n["path"]).alias("at"), n["path"].alias("path"))))
    x = x.withColumns({"_near": F.array_max(over)["kind"]} | {f"_chain{i}": chain(F.col(f"_top{i}")) for i in (0, 1)} | {f"_exchanges{i}": F.transform(exchanges(i), lambda e: e["path"]) for i in (0, 1)}).drop("nodes")
    passes = lambda s: s["name"].isin(*WRAPPERS) | s["name"].startswith("WholeStageCodegen")

    def stop(down: Column) -> Column:
        sorted_before = lambda i: F.exists(F.slice(down, F.lit(1), i), lambda b: b["name"] == "Sort")
        return F.get(F.filter(down, lambda s, i: ~passes(s) & ((s["name"] != "Sort") | sorted_before(i))), F.lit(0))

    x = x.withColumns({f"_stop{i}": stop(F.col(f"_chain{i}")) for i in (0, 1)})
    before = lambda i: F.filter(f"_chain{i}", lambda s: s["name"].isin(*READS) & (F.col(f"_stop{i}.d").isNull() | (s["d"] < F.col(f"_stop{i}.d"))))
    behind = lambda i: F.get(F.filter(f"_chain{i}", lambda s: s["d"] == F.col(f"_stop{i}.d") + 2), F.lit(0))["detail"]
    x = x.withColumns({f"_reads{i}": before(i) for i in (0, 1)} | {f"_from{i}": behind(i) for i in (0, 1)})

    def told(i: int) -> Column:
        staged = F.coalesce(F.col(f"_stop{i}.name") == "ShuffleQueryStage", F.lit(False))
        asked = staged & _origin(F.col(f"_from{i}"), *USER_ORIGINS)
        side = F.struct(
            F.when(asked, "user").when(staged, "shuffle").otherwise("operator").alias("input"), F.when(~staged, F.coalesce(F.col(f"_stop{i}.name"), F.lit("unknown"))).alias("name"),
            F.when(asked, F.when(_origin(F.col(f"_from{i}"), *USER_ORIGINS[:2]), "repartition").otherwise("rebalance")).alias("hint"), (staged & F.exists(f"_reads{i}", lambda s: _word(s["detail"], "coalesced"))).alias("coalesced"),
            F.transform(F.filter(f"_reads{i}", lambda s: _word(s["detail"], "skewed")), lambda s: s["path"]).alias("splits"), F.col(f"_exchanges{i}").alias("exchanges"),
        )
        return F.when((F.size(f"_chain{i}") > 0) | (F.size(f"_exchanges{i}") > 0), side).alias(f"side{i}")

    return x.select(*NODE, "name", "detail", "n", F.when(F.col("_near") != "exchange", F.col("_near")).alias("needing"), told(0), told(1))


#: Metrics of exchanges and of reads of skewed partitions.
WROTE, SIZE, PARTS, SPLITS = "shuffle bytes written", "data size", "number of skewed partitions", "number of skewed partition splits"


def _with_bytes(x: DataFrame) -> DataFrame:
    """Adds, from `values`: for each side bytes, those of the first exchange below that says any, and written, only those it says it wrote; how many skewed partitions were split into how many."""
    first = lambda i, of: F.get(F.filter(F.transform(f"side{i}.exchanges", of), lambda v: v.isNotNull()), F.lit(0))
    total = lambda m: sum((F.aggregate(F.coalesce(f"side{i}.splits", F.expr("CAST(array() AS array<string>)")), F.lit(0.0), lambda a, p: a + F.coalesce(value_at(p, m).cast("double"), F.lit(0.0))) for i in (0, 1)), F.lit(0.0))
    x = x.withColumns({f"bytes{i}": first(i, lambda p: F.coalesce(value_at(p, WROTE), value_at(p, SIZE))) for i in (0, 1)} | {f"written{i}": first(i, lambda p: value_at(p, WROTE)) for i in (0, 1)})
    return x.withColumns({"parts": total(PARTS), "splits": total(SPLITS)})


def _ran() -> Column:
    """The stages of an execution, from its array of them, that run a join.

    Those linked to it; where a plan has one join and that has no stage at all, the stage that an exchange below it
    is linked to, or, if none is linked, a stage that read about as much as both sides wrote.
    """
    none = F.expr("CAST(array() AS array<string>)")
    at = F.transform(F.filter("_links", lambda v: v["path"] == F.col("path")), lambda v: v["stage_id"])
    exchanges = F.concat(F.coalesce("side0.exchanges", none), F.coalesce("side1.exchanges", none))
    below = F.transform(F.filter("_links", lambda v: F.array_contains(exchanges, v["path"])), lambda v: v["stage_id"])
    among = lambda ids: F.filter("_stages", lambda s: F.exists(ids, lambda i: i == s["stage_id"]))
    both = F.col("written0") + F.col("written1")
    near = F.filter("_stages", lambda s: (s["shuffle_read"] > 0) & (F.abs(s["shuffle_read"] - both) <= NEAR * both))
    return F.when(F.size(at) > 0, among(at)).when(F.col("n") > 1, None).when(F.size(below) > 0, among(below)).when(both > 0, near)


def skew_join_cases(nodes: DataFrame, metrics: DataFrame, links: DataFrame, stages: DataFrame, settings: DataFrame) -> DataFrame:
    """(app, execution, stage, path, case, detail, can_force): why the join of a stage was, or wasn't, split.

    case is the first that holds: split (done already), evenReads (no partition stands out), planShape (an input is no
    shuffle), userRepartition (the job asked for the shuffle), joinType (the type forbids it on one or both sides), belowThreshold
    (detail: threshold, factor or both), extraShuffle (something above needs the partitioning) or notSplit. Stages
    are (app_id, execution_id, stage_id, read_max, read_p50, shuffle_read, data_tail): data_tail is true where more data explains the slow
    tasks. A plan that isn't final, a stage without a join, and a coalesced read that may be a sum of small partitions
    give no row. Of several joins a split one counts, else the first in the plan. settings has a row an execution, `v` its version
    as major * 100 + minor. nodes: a row each, or plans with an array of them.
    """
    # One row an execution of each, so that what an execution has meets its joins once.
    listed = lambda df, name, *cols: df.groupBy(EXEC).agg(F.collect_list(F.struct(*cols)).alias(name)).hint("merge")
    x = join_sides(plans_of(nodes)).join(listed(stages, "_stages", "stage_id", "read_max", "read_p50", "shuffle_read", "data_tail"), EXEC).join(listed(links, "_links", "path", "stage_id"), EXEC, "left")
    x = _with_bytes(x.join(values_of(metrics, WROTE, SIZE, PARTS, SPLITS).hint("merge"), EXEC, "left").join(settings.hint("merge"), EXEC))
    x = x.withColumn("_s", F.explode(_ran())).withColumns({c: F.col(f"_s.{c}") for c in ("stage_id", "read_max", "read_p50", "shuffle_read", "data_tail")})
    x = x.withColumns({f"{c}{i}": F.col(f"side{i}.{c}") for c in ("input", "name", "hint", "coalesced") for i in (0, 1)})
    x = x.withColumn("marked", F.col("name").contains(SPLIT_MARK)).withColumn("skewed", (F.size("side0.splits") > 0) | (F.size("side1.splits") > 0))

    type_ = F.get(F.filter(F.regexp_extract_all("detail", F.lit(r"\]\s*,\s*(\w+)"), F.lit(1)), lambda w: w.isin(*TYPES)), F.lit(0))
    x = x.withColumn("type", type_).withColumn("left", F.coalesce(F.col("type").isin(*LEFT_SPLITS), F.lit(False))).withColumn("right", F.coalesce(F.col("type").isin(*RIGHT_SPLITS), F.lit(False)))
    yes = lambda c: F.coalesce(c, F.lit(False))
    merged = yes(F.col("coalesced0")) | yes(F.col("coalesced1"))
    both = F.col("bytes0") + F.col("bytes1")
    alone = yes((both > 0) & (F.least("bytes0", "bytes1") <= ISOLATED * both))
    threshold, factor, advisory = byte_size(F.col(THRESHOLD_)), F.col(FACTOR_).try_cast("double"), byte_size(F.col(ADVISORY_))
    x = x.withColumns({
        "even": ~merged & alone & ~F.col("data_tail") & (F.col("read_p50") > 0) & (F.col("read_max") < EVEN * F.col("read_p50")),
        "small": yes(F.col("read_max") <= threshold), "flat": ~merged & alone & yes((F.col("read_p50") > 0) & (F.col("read_max") <= factor * F.col("read_p50"))),
        "unclear": merged & yes(F.col("read_max") <= 2 * advisory), "can_force": F.when(F.col("v").isNotNull(), F.col("v") >= 303).otherwise(F.col(FORCE_).isNotNull()),
    })
    held = F.col("needing").isNotNull() & ~(F.col("can_force") & yes(F.lower(FORCE_) == "true"))
    operator, asked = yes((F.col("input0") == "operator") | (F.col("input1") == "operator")), yes((F.col("input0") == "user") | (F.col("input1") == "user"))
    case = (
        F.when(F.col("marked") | yes(F.col("skewed")), "split").when(F.col("even"), "evenReads").when(operator | F.col("input0").isNull() | F.col("input1").isNull(), "planShape").when(asked, "userRepartition")
        .when(F.col("type").isNotNull() & ~F.col("left") & ~F.col("right"), "joinType").when(F.col("small") | F.col("flat"), "belowThreshold").when(F.col("unclear"), None)
        .when(F.col("type").isNotNull() & (F.col("left") != F.col("right")), "joinType").when(held, "extraShuffle").otherwise("notSplit")
    )
    x = x.withColumn("case", case).filter("case IS NOT NULL")
    detail = (
        F.when(F.col("case") == "split", F.when((F.col("parts") > 0) & (F.col("splits") > 0), F.format_string("%d into %d", F.col("parts").cast("long"), F.col("splits").cast("long"))))
        .when(F.col("case") == "planShape", F.when(yes(F.col("input0") != "operator"), F.concat(F.lit("right: "), F.coalesce("name1", F.lit("unknown")))).otherwise(F.concat(F.lit("left: "), F.coalesce("name0", F.lit("unknown")))))
        .when(F.col("case") == "userRepartition", F.coalesce("hint0", "hint1")).when(F.col("case") == "belowThreshold", F.when(F.col("small") & F.col("flat"), "both").when(F.col("small"), "threshold").otherwise("factor"))
        .when(F.col("case") == "joinType", F.concat_ws(", ", "type", F.when(F.col("left"), "left only").when(F.col("right"), "right only"), F.when((F.col("left") | F.col("right")) & held, F.col("needing")))).when(F.col("case") == "extraShuffle", F.col("needing"))
    )
    pick = F.row_number().over(Window.partitionBy(*EXEC, "stage_id").orderBy(F.col("case") != "split", ordinals(F.col("path"))))
    return x.withColumn("_i", pick).filter("_i = 1").select(*EXEC, "stage_id", "path", "case", detail.alias("detail"), "can_force", held.alias("held"))


#: Names of the columns that `config.execution_settings` makes of the settings.
THRESHOLD_, FACTOR_, FORCE_, ADVISORY_, INITIAL_, PARTITIONS_, AQE_, COALESCE_ = (k.removeprefix("spark.").replace(".", "_") for k in SETTINGS)


def plan_flags(nodes: DataFrame) -> DataFrame:
    """(app, execution, split, asked): whether a final adaptive plan shows a skewed partition split (null for other plans), and whether the job asked for a shuffle."""
    flags = nodes.groupBy(EXEC).agg(F.bool_or(F.col("name").isin(*READS) & _word(F.col("detail"), "skewed")).alias("_split"), F.bool_or(_origin(F.col("detail"), *USER_ORIGINS)).alias("asked"))
    return flags.join(is_final(nodes).withColumn("_final", F.lit(True)), EXEC, "left").select(*EXEC, F.when(F.col("_final"), F.col("_split")).alias("split"), "asked")


def resized_shuffles(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(app, execution, stage, resized): for stages that read an exchange, whether adaptive execution reads any of those in another number of partitions.

    An exchange is linked to the stages that wrote and read it; the reader is not the least of them. It is resized if,
    up the plan, a shuffle read comes before another exchange.
    """
    exchange = F.col("name").endswith("Exchange")
    turning = nodes.filter(exchange | F.col("name").isin(*READS)).select(*NODE, F.col("name").isin(*READS).alias("read"))
    over = with_ancestors(nodes.filter(exchange).select(NODE), turning, "up").groupBy(NODE).agg(F.max_by("up.read", F.size(ordinals(F.col("up.path")))).alias("read"))
    reads = nodes.filter(exchange).select(NODE).join(links, NODE).withColumn("_least", F.min("stage_id").over(Window.partitionBy(NODE))).filter("stage_id <> _least")
    return reads.join(over, NODE, "left").groupBy(*EXEC, "stage_id").agg(F.bool_or(F.coalesce("read", F.lit(False))).alias("resized"))


def partition_levers(stages: DataFrame, nodes: DataFrame, links: DataFrame, settings: DataFrame) -> DataFrame:
    """(app, execution, stage, partitions, lever, key, count, needed, asked): what sized a stage's shuffle and whether more partitions would help.

    count is what the settings start from and key the setting that says so: the initial number where adaptive execution
    coalesces and it is set, else the shuffle partitions. lever: property (as many tasks as that, or unknown), aqeCoalesced
    (fewer, merged by adaptive execution), aqeAdjusted (more, by it) or ownPartitioning. partitions: sufficient (tasks
    read IDEAL bytes or less), aqeCoalesced, ownPartitioning (no setting would help) or raise. needed is the
    number of partitions of IDEAL bytes. stages: (app_id, execution_id, stage_id, tasks, shuffle_read); a stage outside
    SQL has a null execution, and settings a row for that too.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    own = settings.select(F.col("app_id").alias("_app"), F.col("execution_id").alias("_execution"), INITIAL_, PARTITIONS_, AQE_, COALESCE_)
    x = stages.select(*EXEC, "stage_id", "tasks", "shuffle_read")
    x = x.join(own, (F.col("app_id") == F.col("_app")) & F.col("execution_id").eqNullSafe(F.col("_execution")), "left").drop("_app", "_execution")
    x = x.join(plan_flags(nodes), EXEC, "left").join(resized_shuffles(nodes, links), [*EXEC, "stage_id"], "left")
    number = lambda c: F.when(F.col(c).rlike("^[0-9]+$"), F.col(c).try_cast("long"))
    x = x.withColumn("aqe", F.col("execution_id").isNotNull() & yes(F.lower(AQE_) == "true"))
    x = x.withColumn("merges", F.col("aqe") & yes(F.lower(COALESCE_) == "true"))
    x = x.withColumn("resized", F.when(F.col("aqe"), F.col("resized"))).withColumn("split", F.when(F.col("aqe"), F.col("split"))).withColumn("asked", yes(F.col("asked")))
    x = x.withColumn("_initial", F.when(F.col("merges"), number(INITIAL_))).withColumn("count", F.coalesce("_initial", number(PARTITIONS_)))
    n, count = F.col("tasks"), F.col("count")
    grew = F.coalesce(F.col("resized"), F.coalesce(F.col("split"), F.lit(True)) | ~F.col("asked"))
    lever = F.when(count.isNull() | (n == count), "property").when(F.col("merges") & (n < count) & F.coalesce(F.col("resized"), F.lit(True)), "aqeCoalesced").when(F.col("aqe") & (n > count) & grew, "aqeAdjusted").otherwise("ownPartitioning")
    x = x.withColumn("lever", lever).withColumn("needed", F.ceil(F.col("shuffle_read") / IDEAL))
    partitions = (
        F.when(F.col("shuffle_read") / F.greatest(F.lit(1), n) <= IDEAL, "sufficient").when(F.col("lever") == "aqeCoalesced", "aqeCoalesced").when((F.col("lever") == "ownPartitioning") & ~F.coalesce("resized", F.lit(True)), "ownPartitioning")
        .when((count >= F.col("needed")) & (F.col("lever") != "aqeAdjusted"), "ownPartitioning").otherwise("raise")
    )
    return x.select(*EXEC, "stage_id", partitions.alias("partitions"), "lever", F.when(F.col("_initial").isNotNull(), INITIAL).otherwise(PARTITIONS).alias("key"), "count", "needed", "asked")
