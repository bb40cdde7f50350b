"""Joins and unions that several executions of a run compute alike, and rows around nested loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .nodes import EXEC, NODE, depth, parent, scan_relations, subtree_shapes, with_ancestors, with_descendants, with_metrics

#: Operators that pass on every row of their one child.
PASSING = ("InputAdapter", "Project", "Sort", "Exchange", "BroadcastExchange", "ShuffleQueryStage", "BroadcastQueryStage", "AQEShuffleRead", "CustomShuffleReader", "ColumnarToRow", "AdaptiveSparkPlan")
#: Executions from which a composite or relation is worth caching.
TIMES = 2


#: Words that number a plan or say which side was built; none of them tells two joins apart.
RUN_WORDS = ("plan_id", "BuildLeft", "BuildRight")


def same_terms(detail: Column) -> Column:
    """The terms of a join's or union's text that tell what it computes, as one text.

    Terms lie between commas and ANDs. Expression ids, the mark of code generation behind them all, and terms about one run of the plan go; names on both sides of an
    equality are put in order, brackets around them left where they are.
    """
    terms = F.split(F.regexp_replace(F.substring_index(detail, " [codegen", 1), "#[0-9]+L?", ""), r",| AND ")
    own = F.filter(terms, lambda t: ~F.arrays_overlap(F.split(t, r"\W+"), F.array(*map(F.lit, RUN_WORDS))))

    def in_order(t: Column) -> Column:
        core = F.btrim(t, F.lit(" ()[]"))
        sides = F.split(core, " = ")
        plain = (F.size(sides) == 2) & F.forall(sides, lambda s: s.rlike(r"^[A-Za-z_][\w.]*$"))
        return F.when(plain, F.replace(t, core, F.array_join(F.array_sort(sides), " = "))).otherwise(F.trim(t))

    return F.array_join(F.transform(own, in_order), ",")


def composites(nodes: DataFrame, metrics: DataFrame) -> DataFrame:
    """(node, operator, fingerprint, relations, bytes, above): one row a join or union, with the relations scanned below it, the bytes read there, and the fingerprints of composites above it."""
    kind = F.when(F.col("name").rlike("(?i)join"), "join").when(F.col("name") == "Union", "union")
    own = nodes.withColumn("operator", kind).filter("operator IS NOT NULL").select(*NODE, "operator", F.coalesce(same_terms(F.col("detail")), F.lit("")).alias("_own"))
    labels = metrics.groupBy(NODE).agg(F.array_join(F.sort_array(F.collect_set("metric")), ",").alias("_m"))
    named = nodes.select(*NODE, "name").join(labels, NODE, "left").select(*NODE, F.concat_ws("/", "name", "_m").alias("name"))
    x = own.join(subtree_shapes(named), NODE).select(*NODE, "operator", F.sha2(F.concat_ws("|", "fingerprint", "_own"), 256).alias("fingerprint"))
    scans = with_metrics(scan_relations(nodes).filter("relation IS NOT NULL"), metrics, "size of files read").select(*NODE, F.concat_ws(":", "format", "relation").alias("relation"), F.coalesce("size_of_files_read", F.lit(0.0)).alias("bytes"))
    below = with_descendants(nodes.select(NODE).join(own.select(NODE), NODE, "left_semi").unionByName(scans.select(NODE)).distinct()).join(own.select(NODE), NODE, "left_semi")
    at = scans.select(*EXEC, F.col("path").alias("_p"), "relation", "bytes")
    leaves = below.select(*NODE, F.col("below.path").alias("_p")).join(at, [*EXEC, "_p"]).groupBy(NODE).agg(F.sort_array(F.collect_set("relation")).alias("relations"), F.sum("bytes").alias("bytes"))
    over = with_descendants(x.select(*NODE, "fingerprint")).filter(F.col("below.path") != F.col("path")).groupBy(*EXEC, F.col("below.path").alias("path")).agg(F.collect_set("fingerprint").alias("above"))
    none = F.array().cast("array<string>")
    return x.join(leaves, NODE, "left").join(over, NODE, "left").select(*NODE, "operator", "fingerprint", F.coalesce("relations", none).alias("relations"), F.coalesce("bytes", F.lit(0.0)).alias("bytes"), F.coalesce("above", none).alias("above"))


def _uses(found: DataFrame) -> DataFrame:
    """(app, execution, fingerprint, operator, relations, bytes, above): composites of an execution, equal ones once, with what is above the first of them."""
    order = F.transform(F.split("path", r"\."), lambda i: i.try_cast("int"))
    return found.groupBy(*EXEC, "fingerprint").agg(F.first("operator").alias("operator"), F.array_distinct(F.flatten(F.collect_list("relations"))).alias("relations"), F.sum("bytes").alias("bytes"), F.min_by("above", order).alias("above"))


def caching_composites(found: DataFrame, times: int = TIMES) -> tuple[DataFrame, DataFrame]:
    """Composites in `times` or more executions, executions covered by such a composite above left out; and which execution reads which relation inside one.

    The first frame is (app, fingerprint, operator, relations, executions, bytes), the second (app, execution, relation).
    found: from `composites`. Composites that scan no known relation aren't reported.
    """
    uses = _uses(found)
    many = uses.groupBy("app_id", "fingerprint").agg(F.count("*").alias("_n")).filter(F.col("_n") >= times).select("app_id", "fingerprint")
    good = uses.join(many, ["app_id", "fingerprint"], "left_semi")
    pairs = good.select("app_id", "fingerprint", F.explode("above").alias("_up")).distinct().join(many.withColumnRenamed("fingerprint", "_up"), ["app_id", "_up"], "left_semi")
    covered = pairs.join(good.select(*EXEC, F.col("fingerprint").alias("_up")), ["app_id", "_up"]).select(*EXEC, "fingerprint").distinct()
    left = good.join(covered, [*EXEC, "fingerprint"], "left_anti")
    none = F.array().cast("array<string>")
    names = good.groupBy("app_id", "fingerprint").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_set("relations")))).alias("relations"))
    sums = left.groupBy("app_id", "fingerprint").agg(F.first("operator").alias("operator"), F.count("*").alias("executions"), F.sum("bytes").alias("bytes")).filter(F.col("executions") >= times)
    out = sums.join(names, ["app_id", "fingerprint"]).filter(F.size(F.coalesce("relations", none)) > 0).select("app_id", "fingerprint", "operator", F.array_join("relations", ",").alias("relations"), "executions", "bytes")
    inside = left.join(out.select("app_id", "fingerprint"), ["app_id", "fingerprint"], "left_semi").join(names.withColumnRenamed("relations", "_r"), ["app_id", "fingerprint"]).select(*EXEC, F.explode("_r").alias("relation")).distinct()
    return out, inside


def uncovered_relations(nodes: DataFrame, inside: DataFrame, times: int = TIMES) -> DataFrame:
    """(app, relation, executions): relations that `times` or more executions scan outside the composites of `caching_composites`."""
    s = scan_relations(nodes).filter("relation IS NOT NULL").select(*EXEC, F.concat_ws(":", "format", "relation").alias("relation")).distinct()
    return s.join(inside, [*EXEC, "relation"], "left_anti").groupBy("app_id", "relation").agg(F.count("*").alias("executions")).filter(F.col("executions") >= times)


def nested_loop_rows(nodes: DataFrame, metrics: DataFrame) -> DataFrame:
    """(node, operator, type, condition, out, left, right): nested loops with their own rows and those of both sides.

    A side's rows are the nearest count at or below it, through operators that pass all rows of one child on; null where
    another operator without a count is in between. type is null where the text has none.
    """
    ids = lambda c: F.nullif(F.trim(F.regexp_replace(c, "#[0-9]+L?", "")), F.lit(""))
    loop, product = r"(?s)^BroadcastNestedLoopJoin\s+Build(?:Left|Right),\s*(\w+)(?:,\s*(.+))?$", r"(?s)^CartesianProduct(?:\s+(.+))?$"
    text, is_loop = F.trim(F.coalesce("detail", F.lit(""))), F.col("name") == "BroadcastNestedLoopJoin"
    counted = with_metrics(nodes.select(*NODE, "name", "detail"), metrics, "number of output rows").withColumnRenamed("number_of_output_rows", "rows")
    joins = counted.filter(F.col("name").isin("BroadcastNestedLoopJoin", "CartesianProduct")).select(
        *NODE, F.col("name").alias("operator"), F.when(is_loop, F.nullif(F.regexp_extract(text, loop, 1), F.lit(""))).otherwise("Inner").alias("type"),
        ids(F.when(is_loop, F.regexp_extract(text, loop, 2)).otherwise(F.regexp_extract(text, product, 1))).alias("condition"), F.col("rows").alias("out"),
    )
    children = nodes.select(*EXEC, parent(F.col("path")).alias("path")).filter("path <> ''").groupBy(NODE).agg(F.count("*").alias("_children"))
    passes = (F.col("name").isin(*PASSING) | F.col("name").startswith("WholeStageCodegen")) & (F.coalesce("_children", F.lit(0)) == 1)
    below = counted.join(children, NODE, "left").select(*EXEC, F.col("path").alias("_p"), "rows", passes.alias("_passes"))
    x = with_ancestors(below.withColumn("path", F.col("_p")), joins.select(NODE)).select(*EXEC, "up.path", "_p", "rows", "_passes")
    rest = F.substring(F.col("_p"), F.length("path") + 2, F.length("_p"))
    x = x.withColumn("side", F.regexp_extract(rest, r"^([0-9]+)", 1).try_cast("int")).filter("side < 2").withColumn("_d", depth(F.col("_p")))
    # The nearest node that counts or stops: all nodes above it pass on, so it is the only one at its depth.
    near = x.filter(F.col("rows").isNotNull() | ~F.col("_passes")).groupBy(*NODE, "side").agg(F.min_by("rows", "_d").alias("rows"))
    sides = near.groupBy(NODE).agg(*[F.max(F.when(F.col("side") == i, F.col("rows"))).alias(n) for i, n in enumerate(("left", "right"))])
    return joins.join(sides, NODE, "left")
