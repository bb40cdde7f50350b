"""Order among findings: costs, rollups, steps, and filters for a reader."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.intervals import islands
from .impact import FAILURE_TYPES

#: Bands from the worst down.
BANDS = ("critical", "warning", "info")


def rank_cost(findings: DataFrame, stages: DataFrame) -> DataFrame:
    """Findings gain rank_cost: their stage's task time, 0 for info or without a stage."""
    work = stages.select("app_id", "stage_id", F.col("task_ms").alias("_task_ms"))
    return findings.join(work, ["app_id", "stage_id"], "left").select(*findings.columns, F.when(F.col("band") == "info", F.lit(0)).otherwise(F.coalesce("_task_ms", F.lit(0))).alias("rank_cost"))


def rollup(findings: DataFrame, stages: DataFrame) -> DataFrame:
    """(app, type, kind, n, total_ms): findings by type; the time of a type is at most the union of its stages' windows."""
    kind = F.when(F.col("waste_ms").isNotNull(), "time").otherwise("count")
    sums = findings.groupBy("app_id", "type", kind.alias("kind")).agg(F.count("*").alias("n"), F.sum("waste_ms").alias("sum_ms"))
    spans = findings.filter("waste_ms IS NOT NULL AND stage_id IS NOT NULL").select("app_id", "type", "stage_id").distinct().join(stages.select("app_id", "stage_id", "submitted_ms", "completed_ms"), ["app_id", "stage_id"])
    union = islands(spans, ["app_id", "type"], "submitted_ms", "completed_ms").groupBy("app_id", "type").agg(F.sum(F.col("completed_ms") - F.col("submitted_ms")).alias("union_ms"))
    x = sums.join(union, ["app_id", "type"], "left")
    return x.select("app_id", "type", "kind", "n", F.when(F.col("kind") == "time", F.least("sum_ms", F.coalesce("union_ms", "sum_ms"))).alias("total_ms"))


def rank_findings(findings: DataFrame) -> DataFrame:
    """Findings (with rank_cost) gain rank within their run: worst band, then cost, then type and stage."""
    band = F.array_position(F.array(*map(F.lit, BANDS)), F.col("band"))
    return findings.withColumn("rank", F.row_number().over(Window.partitionBy("app_id").orderBy(band, F.desc("rank_cost"), "type", "rule", F.col("stage_id").asc_nulls_last())))


def next_steps(ranked: DataFrame, limit: int = 3) -> DataFrame:
    """(app, step, stage_id, lead, related): the first places to look at; at each, its best finding and one of each other type.

    Failures lead. A place is a stage, or the run.
    """
    failing = F.col("type").isin(*FAILURE_TYPES)
    best = ranked.groupBy("app_id", "stage_id", "type").agg(F.min("rank").alias("rank"), F.min(F.when(failing, 0).otherwise(1)).alias("late"))
    at = Window.partitionBy("app_id", "stage_id").orderBy("late", "rank")
    best = best.withColumn("_i", F.row_number().over(at))
    place = best.groupBy("app_id", "stage_id").agg(
        F.min(F.struct("late", "rank")).alias("order"), F.max(F.when(F.col("_i") == 1, F.col("type"))).alias("lead"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("_i") > 1, F.col("type")))), ",").alias("related"),
    )
    place = place.withColumn("step", F.row_number().over(Window.partitionBy("app_id").orderBy("order")))
    return place.filter(F.col("step") <= limit).select("app_id", "step", "stage_id", "lead", "related")


def cost_lane(claims: DataFrame, limit: int = 3) -> DataFrame:
    """The `limit` findings of a run whose fixes free the most task time, by `waste.core_time`; ties by band, type, rule and stage. Findings without such a figure aren't ranked."""
    band = F.array_position(F.array(*map(F.lit, BANDS)), F.col("band"))
    order = F.row_number().over(Window.partitionBy("app_id").orderBy(F.desc("core_high_ms"), band, "type", "rule", F.col("stage_id").asc_nulls_last()))
    return claims.filter("core_high_ms > 0").withColumn("rank", order).filter(F.col("rank") <= limit).select("app_id", "rank", "type", "rule", "stage_id", "core_high_ms")


def filter_findings(findings: DataFrame, bands: Sequence[str] = ("critical", "warning"), types: Sequence[str] | None = None, stage_ids: Sequence[int] | None = None) -> DataFrame:
    """Findings of these bands, types and stages, with the number of notes that the bands hide in their run."""
    hidden = findings.groupBy("app_id").agg(F.count_if(~F.col("band").isin(*bands)).alias("hidden_n"))
    out = findings.filter(F.col("band").isin(*bands))
    out = out if types is None else out.filter(F.col("type").isin(*types))
    out = out if stage_ids is None else out.filter(F.col("stage_id").isin(*stage_ids))
    return out.join(hidden, ["app_id"])


def stage_type_counts(findings: DataFrame) -> DataFrame:
    return findings.filter("stage_id IS NOT NULL").groupBy("app_id", "stage_id").agg(F.countDistinct("type").alias("n"))


def suppress(findings: DataFrame, pairs: Sequence[tuple[str, str]] = (("stageSlowness", "slowHost"),)) -> DataFrame:
    """Findings without those of a type on stages where another type explains them."""
    out = findings
    for gone, because in pairs:
        explained = findings.filter(F.col("type") == because).select("app_id", "stage_id").distinct().withColumn("type", F.lit(gone))
        out = out.join(explained, ["app_id", "stage_id", "type"], "left_anti").select(*findings.columns)
    return out


def finding_ids(findings: DataFrame) -> DataFrame:
    """Findings gain id, a hash of type, rule, place, metric and value; of equal ones, one stays."""
    key = F.sha2(F.concat_ws("|", "app_id", "type", "rule", F.coalesce(F.col("stage_id").cast("string"), F.lit("run")), "metric", F.format_string("%.6f", "value")), 256)
    return findings.withColumn("id", key).dropDuplicates(["id"])


def pages(rows: DataFrame, page_chars: int = 20_000) -> DataFrame:
    """Rows (app, section, rank, ...) gain page, from 0, by the length of their JSON, total (rows of their section) and cursor, which names the next page and is null on the last.

    A cursor holds a fingerprint of all of the run's rows, so that one from another result is told apart.
    """
    own, run, text = Window.partitionBy("app_id", "section"), Window.partitionBy("app_id"), F.to_json(F.struct(*rows.columns))
    upto = F.sum(F.length(text)).over(own.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
    x = rows.withColumn("page", F.floor(F.coalesce(upto, F.lit(0)) / page_chars)).withColumn("_h", F.xxhash64(text))
    mark = F.hex(F.bit_xor("_h").over(run).bitwiseXOR(F.count("*").over(run)))
    after = F.min("page").over(own.orderBy("page").rangeBetween(1, Window.unboundedFollowing))
    return x.select(*rows.columns, "page", F.count("*").over(own).alias("total"), F.when(after.isNotNull(), F.concat_ws(":", mark, "section", after.cast("string"))).alias("cursor"))


def page_at(paged: DataFrame, app_id: str, cursor: str) -> DataFrame:
    """Rows of the page that a cursor of `pages` names. None of another result: a cursor whose fingerprint no row of the run has given."""
    mark, section, page = cursor.split(":")
    mine = paged.filter(F.col("app_id") == app_id)
    known = mine.filter(F.substring_index("cursor", ":", 1) == mark).select("app_id").distinct()
    return mine.filter((F.col("section") == section) & (F.col("page") == int(page))).join(known, ["app_id"], "left_semi")
