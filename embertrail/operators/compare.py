"""Comparison of run pairs (base_app, cand_app): stages paired, metrics and findings set against each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: relative change below which a difference is noise.
NOISE = 0.02
#: Run metrics and whether more is worse (1), better (-1) or neither (0).
DIRECTIONS = {"duration_ms": 1, "task_ms": 1, "gc_ms": 1, "fetch_wait_ms": 1, "mem_spilled": 1, "disk_spilled": 1, "shuffle_read": 1, "shuffle_write": 1, "failed_tasks": 1, "tasks": 0, "stages": 0, "input_bytes": 0, "output_bytes": 0}
STAGE_METRICS = ("stage_ms", "task_ms", "gc_ms", "mem_spilled", "disk_spilled", "shuffle_read", "input_bytes", "tasks")
#: Settings that only identify a run, and names whose values are withheld.
RUN_KEYS, SECRET = r"^spark\.(app\.(id|startTime|submitTime)|driver\.(host|port))$", r"(?i)secret|password|token|access[._]?key|credential"


def run_metrics(stages: DataFrame, timing: DataFrame) -> DataFrame:
    """One row a run with the figures of DIRECTIONS."""
    sums = [c for c in DIRECTIONS if c not in ("duration_ms", "stages")]
    return stages.groupBy("app_id").agg(F.count("*").alias("stages"), *[F.sum(c).alias(c) for c in sums]).join(timing.select("app_id", "duration_ms"), ["app_id"])


def _sides(pairs: DataFrame, df: DataFrame) -> tuple[DataFrame, DataFrame]:
    base = pairs.join(df.withColumnRenamed("app_id", "base_app"), ["base_app"])
    return base, pairs.join(df.withColumnRenamed("app_id", "cand_app"), ["cand_app"])


def metric_deltas(metrics: DataFrame, pairs: DataFrame, noise: float = NOISE) -> DataFrame:
    """(base_app, cand_app, metric, base, cand, delta, relative, direction): better, worse, changed or same within `noise`."""
    long = metrics.select("app_id", F.explode(F.create_map(*[x for m in DIRECTIONS for x in (F.lit(m), F.col(m).cast("double"))])).alias("metric", "v"))
    base, cand = _sides(pairs, long)
    x = base.withColumnRenamed("v", "base").join(cand.withColumnRenamed("v", "cand"), ["base_app", "cand_app", "metric"])
    delta = F.col("cand") - F.col("base")
    rel = F.when(F.col("base") != 0, delta / F.col("base")).when(F.col("cand") == 0, 0.0)
    worse = F.create_map(*[y for m, d in DIRECTIONS.items() for y in (F.lit(m), F.lit(d))])[F.col("metric")]
    same = F.abs(rel) <= noise
    return x.select("base_app", "cand_app", "metric", "base", "cand", delta.alias("delta"), rel.alias("relative"), F.when(same, "same").when(worse == 0, "changed").when(delta * worse > 0, "worse").otherwise("better").alias("direction"))


def match_stages(identity: DataFrame, pairs: DataFrame) -> DataFrame:
    """(base_app, cand_app, base_stage, cand_stage) of equal identity where both runs have as many stages of it; paired in order of id."""
    order = Window.partitionBy("app_id", "identity").orderBy("stage_id")
    counted = identity.withColumn("i", F.row_number().over(order)).join(identity.groupBy("app_id", "identity").agg(F.count("*").alias("n")), ["app_id", "identity"])
    base, cand = _sides(pairs, counted)
    return base.withColumnRenamed("stage_id", "base_stage").join(cand.withColumnRenamed("stage_id", "cand_stage"), ["base_app", "cand_app", "identity", "i", "n"]).select("base_app", "cand_app", "base_stage", "cand_stage")


def match_coverage(matches: DataFrame, stages: DataFrame, pairs: DataFrame) -> DataFrame:
    """Twice the pairs over all stages of both runs."""
    n = stages.groupBy("app_id").agg(F.count("*").alias("n"))
    base, cand = _sides(pairs, n)
    both = base.withColumnRenamed("n", "base_n").join(cand.withColumnRenamed("n", "cand_n"), ["base_app", "cand_app"])
    paired = matches.groupBy("base_app", "cand_app").agg(F.count("*").alias("paired"))
    return both.join(paired, ["base_app", "cand_app"], "left").select("base_app", "cand_app", F.coalesce("paired", F.lit(0)).alias("paired"), (2 * F.coalesce("paired", F.lit(0)) / (F.col("base_n") + F.col("cand_n"))).alias("coverage"))


def leftover_stages(matches: DataFrame, stages: DataFrame, pairs: DataFrame) -> DataFrame:
    """(base_app, cand_app, side, stage_id) of stages without a partner."""
    base, cand = _sides(pairs, stages.select("app_id", "stage_id"))
    alone = base.join(matches.withColumnRenamed("base_stage", "stage_id"), ["base_app", "cand_app", "stage_id"], "left_anti").withColumn("side", F.lit("base"))
    return alone.unionByName(cand.join(matches.withColumnRenamed("cand_stage", "stage_id"), ["base_app", "cand_app", "stage_id"], "left_anti").withColumn("side", F.lit("cand"))).select("base_app", "cand_app", "side", "stage_id")


def pair_deltas(matches: DataFrame, stages: DataFrame) -> DataFrame:
    """(pair, metric, base, cand, delta) of paired stages."""
    long = stages.select("app_id", "stage_id", F.explode(F.create_map(*[x for m in STAGE_METRICS for x in (F.lit(m), F.col(m).cast("double"))])).alias("metric", "v"))
    b = long.select(F.col("app_id").alias("base_app"), F.col("stage_id").alias("base_stage"), "metric", F.col("v").alias("base"))
    c = long.select(F.col("app_id").alias("cand_app"), F.col("stage_id").alias("cand_stage"), "metric", F.col("v").alias("cand"))
    return matches.join(b, ["base_app", "base_stage"]).join(c, ["cand_app", "cand_stage", "metric"]).withColumn("delta", F.col("cand") - F.col("base")).select("base_app", "cand_app", "base_stage", "cand_stage", "metric", "base", "cand", "delta")


def stage_skew_deltas(matches: DataFrame, stages: DataFrame) -> DataFrame:
    """Longest task over stage duration of paired stages."""
    share = stages.filter("stage_ms > 0").select("app_id", "stage_id", (F.col("longest") / F.col("stage_ms")).alias("v"))
    b = share.select(F.col("app_id").alias("base_app"), F.col("stage_id").alias("base_stage"), F.col("v").alias("base"))
    c = share.select(F.col("app_id").alias("cand_app"), F.col("stage_id").alias("cand_stage"), F.col("v").alias("cand"))
    return matches.join(b, ["base_app", "base_stage"]).join(c, ["cand_app", "cand_stage"]).withColumn("delta", F.col("cand") - F.col("base")).select("base_app", "cand_app", "base_stage", "cand_stage", "base", "cand", "delta")


def findings_delta(findings: DataFrame, matches: DataFrame, pairs: DataFrame) -> DataFrame:
    """(base_app, cand_app, status, type, rule, stage_id, band, from_band): introduced, resolved, or changed in band.

    A base finding stands at its stage's partner; findings of one type, rule and place pair in order of band.
    """
    base, cand = _sides(pairs, findings.select("app_id", "type", "rule", "stage_id", "band"))
    moved = base.join(matches.select("base_app", "cand_app", F.col("base_stage").alias("stage_id"), "cand_stage"), ["base_app", "cand_app", "stage_id"], "left")
    moved = moved.withColumn("place", F.when(F.col("stage_id").isNull(), "run").when(F.col("cand_stage").isNotNull(), F.col("cand_stage").cast("string")).otherwise(F.concat(F.lit("base:"), F.col("stage_id"))))
    cand = cand.withColumn("place", F.coalesce(F.col("stage_id").cast("string"), F.lit("run")))
    key = ["base_app", "cand_app", "type", "rule", "place"]
    number = F.row_number().over(Window.partitionBy(*key).orderBy("band"))
    b = moved.withColumn("i", number).select(*key, "i", F.col("band").alias("base_band"), F.col("stage_id").alias("base_stage"))
    c = cand.withColumn("i", number).select(*key, "i", F.col("band").alias("cand_band"), F.col("stage_id").alias("cand_stage"))
    x = b.join(c, [*key, "i"], "full")
    status = F.when(F.col("base_band").isNull(), "introduced").when(F.col("cand_band").isNull(), "resolved").when(F.col("base_band") != F.col("cand_band"), "changed")
    return x.withColumn("status", status).filter("status IS NOT NULL").select("base_app", "cand_app", "status", "type", "rule", F.coalesce("cand_stage", "base_stage").alias("stage_id"), F.coalesce("cand_band", "base_band").alias("band"), F.col("base_band").alias("from_band"))


def conf_diff(conf: DataFrame, pairs: DataFrame, ignore: str | None = None) -> DataFrame:
    """(base_app, cand_app, key, base, cand) of settings that differ; run identity and `ignore` left out, secrets withheld."""
    conf = conf.filter(~F.col("key").rlike(RUN_KEYS))
    conf = conf if ignore is None else conf.filter(~F.col("key").rlike(ignore))
    base, cand = _sides(pairs, conf)
    x = base.withColumnRenamed("value", "base").join(cand.withColumnRenamed("value", "cand"), ["base_app", "cand_app", "key"], "full").filter(~F.col("base").eqNullSafe(F.col("cand")))
    hide = lambda c: F.when(F.col("key").rlike(SECRET) & F.col(c).isNotNull(), "(withheld)").otherwise(F.col(c)).alias(c)
    return x.select("base_app", "cand_app", "key", hide("base"), hide("cand"))


def volume_diff(deltas: DataFrame, band: float = 0.1) -> DataFrame:
    """Whether both runs read and wrote about as much."""
    return deltas.filter(F.col("metric").isin("input_bytes", "output_bytes")).select("base_app", "cand_app", F.col("metric").alias("figure"), "relative", (F.abs("relative") <= band).alias("equal"))
