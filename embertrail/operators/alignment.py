"""Pairing the executions and stages of two runs that need not be alike. Every table carries its pair of runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut

#: Least similarity of paired executions, share of the smaller run that must pair, least Jaccard of paired stages, coverage that is trusted.
LEAST_SCORE, LEAST_AGREEMENT, LEAST_STAGE, TRUSTED = 0.55, 0.5, 0.6, 0.9
#: Weights of a token's kind in an execution's similarity.
WEIGHTS = {"structure": 4.0, "frame": 2.0, "word": 1.0}
PAIR = ["base_app", "cand_app"]


def normalised(text: Column, patterns: Sequence[str] = ()) -> Column:
    """A name or detail without what differs from run to run: expression ids, plan ids, numbers, and the caller's patterns."""
    for p in patterns:
        text = F.regexp_replace(text, p, "<x>")
    text = F.regexp_replace(text, r"#[0-9]+L?|\[?plan_id=[0-9]+\]?", "")
    return F.regexp_replace(text, r"[0-9]+", "<n>")


def stage_identity(stages: DataFrame, nodes: DataFrame, patterns: Sequence[str] = ()) -> DataFrame:
    """(app_id, stage_id, identity): the normalised name and a digest of the stage's plan nodes; without nodes the name alone.

    stages: (app_id, stage_id, name); nodes: (app_id, stage_id, name, detail).
    """
    text = F.concat_ws("=", normalised(F.col("name"), patterns), normalised(F.coalesce("detail", F.lit("")), patterns))
    digest = nodes.groupBy("app_id", "stage_id").agg(F.sha2(F.concat_ws("|", F.sort_array(F.collect_list(text))), 256).alias("plan"))
    x = stages.join(digest, ["app_id", "stage_id"], "left")
    return x.select("app_id", "stage_id", F.concat_ws("/", normalised(F.col("name"), patterns), F.coalesce("plan", F.lit("none"))).alias("identity"))


def _two_sides(df: DataFrame, pairs: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    rest = [c for c in df.columns if c not in ("app_id", key)]
    return tuple(pairs.join(df.select(F.col("app_id").alias(f"{s}_app"), F.col(key).alias(f"{s}_{key}"), *rest), [f"{s}_app"]) for s in ("base", "cand"))


def execution_similarity(tokens: DataFrame, pairs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """(pair, base_execution_id, cand_execution_id, score) of executions alike by at least `least`.

    tokens: (app_id, execution_id, kind, token). For each kind both have, the Jaccard of their tokens, weighted by kind;
    only executions with a common token meet.
    """
    t = tokens.distinct()
    n = t.groupBy("app_id", "execution_id", "kind").agg(F.count("*").alias("n"))
    base, cand = _two_sides(t, pairs, "execution_id")
    ids = [*PAIR, "base_execution_id", "cand_execution_id"]
    common = base.join(cand, [*PAIR, "kind", "token"]).groupBy(*ids, "kind").agg(F.count("*").alias("common"))
    n_base, n_cand = _two_sides(n, pairs, "execution_id")
    met = common.select(ids).distinct()
    both = met.join(n_base.withColumnRenamed("n", "nb"), [*PAIR, "base_execution_id"]).join(n_cand.withColumnRenamed("n", "nc"), [*PAIR, "cand_execution_id", "kind"])
    x = both.join(common, [*ids, "kind"], "left").withColumn("j", F.coalesce("common", F.lit(0)) / (F.col("nb") + F.col("nc") - F.coalesce("common", F.lit(0))))
    w = F.create_map(*[y for k, v in WEIGHTS.items() for y in (F.lit(k), F.lit(v))])[F.col("kind")]
    return x.groupBy(ids).agg((F.sum(w * F.col("j")) / F.sum(w)).alias("score")).filter(F.col("score") >= least)


def mutual_best(scores: DataFrame, keys: Sequence[str], left: str, right: str) -> DataFrame:
    """One partner at most on each side: rounds in which each best pair of both its members is taken, ties to the lower ids,
    until a round takes none."""
    out, rest = None, cut(scores)
    while True:
        by = lambda side, other: F.row_number().over(Window.partitionBy(*keys, side).orderBy(F.desc("score"), side, other))
        took = cut(rest.withColumn("_l", by(left, right)).withColumn("_r", by(right, left)).filter("_l = 1 AND _r = 1").drop("_l", "_r"))
        out = took if out is None else out.unionByName(took)
        if not took.limit(1).count():
            return out
        rest = cut(rest.join(took.select(*keys, left), [*keys, left], "left_anti").join(took.select(*keys, right), [*keys, right], "left_anti"))


def align_executions(similarity: DataFrame, executions: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair, base_execution_id, cand_execution_id, score): equal signatures pair in order, then best mutual matches.

    executions: (app_id, execution_id, signature). Where fewer than half of the smaller run's executions pair, none does.
    """
    ids = [*PAIR, "base_execution_id", "cand_execution_id"]
    i = F.row_number().over(Window.partitionBy("app_id", "signature").orderBy("execution_id"))
    base, cand = _two_sides(executions.withColumn("i", i), pairs, "execution_id")
    same = base.join(cand, [*PAIR, "signature", "i"]).select(*ids, F.lit(1.0).alias("score"))
    left = similarity.join(same.select(*PAIR, "base_execution_id"), [*PAIR, "base_execution_id"], "left_anti").join(same.select(*PAIR, "cand_execution_id"), [*PAIR, "cand_execution_id"], "left_anti")
    out = same.unionByName(mutual_best(left, PAIR, "base_execution_id", "cand_execution_id").select(*ids, "score"))
    n = executions.groupBy("app_id").agg(F.count("*").alias("n"))
    fewer = pairs.join(n.select(F.col("app_id").alias("base_app"), F.col("n").alias("b")), ["base_app"]).join(n.select(F.col("app_id").alias("cand_app"), F.col("n").alias("c")), ["cand_app"]).select(*PAIR, F.least("b", "c").alias("least"))
    out = cut(out)
    good = out.groupBy(PAIR).agg(F.count("*").alias("k")).join(fewer, PAIR).filter(F.col("k") / F.col("least") >= LEAST_AGREEMENT).select(PAIR)
    return out.join(good, PAIR, "left_semi")


def pair_stages(execution_pairs: DataFrame, stages: DataFrame, tokens: DataFrame) -> DataFrame:
    """(pair, base_stage_id, cand_stage_id, quality, score) within paired executions: exact key, structural key, alike by tokens, then place by name.

    stages: (app_id, execution_id, stage_id, exact, structural, name); tokens: (app_id, stage_id, token).
    """
    ids = [*PAIR, "base_stage_id", "cand_stage_id"]
    x = execution_pairs.select(*PAIR, "base_execution_id", "cand_execution_id")
    side = {s: x.join(stages.select(F.col("app_id").alias(f"{s}_app"), F.col("execution_id").alias(f"{s}_execution_id"), F.col("stage_id").alias(f"{s}_stage_id"), "exact", "structural", "name"), [f"{s}_app", f"{s}_execution_id"]) for s in ("base", "cand")}
    place, done = [*PAIR, "base_execution_id", "cand_execution_id"], None

    def left(s: str) -> DataFrame:
        return side[s] if done is None else side[s].join(done.select(*PAIR, f"{s}_stage_id"), [*PAIR, f"{s}_stage_id"], "left_anti")

    def numbered(s: str, key: str) -> DataFrame:
        return left(s).withColumn("i", F.row_number().over(Window.partitionBy(*place, key).orderBy(f"{s}_stage_id"))).select(*place, key, "i", f"{s}_stage_id")

    for key, quality, score in (("exact", "exact", 1.0), ("structural", "structural", 0.9), (None, "similar", None), ("name", "position", 0.5)):
        if key is None:
            n = tokens.distinct().groupBy("app_id", "stage_id").agg(F.count("*").alias("n"))
            t = {s: left(s).select(*place, f"{s}_stage_id").join(tokens.distinct().select(F.col("app_id").alias(f"{s}_app"), F.col("stage_id").alias(f"{s}_stage_id"), "token"), [f"{s}_app", f"{s}_stage_id"]) for s in ("base", "cand")}
            common = t["base"].join(t["cand"], [*place, "token"]).groupBy(*place, "base_stage_id", "cand_stage_id").agg(F.count("*").alias("common"))
            for s in ("base", "cand"):
                common = common.join(n.select(F.col("app_id").alias(f"{s}_app"), F.col("stage_id").alias(f"{s}_stage_id"), F.col("n").alias(f"n_{s}")), [f"{s}_app", f"{s}_stage_id"])
            scored = common.withColumn("score", F.col("common") / (F.col("n_base") + F.col("n_cand") - F.col("common"))).filter(F.col("score") >= LEAST_STAGE)
            new = mutual_best(scored, place, "base_stage_id", "cand_stage_id").select(*ids, F.lit(quality).alias("quality"), "score")
        else:
            new = numbered("base", key).join(numbered("cand", key), [*place, key, "i"]).select(*ids, F.lit(quality).alias("quality"), F.lit(score).alias("score"))
        done = cut(new if done is None else done.unionByName(new))
    return done


def leftovers(stage_pairs: DataFrame, stages: DataFrame, pairs: DataFrame, execution_pairs: DataFrame) -> DataFrame:
    """(pair, side, stage_id, status): stages without a partner, replanned if their execution has one, else unmatched."""
    parts = []
    for s in ("base", "cand"):
        alone = pairs.join(stages.select(F.col("app_id").alias(f"{s}_app"), "execution_id", F.col("stage_id").alias(f"{s}_stage_id")), [f"{s}_app"]).join(stage_pairs.select(*PAIR, f"{s}_stage_id"), [*PAIR, f"{s}_stage_id"], "left_anti")
        known = execution_pairs.select(*PAIR, F.col(f"{s}_execution_id").alias("execution_id"), F.lit(True).alias("known"))
        parts.append(alone.join(known, [*PAIR, "execution_id"], "left").select(*PAIR, F.lit(s).alias("side"), F.col(f"{s}_stage_id").alias("stage_id"), F.when(F.col("known"), "replanned").otherwise("unmatched").alias("status")))
    return parts[0].unionByName(parts[1])


def coverage(stage_pairs: DataFrame, left: DataFrame, stages: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair, coverage, trusted): run time of paired and replanned stages over all of both runs. stages: (app_id, stage_id, run_ms)."""
    t = [pairs.join(stages.select(F.col("app_id").alias(f"{s}_app"), "stage_id", "run_ms"), [f"{s}_app"]).withColumn("side", F.lit(s)) for s in ("base", "cand")]
    all_ = t[0].select(*PAIR, "side", "stage_id", "run_ms").unionByName(t[1].select(*PAIR, "side", "stage_id", "run_ms"))
    lost = left.filter("status = 'unmatched'").select(*PAIR, "side", "stage_id", F.lit(True).alias("lost"))
    share = F.sum(F.when(F.col("lost").isNull(), F.col("run_ms")).otherwise(0)) / F.sum("run_ms")
    return all_.join(lost, [*PAIR, "side", "stage_id"], "left").groupBy(PAIR).agg(share.alias("coverage")).withColumn("trusted", F.col("coverage") >= TRUSTED)


def plan_equal(left: DataFrame, pairs: DataFrame) -> DataFrame:
    n = left.groupBy(PAIR).agg(F.count_if(F.col("status") == "unmatched").alias("unmatched"), F.count_if(F.col("status") == "replanned").alias("replanned"))
    return pairs.join(n, PAIR, "left").na.fill(0, ["unmatched", "replanned"]).withColumn("equal", (F.col("unmatched") + F.col("replanned")) == 0)


def wall_clock_bridge(alloc: DataFrame, metrics: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair, factor, base, cand, ratio): task time, mean executors, and the share of the allocation that was task time.

    Run time is task time over (mean executors times that share times cores each).
    """
    x = metrics.select("app_id", F.col("task_ms").cast("double").alias("task_ms"), F.col("duration_ms").cast("double").alias("duration_ms")).join(alloc.select("app_id", "core_hours", "executors_mean"), ["app_id"])
    x = x.withColumn("task_share", F.when(F.col("core_hours") > 0, F.col("task_ms") / (F.col("core_hours") * 3_600_000)))
    long = x.select("app_id", F.explode(F.create_map(*[y for c in ("task_ms", "executors_mean", "task_share", "duration_ms") for y in (F.lit(c), F.col(c))])).alias("factor", "v"))
    base = pairs.join(long.select(F.col("app_id").alias("base_app"), "factor", F.col("v").alias("base")), ["base_app"])
    return base.join(long.select(F.col("app_id").alias("cand_app"), "factor", F.col("v").alias("cand")), ["cand_app", "factor"]).select(*PAIR, "factor", "base", "cand", F.when(F.col("base") != 0, F.col("cand") / F.col("base")).alias("ratio"))


def caveats(bridge: DataFrame, left: DataFrame, stages: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair, caveat, value): executors that differ by half or more, and over a fifth of the stages without a partner."""
    executors = bridge.filter((F.col("factor") == "executors_mean") & (F.greatest("ratio", 1 / F.col("ratio")) > 1.5)).select(*PAIR, F.lit("executors").alias("caveat"), F.col("ratio").alias("value"))
    n = stages.groupBy("app_id").agg(F.count("*").alias("n"))
    both = pairs.join(n.select(F.col("app_id").alias("base_app"), F.col("n").alias("b")), ["base_app"]).join(n.select(F.col("app_id").alias("cand_app"), F.col("n").alias("c")), ["cand_app"])
    lost = left.filter("status = 'unmatched'").groupBy(PAIR).agg(F.count("*").alias("k"))
    share = both.join(lost, PAIR).withColumn("value", F.col("k") / (F.col("b") + F.col("c"))).filter("value > 0.2")
    return executors.unionByName(share.select(*PAIR, F.lit("unmatched").alias("caveat"), "value"))


def comparison_verdict(deltas: DataFrame, delta_findings: DataFrame, cover: DataFrame) -> DataFrame:
    """(pair, title, tone, sentences): what the run time did, what got worse, new findings, and whether the runs compare."""
    run = deltas.filter(F.col("metric") == "duration_ms").select(*PAIR, "direction", "relative")
    worse = deltas.filter(F.col("direction") == "worse").groupBy(PAIR).agg(F.array_join(F.sort_array(F.collect_list("metric")), ", ").alias("worse"))
    new = delta_findings.groupBy(PAIR).agg(F.count_if(F.col("status") == "introduced").alias("introduced"), F.count_if(F.col("status") == "resolved").alias("resolved"))
    x = run.join(worse, PAIR, "left").join(new, PAIR, "left").join(cover, PAIR, "left")
    pct = F.concat(F.format_number(F.abs("relative") * 100, 1), F.lit("%"))
    title = F.when(~F.coalesce("trusted", F.lit(False)), "Runs do not compare").when(F.col("direction") == "worse", F.concat(F.lit("Slower by "), pct)).when(F.col("direction") == "better", F.concat(F.lit("Faster by "), pct)).otherwise("About as fast")
    tone = F.when(~F.coalesce("trusted", F.lit(False)), "neutral").when(F.col("direction") == "worse", "bad").when(F.col("direction") == "better", "good").otherwise("neutral")
    said = F.concat_ws(" ", F.concat(F.lit("Worse: "), "worse", F.lit(".")), F.concat(F.coalesce("introduced", F.lit(0)), F.lit(" new findings, "), F.coalesce("resolved", F.lit(0)), F.lit(" resolved.")))
    return x.select(*PAIR, title.alias("title"), tone.alias("tone"), said.alias("sentences"))
