"""What to change for each finding, and how findings of one run bear on each other.

A remedy is (kind, key, direction, value): kind conf raises, lowers or sets a setting, to a value where one can be told;
kind code names what the job itself has to do. What is in force already is no remedy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import skew_joins as S
from .config import column_of
from .stages import STAGE

#: Names of settings.
MEMORY, OVERHEAD, INSTANCES, FILES = "spark.executor.memory", "spark.executor.memoryOverhead", "spark.executor.instances", "spark.sql.files.maxPartitionBytes"
DYNAMIC, LEAST, FIRST, MOST, IDLE = "spark.dynamicAllocation.enabled", "spark.dynamicAllocation.minExecutors", "spark.dynamicAllocation.initialExecutors", "spark.dynamicAllocation.maxExecutors", "spark.dynamicAllocation.executorIdleTimeout"
SKEW, PARALLEL = "spark.sql.adaptive.skewJoin.enabled", "spark.sql.adaptive.coalescePartitions.parallelismFirst"
SPECULATION, MULTIPLIER, QUANTILE, LOCALITY = "spark.speculation", "spark.speculation.multiplier", "spark.speculation.quantile", "spark.locality.wait"
SERIALIZER, KRYO = "spark.serializer", "org.apache.spark.serializer.KryoSerializer"
PEAKS, BLOCKS = "spark.eventLog.logStageExecutorMetrics", "spark.eventLog.logBlockUpdates.enabled"
#: Settings that `remedies` reads, as columns of its context.
SETTINGS = (*S.SETTINGS, SKEW, PARALLEL, DYNAMIC, LEAST, SPECULATION, SERIALIZER, PEAKS, BLOCKS)
#: Fixed value: a tail that read so many times the median task's data has more data even where time did not follow it.
MORE_DATA = 2
#: Share of a stage's shuffle in one partition from which, the median one being empty, a single key holds it.
SINGLE_KEY_SHARE = 0.9

_REMEDY = "array<struct<kind:string,key:string,direction:string,value:string>>"


def _conf(key: str | Column, direction: str, value: str | Column | None = None) -> Column:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(F.lit("conf").alias("kind"), as_col(key).cast("string").alias("key"), F.lit(direction).alias("direction"), as_col(value).cast("string").alias("value"))


def _code(what: str) -> Column:
    return F.struct(F.lit("code").alias("kind"), F.lit(what).alias("key"), F.lit(None).cast("string").alias("direction"), F.lit(None).cast("string").alias("value"))


def _list(*remedies: Column) -> Column:
    return F.array(*remedies).cast(_REMEDY) if remedies else F.expr(f"CAST(array() AS {_REMEDY})")


def _is(key: str, value: str) -> Column:
    return F.coalesce(F.lower(column_of(key)) == value.lower(), F.lit(False))


def advice_context(stages: DataFrame, executions: DataFrame, tails: DataFrame, spill: DataFrame, locality: DataFrame, joined: DataFrame, levers: DataFrame, cases: DataFrame, settings: DataFrame) -> DataFrame:
    """One row a stage, and one a run (null stage_id), with what `remedies` reads beside a finding.

    stages: the stage table; executions: (app_id, stage_id, execution_id); tails: stages with `cause`, `data_ratio` and
    `data_most` (data explains the largest part of the tail); spill: from `spill_class`; locality: from `locality_stats`;
    joined: executions whose plan has a join that can be split; levers, cases: from `partition_levers` and
    `skew_join_cases`; settings: from `execution_settings`, for executions and runs.
    """
    s = stages.select(*STAGE, F.when((F.col("shuffle_read") > 0) & (F.col("shuffle_read") >= F.col("input_bytes")), "shuffle").when(F.col("input_bytes") > 0, "input").otherwise("other").alias("reads"), ((F.col("shuffle_p50") == 0) & (F.col("shuffle_max") >= SINGLE_KEY_SHARE * F.col("shuffle_read"))).alias("single_key"))
    x = s.join(executions.select(*STAGE, "execution_id"), STAGE, "left").join(tails.select(*STAGE, "cause", "data_ratio", "data_most"), STAGE, "left").join(spill, STAGE, "left")
    x = x.join(levers.select(*STAGE, "partitions", "lever", "key", "count", "needed"), STAGE, "left").join(cases.select(*STAGE, "case", "detail", "can_force", "held"), STAGE, "left")
    x = x.join(joined.select("app_id", "execution_id").distinct().withColumn("has_join", F.lit(True)), ["app_id", "execution_id"], "left")
    tier = lambda *names: F.bool_or(F.col("locality").isin(*names) & (F.col("tasks") > 0))
    slots = locality.groupBy(STAGE).agg((tier("RACK_LOCAL", "ANY") & tier("PROCESS_LOCAL", "NODE_LOCAL")).alias("_both")).groupBy("app_id").agg(F.bool_or("_both").alias("local_slots"))
    own = settings.withColumnsRenamed({"app_id": "_app", "execution_id": "_execution"})
    x = x.join(own, (F.col("app_id") == F.col("_app")) & F.col("execution_id").eqNullSafe(F.col("_execution")), "left").drop("_app", "_execution")
    runs = settings.filter("execution_id IS NULL").join(slots, ["app_id"], "left").withColumn("stage_id", F.lit(None).cast("long"))
    return x.unionByName(runs, allowMissingColumns=True)


def _skew_fix(shuffled: Column) -> Column:
    """Remedies of a skewed stage. shuffled: it is known to read a shuffle unevenly."""
    spread, force = _code("spreadKey"), _conf(S.FORCE, "set", "true")
    one_sided = F.coalesce(F.col("detail").contains(" only"), F.lit(False))
    case, detail = F.col("case"), F.col("detail")
    by_case = (
        F.when(case.isNull(), _list(spread)).when(case == "split", F.when(F.col("cause") == "data", _list(spread)).otherwise(_list())).when(case == "evenReads", _list()).when(case == "userRepartition", _list(_code("dropRepartition")))
        .when(case == "joinType", F.when(one_sided & F.col("held") & F.col("can_force"), _list(_code("hotKeyApart"), force)).otherwise(_list(_code("hotKeyApart"))))
        .when(case == "belowThreshold", F.when(detail == "both", _list(_conf(S.THRESHOLD, "decrease"), _conf(S.FACTOR, "decrease"))).when(detail == "threshold", _list(_conf(S.THRESHOLD, "decrease"))).otherwise(_list(_conf(S.FACTOR, "decrease"))))
        .when((case == "extraShuffle") & F.col("can_force"), _list(force)).otherwise(_list(spread))
    )
    shuffle = shuffled | (F.col("reads") == "shuffle")
    return (
        F.when(~shuffle & (F.col("reads") == "input"), _list(_conf(FILES, "decrease"))).when(~shuffle | ~F.coalesce("has_join", F.lit(False)) | F.coalesce(F.col("v") < 300, F.lit(False)), _list(spread))
        .when(_is(S.AQE, "false"), _list(_conf(S.AQE, "set", "true"), _conf(SKEW, "set", "true"))).when(~_is(SKEW, "true"), _list(_conf(SKEW, "set", "true"))).otherwise(by_case)
    )


def remedies(findings: DataFrame, context: DataFrame) -> DataFrame:
    """(app_id, type, rule, stage_id, kind, key, direction, value): one row a remedy; a finding may have none.

    findings: (app_id, type, rule, stage_id, ...); context: from `advice_context`. The partitions of a stage are sized by
    what `partition_levers` says did so before. Fewer cores an executor, as a remedy of spill, isn't among these.
    """
    where = context.withColumnsRenamed({"app_id": "_app", "stage_id": "_stage"})
    x = findings.select("app_id", "type", "rule", "stage_id").join(where, (F.col("app_id") == F.col("_app")) & F.col("stage_id").eqNullSafe(F.col("_stage")), "left")
    lever, key = F.col("lever"), F.coalesce("key", F.lit(S.PARTITIONS))
    raise_, memory, smaller, own = _conf(key, "increase"), _conf(MEMORY, "increase"), _conf(S.ADVISORY, "decrease"), _code("ownPartitions")
    shuffled, kind, rule, off = F.col("reads") == "shuffle", F.col("type"), F.col("rule"), ~_is(DYNAMIC, "true")
    skew = _skew_fix(F.lit(False))
    coalesced, fixed = F.coalesce(lever == "aqeCoalesced", F.lit(False)), F.coalesce(lever == "ownPartitioning", F.lit(False))
    by_size = lambda more, *also: F.when(coalesced, _list(smaller, *also)).when(fixed, _list(own, *also)).otherwise(_list(more, *also))
    idle = F.when(off, _list(_conf(DYNAMIC, "set", "true"), _conf(INSTANCES, "decrease"))).when(F.col(column_of(LEAST)).try_cast("int") > 0, _list(_conf(MOST, "decrease"), _conf(LEAST, "decrease"))).otherwise(_list(_conf(MOST, "decrease")))
    larger = _conf(S.ADVISORY, "increase")
    few = F.when(F.col("partitions") == "aqeCoalesced", _list(smaller)).when(F.col("partitions") == "ownPartitioning", _list()).otherwise(_list(_conf(key, "increase", F.when(F.col("count").isNotNull(), F.col("needed")))))
    by_type = (
        F.when(kind == "skew", skew).when(kind == "straggler", F.when((F.col("cause") == "data") | ((F.col("cause") == "unexplained") & (F.col("data_ratio") >= MORE_DATA) & F.col("data_most")), skew).when(F.col("cause") == "gc", _list(memory)).when(F.col("cause") == "host", _list(_conf(SPECULATION, "set", "true"))))
        .when(kind == "spill", F.when(F.col("spill_class") == "skew", _list()).when(shuffled, by_size(raise_, memory)).otherwise(_list(memory)))
        .when(kind == "shuffle", F.when(F.col("partitions") == "aqeCoalesced", _list(smaller)).when(F.col("partitions") == "raise", _list(raise_)))
        .when((kind == "partitionSizing") & (rule == "uneven"), F.when(F.col("single_key"), _list(_code("singleKey"))).otherwise(_skew_fix(F.lit(True)))).when((kind == "partitionSizing") & (rule == "few"), few)
        .when(kind == "gc", F.when(rule == "low", _list(_conf(MEMORY, "decrease"))).otherwise(_list(memory)))
        .when(kind == "stageSlowness", F.when(shuffled, by_size(raise_)).when(F.col("reads") == "input", _list(_conf(FILES, "decrease"))))
        .when(kind == "tinyTask", F.when(shuffled, F.when(coalesced, F.when(_is(PARALLEL, "true"), _list(_conf(PARALLEL, "set", "false"), larger)).otherwise(_list(larger))).when(fixed, _list(own)).otherwise(_list(_conf(key, "decrease")))))
        .when(kind == "speculationWaste", _list(_conf(MULTIPLIER, "increase"), _conf(QUANTILE, "increase"))).when((kind == "coldStart") & ~off, _list(_conf(LEAST, "increase"), _conf(FIRST, "increase")))
        .when((kind == "autoscalingChurn") & ~off, _list(_conf(IDLE, "increase"), _conf(LEAST, "decrease"), _conf(MOST, "increase"))).when((kind == "coreLocality") & F.col("local_slots"), _list(_conf(LOCALITY, "increase")))
        .when((kind == "utilization") | (rule == "idleCores"), idle).when((kind == "memoryUtilization") & (rule == "heapUnknown"), _list(_conf(PEAKS, "set", "true"))).when(kind == "memoryUtilization", _list(_conf(MEMORY, "decrease")))
        .when((kind == "cacheUtilization") & (rule == "unlogged"), _list(_conf(BLOCKS, "set", "true"))).when(kind == "cacheUtilization", _list(memory))
        .when(rule == "unboundedAutoscaling", _list(_conf(MOST, "set"))).when(rule == "javaSerializer", _list(_conf(SERIALIZER, "set", KRYO))).when(rule == "lowOverhead", _list(_conf(OVERHEAD, "increase")))
    )
    held = F.create_map(*[c for k in SETTINGS for c in (F.lit(k), F.col(column_of(k)))])
    new = F.filter(F.coalesce(by_type, _list()), lambda r: ~F.coalesce((r["direction"] == "set") & (F.lower(F.try_element_at(held, r["key"])) == F.lower(r["value"])), F.lit(False)))
    return x.select("app_id", "type", "rule", "stage_id", F.explode(new).alias("r")).select("app_id", "type", "rule", "stage_id", "r.*")


def reconcile_memory(found: DataFrame) -> DataFrame:
    """Remedies of a run without advice to lower executor memory that other findings of it contradict.

    A stage's finding that lowers memory goes, with all its remedies, where a finding of the same stage raises it. A run's
    finding loses that remedy as soon as any finding raises memory; a row of kind note, with the stages that ask for more,
    comma-joined (empty if only runs do), stands in its place. found: from `remedies`.
    """
    mine = ["app_id", "type", "rule", F.coalesce("stage_id", F.lit(-1)).alias("_s")]
    memory = (F.col("kind") == "conf") & (F.col("key") == MEMORY)
    raising, lowering = found.filter(memory & (F.col("direction") == "increase")), found.filter(memory & (F.col("direction") == "decrease"))
    asked = raising.groupBy("app_id").agg(F.array_join(F.sort_array(F.collect_set("stage_id")), ",").alias("_stages"))
    one = ["app_id", "type", "rule", "_s"]
    torn = lowering.select(*mine).distinct().join(raising.select(*mine).distinct(), one, "left_anti").withColumn("_lowers", F.lit(True))
    same = raising.filter("stage_id IS NOT NULL").select("app_id", F.col("stage_id").alias("_s")).distinct().withColumn("_same", F.lit(True))
    x = found.withColumn("_s", F.coalesce("stage_id", F.lit(-1))).join(torn, one, "left").join(asked, ["app_id"], "left").join(same, ["app_id", "_s"], "left")
    x = x.filter(~(F.coalesce("_lowers", F.lit(False)) & F.coalesce("_same", F.lit(False))))
    noted = F.coalesce("_lowers", F.lit(False)) & F.col("stage_id").isNull() & F.col("_stages").isNotNull() & memory & (F.col("direction") == "decrease")
    return x.select("app_id", "type", "rule", "stage_id", F.when(noted, "note").otherwise(F.col("kind")).alias("kind"), "key", F.when(~noted, F.col("direction")).alias("direction"), F.when(noted, F.col("_stages")).otherwise(F.col("value")).alias("value"))


def link_missed_broadcasts(findings: DataFrame, stages: DataFrame, missed: DataFrame, readers: DataFrame) -> DataFrame:
    """(app_id, stage_id, execution_id, path, how): single-key shuffles whose stage also runs a join that could have been a broadcast.

    findings: partitionSizing ones count; stages: the stage table; missed: underBroadcast findings (app_id, execution_id, path,
    rule) with rule limits, notLimiting or disabled; readers: (app_id, execution_id, path, stage_id), the one stage that
    reads both sides of a join, from `plans.detectors.join_readers`. how: enableOrHint, hint or raiseOrHint. Of several joins
    of a stage the first counts.
    """
    single = stages.filter((F.col("shuffle_p50") == 0) & (F.col("shuffle_max") >= SINGLE_KEY_SHARE * F.col("shuffle_read"))).select(STAGE)
    uneven = findings.filter("type = 'partitionSizing' AND rule = 'uneven'").select(STAGE).distinct().join(single, STAGE, "left_semi")
    order = F.struct("execution_id", F.transform(F.split("path", r"\."), lambda i: i.cast("int")).alias("at"))
    first = missed.join(readers, ["app_id", "execution_id", "path"]).groupBy(STAGE).agg(F.min_by(F.struct("execution_id", "path", "rule"), order).alias("m"))
    how = F.when(F.col("m.rule") == "disabled", "enableOrHint").when(F.col("m.rule") == "notLimiting", "hint").otherwise("raiseOrHint")
    return uneven.join(first, STAGE).select(*STAGE, "m.execution_id", "m.path", how.alias("how"))
