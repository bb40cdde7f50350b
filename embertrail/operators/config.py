"""Settings of runs: what is in force, what to hide, and audits of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.units import MIB, byte_size

#: Spark's own defaults, with the version (as major * 100 + minor) from which each holds.
DEFAULTS = (
    ("spark.sql.shuffle.partitions", 100, "200"), ("spark.sql.autoBroadcastJoinThreshold", 100, "10MB"), ("spark.sql.adaptive.enabled", 106, "false"), ("spark.sql.adaptive.enabled", 302, "true"),
    ("spark.sql.adaptive.skewJoin.enabled", 300, "true"), ("spark.sql.adaptive.coalescePartitions.enabled", 300, "true"), ("spark.dynamicAllocation.enabled", 102, "false"), ("spark.executor.memory", 105, "1g"),
    ("spark.executor.memoryOverheadFactor", 303, "0.1"), ("spark.executor.minMemoryOverhead", 400, "384m"), ("spark.memory.fraction", 106, "0.6"), ("spark.serializer", 100, "org.apache.spark.serializer.JavaSerializer"),
    ("spark.speculation", 100, "false"), ("spark.sql.files.maxPartitionBytes", 200, "128MB"), ("spark.locality.wait", 100, "3s"),
    ("spark.sql.adaptive.skewJoin.skewedPartitionFactor", 300, "5"), ("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", 300, "256MB"), ("spark.sql.adaptive.forceOptimizeSkewedJoin", 303, "false"),
    ("spark.sql.adaptive.advisoryPartitionSizeInBytes", 300, "64MB"), ("spark.sql.adaptive.coalescePartitions.parallelismFirst", 302, "true"),
)
#: Names and values that hide a setting, and the credentials part of a URL.
SECRET_NAMES, URL_CREDENTIALS = r"(?i)secret|password|token|access[._]?key|credential", r"(?i)([a-z][a-z0-9+.-]*://)[^/@\s]+@"
MASK = "*********(redacted)"
OVERHEAD_FACTOR, OVERHEAD_LEAST = 0.1, 384 * MIB


def default_settings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(DEFAULTS), "key string, since int, value string")


def version_number(version: Column) -> Column:
    """A version as major * 100 + minor; null if it isn't one."""
    return F.regexp_extract(version, r"^([0-9]+)\.([0-9]+)", 1).try_cast("int") * 100 + F.regexp_extract(version, r"^([0-9]+)\.([0-9]+)", 2).try_cast("int")


def column_of(key: str) -> str:
    """The column that `execution_settings` makes of a setting."""
    return key.removeprefix("spark.").replace(".", "_")


def execution_settings(apps: DataFrame, effective: DataFrame, executions: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(app_id, execution_id, v, a column for each of `keys`): what was in force for each execution and, with a null execution, for the run.

    apps: (app_id, version); effective: from `effective_conf`; executions: (app_id, execution_id).
    """
    def wide(df: DataFrame, *by: str) -> DataFrame:
        return df.groupBy(*by).agg(*[F.max(F.when(F.col("key") == k, F.col("value"))).alias(column_of(k)) for k in keys])

    run = wide(effective.filter("execution_id IS NULL"), "app_id").select(F.col("app_id").alias("_app"), *[F.col(column_of(k)).alias(f"_{column_of(k)}") for k in keys])
    own = wide(effective.filter("execution_id IS NOT NULL"), "app_id", "execution_id")
    rows = executions.select("app_id", "execution_id").filter("execution_id IS NOT NULL").distinct().unionByName(apps.select("app_id", F.lit(None).cast("long").alias("execution_id")))
    x = rows.join(apps.select("app_id", version_number(F.col("version")).alias("v")), ["app_id"]).join(run, F.col("app_id") == F.col("_app"), "left").join(own, ["app_id", "execution_id"], "left")
    return x.select("app_id", "execution_id", "v", *[F.coalesce(column_of(k), f"_{column_of(k)}").alias(column_of(k)) for k in keys])


def effective_conf(apps: DataFrame, conf: DataFrame, overrides: DataFrame, defaults: DataFrame) -> DataFrame:
    """(app_id, execution_id, key, value, source): a query's override, else the run's property, else Spark's default for its version.

    apps: (app_id, version); conf: (app_id, key, value); overrides: (app_id, execution_id, key, value). execution_id is
    null for the run itself.
    """
    known = apps.select("app_id", version_number(F.col("version")).alias("v")).join(F.broadcast(defaults), F.col("since") <= F.coalesce(F.col("v"), F.lit(99_999)))  # a fixed handful of defaults
    known = known.groupBy("app_id", "key").agg(F.max_by("value", "since").alias("default"))
    run = conf.withColumnRenamed("value", "property").join(known, ["app_id", "key"], "full")
    base = run.select("app_id", F.lit(None).cast("long").alias("execution_id"), "key", F.coalesce("property", "default").alias("value"), F.when(F.col("property").isNotNull(), "property").otherwise("default").alias("source"))
    return base.unionByName(overrides.select("app_id", "execution_id", "key", "value", F.lit("override").alias("source")))


def masked_conf(conf: DataFrame, names: str = SECRET_NAMES) -> DataFrame:
    """(app_id, key, value, masked): values of secret names hidden, also of those the run's own spark.redaction.regex names; credentials cut from URLs."""
    own = conf.filter(F.col("key") == "spark.redaction.regex").groupBy("app_id").agg(F.max("value").alias("_own"))
    x = conf.join(own, ["app_id"], "left")
    hide = F.col("key").rlike(names) | F.coalesce(F.expr("key RLIKE _own"), F.lit(False)) | F.lower("value").rlike(r"^(bearer|basic)\s")
    return x.select("app_id", "key", F.when(hide, MASK).otherwise(F.regexp_replace("value", URL_CREDENTIALS, r"$1")).alias("value"), hide.alias("masked"))


def app_resources(conf: DataFrame) -> DataFrame:
    """One row a run: executor memory, overhead and off-heap bytes, cores, instances, flags."""
    get = lambda key: F.max(F.when(F.col("key") == key, F.col("value")))
    x = conf.groupBy("app_id").agg(get("spark.executor.memory").alias("m"), get("spark.executor.memoryOverhead").alias("o"), get("spark.memory.offHeap.size").alias("h"), get("spark.executor.cores").alias("c"), get("spark.executor.instances").alias("n"), get("spark.dynamicAllocation.enabled").alias("d"))
    heap = F.coalesce(byte_size(F.col("m"), "m"), F.lit(1024 * MIB))
    return x.select("app_id", heap.alias("heap"), F.coalesce(byte_size(F.col("o"), "m"), F.greatest(F.lit(OVERHEAD_LEAST), F.floor(heap * OVERHEAD_FACTOR))).alias("overhead"), F.coalesce(byte_size(F.col("h")), F.lit(0)).alias("off_heap"), F.col("c").try_cast("int").alias("cores"), F.col("n").try_cast("int").alias("instances"), (F.lower("d") == "true").alias("dynamic"))


def config_audit(conf: DataFrame, outside_sql: DataFrame | None = None) -> DataFrame:
    """(app_id, rule, value): unbounded autoscaling, Java serialisation, and less overhead than Spark would take.

    outside_sql: (app_id) of runs with a stage outside SQL, the only ones that a serialiser matters to; without it that rule claims nothing.
    """
    get = lambda key: F.max(F.when(F.col("key") == key, F.col("value")))
    x = conf.groupBy("app_id").agg(get("spark.dynamicAllocation.enabled").alias("d"), get("spark.dynamicAllocation.maxExecutors").alias("most"), get("spark.serializer").alias("ser"), get("spark.executor.memory").alias("m"), get("spark.executor.memoryOverhead").alias("o"))
    x = x.withColumn("_rdd", F.lit(False)) if outside_sql is None else x.join(outside_sql.select("app_id").distinct().withColumn("_rdd", F.lit(True)), ["app_id"], "left")
    heap, over = byte_size(F.col("m"), "m"), byte_size(F.col("o"), "m")
    rules = F.array_compact(F.array(
        F.when((F.lower("d") == "true") & F.col("most").isNull(), F.struct(F.lit("unboundedAutoscaling").alias("rule"), F.lit("no maximum").alias("value"))),
        F.when(F.coalesce("_rdd", F.lit(False)) & ~F.coalesce(F.lower("ser").contains("kryo"), F.lit(False)), F.struct(F.lit("javaSerializer").alias("rule"), F.coalesce("ser", F.lit("default")).alias("value"))),
        F.when(over < F.greatest(F.lit(OVERHEAD_LEAST), F.floor(heap * OVERHEAD_FACTOR)), F.struct(F.lit("lowOverhead").alias("rule"), F.col("o").alias("value"))),
    ))
    return x.select("app_id", F.explode(rules).alias("r")).select("app_id", "r.rule", "r.value")


def redact(df: DataFrame, cols: list[str], hosts: str = r"\b((?:host|ip|node|worker)-[A-Za-z0-9.-]+)", apps: str = r"\b((?:application_[0-9]+_[0-9]+)|(?:app-[0-9]+(?:-[0-9]+)*))\b") -> DataFrame:
    """Text columns with hosts and application ids replaced by host-N and app-N, numbered by value within a run, and user names scrubbed.

    Numbers come from the run's sorted distinct names; each row replaces by its run's map. Names already replaced stay as
    they are, so that a second pass changes nothing.
    """
    every = F.concat_ws("\n", *cols)
    parts = []
    for kind, pattern in (("host", hosts), ("app", apps)):
        names = df.select("run", F.explode(F.array_distinct(F.regexp_extract_all(every, F.lit(pattern), F.lit(1)))).alias("name")).filter(~F.col("name").rlike(rf"^\[?{kind}-#")).distinct()
        parts.append(names.groupBy("run").agg(F.sort_array(F.collect_set("name")).alias(f"_{kind}s")))
    out = df
    for p in parts:
        out = out.join(p, ["run"], "left")
    for c in cols:
        text = F.regexp_replace(F.regexp_replace(F.col(c), URL_CREDENTIALS, r"$1"), r"(?i)(/users?/|/home/|user=)[A-Za-z0-9._-]+", r"$1user")
        for kind in ("host", "app"):
            known = F.coalesce(F.col(f"_{kind}s"), F.array().cast("array<string>"))
            order = _longest_first(known, kind)  # so that one name inside another stays whole
            text = F.aggregate(order, text, lambda t, m: F.replace(t, m["s"], m["to"]))
        out = out.withColumn(c, text)
    return out.drop("_hosts", "_apps")


def redact_listing(runs: DataFrame, hidden: tuple[str, ...] = ("name", "source"), prefix: int = 48) -> DataFrame:
    """Rows of a listing with app-N for each distinct app_id, numbered in the order of ids with numbers read as numbers; `hidden` columns get the same.

    Ids are counted within groups of `prefix` characters of their sort key, and groups by a running sum, so that no task
    sorts every id. A null id stays null.
    """
    padded = F.transform(F.regexp_extract_all("app_id", F.lit("([0-9]+|[^0-9]+)"), F.lit(1)), lambda p: F.when(p.rlike("^[0-9]"), F.lpad(F.regexp_replace(p, "^0+(?=[0-9])", ""), 20, "0")).otherwise(p))
    ids = runs.filter("app_id IS NOT NULL").select("app_id").distinct().withColumn("_key", F.array_join(padded, "")).withColumn("_group", F.substring("_key", 1, prefix))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = ids.groupBy("_group").agg(F.count("*").alias("_n")).select("_group", before.alias("_before"))
    at = F.row_number().over(Window.partitionBy("_group").orderBy("_key", "app_id"))
    named = ids.withColumn("_at", at).join(groups, ["_group"]).select("app_id", F.concat(F.lit("app-"), (F.col("_before") + F.col("_at")).cast("string")).alias("_as"))
    return runs.join(named, ["app_id"], "left").select(*[F.col("_as").alias(c) if c == "app_id" or c in hidden else F.col(c) for c in runs.columns])


def _longest_first(known: Column, kind: str) -> Column:
    def named(s: Column, i: Column) -> Column:
        return F.struct(F.length(s).alias("n"), s.alias("s"), F.concat(F.lit(f"[{kind}-#"), (i + 1).cast("string"), F.lit("]")).alias("to"))

    return F.reverse(F.array_sort(F.transform(known, named)))
