from __future__ import annotations

from pyspark.sql import functions as F

from embertrail.functions.units import MIB, byte_size
from embertrail.operators import config as C


def conf(spark, rows):
    return spark.createDataFrame(rows, "app_id string, key string, value string")


def test_byte_sizes(spark):
    rows = [("10MB", 10 * MIB), ("1g", 1 << 30), ("384m", 384 * MIB), ("5", 5), ("1.5k", 1536), ("x", None), ("5zz", None), (None, None)]
    got = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, t string").select("i", byte_size(F.col("t")).alias("b")).orderBy("i").collect()
    assert [r.b for r in got] == [r[1] for r in rows]


def test_effective(spark):
    apps = spark.createDataFrame([("a", "3.1.2"), ("b", "4.0.0"), ("c", None)], "app_id string, version string")
    c = conf(spark, [("a", "spark.sql.shuffle.partitions", "7"), ("a", "own", "x")])
    o = spark.createDataFrame([("a", 3, "spark.sql.shuffle.partitions", "9")], "app_id string, execution_id long, key string, value string")
    got = {(r.app_id, r.execution_id, r.key): (r.value, r.source) for r in C.effective_conf(apps, c, o, C.default_settings(spark)).collect()}
    assert got["a", None, "spark.sql.adaptive.enabled"] == ("false", "default") and got["b", None, "spark.sql.adaptive.enabled"] == ("true", "default")
    assert got["a", None, "spark.sql.shuffle.partitions"] == ("7", "property") and got["a", 3, "spark.sql.shuffle.partitions"] == ("9", "override") and got["a", None, "own"] == ("x", "property")


def test_masks(spark):
    rows = [("a", "x.password", "p"), ("a", "url", "jdbc://u:p@h/d"), ("a", "mine", "v"), ("a", "spark.redaction.regex", "^mine$"), ("b", "mine", "v")]
    got = {(r.app_id, r.key): r.value for r in C.masked_conf(conf(spark, rows)).collect()}
    assert got["a", "x.password"] == got["a", "mine"] == C.MASK and got["a", "url"] == "jdbc://h/d" and got["b", "mine"] == "v"


def test_audit_and_resources(spark):
    c = conf(spark, [("a", "spark.dynamicAllocation.enabled", "true"), ("a", "spark.executor.memory", "8g"), ("a", "spark.executor.memoryOverhead", "500"), ("b", "spark.serializer", "org.KryoSerializer"), ("b", "spark.executor.memory", "2g")])
    rdd = spark.createDataFrame([("a",), ("b",)], "app_id string")
    assert {(r.app_id, r.rule) for r in C.config_audit(c, rdd).collect()} == {("a", "unboundedAutoscaling"), ("a", "javaSerializer"), ("a", "lowOverhead")}
    assert {(r.app_id, r.rule) for r in C.config_audit(c, rdd.filter("app_id = 'b'")).collect()} == {("a", "unboundedAutoscaling"), ("a", "lowOverhead")}  # SQL alone doesn't use the serialiser
    got = {r.app_id: r for r in C.app_resources(c).collect()}
    assert got["a"].overhead == 500 * MIB and got["b"].overhead == 384 * MIB and got["b"].heap == 2048 * MIB


def test_redaction_is_stable(spark):
    rows = [("r1", "task on host-b.x failed for /user/ann/x"), ("r1", "host-a lost, app-20-1 user=bob"), ("r1", "host-b.x again, host-b"), ("r2", "host-b.x")]
    df = spark.createDataFrame(rows, "run string, t string")
    once = C.redact(df, ["t"])
    got = sorted((r.run, r.t) for r in once.collect())
    assert ("r2", "[host-#1]") in got and ("r1", "[host-#1] lost, [app-#1] user=user") in got and ("r1", "[host-#3] again, [host-#2]") in got
    assert sorted((r.run, r.t) for r in C.redact(once, ["t"]).collect()) == got
