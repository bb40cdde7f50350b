from __future__ import annotations

from pyspark.sql import functions as F

from embertrail.functions.intervals import sweep
from embertrail.functions.lineage import written
from embertrail.operators import stages as A
from embertrail.queries import Run
from embertrail.sources.testdata import SHAPED, TABLES, Facts


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_kept_tasks_are_columns_of_which_a_pass_reads_its_own(spark, small):
    text = plan(Run(spark, small, True).tasks.groupBy("app_id").agg(F.sum("duration_ms")))
    read = text[text.index("ReadSchema") :].splitlines()[0]
    assert "duration_ms" in read and "peak_mem" not in read


def test_tasks_are_numbered_before_their_columns_are_worked_out(spark, small):
    text = plan(Facts(spark, small)["tasks"])
    below = text[text.index("Exchange hashpartitioning") :]
    assert "shuffle_write" not in below and "l_quantity" in below
    same = spark.sql(TABLES["tasks"], lineitem=spark.read.parquet(f"{small}/lineitem.parquet"))
    now = Facts(spark, small)["tasks"]
    assert now.schema == same.schema and now.exceptAll(same).isEmpty() and now.count() == same.count()


def test_both_sides_of_a_sweep_share_one_count_of_events(spark, small):
    tasks = written(Facts(spark, small)["tasks"])
    out = sweep(tasks, A.STAGE, "launch_ms", "finish_ms")
    tests = [line for line in plan(out).splitlines() if "Filter" in line and "600000" in line]
    assert len(tests) == 2, tests


def test_one_sweep_gives_peaks_and_active_time(spark):
    rows = [("a", 1, 10, 20), ("a", 1, 15, 1_300_000), ("a", 1, 1_400_000, 1_400_001), ("a", 2, 0, 50), ("a", 2, 5, 5), ("b", 1, 7, 9), ("b", 1, 9, 12)]
    tasks = spark.createDataFrame(rows, "app_id string, stage_id long, launch_ms long, finish_ms long")
    got = {tuple(r) for r in A.concurrency(tasks).collect()}
    assert got == {tuple(r) for r in A.peak_concurrency(tasks).join(A.active_ms(tasks), A.STAGE).collect()} == {("a", 1, 2, 1_299_991), ("b", 1, 1, 5)}


def test_medians_of_counted_values_are_those_of_all_rows(spark):
    rows = [("a", i % 3, (i * i) % 11, None if i % 4 == 0 else i % 7) for i in range(100)]
    df = spark.createDataFrame(rows, "app_id string, stage_id long, x long, y long")
    want = df.groupBy(A.STAGE).agg(F.count("*").alias("n"), A.median("x").alias("m_x"), A.median("y").alias("m_y"))
    assert sorted(map(tuple, A._medians(df, ("x", "y")).collect())) == sorted(map(tuple, want.collect()))


def test_tasks_are_worked_out_without_decimals_as_the_sql_has_them(spark, tmp_path):
    lines = spark.sql(
        "SELECT id - 37 AS l_orderkey, id * 7 AS l_partkey, id % 23 AS l_suppkey, CAST(id % 7 + 1 AS INT) AS l_linenumber, CAST(id % 50 AS DOUBLE) AS l_quantity, CASE WHEN id % 19 <> 0 THEN id * 377.77D - 9000 END AS l_extendedprice,"
        " (id % 11) / 100D AS l_discount, CASE WHEN id % 3 = 0 THEN 'R' ELSE 'A' END AS l_returnflag, TIMESTAMP '2020-01-01' AS l_shipdate FROM range(400) UNION ALL SELECT NULL, 1, 1, 1, 1D, 995D, 0.1D, 'R', NULL"
    )
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    same, now = spark.sql(TABLES["tasks"], lineitem=lines), Facts(spark, str(tmp_path))["tasks"]
    text = plan(now)
    assert "decimal" not in text.lower() and "decimal" in plan(same).lower()
    assert now.schema == same.schema and now.exceptAll(same).isEmpty() and now.count() == same.count() == 401


def test_kept_tasks_leave_out_what_follows_from_other_columns(spark, small):
    for tables in (TABLES, SHAPED):
        kept, plain = Run(spark, small, True, tables).tasks, Facts(spark, small, tables=tables)["tasks"]
        text = plan(kept.select("launch_ms", "finish_ms", "run_ms", "cpu_ns"))
        read = text[text.index("ReadSchema") :].splitlines()[0]
        assert "launch_ms" in read and "duration_ms" in read and not any(c in read for c in ("finish_ms", "run_ms", "cpu_ns"))
        assert kept.dtypes == plain.dtypes and kept.exceptAll(plain).isEmpty() and kept.count() == plain.count()
