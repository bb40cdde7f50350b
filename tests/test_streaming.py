from __future__ import annotations

from embertrail.sources.eventlog import as_lines
from embertrail.sources.testdata import facts
from embertrail.streaming import ingest as S


def test_running_sums_equal_the_batch(spark, small, tmp_path):
    tasks = facts(spark, small)["tasks"]
    as_lines(tasks).select("raw").repartition(3).write.text(str(tmp_path / "log"))
    stream = S.running_stage_sums(S.task_stream(spark, str(tmp_path / "log")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("sums").start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT stage_id, sum(tasks) n, sum(task_ms) ms FROM sums GROUP BY stage_id").collect()
    want = tasks.groupBy("stage_id").agg({"task_id": "count", "duration_ms": "sum"}).collect()
    assert sorted((r.stage_id, r.n, r.ms) for r in got) == sorted((r[0], r["count(task_id)"], r["sum(duration_ms)"]) for r in want)
    closed = S.windowed_stage_sums(S.task_stream(spark, str(tmp_path / "log"))).writeStream.outputMode("append").format("memory").queryName("closed").start()
    closed.processAllAvailable()
    closed.stop()
    assert spark.table("closed").columns == ["log", "from_ms", "tasks", "task_ms"]
