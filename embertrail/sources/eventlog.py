"""Spark event logs as tables: lines, events by type, and the facts of applications, executors, jobs, stages, tasks and SQL executions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Event types that are read, by their last name.
KNOWN = (
    "SparkListenerLogStart", "SparkListenerApplicationStart", "SparkListenerApplicationEnd", "SparkListenerEnvironmentUpdate", "SparkListenerExecutorAdded", "SparkListenerExecutorRemoved",
    "SparkListenerJobStart", "SparkListenerJobEnd", "SparkListenerStageSubmitted", "SparkListenerStageCompleted", "SparkListenerBlockUpdated", "SparkListenerStageExecutorMetrics", "SparkListenerTaskEnd",
    "SparkListenerSQLExecutionStart", "SparkListenerSQLAdaptiveExecutionUpdate", "SparkListenerSQLExecutionEnd", "SparkListenerDriverAccumUpdates",
)

_ACCUMULABLES = "array<struct<`ID`:bigint,`Value`:string,`Metadata`:string,`Name`:string>>"
_STAGE_INFO = (
    "struct<`Stage ID`:bigint,`Stage Attempt ID`:bigint,`Stage Name`:string,`Number of Tasks`:bigint,`Details`:string,`Submission Time`:bigint,`Completion Time`:bigint,`Failure Reason`:string,"
    "`Parent IDs`:array<bigint>,`RDD Info`:array<struct<`RDD ID`:bigint,`Name`:string,`Number of Partitions`:bigint,`Number of Cached Partitions`:bigint,`Memory Size`:bigint,`Disk Size`:bigint>>,"
    f"`Accumulables`:{_ACCUMULABLES}>"
)
_METRICS = (
    "struct<`Executor Run Time`:bigint,`Executor CPU Time`:bigint,`JVM GC Time`:bigint,`Peak Execution Memory`:bigint,`Memory Bytes Spilled`:bigint,`Disk Bytes Spilled`:bigint,"
    "`Input Metrics`:struct<`Bytes Read`:bigint,`Records Read`:bigint>,`Output Metrics`:struct<`Bytes Written`:bigint,`Records Written`:bigint>,"
    "`Shuffle Read Metrics`:struct<`Remote Bytes Read`:bigint,`Local Bytes Read`:bigint,`Fetch Wait Time`:bigint,`Total Records Read`:bigint>,`Shuffle Write Metrics`:struct<`Shuffle Bytes Written`:bigint>>"
)
#: The fields of each event that are read; a column that no operator asks for is not parsed.
SCHEMAS = {
    "SparkListenerLogStart": "struct<`Spark Version`:string>",
    "SparkListenerApplicationStart": "struct<`App ID`:string,`App Name`:string,`App Attempt ID`:string,`Timestamp`:bigint,`Spark Version`:string>",
    "SparkListenerApplicationEnd": "struct<`Timestamp`:bigint>",
    "SparkListenerExecutorAdded": "struct<`Timestamp`:bigint,`Executor ID`:string,`Executor Info`:struct<`Host`:string,`Total Cores`:bigint>>",
    "SparkListenerExecutorRemoved": "struct<`Timestamp`:bigint,`Executor ID`:string,`Removed Reason`:string>",
    "SparkListenerJobStart": "struct<`Job ID`:bigint,`Submission Time`:bigint,`Stage IDs`:array<bigint>,`Properties`:map<string,string>>",
    "SparkListenerJobEnd": "struct<`Job ID`:bigint,`Completion Time`:bigint,`Job Result`:struct<`Result`:string,`Exception`:struct<`Message`:string>>>",
    "SparkListenerStageSubmitted": f"struct<`Stage Info`:{_STAGE_INFO}>",
    "SparkListenerStageCompleted": f"struct<`Stage Info`:{_STAGE_INFO}>",
    "SparkListenerBlockUpdated": "struct<`Block Updated Info`:struct<`Block Manager ID`:struct<`Executor ID`:string>,`Block ID`:string,`Storage Level`:struct<`Use Memory`:boolean,`Use Disk`:boolean>,`Memory Size`:bigint,`Disk Size`:bigint>>",
    "SparkListenerStageExecutorMetrics": "struct<`Stage ID`:bigint,`Executor ID`:string,`Executor Metrics`:map<string,bigint>>",
    "SparkListenerTaskEnd": (
        "struct<`Stage ID`:bigint,`Stage Attempt ID`:bigint,`Task End Reason`:struct<`Reason`:string,`Class Name`:string,`Description`:string,`Full Stack Trace`:string,`Loss Reason`:string>,"
        f"`Task Info`:struct<`Task ID`:bigint,`Index`:bigint,`Attempt`:bigint,`Launch Time`:bigint,`Finish Time`:bigint,`Executor ID`:string,`Host`:string,`Locality`:string,`Speculative`:boolean,`Failed`:boolean,`Killed`:boolean,`Accumulables`:{_ACCUMULABLES}>,"
        f"`Task Executor Metrics`:map<string,bigint>,`Task Metrics`:{_METRICS}>"
    ),
    "SparkListenerSQLExecutionStart": "struct<`executionId`:bigint,`rootExecutionId`:bigint,`description`:string,`physicalPlanDescription`:string,`time`:bigint,`modifiedConfigs`:map<string,string>>",
    "SparkListenerSQLExecutionEnd": "struct<`executionId`:bigint,`time`:bigint>",
    "SparkListenerDriverAccumUpdates": "struct<`executionId`:bigint,`accumUpdates`:array<array<bigint>>>",
}


def read_event_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(log, part, seq, raw): the lines of logs, or of rolling directories, in any codec Hadoop reads.

    log is the file, or the directory of a rolling log; part is a rolling file's index. seq is (part, place), which rises in
    the order of events whichever way the scan packs the files. Of a rolling log only `rolling_members` are read; a
    missing file among them is an error.
    """
    at = paths if isinstance(paths, str) else list(paths)
    name = F.element_at(F.split("path", "/"), -1)
    rolling = name.rlike(r"^events_[0-9]+_")
    log = F.when(rolling, F.regexp_extract("path", r"^(.*)/[^/]*$", 1)).otherwise(F.col("path")).alias("log")
    files = spark.read.format("binaryFile").load(at, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path")).select(log, "path")
    members = rolling_members(files)
    lost = members.filter("gap").select("path").limit(5).collect()
    if lost:
        raise ValueError("rolling log with a file missing before " + ", ".join(sorted(r.path for r in lost)))
    lines = spark.read.text(at, recursiveFileLookup=True).select(F.col("value").alias("raw"), F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("place"))
    lines = lines.filter(~name.startswith("appstatus")).withColumn("part", F.when(rolling, F.regexp_extract(name, r"^events_([0-9]+)_", 1).cast("int")).otherwise(0))
    lines = lines.filter(~rolling).unionByName(lines.filter(rolling).join(members.select("path"), "path", "left_semi"))
    return lines.select(log, "path", "part", F.struct("part", "place").alias("seq"), "raw")


def rolling_members(files: DataFrame) -> DataFrame:
    """Of files (log, path): those to read, with index and gap. The last compacted file and all after it; status files never.

    gap tells whether an index before this one is missing.
    """
    name = F.element_at(F.split("path", "/"), -1)
    x = files.filter(name.rlike(r"^events_[0-9]+_")).withColumn("index", F.regexp_extract(name, r"^events_([0-9]+)_", 1).cast("int")).withColumn("compact", name.endswith(".compact"))
    own = Window.partitionBy("log")
    x = x.withColumn("_from", F.coalesce(F.max(F.when(F.col("compact"), F.col("index"))).over(own), F.lit(0)))
    x = x.filter((F.col("index") > F.col("_from")) | ((F.col("index") == F.col("_from")) & F.col("compact")) | (F.col("_from") == 0))
    before = F.lag("index").over(own.orderBy("index"))
    return x.withColumn("gap", F.coalesce(F.col("index") - before > 1, F.lit(False))).drop("_from")


def parse_events(lines: DataFrame) -> DataFrame:
    """Lines (log, seq, raw, ...) gain event, the last name of their type, or null where a line isn't JSON with a type."""
    name = F.regexp_extract("raw", r'"Event"\s*:\s*"(?:[^"]*\.)?([^".]+)"', 1)
    whole = F.col("raw").rlike(r"^\s*\{") & F.col("raw").rlike(r"\}\s*$")
    return lines.withColumn("event", F.when(whole & (name != ""), name))


def skipped_lines(events: DataFrame) -> DataFrame:
    """(log, skipped, unread_sql): lines that aren't JSON objects with a type, and SQL starts among them."""
    bad = (F.trim("raw") != "") & (F.col("event").isNull() | (F.col("event").isin(*KNOWN) & F.expr("try_parse_json(raw) IS NULL")))
    return events.groupBy("log").agg(F.count_if(bad).alias("skipped"), F.count_if(bad & F.col("raw").contains("SQLExecutionStart")).alias("unread_sql"))


def of_type(events: DataFrame, name: str, keep: Column | None = None) -> DataFrame:
    """(log, seq, e) of one event type: the filter comes before the parse. A line with a type is an object, so e is never null; a test of that would parse it again."""
    rows = events.filter(F.col("event") == name)
    rows = rows if keep is None else rows.filter(keep)
    return rows.select("log", "seq", F.from_json("raw", SCHEMAS[name]).alias("e"))


def applications(events: DataFrame) -> DataFrame:
    """One row a log: app_id, name, attempt_id, start_ms, end_ms (null without an end), version (the log's own wins)."""
    start = of_type(events, "SparkListenerApplicationStart").groupBy("log").agg(F.max_by("e", "seq").alias("s"))
    end = of_type(events, "SparkListenerApplicationEnd").groupBy("log").agg(F.max_by("e.Timestamp", "seq").alias("end_ms"))
    version = of_type(events, "SparkListenerLogStart").groupBy("log").agg(F.max_by(F.col("e.Spark Version"), "seq").alias("v"))
    x = start.join(end, "log", "left").join(version, "log", "left")
    return x.select("log", F.col("s.App ID").alias("app_id"), F.col("s.App Name").alias("name"), F.col("s.App Attempt ID").alias("attempt_id"), F.col("s.Timestamp").alias("start_ms"), "end_ms", F.coalesce("v", F.col("s.Spark Version")).alias("version"))


def spark_properties(events: DataFrame) -> DataFrame:
    """(log, key, value) of the last environment update; properties may be an object, a list of pairs, or missing."""
    rows = events.filter(F.col("event") == "SparkListenerEnvironmentUpdate")
    last = rows.groupBy("log").agg(F.max_by("raw", "seq").alias("raw"))
    text = F.get_json_object("raw", "$['Spark Properties']")
    pairs = F.when(F.ltrim(text).startswith("["), F.map_from_entries(F.transform(F.from_json(text, "array<array<string>>"), lambda p: F.struct(p[0], p[1])))).otherwise(F.from_json(text, "map<string,string>"))
    return last.select("log", F.explode(pairs).alias("key", "value"))


def executor_events(events: DataFrame) -> DataFrame:
    """(log, executor_id, host, added_ms, removed_ms, cores): an addition and the first removal not before it. A repeated addition is one executor."""
    add = of_type(events, "SparkListenerExecutorAdded").groupBy("log", F.col("e.Executor ID").alias("executor_id")).agg(F.min_by("e", "seq").alias("a"))
    gone = of_type(events, "SparkListenerExecutorRemoved").select("log", F.col("e.Executor ID").alias("executor_id"), F.col("e.Timestamp").alias("t"))
    x = add.join(gone, ["log", "executor_id"], "left")
    out = x.groupBy("log", "executor_id").agg(F.first("a").alias("a"), F.min(F.when(F.col("t") >= F.col("a.Timestamp"), F.col("t"))).alias("removed_ms"))
    return out.select("log", "executor_id", F.col("a.Executor Info.Host").alias("host"), F.col("a.Timestamp").alias("added_ms"), "removed_ms", F.col("a.Executor Info.Total Cores").alias("cores"))


def jobs(events: DataFrame) -> DataFrame:
    """(log, job_id, execution_id, start_ms, end_ms, succeeded, stage_ids, reason): starts and ends, either of which may be missing."""
    s = of_type(events, "SparkListenerJobStart").select("log", F.col("e.Job ID").alias("job_id"), F.col("e.Submission Time").alias("start_ms"), F.col("e.Stage IDs").alias("stage_ids"), F.try_element_at("e.Properties", F.lit("spark.sql.execution.id")).cast("long").alias("execution_id"))
    e = of_type(events, "SparkListenerJobEnd").select("log", F.col("e.Job ID").alias("job_id"), F.col("e.Completion Time").alias("end_ms"), (F.col("e.Job Result.Result") == "JobSucceeded").alias("succeeded"), F.col("e.Job Result.Exception.Message").alias("reason"))
    return s.join(e, ["log", "job_id"], "full").select("log", "job_id", "execution_id", "start_ms", "end_ms", "succeeded", "stage_ids", "reason")


def stage_execution_link(events: DataFrame) -> DataFrame:
    """(log, stage_id, execution_id): that of the last job start naming the stage."""
    rows = of_type(events, "SparkListenerJobStart").select("log", "seq", F.try_element_at("e.Properties", F.lit("spark.sql.execution.id")).cast("long").alias("x"), F.explode("e.Stage IDs").alias("stage_id"))
    return rows.groupBy("log", "stage_id").agg(F.max_by("x", "seq").alias("execution_id"))


def stage_attempts(events: DataFrame) -> DataFrame:
    """(log, stage_id, attempt, name, submitted_ms, completed_ms, failure, submitted_seq, completed_seq, latest, attempts, failed_attempts)."""
    rows = [of_type(events, f"SparkListenerStage{k}").select("log", "seq", F.lit(k).alias("kind"), F.col("e.Stage Info").alias("i")) for k in ("Submitted", "Completed")]
    x = rows[0].unionByName(rows[1])
    done = F.col("kind") == "Completed"
    x = x.groupBy("log", F.col("i.Stage ID").alias("stage_id"), F.coalesce(F.col("i.Stage Attempt ID"), F.lit(0)).alias("attempt")).agg(
        F.max("i.Stage Name").alias("name"), F.max("i.Submission Time").alias("submitted_ms"), F.max(F.when(done, F.col("i.Completion Time"))).alias("completed_ms"),
        F.max(F.when(done, F.col("i.Failure Reason"))).alias("failure"), F.min(F.when(~done, F.col("seq"))).alias("submitted_seq"), F.max(F.when(done, F.col("seq"))).alias("completed_seq"),
    )
    own = Window.partitionBy("log", "stage_id")
    return x.withColumn("latest", F.col("attempt") == F.max("attempt").over(own)).withColumn("attempts", F.count("*").over(own)).withColumn("failed_attempts", F.count_if(F.col("failure").isNotNull()).over(own))


def task_records(events: DataFrame) -> DataFrame:
    """Task ends as flat rows: duration, failed (failed or killed), bytes and times with 0 for absent metrics, output records null if absent."""
    x = of_type(events, "SparkListenerTaskEnd")
    i, m = (lambda c: F.col(f"e.Task Info.{c}")), (lambda c: F.col(f"e.Task Metrics.{c}"))
    zero = lambda c: F.coalesce(m(c), F.lit(0).cast("long"))
    return x.select(
        "log", "seq", F.col("e.Stage ID").alias("stage_id"), F.coalesce(F.col("e.Stage Attempt ID"), F.lit(0)).alias("attempt"), i("Task ID").alias("task_id"), i("Index").alias("task_index"), i("Host").alias("host"),
        i("Executor ID").alias("executor_id"), i("Locality").alias("locality"), i("Launch Time").alias("launch_ms"), i("Finish Time").alias("finish_ms"), (i("Finish Time") - i("Launch Time")).alias("duration_ms"),
        (F.coalesce(i("Failed"), F.lit(False)) | F.coalesce(i("Killed"), F.lit(False))).alias("failed"), F.coalesce(i("Speculative"), F.lit(False)).alias("speculative"),
        (zero("Shuffle Read Metrics.Remote Bytes Read") + zero("Shuffle Read Metrics.Local Bytes Read")).alias("shuffle_read"), zero("Shuffle Write Metrics.Shuffle Bytes Written").alias("shuffle_write"),
        zero("Input Metrics.Bytes Read").alias("input_bytes"), (zero("Input Metrics.Records Read") + zero("Shuffle Read Metrics.Total Records Read")).alias("records_read"), zero("Output Metrics.Bytes Written").alias("output_bytes"),
        m("Output Metrics.Records Written").alias("output_records"), zero("Memory Bytes Spilled").alias("mem_spilled"), zero("Disk Bytes Spilled").alias("disk_spilled"), zero("JVM GC Time").alias("gc_ms"), zero("Executor Run Time").alias("run_ms"),
        zero("Executor CPU Time").alias("cpu_ns"), zero("Shuffle Read Metrics.Fetch Wait Time").alias("fetch_wait_ms"), zero("Peak Execution Memory").alias("peak_mem"), F.col("e.Task End Reason").alias("reason"),
    )


def tasks_of_latest(tasks: DataFrame, stages: DataFrame) -> DataFrame:
    """Task records that arrive while a stage's latest attempt is open, whichever attempt they name."""
    open_ = stages.filter("latest").select("log", "stage_id", "submitted_seq", "completed_seq")
    x = tasks.join(open_, ["log", "stage_id"])
    return x.filter((F.col("seq") > F.col("submitted_seq")) & (F.col("completed_seq").isNull() | (F.col("seq") < F.col("completed_seq")))).drop("submitted_seq", "completed_seq")


def task_failures(tasks: DataFrame, excerpt: int = 500) -> DataFrame:
    """(log, stage_id, task_id, reason, cls, message, excerpt): the message is the first line, or a Python traceback's last."""
    text = F.coalesce("reason.Description", "reason.Full Stack Trace", "reason.Loss Reason", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda s: F.trim(s) != "")
    python = text.contains("Traceback (most recent call last)")
    own = F.filter(lines, lambda s: s.rlike(r"^[A-Za-z_][\w.]*(Error|Exception|Warning|Interrupt)\b"))
    message = F.when(python & (F.size(own) > 0), F.element_at(own, -1)).otherwise(F.try_element_at(lines, F.lit(1)))
    return tasks.filter("failed").select("log", "stage_id", "task_id", F.col("reason.Reason").alias("reason"), F.col("reason.Class Name").alias("cls"), F.trim(message).alias("message"), F.substring(text, 1, excerpt).alias("excerpt"))


def rdd_info(events: DataFrame) -> DataFrame:
    """(log, rdd_id, name, partitions, cached, mem_bytes, disk_bytes): the last figures, a cached one never falling back to 0."""
    rows = [of_type(events, f"SparkListenerStage{k}").select("log", "seq", F.explode("e.Stage Info.RDD Info").alias("r")) for k in ("Submitted", "Completed")]
    x = rows[0].unionByName(rows[1])
    keep = lambda c: F.coalesce(F.max_by(F.when(F.col(f"r.{c}") > 0, F.col(f"r.{c}")), F.when(F.col(f"r.{c}") > 0, F.col("seq"))), F.lit(0))
    return x.groupBy("log", F.col("r.RDD ID").alias("rdd_id")).agg(F.max_by("r.Name", "seq").alias("name"), F.max_by(F.col("r.Number of Partitions"), "seq").alias("partitions"), keep("Number of Cached Partitions").alias("cached"), keep("Memory Size").alias("mem_bytes"), keep("Disk Size").alias("disk_bytes"))


def sql_executions(events: DataFrame) -> DataFrame:
    """(log, execution_id, root_id, description, start_ms, end_ms, modified, plan, adaptive): plan is the last one's JSON text.

    The last plan is chosen among unparsed lines.
    """
    s = of_type(events, "SparkListenerSQLExecutionStart").select("log", F.col("e.executionId").alias("execution_id"), F.col("e.rootExecutionId").alias("root_id"), F.col("e.description").alias("description"), F.col("e.time").alias("start_ms"), F.col("e.modifiedConfigs").alias("modified"))
    e = of_type(events, "SparkListenerSQLExecutionEnd").groupBy("log", F.col("e.executionId").alias("execution_id")).agg(F.max("e.time").alias("end_ms"))
    plans = events.filter(F.col("event").isin("SparkListenerSQLExecutionStart", "SparkListenerSQLAdaptiveExecutionUpdate")).withColumn("execution_id", F.regexp_extract("raw", r'"executionId"\s*:\s*([0-9]+)', 1).cast("long"))
    last = plans.groupBy("log", "execution_id").agg(F.max_by("raw", "seq").alias("raw"), F.bool_or(F.col("event") == "SparkListenerSQLAdaptiveExecutionUpdate").alias("adaptive"))
    last = last.select("log", "execution_id", F.get_json_object("raw", "$.sparkPlanInfo").alias("plan"), "adaptive")
    return s.join(e, ["log", "execution_id"], "left").join(last, ["log", "execution_id"], "left")


def accumulators(events: DataFrame) -> DataFrame:
    """(log, acc_id, value, side): driver updates summed, else the last stage's running total of a SQL metric."""
    d = of_type(events, "SparkListenerDriverAccumUpdates").select("log", F.explode("e.accumUpdates").alias("u")).groupBy("log", F.col("u")[0].alias("acc_id")).agg(F.sum(F.col("u")[1]).cast("double").alias("driver"))
    x = of_type(events, "SparkListenerStageCompleted").select("log", "seq", F.explode("e.Stage Info.Accumulables").alias("a")).filter(F.col("a.Metadata") == "sql")
    x = x.groupBy("log", F.col("a.ID").alias("acc_id")).agg(F.max_by(F.expr("try_cast(a.Value AS double)"), "seq").alias("executor"))
    return d.join(x, ["log", "acc_id"], "full").select("log", "acc_id", F.coalesce("driver", "executor").alias("value"), F.when(F.col("driver").isNotNull(), "driver").otherwise("executor").alias("side"))


def executor_peaks(events: DataFrame) -> DataFrame:
    """(log, executor_id, metric, peak): the largest positive value over task ends."""
    x = of_type(events, "SparkListenerTaskEnd").select("log", F.col("e.Task Info.Executor ID").alias("executor_id"), F.explode("e.Task Executor Metrics").alias("metric", "v")).filter("v > 0")
    return x.groupBy("log", "executor_id", "metric").agg(F.max("v").alias("peak"))


def stage_executor_metrics(events: DataFrame) -> DataFrame:
    """(log, stage_id, executor_id, metric, value) of the last report."""
    x = of_type(events, "SparkListenerStageExecutorMetrics").groupBy("log", F.col("e.Stage ID").alias("stage_id"), F.col("e.Executor ID").alias("executor_id")).agg(F.max_by(F.col("e.Executor Metrics"), "seq").alias("m"))
    return x.select("log", "stage_id", "executor_id", F.explode("m").alias("metric", "value"))


def heap_peaks(peaks: DataFrame, stage_metrics: DataFrame, metric: str = "JVMHeapMemory") -> DataFrame:
    """(log, executor_id, bytes): the largest heap of each executor in either table, the driver left out."""
    both = peaks.select("log", "executor_id", "metric", F.col("peak").alias("v")).unionByName(stage_metrics.select("log", "executor_id", "metric", F.col("value").alias("v")))
    return both.filter((F.col("metric") == metric) & (F.col("executor_id") != "driver")).groupBy("log", "executor_id").agg(F.max("v").alias("bytes"))


def list_runs(apps: DataFrame, name_pattern: str | None = None, min_ms: int | None = None, max_ms: int | None = None, most: int = 100) -> DataFrame:
    """The newest runs first, `most` of them, with truncated on each row if there are more. A top-k report: the limit is its feature."""
    x = apps if name_pattern is None else apps.filter(F.lower("name").contains(name_pattern.lower()))
    x = x if min_ms is None else x.filter(F.col("start_ms") >= min_ms)
    x = x if max_ms is None else x.filter(F.col("start_ms") <= max_ms)
    top = x.orderBy(F.desc_nulls_last("start_ms"), "log").limit(most + 1)
    return top.withColumn("_i", F.row_number().over(Window.orderBy(F.desc_nulls_last("start_ms"), "log"))).withColumn("truncated", F.max("_i").over(Window.partitionBy()) > most).filter(F.col("_i") <= most).drop("_i")


def as_lines(tasks: DataFrame) -> DataFrame:
    """Task rows written as event lines (log, seq, raw): the sink that the readers above take back.

    Lines come out of a generator, past which no filter is pushed: each is written once, however often readers test it.
    """
    n = lambda c, k: F.col(c).alias(k)
    info = F.struct(n("task_id", "Task ID"), n("task_id", "Index"), F.lit(0).alias("Attempt"), n("launch_ms", "Launch Time"), n("finish_ms", "Finish Time"), n("executor_id", "Executor ID"), n("host", "Host"), n("locality", "Locality"), n("speculative", "Speculative"), n("failed", "Failed"), F.lit(False).alias("Killed"))
    metrics = F.struct(
        n("run_ms", "Executor Run Time"), n("cpu_ns", "Executor CPU Time"), n("gc_ms", "JVM GC Time"), n("peak_mem", "Peak Execution Memory"), n("mem_spilled", "Memory Bytes Spilled"), n("disk_spilled", "Disk Bytes Spilled"),
        F.struct(n("input_bytes", "Bytes Read"), n("records_read", "Records Read")).alias("Input Metrics"), F.struct(n("output_bytes", "Bytes Written"), n("output_records", "Records Written")).alias("Output Metrics"),
        F.struct(n("shuffle_read", "Remote Bytes Read"), n("fetch_wait_ms", "Fetch Wait Time")).alias("Shuffle Read Metrics"), F.struct(n("shuffle_write", "Shuffle Bytes Written")).alias("Shuffle Write Metrics"),
    )
    raw = F.to_json(F.struct(F.lit("SparkListenerTaskEnd").alias("Event"), n("stage_id", "Stage ID"), F.lit(0).alias("Stage Attempt ID"), F.struct(F.when(F.col("failed"), "ExceptionFailure").otherwise("Success").alias("Reason")).alias("Task End Reason"), info.alias("Task Info"), metrics.alias("Task Metrics")))
    return tasks.select(F.col("app_id").alias("log"), F.col("task_id").alias("seq"), F.explode(F.array(raw)).alias("raw"))
