"""Folds of ordered events to state, by stream, as higher-order functions inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A task's state: status, current and fenced epoch, worker, result, error; null before its submission.
TASK_STATE = "struct<status:string,cur:bigint,fence:bigint,worker_id:string,result:string,error:string>"
STEP_STATE = "status string, attempts int, task_id string, result string, error string, scheduled_ms bigint, completed_ms bigint"


def ordered(rows: DataFrame, key: str, order: list[str], *fields: str) -> DataFrame:
    """key and events: the key's rows in order. A key's events must fit one task."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *fields))).alias("events"))


def task_step(s: Column, e: Column) -> Column:
    """The state after one event, by the transition table of tasks."""
    state = lambda status, cur, fence, worker, result, error: F.struct(status.alias("status"), cur.alias("cur"), fence.alias("fence"), worker.alias("worker_id"), result.alias("result"), error.alias("error")).cast(TASK_STATE)
    kind, epoch, none = e["event_type"], F.coalesce(e["epoch"], F.lit(0).cast("bigint")), F.lit(None).cast("string")
    open_ = ~F.coalesce(s["status"], F.lit("")).isin("SUCCEEDED", "FAILED")
    unleased = (s["cur"] == 0) & (s["fence"] == 0)
    starts = open_ & F.when(epoch == 0, unleased).otherwise((epoch > s["fence"]) & (epoch >= s["cur"]))
    ends = open_ & F.when(epoch == 0, unleased).otherwise((s["status"] == "RUNNING") & (epoch == s["cur"]) & (epoch > s["fence"]))
    back = (epoch == 0) | (epoch >= s["cur"])
    return (
        F.when(kind == "TaskSubmitted", state(F.lit("QUEUED"), epoch, F.lit(0).cast("bigint"), F.lit(""), none, none))
        .when(s.isNull(), s)
        .when((kind == "TaskStarted") & starts, state(F.lit("RUNNING"), F.when(epoch == 0, s["cur"]).otherwise(epoch), s["fence"], e["worker_id"], s["result"], s["error"]))
        .when((kind == "TaskRedelivered") & open_, state(F.when(back, F.lit("QUEUED")).otherwise(s["status"]), s["cur"], F.greatest(s["fence"], epoch), F.when(back, F.lit("")).otherwise(s["worker_id"]), s["result"], s["error"]))
        .when((kind == "TaskCompleted") & ends, state(F.lit("SUCCEEDED"), s["cur"], s["fence"], e["worker_id"], e["result"], none))
        .when((kind == "TaskFailed") & ends, state(F.lit("FAILED"), s["cur"], s["fence"], e["worker_id"], e["result"], e["error"]))
        .otherwise(s)
    )


def folded(events: DataFrame, key: str, initial: DataFrame | None = None) -> DataFrame:
    """State by key after its events; from the states of `initial` (key, state) where it has them."""
    rows = ordered(events, key, ["seq"], "event_type", "epoch", "worker_id", "result", "error")
    start = F.lit(None).cast(TASK_STATE)
    if initial is not None:
        rows = initial.withColumnRenamed("state", "start").join(rows, key, "full")
        start = F.col("start")
    return rows.select(key, F.aggregate(F.coalesce("events", F.expr("array()").cast(dict(rows.dtypes)["events"])), start, task_step).alias("state"))


def tasks(events: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """Task rows after replay: a running task is queued again without a worker; streams without a submission have none."""
    s = folded(events, "task_id", initial).where("state is not null").select("task_id", "state.*")
    running = F.col("status") == "RUNNING"
    return s.select("task_id", F.when(running, "QUEUED").otherwise(F.col("status")).alias("status"), F.col("cur").alias("epoch"), "fence", F.when(running, "").otherwise(F.col("worker_id")).alias("worker_id"), "result", "error")


def workflow_steps(events: DataFrame, steps: DataFrame) -> DataFrame:
    """State of each defined step (workflow_id, step_id) by its events, in order; unknown steps are ignored.

    A step that succeeded stays so until it is scheduled again; StepStarted doesn't change it.
    """
    init = F.expr(f"from_json('{{\"status\": \"SCHEDULED\", \"attempts\": 0, \"task_id\": \"\", \"error\": \"\"}}', '{STEP_STATE}')")

    def step(s: Column, e: Column) -> Column:
        make = lambda **k: F.struct(*[k.get(c, s[c]).alias(c) for c in ("status", "attempts", "task_id", "result", "error", "scheduled_ms", "completed_ms")]).cast(f"struct<{STEP_STATE.replace(' ', ':').replace(',:', ',')}>")
        return (
            F.when(e["event_type"] == "StepScheduled", make(status=F.lit("SCHEDULED"), attempts=e["attempt"], task_id=e["task_id"], error=F.lit(""), scheduled_ms=e["timestamp_ms"]))
            .when((e["event_type"] == "StepStarted") & (s["status"] != "SUCCEEDED"), make(status=F.lit("STARTED")))
            .when(e["event_type"] == "StepSucceeded", make(status=F.lit("SUCCEEDED"), result=e["result"], error=F.lit(""), completed_ms=e["timestamp_ms"]))
            .when(e["event_type"] == "StepFailed", make(status=F.lit("FAILED"), error=e["error"], completed_ms=e["timestamp_ms"]))
            .otherwise(s)
        )

    kind = "array<struct<seq:bigint,event_type:string,task_id:string,attempt:int,result:string,error:string,timestamp_ms:bigint>>"
    rows = events.groupBy("workflow_id", "step_id").agg(F.array_sort(F.collect_list(F.struct("seq", "event_type", "task_id", "attempt", "result", "error", "timestamp_ms"))).cast(kind).alias("events"))
    rows = steps.select("workflow_id", "step_id").join(rows, ["workflow_id", "step_id"], "left")
    return rows.select("workflow_id", "step_id", F.aggregate(F.coalesce("events", F.expr("array()").cast(kind)), init, step).alias("s")).select("workflow_id", "step_id", "s.*")


def retryable(steps: DataFrame, max_attempts: int) -> DataFrame:
    """Failed steps with attempts left are scheduled again, without a task."""
    again = (F.col("status") == "FAILED") & (F.col("attempts") < max_attempts)
    return steps.withColumn("task_id", F.when(again, "").otherwise(F.col("task_id"))).withColumn("status", F.when(again, "SCHEDULED").otherwise(F.col("status")))


def actors(events: DataFrame, use_snapshot: bool = False) -> DataFrame:
    """Actor state by ordered aggregates: owner and epoch as last granted, or as a command or snapshot that names them says; counters; last applied state.

    With a snapshot, only commands counted after the last snapshot are replayed, from its state. A command's own number counts before its count.
    """
    by, kind = F.col("seq"), F.col("event_type")
    snap = F.max_by("snapshot_count", F.when(kind == "ActorSnapshotCreated", by)).over(Window.partitionBy("actor_id"))
    rows = events.withColumn("snap", F.coalesce(snap, F.lit(0)) if use_snapshot else F.lit(0))
    command = kind.isin("ActorCommandApplied", "ActorCommandFailed")
    replayed = command & (F.col("command_count") > F.col("snap")) if use_snapshot else command
    granted, taken = kind == "ActorOwnershipGranted", kind == "ActorSnapshotCreated"
    number = F.when(F.col("command_seq") > 0, F.col("command_seq")).otherwise(F.col("command_count"))
    named = granted | ((replayed | taken) & (F.coalesce("worker_id", F.lit("")) != ""))
    dated = granted | ((replayed | taken) & (F.coalesce("epoch", F.lit(0)) != 0))
    state = (kind == "ActorCommandApplied") & replayed
    return rows.groupBy("actor_id").agg(
        F.max_by("worker_id", F.when(named, by)).alias("owner"), F.coalesce(F.max_by("epoch", F.when(dated, by)), F.lit(0)).alias("epoch"),
        F.coalesce(F.greatest(F.max(F.when(kind == "ActorCommandSubmitted", F.col("command_seq"))), F.max(F.when(replayed, number)), F.max("snap")), F.lit(0)).cast("bigint").alias("submitted"),
        F.coalesce(F.max_by(number, F.when(replayed, by)), F.max("snap"), F.lit(0)).cast("bigint").alias("applied"),
        F.max_by("state", F.when(state | taken if use_snapshot else state, by)).alias("state"), F.count_if(replayed).alias("replayed_commands"),
    )


def ewma(values: Column) -> Column:
    """Integer moving average of an ordered array: the first sample, then (7 * before + 3 * sample) div 10, which truncates."""
    return F.aggregate(values, F.lit(None).cast("bigint"), lambda a, x: F.coalesce(F.call_function("div", a * 7 + x * 3, F.lit(10)), x))


def model_stats(events: DataFrame, order: tuple[str, ...] = ("timestamp_ms", "stream_id", "seq")) -> DataFrame:
    """Statistics by model, version and worker: counts and moving averages in the given order; version '' is v1."""
    sound = events.where("model <> '' and worker_id <> '' and total_ms > 0").withColumn("version", F.coalesce(F.nullif("version", F.lit("")), F.lit("v1")))
    rows = sound.groupBy("model", "version", "worker_id").agg(F.array_sort(F.collect_list(F.struct(*order, "total_ms", "load_ms", "fetch_ms", "evictions"))).alias("e"), F.count("*").alias("requests"), F.count_if("cache_hit").alias("hits"), F.max("timestamp_ms").alias("updated_ms"))
    return rows.select("model", "version", "worker_id", "requests", "hits", ewma(F.col("e.total_ms")).alias("ewma_total_ms"), ewma(F.col("e.load_ms")).alias("ewma_load_ms"), ewma(F.col("e.fetch_ms")).alias("ewma_fetch_ms"), F.element_at("e.evictions", -1).alias("evictions"), "updated_ms")


def summary(log: DataFrame) -> DataFrame:
    """By stream: the last payload that isn't empty, the last record's type, and the types in order."""
    by = F.col("seq")
    return log.groupBy("stream_id").agg(F.max_by("payload", F.when(F.col("payload") != "", by)).alias("last_payload"), F.max_by("event_type", by).alias("last_type"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "event_type"))), lambda x: x["event_type"]), ",").alias("types"))
