"""Leases, queues, assignment, fencing and backpressure, over all tasks, workers and actors at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def has_capacity(running: Column, capacity: Column) -> Column:
    return running < F.greatest(capacity, F.lit(1))


def eligible(target: Column, actor: Column, model: Column, worker: Column, free: Column, preferred: Column) -> Column:
    """Whether a worker may take a task: its target, unless an actor's; and for a model call, capacity and being the preferred one, if there is one."""
    blank = lambda c: F.coalesce(c.cast("string"), F.lit("")) == ""
    return (~blank(actor) | blank(target) | (target == worker)) & (blank(model) | (free & (blank(preferred) | (preferred == worker))))


def redeliveries(leases: DataFrame, now_ms: int, timeout_ms: int) -> DataFrame:
    """A TaskRedelivered event for each lease that ran out, in the order of deadlines, then tasks and epochs."""
    due = leases.where((F.col("status") == "RUNNING") & (F.col("updated_ms") != 0)).withColumn("deadline_ms", F.col("updated_ms") + timeout_ms).where(F.col("deadline_ms") <= now_ms)
    return due.select("task_id", F.lit("TaskRedelivered").alias("event_type"), "epoch", "deadline_ms").orderBy("deadline_ms", "task_id", "epoch")


def lease_epochs(events: DataFrame, key: str, leased: Column, granted: Column) -> DataFrame:
    """Leases and grants of each key so far, at each event."""
    w = Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return events.select(key, "seq", F.sum(F.when(leased, 1).otherwise(0)).over(w).alias("lease_epoch"), F.sum(F.when(granted, 1).otherwise(0)).over(w).alias("ownership_epoch"))


def fronts(queue: DataFrame) -> DataFrame:
    """The first task of each worker and priority; of priority 3, which is anyone's, the first of all (worker_id null)."""
    first = F.min_by("task_id", F.struct("enqueued_ms", "task_id"))
    return queue.groupBy("priority", "worker_id").agg(first.alias("task_id"))


def assigned(queue: DataFrame, workers: DataFrame) -> DataFrame:
    """The task that each polling worker gets: its target's (0), its actors' next command (1), a model's it holds (2), else the general queue's front (3)."""
    front = fronts(queue)
    general = front.where("worker_id is null").select(F.col("task_id").alias("general"), F.lit(3).alias("last"))
    own = front.where("worker_id is not null").groupBy("worker_id").agg(F.min(F.struct("priority", "task_id")).alias("own"))
    rows = workers.select("worker_id").join(own, "worker_id", "left").join(F.broadcast(general), F.lit(True), "left")  # one row of fronts
    return rows.select("worker_id", F.coalesce("own.task_id", "general").alias("task_id"), F.coalesce("own.priority", "last").alias("priority"))


def model_queue(waiting: DataFrame, now_ms: int, patience_ms: int = 250) -> DataFrame:
    """The order in which a polling worker takes models: those it holds, and cold ones unless a worker that holds the model is free and its first task is young."""
    ok = F.col("cached") | ~(F.col("held_by_free") & (F.lit(now_ms) - F.col("front_ms") < patience_ms))
    rank = F.row_number().over(Window.partitionBy("worker_id").orderBy("front_ms", "model", "version"))
    return waiting.where(ok).select("worker_id", "model", "version", rank.alias("rank"))


def in_order(commands: DataFrame) -> DataFrame:
    """By actor: commands applied and rejected. A completion counts if worker and epoch are the owner's and its number is the next one."""
    fresh = (F.col("worker_id") == F.col("owner")) & (F.col("epoch") == F.col("owner_epoch"))
    rows = commands.groupBy("actor_id").agg(F.count("*").alias("n"), F.count_if(~fresh).alias("stale"), F.array_sort(F.collect_list(F.when(fresh, F.struct("seq", "command_seq")))).alias("c"))
    applied = F.aggregate(F.transform("c", lambda x: x["command_seq"].cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: F.when(x == a + 1, x).otherwise(a))
    return rows.select("actor_id", applied.alias("applied"), "stale", (F.col("n") - F.col("stale") - applied).alias("out_of_order"))


def backpressure(requests: DataFrame, slow_ms: int, high: int) -> DataFrame:
    """Why each request is turned away: a slow log, then a long queue; a duplicate never is."""
    why = F.when(F.col("duplicate"), "").when((F.lit(slow_ms) > 0) & (F.col("append_ms") >= slow_ms), "slow log").when((F.lit(high) > 0) & (F.col("backlog") >= high), "backlog").otherwise("")
    return requests.withColumn("rejected", why)


def snapshot_plan(applied: DataFrame, every: int = 25) -> DataFrame:
    """By actor: commands, snapshots taken, and what its stream is trimmed before: the record of the last snapshot."""
    n = F.row_number().over(Window.partitionBy("actor_id").orderBy("seq"))
    rows = applied.withColumn("n", n)
    return rows.groupBy("actor_id").agg(F.count("*").alias("commands"), F.count_if(F.col("n") % every == 0).alias("snapshots"), F.max(F.when(F.col("n") % every == 0, F.col("seq"))).alias("trim_before"))


def running(events: DataFrame, key: str, started: Column, ended: Column) -> DataFrame:
    return events.groupBy(key).agg(F.greatest(F.lit(0), F.sum(F.when(started, 1).when(ended, -1).otherwise(0))).alias("running"))


def owners(claims: DataFrame) -> DataFrame:
    """Of the workers that claim an actor, the lowest id wins."""
    return claims.groupBy("actor_id").agg(F.min("worker_id").alias("owner"))


def gauges(deltas: DataFrame, key: str, applied: Column) -> DataFrame:
    """By key: deltas that wait, and how far behind the last applied one is."""
    lag = F.max("timestamp_ms") - F.max(F.when(applied, F.col("timestamp_ms")))
    return deltas.groupBy(key).agg(F.count_if(~applied).alias("pending"), lag.alias("lag_ms"))
