"""Append, scan, statistics, trim and compaction of an append-only keyed log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def append(log: DataFrame, arrivals: DataFrame, order: str) -> DataFrame:
    """arrivals with seq, duplicate and, for duplicates, the first record's seq; keys that are null or empty never repeat.

    Rows without stream_id or event_type are rejected. A key that the log already holds gives that record. Payloads of duplicates are ignored.
    """
    sound = arrivals.where("stream_id is not null and stream_id <> '' and event_type is not null and event_type <> ''")
    keyed = F.coalesce(F.col("idempotency_key"), F.lit("")) != ""
    held = log.where(keyed).groupBy("stream_id", "idempotency_key").agg(F.min("seq").alias("held_seq"))
    ends = log.groupBy("stream_id").agg(F.max("seq").alias("last_seq"))
    rows = sound.join(held, ["stream_id", "idempotency_key"], "left").join(ends, "stream_id", "left")
    place = F.row_number().over(Window.partitionBy("stream_id", "idempotency_key").orderBy(order))
    rows = rows.withColumn("duplicate", keyed & (F.col("held_seq").isNotNull() | (place > 1)))
    number = F.sum(F.when(~F.col("duplicate"), 1).otherwise(0)).over(Window.partitionBy("stream_id").orderBy(order))
    rows = rows.withColumn("own_seq", F.coalesce("last_seq", F.lit(0)) + number)
    first = F.min(F.when(~F.col("duplicate"), F.col("own_seq"))).over(Window.partitionBy("stream_id", "idempotency_key"))
    return rows.withColumn("seq", F.when(F.col("duplicate"), F.coalesce("held_seq", first)).otherwise(F.col("own_seq"))).drop("held_seq", "last_seq", "own_seq")


def dedup_first(log: DataFrame) -> DataFrame:
    """The first record of each key of a stream; records without a key all stay."""
    keyed = F.coalesce(F.col("idempotency_key"), F.lit("")) != ""
    first = F.row_number().over(Window.partitionBy("stream_id", "idempotency_key").orderBy("seq"))
    return log.withColumn("_n", first).where(~keyed | (F.col("_n") == 1)).drop("_n")


def scan(log: DataFrame, stream: str, from_seq: int = 0, limit: int | None = 100, trim_before: int = 0) -> DataFrame:
    rows = log.where((F.col("stream_id") == stream) & (F.col("seq") >= max(from_seq, trim_before, 1))).orderBy("seq")
    return rows if limit is None else rows.limit(limit or 100)


def live(log: DataFrame, retention: DataFrame) -> DataFrame:
    """Records that retention keeps."""
    return log.join(retention, "stream_id", "left").where(F.col("seq") >= F.coalesce("trim_before", F.lit(0)))


def streams(log: DataFrame, prefix: str = "") -> DataFrame:
    return log.where(F.col("stream_id").startswith(prefix)).select("stream_id").distinct()


def stream_stats(log: DataFrame, retention: DataFrame) -> DataFrame:
    dead = (F.col("trim") > 0) & (F.col("seq") < F.col("trim"))
    rows = log.join(retention, "stream_id", "left").withColumn("trim", F.coalesce("trim_before", F.lit(0)))
    out = rows.groupBy("stream_id").agg(F.min(F.when(F.col("seq") >= F.col("trim"), F.col("seq"))).alias("_first"), (F.max("seq") + 1).alias("next_seq"), F.max("trim").alias("trimmed_before_seq"), F.count_if(dead).alias("compactable_records"), F.coalesce(F.sum(F.when(dead, F.col("length"))), F.lit(0)).cast("long").alias("compactable_bytes"))
    return out.select("stream_id", F.coalesce("_first", "next_seq").alias("first_seq"), "next_seq", "trimmed_before_seq", "compactable_records", "compactable_bytes")


def trim(retention: DataFrame, wanted: DataFrame, stats: DataFrame) -> DataFrame:
    """Retention after requests (stream_id, before_seq): forward only, between 1 and next_seq; unknown streams and 0 are left out."""
    new = wanted.where("before_seq > 0").groupBy("stream_id").agg(F.max("before_seq").alias("before_seq")).join(stats.select("stream_id", "next_seq"), "stream_id")
    rows = retention.join(new, "stream_id", "full")
    return rows.select("stream_id", F.greatest(F.coalesce("trim_before", F.lit(0)), F.coalesce(F.least("before_seq", "next_seq"), F.lit(0))).alias("trim_before"))


def segment_streams(log: DataFrame, retention: DataFrame) -> DataFrame:
    alive = F.col("seq") >= F.coalesce("trim_before", F.lit(0))
    rows = log.join(retention, "stream_id", "left").withColumn("alive", alive)
    return rows.groupBy("segment_id", "stream_id").agg(F.count("*").alias("total_records"), F.sum("length").alias("total_bytes"), F.count_if("alive").alias("live_records"), F.coalesce(F.sum(F.when(F.col("alive"), F.col("length"))), F.lit(0)).cast("long").alias("live_bytes"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"))


def segment_stats(log: DataFrame, retention: DataFrame) -> DataFrame:
    """By segment; the second level is summed from the first, so the log is shuffled once."""
    out = segment_streams(log, retention).groupBy("segment_id").agg(*[F.sum(c).alias(c) for c in ("total_records", "total_bytes", "live_records", "live_bytes")], F.count("*").alias("streams"))
    return out.select("segment_id", "streams", "total_records", "live_records", (F.col("total_records") - F.col("live_records")).alias("compactable_records"), "total_bytes", "live_bytes", (F.col("total_bytes") - F.col("live_bytes")).alias("compactable_bytes"), ((F.col("total_records") > 0) & (F.col("live_records") == 0)).alias("fully_compactable"))


def compaction_plan(stats: DataFrame, active_segment: int, threshold: float = 0.5) -> DataFrame:
    action = F.when((F.col("segment_id") == active_segment) | (F.col("total_records") == 0), "skip").when(F.col("fully_compactable"), "delete").when((F.col("compactable_records") > 0) & (F.col("live_bytes") / F.col("total_bytes") <= threshold), "copy").otherwise("keep")
    return stats.select("segment_id", action.alias("action"), F.round(F.col("live_bytes") / F.col("total_bytes"), 6).alias("live_ratio"))


def compact(log: DataFrame, retention: DataFrame, plan: DataFrame) -> DataFrame:
    """The log after the plan: deleted segments go, copied ones keep live records; order and seq stay."""
    rows = log.join(plan.select("segment_id", "action").where("action in ('delete', 'copy')"), "segment_id", "left").join(retention, "stream_id", "left")
    gone = F.col("action").isNotNull() & (F.col("seq") < F.coalesce("trim_before", F.lit(0)))
    return rows.where(~gone).drop("action", "trim_before")


def recovered(log: DataFrame, bad) -> DataFrame:
    """Records of each segment before its first that is bad."""
    first = F.min(F.when(bad, F.col("event_id"))).over(Window.partitionBy("segment_id"))
    return log.withColumn("_bad", first).where(F.col("_bad").isNull() | (F.col("event_id") < F.col("_bad"))).drop("_bad")


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key that is last by order."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(*keys, "_r.*")


def tail(log: DataFrame, n: int) -> DataFrame:
    """The last n records of each stream."""
    back = F.row_number().over(Window.partitionBy("stream_id").orderBy(F.desc("seq")))
    return log.withColumn("_n", back).where(F.col("_n") <= n).drop("_n")


def changes(log: DataFrame, value: str) -> DataFrame:
    """Records whose value differs from the one before in their stream."""
    before = F.lag(value).over(Window.partitionBy("stream_id").orderBy("seq"))
    return log.withColumn("_was", before).where(~F.col(value).eqNullSafe(F.col("_was"))).drop("_was")


def merged(batches: list[DataFrame], n: int) -> DataFrame:
    """Overlapping batches as one: for each seq the first batch's record, the last n of a stream."""
    rows = None
    for i, b in enumerate(batches):
        b = b.withColumn("_batch", F.lit(i))
        rows = b if rows is None else rows.unionByName(b)
    first = F.row_number().over(Window.partitionBy("stream_id", "seq").orderBy("_batch"))
    return tail(rows.withColumn("_k", first).where("_k = 1").drop("_k", "_batch"), n)


def keyset(log: DataFrame, retained: DataFrame, from_seq: int, limit: int = 100) -> DataFrame:
    """For every stream, the page that starts at from_seq: its records, the next page's start, and whether there is more.

    A page before a trimmed prefix that holds nothing continues at the first record that is left.
    """
    if not 1 <= limit <= 1000:
        raise ValueError("limit is 1 to 1000")
    stats = stream_stats(log, retained).select("stream_id", "first_seq", F.col("next_seq").alias("end"))
    n = F.row_number().over(Window.partitionBy("stream_id").orderBy("seq"))
    page = live(log, retained).where(F.col("seq") >= from_seq).withColumn("n", n).where(F.col("n") <= limit)
    rows = stats.join(page.groupBy("stream_id").agg(F.count("*").alias("records"), F.max("seq").alias("last")), "stream_id", "left")
    start = F.coalesce(F.col("last") + 1, F.lit(from_seq).cast("bigint"))
    after = F.when(F.col("last").isNull() & (start < F.col("first_seq")) & (start < F.col("end")), F.col("first_seq")).otherwise(start)
    return rows.select("stream_id", F.coalesce("records", F.lit(0)).alias("records"), after.alias("next_seq"), (after < F.col("end")).alias("has_more"))
