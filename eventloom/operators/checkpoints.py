"""Checkpoints as log records: the newest that can be read, retention, and scans up to a high-water mark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(checkpoints: DataFrame, key: str, sound: Column) -> DataFrame:
    """The newest sound checkpoint of each key; of equal times the later record. Those that can't be read are skipped; keys without a sound one replay in full."""
    return checkpoints.groupBy(key).agg(F.max_by("payload", F.when(sound, F.struct("timestamp_ms", "seq"))).alias("payload"), F.max(F.when(sound, F.struct("timestamp_ms", "seq")))["seq"].alias("seq"), F.count_if(~sound).alias("skipped"))


def retained(checkpoints: DataFrame, key: str, keep: int = 3) -> DataFrame:
    """The last `keep` checkpoints of each key."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("seq")))
    return checkpoints.withColumn("n", n).where(F.col("n") <= keep).drop("n")


def snapshot_scan(log: DataFrame, ends: DataFrame) -> DataFrame:
    """Records below each stream's high-water mark (next_seq), whatever is appended later."""
    return log.join(ends, "stream_id").where("seq < next_seq").drop("next_seq")
