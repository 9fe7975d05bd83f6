"""The event log that queries run on, derived from the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LOG_SQL = """log AS (
  SELECT 'user:' || user_id AS stream_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_type,
    event_type || ':' || json_extract_string(props, '$.k') AS idempotency_key, props AS payload, epoch_us(ts) // 1000 AS timestamp_ms,
    event_id, event_id // 100 AS segment_id, value,
    40 + strlen('user:' || user_id) + strlen(event_type) + strlen(event_type || ':' || json_extract_string(props, '$.k')) + strlen(props) AS length
  FROM events)"""
RETENTION_SQL = """retention AS (SELECT DISTINCT 'user:' || user_id AS stream_id, 1 + (user_id % 5) * 3 AS trim_before FROM events)"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(column):
    """Epoch milliseconds of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', {column})")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    stream = F.concat(F.lit("user:"), F.col("user_id").cast("string"))
    key = F.concat_ws(":", "event_type", F.get_json_object("props", "$.k"))
    seq = F.row_number().over(Window.partitionBy("stream_id").orderBy("ts", "event_id")).cast("long")  # by the key of all that follows: one exchange
    out = e.withColumn("stream_id", stream).select("stream_id", seq.alias("seq"), "event_type", key.alias("idempotency_key"), F.col("props").alias("payload"), millis("ts").alias("timestamp_ms"), "event_id", F.expr("event_id div 100").alias("segment_id"), "value")
    return out.withColumn("length", record_length().cast("long"))


def record_length():
    """Encoded size of a record: a header of 40 bytes and its four byte strings."""
    return F.lit(40) + F.octet_length("stream_id") + F.octet_length("event_type") + F.octet_length("idempotency_key") + F.octet_length("payload")


def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("user_id").distinct()
    return e.select(F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("stream_id"), (1 + (F.col("user_id") % 5) * 3).alias("trim_before"))
