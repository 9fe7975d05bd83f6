"""Reading and writing: cut lineage, content-addressed objects, reports, and latest-version upserts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one is set only where the session has none, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        spark.sparkContext.setCheckpointDir(found := "/tmp/checkpoints")
    return found


def cut(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, so that loops don't grow its plan and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/eventloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def objects(rows: DataFrame, namespace: str, content: str) -> DataFrame:
    """Content-addressed references: <namespace>/<sha256>.json, size and digest."""
    digest = F.sha2(F.col(content).cast("binary"), 256)
    return rows.withColumn("ref", F.concat(F.lit(f"{namespace}/"), digest, F.lit(".json"))).withColumn("size", F.octet_length(content).cast("long"))


def spilled(rows: DataFrame, content: str, most: int = 4096) -> DataFrame:
    """Contents of more than `most` bytes are replaced by a reference."""
    out = objects(rows, "results", content)
    big = F.col("size") > most
    return out.withColumn("inline", F.when(~big, F.col(content))).withColumn("ref", F.when(big, F.col("ref")))


def upserted(current: DataFrame, deltas: DataFrame, keys: list[str], version: str) -> DataFrame:
    """current with the newest version of each key of both; of equal versions a delta wins."""
    both = current.withColumn("_new", F.lit(0)).unionByName(deltas.withColumn("_new", F.lit(1)))
    rest = [c for c in current.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(version, "_new")).alias("_r")).select(*keys, "_r.*")


def statuses(spark: SparkSession, path: str) -> DataFrame:
    """Command results, one JSON object a line; a line that can't be read is a failed row with its text."""
    raw = spark.read.text(path).where("trim(value) <> ''")
    parsed = F.from_json("value", "name string, exit_code int, duration_sec double, log string, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    rows = raw.withColumn("r", parsed)
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull()
    return rows.select(F.when(bad, "invalid").otherwise(F.col("r.name")).alias("name"), F.when(bad, 1).otherwise(F.col("r.exit_code")).alias("exit_code"), "r.duration_sec", F.when(bad, F.col("value")).otherwise(F.col("r.log")).alias("log"))


def environment(spark: SparkSession, path: str) -> DataFrame:
    """key=value lines."""
    return spark.read.text(path).where("value like '%=%'").select(F.trim(F.substring_index("value", "=", 1)).alias("key"), F.trim(F.expr("substring(value, instr(value, '=') + 1)")).alias("value"))


def benchmarks(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark text lines: name, ns_per_op, bytes_per_op, allocs_per_op (0 where a line has none); a name that repeats keeps its last line."""
    take = lambda p: F.nullif(F.regexp_extract("value", p, 1), F.lit(""))
    rows = spark.read.text(path).where(r"value rlike '^Benchmark\\S+\\s+\\d+\\s+[0-9.]+ ns/op'")
    count = lambda p: F.coalesce(take(p).cast("long"), F.lit(0))
    lines = rows.select(F.regexp_extract("value", r"^(Benchmark\S+)\s", 1).alias("name"), F.monotonically_increasing_id().alias("no"), take(r"([0-9.]+) ns/op").cast("double").alias("ns_per_op"), count(r"(\d+) B/op").alias("bytes_per_op"), count(r"(\d+) allocs/op").alias("allocs_per_op"))
    return lines.groupBy("name").agg(F.max_by(F.struct("ns_per_op", "bytes_per_op", "allocs_per_op"), "no").alias("r")).select("name", "r.*")
