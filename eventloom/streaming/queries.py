"""Stateful work over the log as a stream: dedup, incremental folds, upserts, windows.

State that must outlive a batch is a table of the newest generation in the shared folder; a batch that is run again writes
its generation again, so the result is the same.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.operators import folds
from eventloom.sources import tables


def stream(spark: SparkSession, folder: str, name: str, files: int = 1) -> DataFrame:
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").option("maxFilesPerTrigger", files).parquet(folder)


def state_of(rows: DataFrame, step: Callable[[DataFrame | None, DataFrame], DataFrame]) -> DataFrame:
    """The state after all batches that are available: step(state or None, batch) gives the next."""
    spark = rows.sparkSession
    root = f"{tables.shared_dir(spark).rstrip('/')}/eventloom-stream-{uuid.uuid4().hex}"
    newest: dict[str, str] = {}

    def apply(batch: DataFrame, number: int) -> None:
        before = spark.read.parquet(newest["path"]) if newest else None
        path = f"{root}/state/{number}"
        step(before, batch).write.mode("overwrite").parquet(path)
        newest["path"] = path

    q = rows.writeStream.foreachBatch(apply).option("checkpointLocation", f"{root}/offsets").trigger(availableNow=True).start()
    q.awaitTermination()
    if not newest:
        return step(None, spark.createDataFrame([], rows.schema))
    return spark.read.parquet(newest["path"])


def first_of_each(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Idempotent dedup without a horizon: each key's first row by order."""
    rest = [c for c in rows.columns if c not in keys]

    def step(before: DataFrame | None, batch: DataFrame) -> DataFrame:
        both = batch if before is None else before.unionByName(batch)
        return both.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")

    return state_of(rows, step)


def upserts(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The materializer: the newest version of each key."""
    return state_of(rows, lambda before, batch: tables.upserted(before if before is not None else batch.limit(0), batch, keys, version))


def task_states(events: Callable[[DataFrame], DataFrame], rows: DataFrame) -> DataFrame:
    """Task states, each batch's events folded into the states before it."""
    return state_of(rows, lambda before, batch: folds.folded(events(batch), "task_id", before))


def window_counts(rows: DataFrame, time: str, key: str, width: str, late: str) -> DataFrame:
    """Counts by tumbling window and key, with a watermark; complete output in memory of the sink table."""
    spark = rows.sparkSession
    root = f"{tables.shared_dir(spark).rstrip('/')}/eventloom-stream-{uuid.uuid4().hex}"
    counts = rows.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n"))
    out = counts.select(F.col("w.start").alias("start"), key, "n")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/{number}")

    q = out.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{root}/offsets").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.schema(out.schema).option("recursiveFileLookup", "true").parquet(f"{root}/out")
    return rows.groupBy("start", key).agg(F.max("n").alias("n"))
