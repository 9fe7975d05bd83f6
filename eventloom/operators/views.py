"""Filters, pages, joins, indicators and rankings over state tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def search(rows: DataFrame, fields: list[str], q: str | None = None, **equal: str | None) -> DataFrame:
    """Rows whose columns equal the given values and whose fields, joined by spaces, hold q whatever its case."""
    for c, v in equal.items():
        v = v.strip().upper() if v and c == "status" else v
        if v:
            rows = rows.where(F.col(c) == v)
    return rows.where(F.lower(F.concat_ws(" ", *fields)).contains(q.lower())) if q else rows


def page(rows: DataFrame, order: list, offset: int = 0, limit: int = 50) -> DataFrame:
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("limit is 1 to 100, offset 0 or more")
    return rows.orderBy(*order).offset(offset).limit(limit)


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 * part / whole))).otherwise(F.lit(0.0))


def filled(primary: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """primary with empty or null fields taken from other."""
    o = other.select(F.col(key), *[F.col(c).alias(f"_{c}") for c in other.columns if c != key])
    have = [c for c in other.columns if c != key]
    rows = primary.join(o, key, "left")
    return rows.select(key, *[F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"_{c}")).alias(c) if c in have else F.col(c) for c in primary.columns if c != key])


def alive(workers: DataFrame, now_ms: int, age_ms: int) -> DataFrame:
    return workers.where(F.lit(now_ms) - F.col("heartbeat_ms") <= age_ms) if age_ms > 0 else workers


def expired(leases: DataFrame, now_ms: int, timeout_ms: int) -> DataFrame:
    return leases.where((F.col("status") == "RUNNING") & (F.col("updated_ms") != 0) & (F.lit(now_ms) - F.col("updated_ms") >= timeout_ms))


def locality_score(capacity: Column, running: Column, hit: Column, cold_penalty: Column) -> Column:
    return 100 * (capacity - running) - 10 * running + F.when(hit, 1000).otherwise(0) - F.when(cold_penalty, 1000).otherwise(0)


def predicted_ms(ewma: Column, cold: Column, cold_ms: Column, evictions: Column, running: Column, waited: Column) -> Column:
    return F.coalesce(ewma, F.lit(25)) + F.when(cold, F.coalesce(cold_ms, F.lit(100)) + 25 * evictions).otherwise(0) + 50 * running - F.when(cold & waited, 25).otherwise(0)


def best(rows: DataFrame, by: str, *order) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where("rank = 1").drop("rank")


def kept_by_recency(entries: DataFrame, group: str, size: str, used: str, capacity: int) -> DataFrame:
    """Entries of each group that a least-recently-used cache of a capacity holds; those larger than it never enter."""
    total = F.sum(size).over(Window.partitionBy(group).orderBy(F.desc(used), "entry").rowsBetween(Window.unboundedPreceding, 0))
    return entries.where(F.col(size) <= capacity).withColumn("used_bytes", total).where(F.col("used_bytes") <= capacity)


def as_of(left: DataFrame, right: DataFrame, key: str, order: str, values: list[str]) -> DataFrame:
    """left rows with the values of the key's last right row at or before them, by one window over both."""
    names = [c for c in left.columns if c not in (key, order)]
    both = left.select(key, order, F.lit(1).alias("_side"), *names, *[F.lit(None).alias(v) for v in values]).unionByName(right.select(key, order, F.lit(0).alias("_side"), *[F.lit(None).alias(c) for c in names], *values))
    w = Window.partitionBy(key).orderBy(order, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.select(key, order, "_side", *names, *[F.last(v, ignorenulls=True).over(w).alias(v) for v in values]).where("_side = 1").drop("_side")


def nearest_rank(column: str, p: int) -> Column:
    return F.coalesce(F.expr(f"percentile_disc({p / 100}) within group (order by {column})"), F.lit(0)).cast("long")


def regressions(before: DataFrame, after: DataFrame, key: str, value: str, most: float) -> DataFrame:
    rows = before.select(key, F.col(value).alias("baseline")).join(after.select(key, F.col(value).alias("current")), key).where("baseline > 0")
    return rows.withColumn("ratio", F.round(F.col("current") / F.col("baseline"), 4)).where(F.col("current") / F.col("baseline") > most)


def classified(payload: Column) -> Column:
    """json, text or base64: what a payload is shown as."""
    return F.when(F.try_parse_json(payload).isNotNull(), "json").when(F.is_valid_utf8(payload), "text").otherwise("base64")


def consistency(full: DataFrame, fast: DataFrame, key: str) -> DataFrame:
    """Keys whose rows differ, or that only one side has."""
    cols = [c for c in full.columns if c != key]
    a, b = full.select(key, F.struct(*cols).alias("_a")), fast.select(key, F.struct(*cols).alias("_b"))
    return a.join(b, key, "full").where(~F.col("_a").eqNullSafe(F.col("_b"))).select(key)
