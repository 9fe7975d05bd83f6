"""Projections, predicates and decodings of state rows, as consoles and gateways ask for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.schemas import KINDS, TERMINAL

# Numbers and names of statuses, aliases of policies, ranks of roles.
TASK_STATUS = {1: "QUEUED", 2: "RUNNING", 3: "SUCCEEDED", 4: "FAILED"}
POLICIES = ("LOCALITY_AWARE", "RESOURCE_ONLY", "PREDICTED_LATENCY")
ROLES = {"viewer": 1, "operator": 2, "admin": 3}


def by_id(rows: DataFrame, column: str, value: str) -> DataFrame:
    return rows.where(F.col(column) == value)


def by_key(rows: DataFrame, column: str, value: str) -> DataFrame:
    """Rows of an idempotency key; the empty key finds nothing."""
    return rows.where((F.col(column) == value) & (F.col(column) != ""))


def blank_as_null(column: Column) -> Column:
    return F.nullif(column, F.lit(""))


def instant(ms: str) -> Column:
    """A time from epoch milliseconds; 0 and less are none."""
    return F.expr(f"CASE WHEN {ms} > 0 THEN timestampadd(MILLISECOND, {ms}, timestamp_ntz'1970-01-01 00:00:00') END")


def dashboard(rows: DataFrame, hidden: tuple[str, ...] = ("result", "error")) -> DataFrame:
    """Rows without large fields; texts that are empty are null."""
    return rows.select(*[blank_as_null(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes if c not in hidden])


def decoded(code: Column, names: dict[int, str]) -> Column:
    out = F.lit("UNSPECIFIED")
    for k, v in names.items():
        out = F.when(code == k, v).otherwise(out)
    return out


def policy(text: Column) -> Column:
    """A policy's name from what a user wrote: any case, words joined by - _ or a space; nothing means the first; null if unknown."""
    name = F.upper(F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), "[-_ ]", "_"))
    return F.when(name == "", POLICIES[0]).when(name.isin(*POLICIES), name)


def allowed(actual: Column, required: Column) -> Column:
    rank = lambda c: F.coalesce(F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])[F.coalesce(c, F.lit(""))], F.lit(0))
    return rank(actual) >= rank(required)


def outcome(code: Column) -> Column:
    """The class of an HTTP status."""
    return F.when(code.between(200, 299), "ok").when(code == 403, "denied").when(code.between(400, 499), "rejected").when(code >= 500, "error").otherwise("unknown")


def terminal(status: Column) -> Column:
    return status.isin(*TERMINAL)


def kind(stream_id: Column) -> Column:
    """What a stream is about, by its prefix; '' for others."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])[F.split(stream_id, ":")[0]], F.lit(""))


def standalone(rows: DataFrame, derived: list[str], retry: bool = False) -> DataFrame:
    """Tasks that may be submitted again: those that no workflow, actor or model call made; for a retry, failed ones."""
    ok = F.lit(True)
    for c in derived:
        ok = ok & (F.coalesce(F.col(c).cast("string"), F.lit("")).isin("", "0"))
    return rows.where(ok & (F.col("status") == "FAILED") if retry else ok)


def page_with_total(rows: DataFrame, order: list, offset: int = 0, limit: int = 50) -> DataFrame:
    """A page, with total_count before paging and next_page_token where more rows follow."""
    from .views import page

    total = rows.count()
    token = F.lit(str(offset + limit)) if offset + limit < total else F.lit(None).cast("string")
    return page(rows, order, offset, limit).withColumn("total_count", F.lit(total).cast("bigint")).withColumn("next_page_token", token)


def recent(rows: DataFrame, time: str, key: str, n: int) -> DataFrame:
    return rows.orderBy(F.desc(time), F.desc(key)).limit(n)


def checked(required: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Each required check: passed, failed, or missing where there is no result."""
    state = F.when(F.col("ok").isNull(), "missing").when(F.col("ok"), "passed").otherwise("failed")
    return required.select(key).join(results.groupBy(key).agg(F.bool_and("ok").alias("ok")), key, "left").select(key, state.alias("state"))


def verdict(severity: Column) -> Column:
    """The worst of pass, warn and fail."""
    return F.element_at(F.array(F.lit("pass"), F.lit("warn"), F.lit("fail")), F.max(severity).cast("int") + 1)


def mode_ratio(rows: DataFrame, key: str, mode: str, value: str, base: str, other: str) -> DataFrame:
    """By key, the mean value of two modes and their ratio; null where either is missing or the first is 0."""
    of = lambda m: F.avg(F.when(F.col(mode) == m, F.col(value)))
    out = rows.groupBy(key).agg(of(base).alias("base"), of(other).alias("other"))
    return out.select(key, F.round("base", 4).alias("base"), F.round("other", 4).alias("other"), F.round(F.try_divide("other", "base"), 4).alias("ratio"))


def overlay(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the fields of new that say something; keys of either."""
    cols = [c for c in old.columns if c != key]
    n = new.select(key, *[F.col(c).alias(f"_{c}") for c in cols])
    return old.join(n, key, "full").select(key, *[F.coalesce(blank_as_null(F.col(f"_{c}")), F.col(c)).alias(c) for c in cols])


def fingerprint(fields: dict[str, Column]) -> Column:
    """A request's identity: the hash of its fields as JSON with keys in order."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"}), 256)


def canonical(payload: Column) -> Column:
    """A flat JSON object with its keys in order."""
    return F.map_from_entries(F.array_sort(F.map_entries(F.from_json(payload, "map<string,bigint>"))))


def registry(rows: DataFrame) -> DataFrame:
    """The newest entry of each function hash; entries without one are left out (see malformed)."""
    newest = Window.partitionBy("function_hash").orderBy(F.desc("timestamp_ms"), F.desc("source_ref"))
    return rows.where("coalesce(function_hash, '') <> ''").withColumn("n", F.row_number().over(newest)).where("n = 1").drop("n")


def malformed(rows: DataFrame) -> Column:
    return F.count_if(F.coalesce(F.col("function_hash"), F.lit("")) == "")
