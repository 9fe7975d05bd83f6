"""Queries over state rows: lookups, pages, decodings, leases, queues, actors, checkpoints and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import L, LR, NOW, STATS, STEPS, TASKS, query, step_rows, task_rows
from .operators import checkpoints, console, dag, log, scheduling, views
from .plans.log_view import log as log_of, millis, read, retention


def text(prefix, column):
    return F.concat(F.lit(prefix), column.cast("string"))


# Lookups, pages and projections.


@query(f"WITH {TASKS} SELECT task_id, status FROM tasks WHERE task_id = 'task-7'")
def task_lookup(spark, d):
    return console.by_id(task_rows(spark, d), "task_id", "task-7").select("task_id", "status")


@query(f"{L} SELECT stream_id, seq FROM log WHERE idempotency_key = 'click:5'")
def log_lookup_key(spark, d):
    rows = log_of(spark, d)
    return console.by_key(rows, "idempotency_key", "click:5").unionByName(console.by_key(rows, "idempotency_key", "")).select("stream_id", "seq")


@query(f"WITH {TASKS} SELECT task_id, task_name, nullif(CASE WHEN status = 'QUEUED' THEN '' ELSE worker_id END, '') AS worker_id, CASE WHEN created_ms > 0 THEN make_timestamp(created_ms * 1000) END AS created_at FROM tasks")
def dashboard_tasks(spark, d):
    rows = task_rows(spark, d).select("task_id", "task_name", F.when(F.col("status") == "QUEUED", "").otherwise(F.col("worker_id")).alias("worker_id"), console.instant("created_ms").alias("created_at"), F.lit("large").alias("result"), F.lit("").alias("error"))
    return console.dashboard(rows)


@query(f"{L} SELECT stream_id, seq FROM log WHERE contains(stream_id, ':1') AND event_type = 'error'")
def log_client_filter(spark, d):
    return log_of(spark, d).where(F.col("stream_id").contains(":1") & (F.col("event_type") == "error")).select("stream_id", "seq")


@query("SELECT event_id, CASE event_id % 6 WHEN 1 THEN 'QUEUED' WHEN 2 THEN 'RUNNING' WHEN 3 THEN 'SUCCEEDED' WHEN 4 THEN 'FAILED' ELSE 'UNSPECIFIED' END AS status, CASE event_type WHEN 'click' THEN 'LOCALITY_AWARE' WHEN 'signup' THEN 'LOCALITY_AWARE' WHEN 'view' THEN 'RESOURCE_ONLY' WHEN 'purchase' THEN 'PREDICTED_LATENCY' END AS policy FROM events")
def enum_decode(spark, d):
    wrote = F.create_map(*[F.lit(x) for x in ("click", " Locality-Aware ", "signup", "", "view", "resource_only", "purchase", "PREDICTED latency", "error", "fastest")])
    return read(spark, d, "events").select("event_id", console.decoded(F.col("event_id") % 6, console.TASK_STATUS).alias("status"), console.policy(wrote[F.col("event_type")]).alias("policy"))


@query(f"WITH {TASKS} SELECT status, status IN ('SUCCEEDED', 'FAILED') AS terminal, count(*) AS n FROM tasks GROUP BY ALL")
def task_terminal(spark, d):
    return task_rows(spark, d).groupBy("status", console.terminal(F.col("status")).alias("terminal")).agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n, event_type IN ('view', 'purchase') AS may_operate FROM events GROUP BY ALL")
def role_allows(spark, d):
    role = F.create_map(*[F.lit(x) for x in ("click", "viewer", "view", "operator", "purchase", "admin", "signup", "", "error", "guest")])
    may = console.allowed(role[F.col("event_type")], F.lit("operator"))
    return read(spark, d, "events").groupBy("event_type", may.alias("may_operate")).agg(F.count("*").alias("n"))


@query(f"WITH {TASKS} SELECT task_id FROM tasks WHERE status = 'SUCCEEDED' AND worker_id = 'worker-3'")
def task_retryable(spark, d):
    rows = task_rows(spark, d).withColumn("status", F.when(F.col("status") == "SUCCEEDED", "FAILED").otherwise(F.col("status")))
    rows = rows.withColumn("actor_id", F.when(F.col("worker_id") != "worker-3", F.col("worker_id"))).withColumn("llm_max_tokens", F.lit(0))
    return console.standalone(rows, ["actor_id", "llm_max_tokens"], retry=True).select("task_id")


CODES = (200, 204, 403, 404, 429, 500, 101)


@query("SELECT CASE event_id % 7 WHEN 0 THEN 'ok' WHEN 1 THEN 'ok' WHEN 2 THEN 'denied' WHEN 3 THEN 'rejected' WHEN 4 THEN 'rejected' WHEN 5 THEN 'error' ELSE 'unknown' END AS outcome, count(*) AS n FROM events GROUP BY ALL")
def audit_outcomes(spark, d):
    code = F.element_at(F.array(*map(F.lit, CODES)), (F.col("event_id") % 7 + 1).cast("int"))
    return read(spark, d, "events").groupBy(console.outcome(code).alias("outcome")).agg(F.count("*").alias("n"))


KIND_SQL = "CASE event_id % 5 WHEN 0 THEN 'task' WHEN 1 THEN 'workflow' WHEN 2 THEN 'actor' WHEN 3 THEN 'llm' ELSE '' END"


@query(f"SELECT {KIND_SQL} AS kind, count(*) AS n FROM events GROUP BY ALL")
def stream_kinds(spark, d):
    prefix = F.element_at(F.array(*map(F.lit, ("task:", "wf:", "actor:", "llm:", "system:"))), (F.col("event_id") % 5 + 1).cast("int"))
    return read(spark, d, "events").groupBy(console.kind(F.concat(prefix, F.col("user_id").cast("string"))).alias("kind")).agg(F.count("*").alias("n"))


KEYSET = """p AS (SELECT stream_id, count(*) AS records, max(seq) AS last FROM (SELECT stream_id, seq, row_number() OVER (PARTITION BY stream_id ORDER BY seq) AS n FROM log JOIN retention USING (stream_id) WHERE seq >= trim_before AND seq >= 5) WHERE n <= 10 GROUP BY ALL),
  k AS (SELECT stream_id, coalesce(records, 0) AS records, next_seq AS fin, CASE WHEN last IS NULL AND 5 < first_seq AND 5 < next_seq THEN first_seq ELSE coalesce(last + 1, 5) END AS next_seq FROM stats LEFT JOIN p USING (stream_id))"""


@query(f"{LR}, {STATS}, {KEYSET} SELECT stream_id, records, next_seq, next_seq < fin AS has_more FROM k")
def log_keyset_page(spark, d):
    return log.keyset(log_of(spark, d), retention(spark, d), 5, 10)


@query(f"WITH {TASKS}, r AS (SELECT * FROM tasks WHERE status = 'RUNNING') SELECT task_id, created_ms, (SELECT count(*) FROM r) AS total_count, CASE WHEN (SELECT count(*) FROM r) > 60 THEN '60' END AS next_page_token FROM r ORDER BY created_ms, task_id LIMIT 20 OFFSET 40")
def task_page_total(spark, d):
    rows = views.search(task_rows(spark, d), [], status=" running ")
    return console.page_with_total(rows, ["created_ms", "task_id"], 40, 20).select("task_id", "created_ms", "total_count", "next_page_token")


@query(f"WITH {TASKS} SELECT task_id, created_ms FROM tasks ORDER BY created_ms DESC, task_id DESC LIMIT 10")
def overview_recent(spark, d):
    return console.recent(task_rows(spark, d), "created_ms", "task_id", 10).select("task_id", "created_ms")


@query(f"{LR}, {STATS} SELECT stream_id, first_seq, next_seq FROM (SELECT DISTINCT stream_id FROM log WHERE starts_with(stream_id, 'user:1')) LEFT JOIN stats USING (stream_id)")
def log_streams_with_stats(spark, d):
    rows = log_of(spark, d)
    return log.streams(rows, "user:1").join(log.stream_stats(rows, retention(spark, d)), "stream_id", "left").select("stream_id", "first_seq", "next_seq")


@query(f"{L}, c AS (SELECT stream_id, max(seq) + 1 AS hwm FROM log WHERE event_id < 500 GROUP BY ALL) SELECT stream_id, seq FROM log JOIN c USING (stream_id) WHERE seq < hwm")
def log_snapshot_scan(spark, d):
    rows = log_of(spark, d)
    ends = rows.where("event_id < 500").groupBy("stream_id").agg((F.max("seq") + 1).alias("next_seq"))
    return checkpoints.snapshot_scan(rows, ends).select("stream_id", "seq")


@query(f"{L} SELECT sha256('{{\"args_json\":{{\"k\":' || CAST(json_extract_string(payload, '$.k') AS BIGINT) || '}},\"function_name\":\"' || event_type || '\",\"timeout_ms\":0}}') AS fingerprint, count(*) AS n FROM log GROUP BY ALL")
def request_fingerprints(spark, d):
    rows = log_of(spark, d)
    return rows.groupBy(console.fingerprint({"timeout_ms": F.lit(0), "function_name": F.col("event_type"), "args_json": console.canonical(F.col("payload"))}).alias("fingerprint")).agg(F.count("*").alias("n"))


REGISTRY = "f AS (SELECT CASE WHEN CAST(json_extract_string(payload, '$.k') AS BIGINT) % 10 = 0 THEN '' ELSE sha256(payload) END AS function_hash, stream_id || ':' || seq AS source_ref, timestamp_ms FROM log)"


def registered(spark, d):
    blank = F.get_json_object("payload", "$.k").cast("long") % 10 == 0
    return log_of(spark, d).select(F.when(blank, "").otherwise(F.sha2(F.col("payload").cast("binary"), 256)).alias("function_hash"), F.concat_ws(":", "stream_id", "seq").alias("source_ref"), "timestamp_ms")


@query(f"{L}, {REGISTRY} SELECT function_hash, max(timestamp_ms) AS timestamp_ms, max_by(source_ref, (timestamp_ms, source_ref)) AS source_ref FROM f WHERE function_hash <> '' GROUP BY ALL")
def function_registry(spark, d):
    return console.registry(registered(spark, d)).orderBy(F.desc("timestamp_ms"), "function_hash").select("function_hash", "timestamp_ms", "source_ref")


@query(f"{L}, {REGISTRY} SELECT count(*) FILTER (function_hash = '') AS malformed, count(*) AS entries FROM f")
def function_registry_malformed(spark, d):
    rows = registered(spark, d)
    return rows.agg(console.malformed(rows).alias("malformed"), F.count("*").alias("entries"))


@query("SELECT c_custkey, coalesce(nullif(CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '' END, ''), c_name) AS name, coalesce(CASE WHEN c_custkey % 3 = 0 THEN 'x' END, c_mktsegment) AS segment FROM customer")
def overlay_merge(spark, d):
    c = read(spark, d, "customer")
    old = c.select("c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    new = c.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise("").alias("name"), F.when(F.col("c_custkey") % 3 == 0, "x").alias("segment"))
    return console.overlay(old, new, "c_custkey")


# Leases, queues, workers.


@query(f"WITH {TASKS} SELECT task_id, 'TaskRedelivered' AS event_type, 1 AS epoch, created_ms + 100000000 AS deadline_ms FROM tasks WHERE status = 'RUNNING' AND created_ms <> 0 AND created_ms + 100000000 <= {NOW}")
def lease_redelivery(spark, d):
    rows = task_rows(spark, d).select("task_id", "status", F.col("created_ms").alias("updated_ms"), F.lit(1).alias("epoch"))
    return scheduling.redeliveries(rows, NOW, 100_000_000)


@query(f"{L} SELECT stream_id, seq, CAST(count(*) FILTER (event_type IN ('view', 'click')) OVER w AS BIGINT) AS lease_epoch, CAST(count(*) FILTER (event_type = 'signup') OVER w AS BIGINT) AS ownership_epoch FROM log WINDOW w AS (PARTITION BY stream_id ORDER BY seq)")
def lease_epochs(spark, d):
    return scheduling.lease_epochs(log_of(spark, d), "stream_id", F.col("event_type").isin("view", "click"), F.col("event_type") == "signup")


@query("SELECT s_suppkey, s_suppkey % 4 < greatest(s_suppkey % 3, 1) AS free FROM supplier")
def worker_capacity(spark, d):
    k = F.col("s_suppkey")
    return read(spark, d, "supplier").select("s_suppkey", scheduling.has_capacity(k % 4, k % 3).alias("free"))


@query(
    """SELECT o_orderkey, s_suppkey, (o_orderkey % 4 = 0 OR o_orderkey % 3 <> 0 OR 1 + o_orderkey % 10 = s_suppkey)
    AND (o_orderkey % 2 = 0 OR (s_suppkey % 4 < greatest(s_suppkey % 3, 1) AND (o_orderkey % 5 <> 0 OR 1 + o_orderkey % 7 = s_suppkey))) AS eligible FROM orders JOIN supplier ON s_suppkey = 1 + o_custkey % 10"""
)
def worker_eligibility(spark, d):
    o, s = read(spark, d, "orders"), read(spark, d, "supplier")
    k, w = F.col("o_orderkey"), F.col("s_suppkey")
    rows = o.join(s, w == 1 + F.col("o_custkey") % 10)
    ok = scheduling.eligible(F.when(k % 3 == 0, 1 + k % 10), F.when(k % 4 == 0, "actor"), F.when(k % 2 == 1, "model"), w, scheduling.has_capacity(w % 4, w % 3), F.when(k % 5 == 0, 1 + k % 7))
    return rows.select("o_orderkey", "s_suppkey", ok.alias("eligible"))


QUEUE = """q AS (SELECT o_orderkey AS task_id, epoch_ms(o_orderdate) AS enqueued_ms, least(o_orderkey % 5, 3) AS priority, CASE WHEN o_orderkey % 5 < 3 THEN 1 + o_custkey % 10 END AS worker_id FROM orders WHERE o_orderkey % 5 <> 1 OR o_orderkey % 2 = 0),
  f AS (SELECT priority, worker_id, arg_min(task_id, (enqueued_ms, task_id)) AS task_id FROM q GROUP BY ALL)"""


@query(f"WITH {QUEUE} SELECT s_suppkey AS worker_id, coalesce((SELECT arg_min(task_id, priority) FROM f WHERE f.worker_id = s_suppkey), (SELECT task_id FROM f WHERE worker_id IS NULL)) AS task_id, coalesce((SELECT min(priority) FROM f WHERE f.worker_id = s_suppkey), 3) AS priority FROM supplier")
def assign_next(spark, d):
    o = read(spark, d, "orders").where("o_orderkey % 5 <> 1 or o_orderkey % 2 = 0")  # an actor's command waits until it is the next one
    kind = F.col("o_orderkey") % 5
    queue = o.select(F.col("o_orderkey").alias("task_id"), millis("o_orderdate").alias("enqueued_ms"), F.least(kind, F.lit(3)).alias("priority"), F.when(kind < 3, 1 + F.col("o_custkey") % 10).alias("worker_id"))
    return scheduling.assigned(queue, read(spark, d, "supplier").select(F.col("s_suppkey").alias("worker_id")))


@query("SELECT p_size % 7 AS worker_id, p_partkey AS model, 'v1' AS version, row_number() OVER (PARTITION BY p_size % 7 ORDER BY 1000 - p_partkey % 500, p_partkey) AS rank FROM part WHERE p_partkey % 3 = 0 OR NOT (p_partkey % 2 = 0 AND p_partkey % 500 < 250)")
def model_queue_order(spark, d):
    k = F.col("p_partkey")
    waiting = read(spark, d, "part").select((F.col("p_size") % 7).alias("worker_id"), k.alias("model"), F.lit("v1").alias("version"), (1000 - k % 500).alias("front_ms"), (k % 3 == 0).alias("cached"), (k % 2 == 0).alias("held_by_free"))
    return scheduling.model_queue(waiting, 1000)


@query(f"WITH {TASKS} SELECT task_name, count(*) AS depth, max({NOW} - created_ms) AS oldest_wait_ms FROM tasks WHERE status = 'QUEUED' GROUP BY ALL")
def queue_depth(spark, d):
    return task_rows(spark, d).where("status = 'QUEUED'").groupBy("task_name").agg(F.count("*").alias("depth"), F.max(F.lit(NOW) - F.col("created_ms")).alias("oldest_wait_ms"))


@query(f"{L} SELECT stream_id, CAST(greatest(0, sum(CASE WHEN event_type IN ('view', 'click') THEN 1 WHEN event_type = 'purchase' THEN -1 ELSE 0 END)) AS BIGINT) AS running FROM log GROUP BY ALL")
def worker_running(spark, d):
    return scheduling.running(log_of(spark, d), "stream_id", F.col("event_type").isin("view", "click"), F.col("event_type") == "purchase")


@query("SELECT s_suppkey AS worker_id, 'm' || (s_suppkey % 3) AS model FROM supplier UNION ALL SELECT s_suppkey, 'n' || (s_suppkey % 4) FROM supplier WHERE s_suppkey % 2 = 0")
def worker_cached_models(spark, d):
    k = F.col("s_suppkey")
    held = F.create_map(text("m", k % 3), F.lit(True), text("n", k % 4), k % 2 == 0)
    return read(spark, d, "supplier").select(k.alias("worker_id"), F.explode(held).alias("model", "held")).where("held").select("worker_id", "model")


@query(f"{L} SELECT stream_id, seq, CASE WHEN row_number() OVER (PARTITION BY stream_id, idempotency_key ORDER BY seq) > 1 THEN '' WHEN floor(value) >= 90 THEN 'slow log' WHEN seq >= 15 THEN 'backlog' ELSE '' END AS rejected FROM log")
def backpressure(spark, d):
    rows = log_of(spark, d)
    first = log.dedup_first(rows).select("stream_id", "seq", F.lit(False).alias("duplicate"))
    asked = rows.join(first, ["stream_id", "seq"], "left").select("stream_id", "seq", F.coalesce("duplicate", F.lit(True)).alias("duplicate"), F.floor("value").alias("append_ms"), F.col("seq").alias("backlog"))
    return scheduling.backpressure(asked, 90, 15).select("stream_id", "seq", "rejected")


# Actors and checkpoints.


@query(f"{L}, c AS (SELECT stream_id AS actor_id, seq, event_id % 5 <> 0 AS fresh, seq - CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END AS n FROM log), r AS (SELECT actor_id, count(*) AS k, count(*) FILTER (NOT fresh) AS stale, list_reduce(list_prepend(CAST(0 AS BIGINT), coalesce(list(n ORDER BY seq) FILTER (fresh), [])), lambda a, x: CASE WHEN x = a + 1 THEN x ELSE a END) AS applied FROM c GROUP BY ALL) SELECT actor_id, applied, stale, k - stale - applied AS out_of_order FROM r")
def actor_commands_in_order(spark, d):
    e = F.col("event_id")
    rows = log_of(spark, d).select(F.col("stream_id").alias("actor_id"), "seq", (F.col("seq") - F.when(e % 11 == 0, 1).otherwise(0)).alias("command_seq"), F.when(e % 10 == 0, "late").otherwise("w1").alias("worker_id"), F.when(e % 10 == 5, 1).otherwise(2).alias("epoch"), F.lit("w1").alias("owner"), F.lit(2).alias("owner_epoch"))
    return scheduling.in_order(rows)


@query(f"{L}, a AS (SELECT stream_id AS actor_id, seq, row_number() OVER (PARTITION BY stream_id ORDER BY seq) AS n FROM log WHERE event_type IN ('click', 'view')) SELECT actor_id, count(*) AS commands, count(*) FILTER (n % 5 = 0) AS snapshots, max(seq) FILTER (n % 5 = 0) AS trim_before FROM a GROUP BY ALL")
def actor_snapshot_plan(spark, d):
    return scheduling.snapshot_plan(log_of(spark, d).where("event_type in ('click', 'view')").withColumnRenamed("stream_id", "actor_id"), 5)


@query(f"{L} SELECT stream_id AS actor_id, min('w' || (event_id % 13)) AS owner FROM log GROUP BY ALL")
def actor_owner_lowest(spark, d):
    return scheduling.owners(log_of(spark, d).select(F.col("stream_id").alias("actor_id"), text("w", F.col("event_id") % 13).alias("worker_id")))


SOUND = "CAST(json_extract_string(payload, '$.k') AS BIGINT) % 4 <> 0"


@query(f"{L}, c AS (SELECT *, {SOUND} AS sound FROM log WHERE event_type = 'purchase') SELECT stream_id, arg_max(payload, (timestamp_ms, seq)) FILTER (sound) AS payload, arg_max(seq, (timestamp_ms, seq)) FILTER (sound) AS seq, count(*) FILTER (NOT sound) AS skipped FROM c GROUP BY ALL")
def checkpoint_newest(spark, d):
    sound = F.get_json_object("payload", "$.k").cast("long") % 4 != 0
    return checkpoints.newest(log_of(spark, d).where("event_type = 'purchase'"), "stream_id", sound)


@query(f"{L} SELECT stream_id, seq FROM log WHERE event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY stream_id ORDER BY seq DESC) <= 3")
def checkpoint_retained(spark, d):
    return checkpoints.retained(log_of(spark, d).where("event_type = 'purchase'"), "stream_id").select("stream_id", "seq")


@query(f"{L} SELECT stream_id, count(*) FILTER (seq > 10) AS pending, max(timestamp_ms) - max(timestamp_ms) FILTER (seq <= 10) AS lag_ms FROM log GROUP BY ALL")
def materializer_gauges(spark, d):
    return scheduling.gauges(log_of(spark, d), "stream_id", F.col("seq") <= 10)


@query(f"{L}, m AS (SELECT event_type || ':v' || (event_id % 2) AS model, event_id < 300 AS before FROM log) SELECT DISTINCT model FROM m WHERE before UNION SELECT 'late:v1'")
def affected_models(spark, d):
    rows = log_of(spark, d).where("event_id < 300")
    models = rows.select(F.concat(F.col("event_type"), F.lit(":v"), (F.col("event_id") % 2).cast("string")).alias("model"))
    return models.union(spark.range(1).select(F.lit("late:v1"))).distinct()


# Graphs.


@query(f"WITH RECURSIVE {STEPS}, walk AS (SELECT workflow_id, step_id, 0 AS depth FROM steps UNION SELECT k.workflow_id, k.step_id, w.depth + 1 FROM walk w JOIN known k ON k.workflow_id = w.workflow_id AND k.depends_on = w.step_id), lv AS (SELECT workflow_id, step_id, max(depth) AS depth FROM walk GROUP BY ALL) SELECT workflow_id, step_id, row_number() OVER (PARTITION BY workflow_id ORDER BY depth, step_id) AS position, 3 AS max_attempts, 30000 AS timeout_ms FROM lv")
def dag_normalised(spark, d):
    return dag.normalised(step_rows(spark, d))


@query(f"WITH RECURSIVE {STEPS}, walk AS (SELECT workflow_id, step_id, 0 AS depth FROM steps UNION SELECT k.workflow_id, k.step_id, w.depth + 1 FROM walk w JOIN known k ON k.workflow_id = w.workflow_id AND k.depends_on = w.step_id), lv AS (SELECT workflow_id, step_id, max(depth) AS depth FROM walk GROUP BY ALL) SELECT e.workflow_id, e.step_id, e.depends_on, t.depth AS to_depth, f.depth AS from_depth FROM edge e JOIN lv t ON t.workflow_id = e.workflow_id AND t.step_id = e.step_id JOIN lv f ON f.workflow_id = e.workflow_id AND f.step_id = e.depends_on")
def dag_layout(spark, d):
    return dag.layout(step_rows(spark, d))


@query(f"WITH {STEPS}, st AS (SELECT l_orderkey AS workflow_id, l_linenumber AS step_id, max(l_linestatus) = 'F' AS won FROM lineitem GROUP BY ALL), r AS (SELECT workflow_id, step_id FROM st WHERE NOT won AND NOT EXISTS (SELECT 1 FROM edge e WHERE e.workflow_id = st.workflow_id AND e.step_id = st.step_id AND NOT EXISTS (SELECT 1 FROM st w WHERE w.won AND w.workflow_id = e.workflow_id AND w.step_id = e.depends_on))) SELECT DISTINCT r.workflow_id, r.step_id FROM r JOIN edge e USING (workflow_id, step_id) JOIN st ON st.workflow_id = e.workflow_id AND st.step_id = e.depends_on AND st.won AND st.step_id = 1")
def dag_unlocked(spark, d):
    won = F.max("l_linestatus") == "F"
    states = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("workflow_id"), F.col("l_linenumber").alias("step_id")).agg(F.when(won, "SUCCEEDED").otherwise("SCHEDULED").alias("status"))
    return dag.unlocked(step_rows(spark, d), states, (F.col("status") == "SUCCEEDED") & (F.col("step_id") == 1))


# Reports.


@query("SELECT event_type, CAST(trunc(median(value)) AS INT) AS median FROM events GROUP BY ALL")
def bench_median(spark, d):
    return read(spark, d, "events").groupBy("event_type").agg(F.median("value").cast("int").alias("median"))


@query(f"{L} SELECT event_type AS policy, count(*) AS records, max(timestamp_ms) - min(timestamp_ms) AS elapsed_ms, count(DISTINCT segment_id) AS segments, round(count(*) * 1000.0 / (max(timestamp_ms) - min(timestamp_ms)), 6) AS records_per_sec FROM log GROUP BY ALL")
def bench_fsync_table(spark, d):
    span = F.max("timestamp_ms") - F.min("timestamp_ms")
    return log_of(spark, d).groupBy(F.col("event_type").alias("policy")).agg(F.count("*").alias("records"), span.alias("elapsed_ms"), F.count_distinct("segment_id").alias("segments"), F.round(F.try_divide(F.count("*") * F.lit(1000.0), span), 6).alias("records_per_sec"))


@query(f"{L} SELECT CAST(sum(length) AS BIGINT) AS full_bytes, CAST(sum(length) FILTER (seq > 20) AS BIGINT) AS tail_bytes, round(1 - sum(length) FILTER (seq > 20) / sum(length), 4) AS reduction FROM log")
def payload_reduction(spark, d):
    tail = F.sum(F.when(F.col("seq") > 20, F.col("length")))
    return log_of(spark, d).agg(F.sum("length").alias("full_bytes"), tail.alias("tail_bytes"), F.round(1 - F.try_divide(tail, F.sum("length")), 4).alias("reduction"))


@query("SELECT s_nationkey, count(*) FILTER (s_acctbal >= 0) AS passed, count(*) FILTER (s_acctbal < 0) AS failed, coalesce(string_agg(s_name, ',' ORDER BY s_name) FILTER (s_acctbal < 0), '') AS failures FROM supplier GROUP BY ALL")
def command_results(spark, d):
    bad = F.col("s_acctbal") < 0
    return read(spark, d, "supplier").groupBy("s_nationkey").agg(F.count_if(~bad).alias("passed"), F.count_if(bad).alias("failed"), F.array_join(F.array_sort(F.collect_list(F.when(bad, F.col("s_name")))), ",").alias("failures"))


@query("SELECT n_nationkey, CASE WHEN ok IS NULL THEN 'missing' WHEN ok THEN 'passed' ELSE 'failed' END AS state FROM nation LEFT JOIN (SELECT s_nationkey AS n_nationkey, bool_and(s_acctbal > 0) AS ok FROM supplier GROUP BY ALL) USING (n_nationkey)")
def acceptance_checks(spark, d):
    results = read(spark, d, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), (F.col("s_acctbal") > 0).alias("ok"))
    return console.checked(read(spark, d, "nation"), results, "n_nationkey")


@query("SELECT o_orderpriority, round(avg(o_custkey) FILTER (o_orderstatus = 'F'), 4) AS base, round(avg(o_custkey) FILTER (o_orderstatus = 'O'), 4) AS other, round(avg(o_custkey) FILTER (o_orderstatus = 'O') / avg(o_custkey) FILTER (o_orderstatus = 'F'), 4) AS ratio FROM orders GROUP BY ALL")
def bench_mode_ratio(spark, d):
    return console.mode_ratio(read(spark, d, "orders"), "o_orderpriority", "o_orderstatus", "o_custkey", "F", "O")


@query("SELECT l_orderkey, CASE max(CASE WHEN l_returnflag = 'R' THEN 2 WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) WHEN 2 THEN 'fail' WHEN 1 THEN 'warn' ELSE 'pass' END AS verdict FROM lineitem GROUP BY ALL")
def acceptance_verdict(spark, d):
    severity = F.when(F.col("l_returnflag") == "R", 2).when(F.col("l_linestatus") == "O", 1).otherwise(0)
    return read(spark, d, "lineitem").groupBy("l_orderkey").agg(console.verdict(severity).alias("verdict"))


@query("SELECT DISTINCT 'wf-' || l_orderkey AS workflow_id, 'SCHEDULED' AS status FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber < 3")
def workflow_list_status(spark, d):
    rows = read(spark, d, "lineitem").select(text("wf-", F.col("l_orderkey")).alias("workflow_id"), F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") < 3), "SCHEDULED").otherwise("DONE").alias("status"))
    return views.search(rows, [], status="scheduled").distinct()
