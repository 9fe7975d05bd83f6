"""Runs the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from eventloom import catalog

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
HEADLINE = [
    "log_scan_range", "log_dedup_first_wins", "log_stream_stats", "log_segment_stats", "log_latest_per_key", "log_change_feed", "task_list_search_page", "task_status_kpis", "workflow_step_counters",
    "fold_task_state", "fold_actor_snapshot", "stats_ewma", "checkpoint_tail", "asof_snapshot", "wf_ready_steps", "placement_locality", "lru_keep_set", "materializer_coalesce", "bench_percentiles", "bench_policy_ablation",
]


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        for _ in range(2):  # the second run counts: code is compiled by then
            began = time.perf_counter()
            catalog.QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - began, 3)
    events = spark.read.parquet(f"{SF}/events.parquet").count()
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF.rsplit("sf", 1)[-1], "records_per_sec": {q: round(events / took[q]) for q in ("log_dedup_first_wins", "log_stream_stats", "fold_task_state", "fold_actor_snapshot", "stats_ewma")}}))
    spark.stop()


if __name__ == "__main__":
    main()
