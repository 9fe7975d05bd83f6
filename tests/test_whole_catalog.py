"""Queries over all rows of what others take a part of; their rows are compared to SQL with all queries."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from eventloom import catalog
from eventloom.operators import folds
from eventloom.streaming import queries

SF = "/root/testdata/sf0.001"


def test_every_workflow_is_validated_and_every_step_folded(spark):
    steps = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_linenumber").distinct()
    errors = catalog.QUERIES["dag_validate"](spark, SF)
    assert errors.count() == steps.select("l_orderkey").distinct().count()
    assert errors.where(F.col("errors").contains("unknown dependency")).count() > 0
    assert catalog.QUERIES["fold_workflow_steps"](spark, SF).count() == steps.count()


def test_every_model_gets_the_best_of_all_workers(spark):
    parts = spark.read.parquet(f"{SF}/part.parquet").select("p_partkey").collect()
    workers = [r.s_suppkey for r in spark.read.parquet(f"{SF}/supplier.parquet").select("s_suppkey").collect()]
    score = lambda m, w: (-(100 * (4 - w % 4) - 10 * (w % 4) + 1000 * ((m + w) % 5 == 0)), w)
    got = {r.model: r.worker_id for r in catalog.QUERIES["placement_locality"](spark, SF).collect()}
    assert got == {p.p_partkey: min(workers, key=lambda w: score(p.p_partkey, w)) for p in parts}


@pytest.mark.parametrize("name", ["placement_locality", "placement_predicted"])
def test_workers_are_ranked_by_remainders_of_models_not_by_model(spark, tmp_path, name):
    spark.createDataFrame([(k,) for k in (None, -7, -5, 0, 3, 3, 4, 2**40)], "p_partkey bigint").write.parquet(f"{tmp_path}/part.parquet")
    for i, keys in enumerate([[None, -3, -1, 6, 11, 14, 15, 22], [None], []]):
        spark.createDataFrame([(k,) for k in keys], "s_suppkey bigint").write.parquet(f"{tmp_path}/supplier-{i}.parquet")
        spark.read.parquet(f"{tmp_path}/supplier-{i}.parquet").write.mode("overwrite").parquet(f"{tmp_path}/supplier.parquet")
        duck = duckdb.connect()
        for t in ("part", "supplier"):
            duck.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
        got = catalog.QUERIES[name](spark, str(tmp_path))
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, duck.sql(catalog.ORACLE_SQL[name]).fetchall()))
    windows = [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window" in x]
    assert windows and not any("[model#" in x for x in windows)


def test_tasks_fold_alike_in_one_batch_and_over_several_files(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("user_id", "event_id", "event_type", "props")
    third = events.agg(F.max("event_id")).first()[0] // 3 + 1
    for i in range(3):
        part = tmp_path / f"part-{i}"
        events.where(F.expr(f"event_id div {third} = {i}")).coalesce(1).write.parquet(str(part))
        for f in part.glob("*.parquet"):
            os.utime(f, (1_000_000 + i, 1_000_000 + i))
    rows = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/part-*")
    got = queries.task_states(catalog.task_batch, rows)
    want = folds.folded(catalog.task_batch(events), "task_id")
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
    assert got.select("state.status").distinct().count() > 2
