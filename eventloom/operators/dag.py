"""Workflow graphs: edges, validation, levels, order and readiness, for all workflows at once."""

from __future__ import annotations

from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions import graphs
from eventloom.sources.tables import cut


def edges(steps: DataFrame) -> DataFrame:
    """workflow_id, step_id, depends_on: a row for each dependency."""
    return steps.select("workflow_id", "step_id", F.explode("depends_on").alias("depends_on"))


def walked(steps: DataFrame, make, columns: list[str], results: DataFrame | None = None, large: int = graphs.LARGE) -> tuple[DataFrame, DataFrame | None]:
    """What make gives for each workflow, dealt once by workflow; and the workflow_id of those that are too large for a task, if any."""
    rows = steps.select("workflow_id", F.concat(F.array("step_id"), F.coalesce("depends_on", F.array())).alias("ids"), F.lit(False).alias("result"))
    if results is not None:
        rows = rows.unionByName(results.select("workflow_id", F.array("result_step_id").alias("ids"), F.lit(True).alias("result")))
    types = {"to_depth": pa.int32(), "from_depth": pa.int32(), "depth": pa.int32(), "errors": pa.string()}
    key, item = rows.schema["workflow_id"].dataType.simpleString(), rows.schema["ids"].dataType.elementType.simpleString()
    spark_type = lambda c: key if c == "workflow_id" else "string" if c == "errors" else "int" if c in types else item
    schema = ", ".join([*[f"{c} {spark_type(c)}" for c in columns], "large boolean"])
    sorted_ = rows.repartition("workflow_id").sortWithinPartitions("workflow_id")
    out = cut(sorted_.mapInArrow(partial(graphs.walked, make=make, columns=columns, types=types, large=large), schema))
    big = out.where("large").select("workflow_id").distinct()
    was = {c: steps.schema["step_id"].dataType if c == "step_id" else steps.schema["depends_on"].dataType.elementType for c in ("step_id", "depends_on")}
    rest = out.where("not large").select(*[F.col(c).cast(was[c]) if c in was else c for c in columns])
    return rest, None if big.isEmpty() else big


def of(rows: DataFrame, big: DataFrame) -> DataFrame:
    """Rows of some workflows, whose ids can be null."""
    return rows.join(F.broadcast(big.withColumnRenamed("workflow_id", "_w")), F.col("workflow_id").eqNullSafe(F.col("_w")), "left_semi")


def levels(steps: DataFrame, large: int = graphs.LARGE) -> DataFrame:
    """depth of each step: 0 without known dependencies, else one more than its deepest; steps on or behind a cycle have null."""
    out, big = walked(steps, graphs.levels, ["workflow_id", "step_id", "depth"], large=large)
    return out if big is None else out.unionByName(levels_by_rounds(of(steps, big)))


def levels_by_rounds(steps: DataFrame) -> DataFrame:
    """levels of workflows that no task could hold: one more depth a round, by joins. Ids are structs, so that null is a step's id but no known dependency."""
    key = ["w", "s"]
    ids = steps.select(F.struct("workflow_id").alias("w"), F.struct("step_id").alias("s"), "depends_on")
    on = ids.select("w", "s", F.explode("depends_on").alias("p")).where("p is not null and w.workflow_id is not null").select("w", "s", F.struct(F.col("p").alias("step_id")).alias("p"))
    links = cut(on.join(ids.select("w", F.col("s").alias("p")), ["w", "p"], "left_semi").distinct())
    done, depth = cut(ids.select(*key).distinct().join(links, key, "left_anti").withColumn("depth", F.lit(0))), 0
    while True:
        depth += 1
        open_ = links.join(done.select("w", F.col("s").alias("p"), F.lit(1).alias("d")), ["w", "p"], "left").groupBy(*key).agg(F.count("*").alias("n"), F.count("d").alias("k"))
        new = cut(open_.where("n = k").join(done, key, "left_anti").select(*key, F.lit(depth).alias("depth")))
        if new.isEmpty():
            break
        done = done.unionByName(new)
    return ids.select(*key).join(done, key, "left").select("w.workflow_id", "s.step_id", "depth")


def validated(steps: DataFrame, results: DataFrame, large: int = graphs.LARGE) -> DataFrame:
    """Errors of each workflow of results (workflow_id, result_step_id), sorted; none for a sound one."""
    out, big = walked(steps, graphs.errors, ["workflow_id", "errors"], results, large)
    return out if big is None else out.unionByName(validated_by_joins(of(steps, big), of(results, big)))


def validated_by_joins(steps: DataFrame, results: DataFrame) -> DataFrame:
    cyclic = levels_by_rounds(steps).where("depth is null").select(F.struct("workflow_id").alias("w")).distinct().withColumn("cyclic", F.lit(True))
    steps, results = steps.withColumn("w", F.struct("workflow_id")), results.withColumn("w", F.struct("workflow_id"))
    n = steps.groupBy("w").agg(F.count("*").alias("n"), F.count_distinct("step_id").alias("ids"), F.count_if(F.coalesce(F.col("step_id").cast("string"), F.lit("")) == "").alias("blank"))
    on = steps.where("workflow_id is not null").select("w", F.explode("depends_on").alias("p"))
    unknown = on.join(steps.select("w", F.col("step_id").alias("p")), ["w", "p"], "left_anti").select("w").distinct().withColumn("unknown", F.lit(True))
    have = steps.select("w", F.col("step_id").alias("result_step_id"), F.lit(True).alias("have")).distinct()
    rows = results.join(have, ["w", "result_step_id"], "left").join(n, "w", "left").join(unknown, "w", "left").join(cyclic, "w", "left")
    errors = F.array_compact(F.array(F.when(F.coalesce("n", F.lit(0)) == 0, "empty"), F.when(F.col("blank") > 0, "blank step"), F.when(F.col("ids") < F.col("n"), "duplicate step"), F.when(F.col("unknown"), "unknown dependency"), F.when(F.col("cyclic"), "cycle"), F.when(F.col("have").isNull(), "missing result step")))
    return rows.select("workflow_id", F.array_join(F.array_sort(errors), ",").alias("errors"))


def ready(steps: DataFrame, states: DataFrame) -> DataFrame:
    """Scheduled steps all of whose dependencies have succeeded."""
    won = states.where("status = 'SUCCEEDED'").select("workflow_id", F.col("step_id").alias("depends_on"))
    blocked = edges(steps).join(won, ["workflow_id", "depends_on"], "left_anti").select("workflow_id", "step_id").distinct()
    return states.where("status = 'SCHEDULED'").select("workflow_id", "step_id").join(blocked, ["workflow_id", "step_id"], "left_anti")


def normalised(steps: DataFrame, attempts: int = 3, timeout_ms: int = 30_000) -> DataFrame:
    """Steps in an order in which each follows what it depends on, with defaults where they have none."""
    place = F.row_number().over(Window.partitionBy("workflow_id").orderBy("depth", "step_id"))
    have = set(steps.columns)
    value = lambda c, d: F.coalesce(F.nullif(F.col(c), F.lit(0)), F.lit(d)) if c in have else F.lit(d)
    extra = steps.select("workflow_id", "step_id", value("max_attempts", attempts).alias("max_attempts"), value("timeout_ms", timeout_ms).alias("timeout_ms"))
    return levels(steps).join(extra, ["workflow_id", "step_id"]).select("workflow_id", "step_id", place.alias("position"), "max_attempts", "timeout_ms")


def layout(steps: DataFrame, large: int = graphs.LARGE) -> DataFrame:
    """Each edge between known steps with the depths of its ends."""
    out, big = walked(steps, graphs.layout, ["workflow_id", "depends_on", "step_id", "to_depth", "from_depth"], large=large)
    return out if big is None else out.unionByName(layout_by_joins(of(steps, big)))


def layout_by_joins(steps: DataFrame) -> DataFrame:
    depth = cut(levels_by_rounds(steps))
    to = edges(steps).join(depth.withColumnRenamed("depth", "to_depth"), ["workflow_id", "step_id"])
    return to.join(depth.select("workflow_id", F.col("step_id").alias("depends_on"), F.col("depth").alias("from_depth")), ["workflow_id", "depends_on"])


def unlocked(steps: DataFrame, states: DataFrame, done) -> DataFrame:
    """Steps that the success of the steps where `done` holds made ready, once each."""
    just = states.where(done).select("workflow_id", F.col("step_id").alias("depends_on"))
    waiting = edges(steps).join(just, ["workflow_id", "depends_on"], "left_semi").select("workflow_id", "step_id").distinct()
    return ready(steps, states).join(waiting, ["workflow_id", "step_id"], "left_semi")
