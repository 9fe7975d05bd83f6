"""User code: functions, stateful classes and traced workflows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def task(returns: str, retries: int = 3):
    """A function of one value as a vectorised column function; a value that still raises after so many retries is null."""

    def wrap(f: Callable) -> Callable[[str], Column]:
        def tried(x):
            for left in range(retries, -1, -1):
                try:
                    return f(x)
                except Exception:
                    if not left:
                        return None

        @F.pandas_udf(returns)
        def run(values: pd.Series) -> pd.Series:
            return values.map(tried)

        run.function = f
        return run

    return wrap


def mock_model(name: str, version: str) -> Callable[[str], Column]:
    """The deterministic stand-in of a model: mock:<model>:<version>:<prompt>."""
    return lambda prompt: F.concat_ws(":", F.lit("mock"), F.lit(name), F.lit(version), F.coalesce(F.col(prompt), F.lit("")))


class Adder:
    """Adds up the UTF-8 sizes of what it is called with."""

    def __init__(self):
        self.total = 0

    def call(self, text: str | None) -> int:
        self.total += len((text or "").encode())
        return self.total


def run_actor(rows: DataFrame, cls: type, key: str, order: str, argument: str, into: str) -> DataFrame:
    """Calls an instance of cls for each key, in order: key, order and the call's result as a long.

    Rows are dealt by key and sorted within partitions; a partition holds one instance at a time, so a key of any length fits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, actor = object(), None
        for b in batches:
            out = []
            for k, x in zip(b.column(key).to_pylist(), b.column(argument).to_pylist(), strict=True):
                if actor is None or k != now:
                    now, actor = k, cls()
                out.append(actor.call(x))
            yield pa.RecordBatch.from_arrays([b.column(key), b.column(order), pa.array(out, pa.int64())], names=[key, order, into])

    types = dict(rows.dtypes)
    return rows.repartition(key).sortWithinPartitions(key, order).mapInArrow(run, f"{key} {types[key]}, {order} {types[order]}, {into} long")


class Ref:
    """The result of a step that hasn't run."""

    def __init__(self, step_id: str):
        self.step_id = step_id


class Trace:
    """Records calls as steps: names that repeat get _2, _3; dependencies are the references among the arguments."""

    def __init__(self):
        self.steps: list[dict] = []
        self.names: dict[str, int] = {}

    def step(self, name: str, *args, **kwargs) -> Ref:
        n = self.names[name] = self.names.get(name, 0) + 1
        step_id = name if n == 1 else f"{name}_{n}"
        found: set[str] = set()
        self.steps.append({"step_id": step_id, "args": self.plain(args, found), "kwargs": self.plain(kwargs, found), "depends_on": sorted(found)})
        return Ref(step_id)

    def plain(self, value, found: set[str]):
        if isinstance(value, Ref):
            found.add(value.step_id)
            return {"__step_ref__": value.step_id}
        if isinstance(value, dict):
            return {k: self.plain(v, found) for k, v in value.items()}
        if isinstance(value, list | tuple):
            return [self.plain(v, found) for v in value]
        return value


def workflow(f: Callable) -> Callable[..., dict]:
    """f(trace, ...) as a definition: its steps and the step that it returns."""

    def build(*args, **kwargs) -> dict:
        trace = Trace()
        out = f(trace, *args, **kwargs)
        if not isinstance(out, Ref):
            raise ValueError("a workflow returns a step")
        return {"workflow_name": f.__name__, "steps": trace.steps, "result_step_id": out.step_id}

    return build


def resolved(value, results: dict):
    """value with each {"__step_ref__": id}, where it is the only key, replaced by that step's result."""
    if isinstance(value, dict):
        if set(value) == {"__step_ref__"}:
            return results[value["__step_ref__"]]
        return {k: resolved(v, results) for k, v in value.items()}
    return [resolved(v, results) for v in value] if isinstance(value, list) else value
