"""Workflow graphs against a plain walk, with null ids, repeated steps, cycles and workflows of any size."""

import random
from collections import Counter

import pyarrow as pa
import pytest

from eventloom.functions import graphs
from eventloom.operators import dag

STEPS = "workflow_id string, step_id int, depends_on array<bigint>"


def made(seed, flows=14):
    r, rows = random.Random(seed), []
    for w in [None, *map(str, range(flows))]:
        ids = [None, *range(r.choice([1, 3, 9]))]
        for s in r.choices(ids, k=r.randint(1, 10)) if r.random() < 0.6 else ids[1:]:
            below = [*range(s or 0), *([None, 77, s, 8] if r.random() < 0.15 else [])]
            rows.append((w, s, None if r.random() < 0.1 else r.choices(below, k=r.randint(0, 3)) if below else []))
    return rows


def plain(rows):
    """(workflow, rows of it, times of each step, depth of each step, known dependencies of each row) of each workflow."""
    for w in dict.fromkeys(r[0] for r in rows):
        own = [r for r in rows if r[0] == w]
        times = Counter(s for _, s, _ in own)
        on = [[d for d in deps or [] if d is not None and d in times and w is not None] for _, _, deps in own]
        depth, now = {}, 0
        while new := [s for s in times if s not in depth and all(d in depth for r, o in zip(own, on) if r[1] == s for d in o)]:
            depth |= dict.fromkeys(new, now)
            now += 1
        yield w, own, times, depth, on


def levels_of(rows):
    return [(w, s, depth.get(s)) for w, own, _, depth, _ in plain(rows) for _, s, _ in own]


def layout_of(rows):
    return [(w, d, s, depth.get(s), depth.get(d)) for w, own, times, depth, on in plain(rows) for (_, s, _), o in zip(own, on) if s is not None for d in o for _ in range(times[s] * times[d])]


def errors_of(rows, results):
    flows, out = {w: x for w, *x in plain(rows)}, []
    for w, result in results:
        own, times, depth, on = flows.get(w, ([], Counter(), {}, []))
        bad = {"empty": not own, "blank step": None in times, "duplicate step": len(times.keys() - {None}) < len(own), "cycle": len(depth) < len(times), "missing result step": result is None or result not in times}
        bad["unknown dependency"] = w is not None and any(len(o) < len(deps or []) for (_, _, deps), o in zip(own, on))
        out.append((w, ",".join(sorted(k for k, v in bad.items() if v))))
    return out


def same(got, want):
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


@pytest.fixture
def written(monkeypatch):
    """What the operators write to the shared folder."""
    tables, cut = [], dag.cut
    monkeypatch.setattr(dag, "cut", lambda df: tables.append(df) or cut(df))
    return tables


@pytest.fixture
def chain(spark):
    return spark.createDataFrame([("w", i, [i - 1] if i else []) for i in range(9)], STEPS)


def test_layout_is_of_one_pass_whatever_its_depth(spark, written, chain):
    assert {(r.step_id, r.to_depth, r.from_depth) for r in dag.layout(chain).collect()} == {(i, i, i - 1) for i in range(1, 9)}
    assert len(written) == 1


@pytest.mark.parametrize("large", [graphs.LARGE, 12])
def test_layout_of_any_graph(spark, large):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    got = dag.layout(spark.createDataFrame(made(3), STEPS), large).select("workflow_id", "depends_on", "step_id", "to_depth", "from_depth").collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    same(got, layout_of(made(3)))


@pytest.mark.parametrize("seed", range(40))
def test_workflows_stay_whole_over_batches(monkeypatch, seed):
    rows, r = made(seed), random.Random(seed)
    monkeypatch.setattr(graphs, "TOGETHER", r.choice([1, 20, 1000]))
    results = [(w, r.choice([None, 0, 2, 77])) for w in [*{x[0] for x in rows}, "none"]]
    cells = [(w, [s, *(deps or [])], False) for w, s, deps in rows] + [(w, [s], True) for w, s in results]
    cells.sort(key=lambda x: (x[0] is not None, x[0] or ""))
    batches, size = [], r.choice([1, 2, 7, 500])
    for i in range(0, len(cells), size):
        w, ids, result = zip(*cells[i : i + size])
        batches.append(pa.record_batch([pa.array(w, pa.string()), pa.array(ids, pa.list_(pa.int64())), pa.array(result)], ["workflow_id", "ids", "result"]))
    limit = r.choice([6, 12, 10**6])
    total = Counter(w for w, ids, _ in cells for _ in ids)
    over = {w for w in total if total[w] > limit}
    for make, columns, want in ((graphs.levels, ["workflow_id", "step_id", "depth"], levels_of(rows)), (graphs.layout, ["workflow_id", "depends_on", "step_id", "to_depth", "from_depth"], layout_of(rows)), (graphs.errors, ["workflow_id", "errors"], errors_of(rows, results))):
        types = {c: pa.int32() for c in columns if "depth" in c} | {"errors": pa.string()}
        got = [tuple(x.values()) for b in graphs.walked(iter(batches), make, columns, types, limit) for x in b.to_pylist()]
        large = {x[0] for x in got if x[-1]}
        assert large <= over and (size > 2 or large == over)
        same([x[:-1] for x in got if not x[-1]], [x for x in want if x[0] not in large])


def test_validation_is_of_one_pass_whatever_the_depth(spark, written, chain):
    assert [r.errors for r in dag.validated(chain, spark.createDataFrame([("w", 8)], "workflow_id string, result_step_id int")).collect()] == [""]
    assert len(written) == 1


@pytest.mark.parametrize("large", [graphs.LARGE, 12])
def test_errors_of_any_graph(spark, large):
    results = [(w, 2) for w in [None, *map(str, range(14)), "none"]]
    got = dag.validated(spark.createDataFrame(made(4), STEPS), spark.createDataFrame(results, "workflow_id string, result_step_id int"), large)
    same(got.select("workflow_id", "errors").collect(), errors_of(made(4), results))


def test_levels_are_of_one_pass_whatever_their_number(spark, written, chain):
    assert {(r.step_id, r.depth) for r in dag.levels(chain).collect()} == {(i, i) for i in range(9)}
    assert len(written) == 1


@pytest.mark.parametrize("large", [graphs.LARGE, 12])
def test_levels_of_any_graph(spark, large):
    got = dag.levels(spark.createDataFrame(made(5), STEPS), large)
    assert got.schema["step_id"].dataType.simpleString() == "int"
    same(got.select("workflow_id", "step_id", "depth").collect(), levels_of(made(5)))
