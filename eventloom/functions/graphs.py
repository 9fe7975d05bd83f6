"""Graphs of workflows over Arrow batches that are sorted by workflow: whole workflows are gathered, and many are walked at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LARGE, TOGETHER = 4_000_000, 100_000  # steps and dependencies of a workflow that is left to joins, and of workflows walked at once
ERRORS = ("blank step", "cycle", "duplicate step", "empty", "missing result step", "unknown dependency")


def cells(b: pa.RecordBatch) -> int:
    return pc.sum(pc.list_value_length(b.column("ids"))).as_py() or 0


def gathered(batches: Iterator[pa.RecordBatch], large: int) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """Batches of whole workflows, with True; rows of workflows of more than `large` cells as they come, with False."""
    whole, n, tail, m, over, before = [], 0, [], 0, False, None

    def joined(parts):
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    for b in batches:
        if not b.num_rows:
            continue
        key = b.column("workflow_id")
        code = key.dictionary_encode(null_encoding="encode").indices.to_numpy()
        turns = np.flatnonzero(code[1:] != code[:-1]) + 1
        first, last = (int(turns[0]), int(turns[-1])) if turns.size else (b.num_rows, b.num_rows)
        same = (bool(tail) or over) and before == key[0].as_py()
        before = key[-1].as_py()
        for i, part in enumerate((b.slice(0, first), b.slice(first, last - first), b.slice(last))):
            if not part.num_rows:
                continue
            if i or not same:  # another workflow begins: the one held is whole
                whole, n, tail, m, over = [*whole, *tail], n + m, [], 0, False
            if over:
                yield part, False
                continue
            if i == 1:
                whole, n = [*whole, part], n + cells(part)
                continue
            tail, m = [*tail, part], m + cells(part)
            if m > large:
                yield from ((p, False) for p in tail)
                tail, m, over = [], 0, True
        if n >= TOGETHER:
            yield joined(whole), True
            whole, n = [], 0
    if whole or tail:
        yield joined([*whole, *tail]), True


def depths(n: int, step: np.ndarray, on: np.ndarray) -> np.ndarray:
    """Depth of each of n steps, step[i] depending on on[i]; -1 on or behind a cycle. Each dependency is followed once."""
    left, many = np.bincount(step, minlength=n), np.bincount(on, minlength=n)
    begin, after = np.cumsum(many) - many, step[np.argsort(on, kind="stable")]
    depth, now, d = np.full(n, -1, np.int32), np.flatnonzero(left == 0), 0
    while now.size:
        depth[now], d = d, d + 1
        k = many[now]
        hit = after[np.repeat(begin[now] - np.cumsum(k) + k, k) + np.arange(k.sum())]
        np.subtract.at(left, hit, 1)
        now = np.unique(hit[left[hit] == 0])
    return depth


class Graph:
    """Workflows of a batch: workflow_id, ids (a step and what it depends on), result (whether the row names a result step)."""

    def __init__(self, b: pa.RecordBatch):
        ids = b.column("ids")
        self.batch, self.flat, size = b, ids.flatten(), pc.list_value_length(ids).to_numpy()
        self.first, result = np.cumsum(size) - size, b.column("result").to_numpy(zero_copy_only=False)
        known = self.flat.dictionary_encode()
        self.ids, code = len(known.dictionary) + 1, known.indices.fill_null(-1).to_numpy().astype(np.int64) + 1
        self.flow = b.column("workflow_id").dictionary_encode(null_encoding="encode").indices.to_numpy().astype(np.int64)
        self.no_flow, self.no_step = b.column("workflow_id").is_null().to_numpy(zero_copy_only=False), code[self.first] == 0
        self.steps, self.results, row = np.flatnonzero(~result), np.flatnonzero(result), np.repeat(np.arange(len(size)), size)
        self.key = self.flow[row] * self.ids + code
        self.nodes, at, self.times = np.unique(self.key[self.first[self.steps]], return_inverse=True, return_counts=True)
        self.node = np.zeros(len(size), np.int64)
        self.node[self.steps] = at
        dep = np.ones(len(code), bool)
        dep[self.first] = False
        dep = np.flatnonzero(dep)
        place, found = self.placed(dep)
        found &= (code[dep] > 0) & ~self.no_flow[row[dep]]
        self.cell, self.row, self.on, self.lost = dep[found], row[dep[found]], place[found], row[dep[~found]]
        self.depth = depths(len(self.nodes), self.node[self.row], self.on)

    def placed(self, cell):
        key = self.key[cell]
        place = np.minimum(np.searchsorted(self.nodes, key), max(len(self.nodes) - 1, 0))
        return place, self.nodes[place] == key if len(self.nodes) else np.zeros(len(key), bool)

    def masked(self, node) -> pa.Array:
        return pa.array(self.depth[node], mask=self.depth[node] < 0)


def levels(g: Graph) -> list[pa.Array]:
    """workflow_id, step_id, depth of each step."""
    return [g.batch.column("workflow_id").take(pa.array(g.steps)), g.flat.take(pa.array(g.first[g.steps])), g.masked(g.node[g.steps])]


def layout(g: Graph) -> list[pa.Array]:
    """workflow_id, depends_on, step_id, to_depth, from_depth of each known dependency, as often as its ends are there."""
    times = g.times[g.node[g.row]] * g.times[g.on] * ~g.no_step[g.row]
    row, cell, on = (np.repeat(x, times) for x in (g.row, g.cell, g.on))
    return [g.batch.column("workflow_id").take(pa.array(row)), g.flat.take(pa.array(cell)), g.flat.take(pa.array(g.first[row])), g.masked(g.node[row]), g.masked(on)]


def errors(g: Graph) -> list[pa.Array]:
    """workflow_id and errors of each row that names a result step."""
    flows = int(g.flow.max()) + 1
    count = lambda flow: np.bincount(flow, minlength=flows)
    own = g.flat.take(pa.array(g.first[g.steps]))
    blank = own.is_null().to_numpy(zero_copy_only=False)
    if pa.types.is_string(own.type) or pa.types.is_large_string(own.type):
        blank = pc.fill_null(pc.equal(own, ""), True).to_numpy(zero_copy_only=False)
    n, of = count(g.flow[g.steps]), g.nodes // g.ids
    lost = ~(g.placed(g.first[g.results])[1] & ~g.no_step[g.results])
    r = g.flow[g.results]
    found = (count(g.flow[g.steps[blank]])[r] > 0, count(of[g.depth < 0])[r] > 0, count(of[g.nodes % g.ids > 0])[r] < n[r], n[r] == 0, lost, count(g.flow[g.lost[~g.no_flow[g.lost]]])[r] > 0)
    names = pa.array([",".join(e for i, e in enumerate(ERRORS) if mask >> i & 1) for mask in range(1 << len(ERRORS))])
    mask = sum((f.astype(np.int64) << i for i, f in enumerate(found)), np.zeros(len(r), np.int64))
    return [g.batch.column("workflow_id").take(pa.array(g.results)), names.take(pa.array(mask))]


def walked(batches: Iterator[pa.RecordBatch], make, columns: list[str], types: dict, large: int) -> Iterator[pa.RecordBatch]:
    """What make gives for whole workflows; a row with `large` for each batch of one that is too large."""
    for b, whole in gathered(batches, large):
        if whole:
            out = make(Graph(b))
            out.append(pa.array(np.zeros(len(out[0]), bool)))
        else:
            key = b.column("workflow_id").slice(0, 1)
            out = [key, *[pa.nulls(1, types.get(c, b.column("ids").type.value_type)) for c in columns[1:]], pa.array([True])]
        yield pa.RecordBatch.from_arrays(out, [*columns, "large"])
