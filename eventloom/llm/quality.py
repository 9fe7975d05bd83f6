"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network with calibrated probabilities.

Each word form has a sparse random index vector; its word vector sums those of its neighbours over all documents. Word forms
are hashed to VOCAB rows, so the table has a fixed size whatever the corpus. A document is the mean and the deviation of its
words' vectors, and a few plain rates. The network is fitted in numpy on a bounded sample of labelled documents
and its logits are divided by a temperature fitted on documents kept apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_hold_out, slices, table, tidy, tidy_group, words_of
from .labelled import PER_CLASS, texts_of, training

VOCAB, DIMS, CHUNKS, REACH = 1 << 14, 32, 16, 2
HIDDEN, EPOCHS, RATES = 32, 40, 8
#: Text bytes that a Python worker holds as words at once.
HELD_BYTES = 1_000_000
THRESHOLD = 0.7
PARTIAL = "pile int, chunk int, sums binary"


def forms(flat: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word: its row of the vocabulary (of the whole word, lower case), its number in the slice, and its traits."""
    if not len(flat):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 4), np.float32)
    coded = flat.dictionary_encode()
    unique = coded.dictionary
    rows = np.fromiter(map(xxhash.xxh3_64_intdigest, pc.utf8_lower(unique).cast(pa.binary()).to_pylist()), np.uint64, len(unique)) % np.uint64(VOCAB)
    length = pc.utf8_length(unique).to_numpy(zero_copy_only=False)
    said = [pc.invert(pc.match_substring_regex(unique, r"\p{L}")), pc.utf8_is_upper(unique), pc.match_substring_regex(unique, r"(^|[^\p{L}\p{N}])[^\p{L}\p{N}]$")]
    traits = np.column_stack([*(x.to_numpy(zero_copy_only=False) for x in said), np.log1p(length)]).astype(np.float32)
    traits[:, 1] *= length > 1
    rows = rows.astype(np.int64)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    return rows[codes], codes, traits[codes]


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Two places and their signs of each form's index vector."""
    rng = np.random.default_rng(11)
    return rng.integers(0, DIMS, (VOCAB, 2)), rng.choice([-1.0, 1.0], (VOCAB, 2))


def neighbour_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    places, signs = index_vectors()
    total = np.zeros(VOCAB * DIMS)
    for batch in slices(batches, most=HELD_BYTES):
        flat, offsets = words_of(batch.column("text"))
        rows, _, _ = forms(flat)
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        for step in range(1, REACH + 1):
            near = np.flatnonzero(doc[step:] == doc[:-step])
            for a, b in ((near, near + step), (near + step, near)):
                w, c = rows[a], rows[b]
                for k in range(2):
                    total += np.bincount(w * DIMS + places[c, k], weights=signs[c, k], minlength=VOCAB * DIMS)
    if total.any():
        pile = TaskContext.get().partitionId() // 128
        parts = np.split(total, CHUNKS)
        yield pa.RecordBatch.from_arrays([pa.array([pile] * CHUNKS, pa.int32()), pa.array(range(CHUNKS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["pile", "chunk", "sums"])


def added(group: pa.Table) -> pa.Table:
    total = sum((np.frombuffer(x.as_py()) for x in group.column("sums")), np.zeros(VOCAB * DIMS // CHUNKS))
    return pa.table([group.column("pile")[:1], group.column("chunk")[:1], pa.array([total.tobytes()], pa.binary())], names=["pile", "chunk", "sums"])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """VOCAB x DIMS, of all documents. Sums of a task's slices are added in piles of 128 tasks, then the piles: CHUNKS rows reach the driver."""
    sums = docs.select("text").where("text is not null").mapInArrow(tidy(neighbour_sums), PARTIAL)
    piles = sums.groupBy("pile", "chunk").applyInArrow(tidy_group(added), PARTIAL)
    whole = np.zeros((CHUNKS, VOCAB * DIMS // CHUNKS))
    for r in piles.groupBy("chunk").applyInArrow(tidy_group(added), PARTIAL).collect():
        whole[r["chunk"]] = np.frombuffer(r["sums"])
    vectors = whole.reshape(VOCAB, DIMS)
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return (vectors / np.maximum(length, 1e-9)).astype(np.float32)


def pooled(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Mean and deviation of the words' vectors, and RATES rates, by document; zeros for a text without words."""
    flat, offsets = words_of(texts)
    rows, codes, traits = forms(flat)
    n = np.diff(offsets)
    out = np.zeros((len(n), 2 * DIMS + RATES), np.float32)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    at, count = offsets[full], n[full][:, None].astype(np.float64)
    for k, column in enumerate(vectors.T.astype(np.float64)):  # a dimension at a time: no table of words by dimensions
        v = column[rows]
        mean = np.add.reduceat(v, at) / count[:, 0]
        out[full, k] = mean
        out[full, DIMS + k] = np.sqrt(np.maximum(np.add.reduceat(v * v, at) / count[:, 0] - mean * mean, 0))
    again = np.concatenate([[False], codes[1:] == codes[:-1]])
    again[at] = False
    doc = np.repeat(np.arange(len(n)), n)
    pairs = np.sort(doc * np.int64(len(flat)) + codes)
    first = np.concatenate([[True], pairs[1:] != pairs[:-1]])
    distinct = np.bincount(pairs[first] // len(flat), minlength=len(n))[full]
    rates = np.column_stack([np.add.reduceat(x.astype(np.float64), at) for x in (*traits.T, again)]) / count
    lines = pc.fill_null(pc.count_substring(texts, "\n"), 0).to_numpy(zero_copy_only=False)[full]
    out[full, 2 * DIMS : 2 * DIMS + 5] = rates / [1, 1, 1, 3, 1]
    out[full, 2 * DIMS + 5] = distinct / count[:, 0]
    out[full, 2 * DIMS + 6] = np.log1p(count[:, 0]) / 8
    out[full, 2 * DIMS + 7] = lines / count[:, 0]
    return out


class Network:
    """tanh layer, then a logit; inputs are standardised. Without both classes it gives one probability to all."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 3):
        self.constant = (y.sum() + 1) / (len(y) + 2) if len(set(y.tolist())) < 2 else None
        if self.constant is not None:
            return
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-4
        x = (x - self.mean) / self.scale
        order = rng.permutation(len(y))
        apart, fit = order[: len(y) // 5], order[len(y) // 5 :]
        w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        m, s, t = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
        for epoch in range(EPOCHS):
            rate = 0.01 * (1 - epoch / EPOCHS)
            fit = rng.permutation(fit)
            for a in range(0, len(fit), 256):
                i = fit[a : a + 256]
                h = np.tanh(x[i] @ w[0] + w[1])
                e = (1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -40, 40))) - y[i]) / len(i)
                back = np.outer(e, w[2]) * (1 - h * h)
                t += 1
                for k, g in enumerate((x[i].T @ back + 1e-4 * w[0], back.sum(0), h.T @ e + 1e-4 * w[2], np.array([e.sum()]))):
                    m[k] += 0.1 * (g - m[k])
                    s[k] += 0.001 * (g * g - s[k])
                    w[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
        self.w, self.temperature = w, 1.0
        if len(apart):
            z = self.logits(x[apart])
            losses = [(np.logaddexp(0, z / t) - y[apart] * z / t).mean() for t in TEMPERATURES]
            self.temperature = float(TEMPERATURES[int(np.argmin(losses))])

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3][0]

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = np.clip(self.logits((x - self.mean) / self.scale) / self.temperature, -40, 40)
        return np.round(1 / (1 + np.exp(-z)), 9)


TEMPERATURES = np.geomspace(0.25, 8, 41)


def fitted(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[np.ndarray, Network]:
    vectors = word_vectors(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=HELD_BYTES):
            x = pooled(b.column("text"), vectors)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "y", "x"])

    rows = training(docs, labels, "quality", per_class).mapInArrow(tidy(run), "doc_id long, y int, x binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["x"])))
    x = np.array([np.frombuffer(r["x"], np.float32) for r in rows], np.float64).reshape(len(rows), 2 * DIMS + RATES)
    return vectors, Network(x, np.array([r["y"] for r in rows], np.float64))


def scores(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, into: str = "score") -> DataFrame:
    """docs with a column score, or as `into` names it, (0 to 1, higher: label 1 likelier); scored by text alone.

    A null or empty text is scored as one without words. Without labelled rows of both classes every score is the share of label 1,
    counted with one more of each. Rows that repeat are scored alike; other columns stay, but for one of that name.
    """
    vectors, network = fitted(docs, labels, per_class)
    kept = [c for c in docs.columns if c != into]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=HELD_BYTES):
            x = pooled(b.column("text"), vectors).astype(np.float64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(network.probability(x), pa.float64())], names=[*b.schema.names, into])

    rows = docs.select(*kept)
    return rows.mapInArrow(tidy(run), T.StructType([*rows.schema.fields, T.StructField(into, T.DoubleType())]))


def op10_quality(spark, sf_dir: str) -> DataFrame:
    out = scores(texts_of(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))
    return out.select("doc_id", in_hold_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
