"""Exact top-k search by inner product over an impact-ordered index, score at a time.

Vectors are dealt to shards and queries to blocks; each task indexes one shard and searches it for all queries of its blocks at once.
In a shard, the values of each dimension are quantised to LEVELS steps; the vectors of one dimension and level are a segment, whose
quantised impact on a query bounds what it can add. For each query, segments are processed by descending impact over all
dimensions, in ROUNDS. After a round, a vector's score lies between what its processed segments and the floor and ceiling of
its unprocessed dimensions allow. A query is done only when few enough vectors can still reach its k-th best lower bound; where all
segments leave too many, impacts of FINE steps bound them closer. Those that can still reach it are scored exactly.

A round adds the impacts of all its queries by one matrix product of the segments' membership (vectors by segments) and the
impacts (segments by queries), in whole numbers that the product holds exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEVELS, FINE, ENOUGH = 8, 256, 64
#: Shares of the segments that are processed after each round.
ROUNDS = (0.3, 1.0)
#: Rows of a shard, queries of a block, and queries that are searched together: what one task holds.
SHARD, BLOCK, TOGETHER = 4096, 4096, 128
HITS = "query_id long, vec_id long, score long"


class Index:
    """Which vectors each segment holds, and the bounds of its values: segment d * LEVELS + l is dimension d at level l."""

    def __init__(self, values: np.ndarray):
        self.values = values
        n, dims = values.shape
        low, high = values.min(axis=0), values.max(axis=0)
        step = np.maximum(1, -(-(high - low + 1) // LEVELS))
        level = (values - low) // step
        lo = low[:, None] + np.arange(LEVELS) * step[:, None]
        self.lo, self.hi = lo.ravel(), np.minimum(lo + step[:, None] - 1, high[:, None]).ravel()
        member = np.zeros((n, dims * LEVELS), np.float64 if self.wide() else np.float32)
        member[np.arange(n)[:, None], np.arange(dims) * LEVELS + level] = 1
        self.member = member
        self.filled = member.any(axis=0)
        self.step = np.maximum(1, -(-(high - low + 1) // FINE))
        self.edge = (low + (values - low) // self.step * self.step).astype(member.dtype)

    def wide(self) -> bool:
        """Whether sums of products pass what a 32-bit float holds exactly."""
        most = int(np.abs(self.values).max(initial=0))
        return most * most * self.values.shape[1] >= 1 << 23

    def candidates(self, queries: np.ndarray, k: np.ndarray) -> list[np.ndarray]:
        """For each query, rows that hold every one of its k highest scores, ties included."""
        n, dims = self.values.shape
        out: list[np.ndarray] = [np.arange(n)] * len(queries)
        open_q = np.flatnonzero(k < n) if n > ENOUGH else np.zeros(0, np.int64)
        kind = np.float64 if self.member.dtype == np.float64 or int(np.abs(queries).max(initial=0)) * int(np.abs(self.values).max(initial=0)) * dims >= 1 << 23 else np.float32
        member = self.member.astype(kind, copy=False)
        q = np.repeat(queries, LEVELS, axis=1)
        a, b = q * self.lo, q * self.hi
        most, least = np.maximum(a, b), np.minimum(a, b)
        far = np.iinfo(np.int64).max // 4
        floor = np.where(self.filled, least, far).reshape(len(q), dims, LEVELS).min(axis=2)
        impact = np.where(self.filled, most - np.repeat(floor, LEVELS, axis=1), -1)
        rank = np.empty_like(impact)
        np.put_along_axis(rank, np.argsort(-impact, axis=1, kind="stable"), np.arange(dims * LEVELS)[None, :], axis=1)
        total = int(self.filled.sum())
        for share in ROUNDS:
            if not len(open_q):
                break
            done = (rank[open_q] < share * total) | ~self.filled
            # a vector whose segment of a dimension is still open adds between the floor and the ceiling of that dimension's open segments
            shape = (len(open_q), dims, LEVELS)
            ceiling = np.where(done, -far, most[open_q]).reshape(shape).max(axis=2)
            bottom = np.where(done, far, least[open_q]).reshape(shape).min(axis=2)
            upper = np.where(done, most[open_q], np.repeat(ceiling, LEVELS, axis=1))
            lower = np.where(done, least[open_q], np.repeat(bottom, LEVELS, axis=1))
            can = member @ np.where(self.filled, upper, 0).astype(kind).T
            does = member @ np.where(self.filled, lower, 0).astype(kind).T
            open_q = self.reach(can, does, k, open_q, out)
        if len(open_q):
            q = queries[open_q]
            can = self.edge.astype(kind, copy=False) @ q.astype(kind).T
            does = can + (np.minimum(q, 0) @ (self.step - 1)).astype(kind)
            can += (np.maximum(q, 0) @ (self.step - 1)).astype(kind)
            self.reach(can, does, k, open_q, out)
        return out

    def reach(self, can: np.ndarray, does: np.ndarray, k: np.ndarray, open_q: np.ndarray, out: list[np.ndarray]) -> np.ndarray:
        """Sets the rows that can reach each open query's k-th best lower bound; the queries where these are too many."""
        n = len(self.values)
        for i, j in enumerate(open_q.tolist()):
            out[j] = np.flatnonzero(can[:, i] >= np.partition(does[:, i], n - k[j])[n - k[j]])
        return np.array([j for j in open_q.tolist() if len(out[j]) > ENOUGH], np.int64)


def matrix(t: pa.Table, column: str, dims: int) -> np.ndarray:
    out = np.zeros((t.num_rows, dims), np.int64)
    lists = t.column(column).combine_chunks()
    counts = np.diff(lists.offsets.to_numpy())
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    out[np.repeat(np.arange(len(counts)), counts), at] = lists.flatten().to_numpy()
    return out


def search(k: int, dims: int):
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[list] = [[np.zeros(0, np.int64)] for _ in range(3)]
        if queries.num_rows and rows.num_rows and dims:
            ids, wanted = rows.column("vec_id").to_numpy(), queries.column("vec_id").to_numpy()
            index, asked = Index(matrix(rows, "v", dims)), matrix(queries, "v", dims)
            ordered = np.sort(ids)
            own = np.searchsorted(ordered, wanted, side="right") - np.searchsorted(ordered, wanted, side="left")
            for a in range(0, len(wanted), TOGETHER):
                q = asked[a : a + TOGETHER]
                for i, v, at in zip(wanted[a : a + TOGETHER].tolist(), q, index.candidates(q, k + own[a : a + TOGETHER]), strict=True):
                    at = at[ids[at] != i]
                    scores = index.values[at] @ v
                    best = np.lexsort((ids[at], -scores))[:k]
                    for c, x in zip(out, (np.full(len(best), i), ids[at[best]], scores[best]), strict=True):
                        c.append(x)
        return pa.table([pa.array(np.concatenate(c), pa.int64()) for c in out], names=["query_id", "vec_id", "score"])

    return run


def topk(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k vectors of highest inner product for each query, but its own: query_id, rank, vec_id, score; ties to the smaller vec_id.

    vectors and queries: vec_id long, v array<long>. Rows whose vec_id or v is null, or whose v holds a null, take no part. A
    shorter vector counts as if filled up with 0. Rows that share the query's vec_id are its own. A row that repeats is a
    candidate each time. A vec_id asks once: of several vectors, the smallest as an array. No rows, or no other rows, give no result.
    """
    sound = F.expr("vec_id is not null and v is not null and not exists(v, x -> x is null)")
    rows = vectors.where(sound).select("vec_id", "v")
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dims")).first()
    asked = queries.where(sound).groupBy("vec_id").agg(F.min("v").alias("v"))
    shards, blocks = max(12, -(-size["n"] // SHARD)), max(1, -(-asked.count() // BLOCK))
    key = F.xxhash64("vec_id")
    left = asked.select("vec_id", "v", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(key, F.lit(blocks)).cast("int").alias("block"))
    right = rows.select("vec_id", "v", F.pmod(key, F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    cell = F.xxhash64("shard", "block").alias("cell")
    left, right = left.select("vec_id", "v", cell), right.select("vec_id", "v", cell)
    found = left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(search(k, size["dims"] or 0), HITS)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_topk(spark, sf_dir: str) -> DataFrame:
    sound = F.expr("forall(embedding, x -> x is not null and not isnan(x) and abs(x) < cast('inf' as float))")
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("embedding is not null").where(sound).select("vec_id", v.alias("v"))
    return topk(vectors, vectors.where("vec_id % 50 = 0"), 5)


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id, min(v) AS v FROM v WHERE vec_id % 50 = 0 GROUP BY vec_id),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM q JOIN v c ON q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
