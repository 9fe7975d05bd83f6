"""Substring dedup by fixed-block anchors.

A repeat of `window` words holds at least one block of (window + 1) // 2 words that starts at a multiple of that length in
either text. So the index holds each document's non-overlapping blocks, and every rolling window of a block's length probes it.
Anchors that hit are then extended in the whole text to every window around them; equal windows of a smaller doc_id prove
a repeat, and runs of such windows are the maximal exact repeats.

Texts are dealt to parts once. A part is small enough for one worker, and its anchors and windows, in the order of their hashes, are
the same whenever they are computed. So a part and a bucket of hashes speak in lists: the part sends each distinct hash
once (not one for each place), the bucket answers with one bit for each. Hot passages are one entry a part, and what is
sent back does not name documents or places.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bucket, deltas, dump, load, rolling, slices, text_bytes, word_hashes, words_of
from .labelled import texts_of

#: Text bytes of a part, which one worker holds as words, and those whose anchors meet in one bucket.
PART_BYTES, BUCKET_BYTES = 5_000_000, 8_000_000
SECOND = np.uint64(0xD6E8FEB86659FD93)
LISTS = "bucket int, part int, packed binary"
OUT = "doc_id long, n_words long, n_removed long, kept_text string, spans array<struct<start:long,end:long>>"


class Words:
    """The words of some documents in the order of doc_id."""

    def __init__(self, ids: pa.Array, texts: pa.Array):
        ids = ids.to_numpy(zero_copy_only=False).astype(np.int64)
        self.order = np.argsort(ids, kind="stable")
        self.ids = ids[self.order]
        self.flat, self.offsets = words_of(texts.take(pa.array(self.order)))
        self.hashes, _ = word_hashes(self.flat)
        counts = np.diff(self.offsets)
        self.doc = np.repeat(np.arange(len(counts)), counts)
        self.left = self.offsets[self.doc + 1] - np.arange(len(self.hashes))


def words_in(rows: pa.Table) -> Words:
    return Words(rows.column("doc_id").combine_chunks(), rows.column("text").combine_chunks())


class Lists:
    """Distinct hashes at some places of a part, sorted by bucket and low bits: what a bucket is sent ascends, and its differences are small."""

    def __init__(self, hashes: np.ndarray, buckets: int, second: np.ndarray | None = None):
        bucket = ((hashes >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        turned = (hashes << np.uint64(32)) | (hashes >> np.uint64(32))
        order = np.argsort(turned, kind="stable") if second is None else np.lexsort((second, turned))
        order = order[np.argsort(bucket[order].astype(np.uint16) if buckets < 65536 else bucket[order], kind="stable")]
        new = np.ones(len(order), bool)
        new[1:] = hashes[order[1:]] != hashes[order[:-1]]
        if second is not None:
            new[1:] |= second[order[1:]] != second[order[:-1]]
        self.group = np.empty(len(order), np.int64)
        self.group[order] = np.cumsum(new) - 1
        #: One place of each distinct hash: the first, which is one of the smallest doc_id.
        self.first = order[new]
        _, self.found, self.cut = by_bucket(bucket[self.first])

    def __len__(self) -> int:
        return len(self.first)

    def rows(self, part: int, *columns: np.ndarray) -> pa.Table:
        packed = [dump(*(c[a:b] if c.dtype == bool else deltas(c[a:b]) for c in columns)) for a, b in zip(self.cut[:-1], self.cut[1:], strict=True)]
        return pa.table([pa.array(self.found, pa.int32()), pa.array([part] * len(packed), pa.int32()), pa.array(packed, pa.binary())], names=["bucket", "part", "packed"])

    def answers(self, rows: pa.Table) -> np.ndarray:
        """The buckets' bits, in the order of the list."""
        out = np.zeros(len(self.first), bool)
        at = {int(x): k for k, x in enumerate(self.found)}
        for bucket, packed in zip(rows.column("bucket").to_pylist(), rows.column("packed").to_pylist(), strict=True):
            a, b = self.cut[at[bucket]], self.cut[at[bucket] + 1]
            out[a:b] = np.unpackbits(load(packed)[0], count=int(b - a)).view(bool)
        return out


def opened(rows: pa.Table) -> list[list[np.ndarray]]:
    """The columns of each part."""
    return [[c if c.dtype == bool else np.cumsum(c, dtype=c.dtype) for c in load(v)] for v in rows.column("packed").to_pylist()]


def bits(part: list[int], bucket: int, lengths: list[int], answer: np.ndarray) -> pa.Table:
    """A bucket's answers, a row for each part that has a yes."""
    ends = np.cumsum(lengths)
    parts, packed = [], []
    for p, a, b in zip(part, ends - lengths, ends, strict=True):
        if answer[a:b].any():
            parts.append(p)
            packed.append(dump(np.packbits(answer[a:b])))
    return pa.table([pa.array([bucket] * len(parts), pa.int32()), pa.array(parts, pa.int32()), pa.array(packed, pa.binary())], names=["bucket", "part", "packed"])


def probes(s: Words, window: int, buckets: int) -> tuple[np.ndarray, np.ndarray, Lists]:
    """Places of all rolling windows of a block's length in documents that hold a whole window, whether a block starts there, and the list of hashes."""
    block = (window + 1) // 2
    at = np.flatnonzero((s.left >= block) & ((s.offsets[1:] - s.offsets[:-1])[s.doc] >= window))
    is_block = (at - s.offsets[s.doc[at]]) % block == 0
    return at, is_block, Lists(rolling(s.hashes, block)[at], buckets)


def anchors(window: int, buckets: int):
    def run(rows: pa.Table) -> pa.Table:
        s = words_in(rows)
        at, is_block, found = probes(s, window, buckets)
        blocks, many = np.zeros(len(found), bool), np.zeros(len(found), bool)
        blocks[found.group[is_block]] = True
        many[found.group[s.doc[at] != s.doc[at[found.first]][found.group]]] = True  # two documents of this part hold it
        low = (rolling(s.hashes, (window + 1) // 2)[at[found.first]] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        return found.rows(rows.column("part")[0].as_py(), low, blocks, many) if len(found) else EMPTY

    return run


EMPTY = pa.table([pa.array([], pa.int32()), pa.array([], pa.int32()), pa.array([], pa.binary())], names=["bucket", "part", "packed"])


def hits(rows: pa.Table) -> pa.Table:
    """In a bucket: the hashes that are a block in one document and occur in another."""
    parts = opened(rows)
    keys, blocks, many = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], keys[order[1:]] != keys[order[:-1]]]))
    times = np.diff(np.append(first, len(keys)))
    hot = np.logical_or.reduceat(blocks[order], first) & ((times > 1) | np.logical_or.reduceat(many[order], first))
    answer = np.zeros(len(keys), bool)
    answer[order] = np.repeat(hot, times)
    return bits(rows.column("part").to_pylist(), rows.column("bucket")[0].as_py(), [len(p[0]) for p in parts], answer)


def windows(s: Words, window: int, buckets: int, hot: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, Lists]:
    """Starts of every window around an anchor that hit, their two hashes, and the list of them."""
    block = (window + 1) // 2
    at, _, found = probes(s, window, buckets)
    at = at[found.answers(hot)[found.group]] if len(found) else at
    near = np.zeros(len(s.hashes) + 1, np.int64)
    np.add.at(near, np.maximum(at - (window - block), s.offsets[s.doc[at]]), 1)
    np.add.at(near, at + 1, -1)
    starts = np.flatnonzero((np.cumsum(near)[:-1] > 0) & (s.left >= window))
    one, two = rolling(s.hashes, window)[starts], rolling(s.hashes, window, SECOND)[starts]
    return starts, one, two, Lists(two, buckets, one)


def extended(window: int, buckets: int):
    """Each distinct window around the anchors that hit, with the smallest document of the part that holds it."""

    def run(rows: pa.Table, hot: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return EMPTY
        s = words_in(rows)
        starts, one, two, found = windows(s, window, buckets, hot)
        if not len(found):
            return EMPTY
        low = (two & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        ids = s.ids[s.doc[starts]]
        return found.rows(rows.column("part")[0].as_py(), low[found.first], one[found.first], ids[found.first])

    return run


def repeats(rows: pa.Table) -> pa.Table:
    """In a bucket: the windows of a part that a smaller document of another part holds too."""
    parts = opened(rows)
    two, one, ids = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.lexsort((ids, two, one))
    new = np.concatenate([[True], (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]])])
    least = ids[order[np.flatnonzero(new)[np.cumsum(new) - 1]]]
    answer = np.zeros(len(ids), bool)
    answer[order] = least < ids[order]
    return bits(rows.column("part").to_pylist(), rows.column("bucket")[0].as_py(), [len(p[0]) for p in parts], answer)


def result(s: Words, gone: np.ndarray, lost: np.ndarray | None = None) -> pa.Table:
    """Rows of the result, from the words that go."""
    n = np.diff(s.offsets)
    total = np.concatenate([[0], np.cumsum(gone)])
    removed = total[s.offsets[1:]] - total[s.offsets[:-1]]
    stay = pa.ListArray.from_arrays(pa.array(s.offsets - total[s.offsets], pa.int32()), s.flat.filter(pa.array(gone == 0)))
    spans: list[list] = [[] for _ in n]
    for d in np.flatnonzero(removed):
        inside = np.concatenate([[0], gone[s.offsets[d] : s.offsets[d + 1]].view(np.int8), [0]])
        e = np.flatnonzero(np.diff(inside))
        spans[d] = [{"start": int(x), "end": int(y)} for x, y in zip(e[::2], e[1::2], strict=True)]
    return pa.table(
        [pa.array(s.ids, pa.int64(), mask=lost), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pc.binary_join(stay, " ").cast(pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
        names=["doc_id", "n_words", "n_removed", "kept_text", "spans"],
    )


def kept(window: int, buckets: int):
    """The words that no window covers which a smaller document holds, of this part or another."""

    def run(rows: pa.Table, told: pa.Table) -> pa.Table:
        s = words_in(rows)
        kind = told.column("kind")
        starts, _, _, found = windows(s, window, buckets, told.filter(pc.equal(kind, 0)))
        gone = np.zeros(len(s.hashes), bool)
        if len(found):
            ids = s.ids[s.doc[starts]]
            again = found.answers(told.filter(pc.equal(kind, 1)))[found.group] | (ids > ids[found.first][found.group])
            cover = np.zeros(len(gone) + 1, np.int64)
            np.add.at(cover, starts[again], 1)
            np.add.at(cover, starts[again] + window, -1)
            gone = np.cumsum(cover)[:-1] > 0
        return result(s, gone)

    return run


def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows without doc_id keep all words."""
    for b in slices(batches):
        s = Words(b.column("doc_id").fill_null(0), b.column("text"))
        yield from result(s, np.zeros(len(s.hashes), bool), np.ones(b.num_rows, bool)).combine_chunks().to_batches()


def substring_dedup(docs: DataFrame, window: int = 13) -> DataFrame:
    """Removes each word that a window of `window` words covers whose words also start in a document with a smaller doc_id.

    Returns doc_id, n_words, n_removed, kept_text (words joined by a space) and spans (the maximal repeats, as word ranges), a
    row for each row of docs. Windows are judged on the input. A null or empty text has no words. A null doc_id is neither
    smaller nor larger than another: its row keeps all words. Rows with the same doc_id don't remove from each other. Other
    columns are ignored. Windows of different parts are equal when two hashes of 64 and 32 bits and their bucket are.
    """
    size = text_bytes(docs)
    buckets, parts = max(32, size // BUCKET_BYTES), max(16, size // PART_BYTES)
    texts = texts_of(docs)
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int").alias("part")
    dealt = texts.where("doc_id is not null").select("doc_id", "text", part).repartition(parts, "part").groupBy("part")

    def told(asked: DataFrame, answer) -> DataFrame:
        return asked.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(answer, LISTS)

    hot = told(dealt.applyInArrow(anchors(window, buckets), LISTS), hits)
    again = told(dealt.cogroup(hot.repartition(parts, "part").groupBy("part")).applyInArrow(extended(window, buckets), LISTS), repeats)
    both = hot.withColumn("kind", F.lit(0)).unionByName(again.withColumn("kind", F.lit(1)))
    named = dealt.cogroup(both.repartition(parts, "part").groupBy("part")).applyInArrow(kept(window, buckets), OUT)
    return named.unionByName(texts.where("doc_id is null").mapInArrow(whole, OUT))


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
