"""Line dedup by a deletion-neighbourhood join, for an edit distance of 1.

Deleting each character in turn gives a line's variants. Two lines are at most one edit apart exactly when they are equal, one is
a variant of the other (an insertion), or both have the same variant by deleting the same place (a substitution). So equal keys
of variant and place prove the distance, and in each group of equal keys the earliest line removes the rest: no pairs are made.

Variants are many, so lines first show that a partner can exist: one edit leaves one half of a line as it was. Lines of equal or
neighbouring length that share a half, and only those, emit their variants. Hashes are of code points, by a polynomial
over random values, so that every half and variant of a line comes from one running sum.

Entries travel packed by slice and bucket, as in substring dedup; a slice first settles what repeats within itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MARKS, PACKED, by_bucket, deltas, dump, fingerprint, load, mixed, rows, slices, text_bytes, tidy, tidy_group
from .labelled import texts_of

#: Lines with fewer characters that aren't white space stay; one edit counts where both lines have so many characters.
LEAST, LEAST_EDIT = 8, 20
BUCKET_BYTES, SLICE = 16_000_000, 2_500_000
#: Code points that a worker holds running sums of at once.
BLOCK = 250_000
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
SALTS = (np.uint64(0x165667B19E3779F9), np.uint64(0x85EBCA77C2B2AE63))
OUT = "doc_id long, n_lines long, n_removed long, kept_text string"


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


class Lines:
    """Lines of a slice's documents in the order of doc_id, as one run of code points with running sums."""

    def __init__(self, batch: pa.RecordBatch):
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
        self.order = np.argsort(ids, kind="stable")
        self.ids = ids[self.order]
        self.texts = batch.column("text").take(pa.array(self.order)).to_pylist()
        self.fps = np.array([fingerprint(x) for x in self.texts], np.int64)
        points = np.frombuffer("\n".join(x or "" for x in self.texts).encode("utf-32-le"), np.uint32)
        doc_len = np.array([len(x or "") for x in self.texts], np.int64)
        doc_end = np.cumsum(doc_len + 1) - 1
        cut = np.flatnonzero(points == 10)
        self.start = np.concatenate([[0], cut + 1]).astype(np.int64)
        self.end = np.append(cut, len(points)).astype(np.int64)
        self.doc = np.searchsorted(doc_end, self.start, side="left")
        first = np.searchsorted(self.doc, np.arange(len(self.ids)))
        self.first = first
        self.no = np.arange(len(self.start)) - first[self.doc]
        solid = np.concatenate([[0], np.cumsum(~np.isin(points, WHITE))])
        self.solid = solid[self.end] - solid[self.start]
        self.points = points
        self.n = self.end - self.start

    def sums(self, which: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Running sums of value * base ** place, and base ** -place, of the points from lo to hi; with them the hash of any stretch, whatever lo is."""
        base = BASES[which]
        values = mixed(self.points[lo:hi].astype(np.uint64) + SALTS[which])
        values *= powers(base, len(values))
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)]), powers(inverse(base), len(values) + 1)

    def packed(self, lines: np.ndarray, *more: np.ndarray) -> bytes:
        docs = self.doc[lines]
        return dump(deltas(self.ids[docs]), self.fps[docs].astype(np.uint32), self.no[lines].astype(np.uint32), *more)


WHITE = np.array([ord(c) for c in " \t\v\f\r\xa0"], np.uint32)


def stretch(sums: np.ndarray, back: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (sums[b] - sums[a]) * back[a]


def blocks(start: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and last (excluded) of the lines that start in the same BLOCK points; start ascends."""
    cut = (np.flatnonzero(np.diff(start // BLOCK)) + 1).tolist()
    return zip([0, *cut], [*cut, len(start)], strict=True)


def spread(out: list[list], buckets: np.ndarray, kind: int, pack) -> None:
    order, found, cut = by_bucket(buckets)
    for k, x in enumerate(found):
        for c, v in zip(out, (x, kind, pack(order[cut[k] : cut[k + 1]])), strict=True):
            c.append(v)


def offered(buckets: int):
    """Each distinct line of a slice by its hash, and by its halves; lines that repeat within the slice are settled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SLICE):
            s = Lines(batch)
            out: list[list] = [[], [], []]
            lines = np.flatnonzero(s.solid >= LEAST)
            if not len(lines):
                continue
            n = s.n[lines]
            one, two, keys = np.empty(len(lines), np.uint64), np.empty(len(lines), np.uint64), np.empty((4, len(lines)), np.uint64)
            for x, y in blocks(s.start[lines]):
                lo, hi = int(s.start[lines[x]]), int(s.end[lines[y - 1]])
                a, b = s.start[lines[x:y]] - lo, s.end[lines[x:y]] - lo
                sums, back = s.sums(0, lo, hi)
                one[x:y] = mixed(stretch(sums, back, a, b) + n[x:y].astype(np.uint64))
                for shorter in (0, 1):  # as a line of its length, and as one longer than a line that lacks a character
                    m = n[x:y] - shorter
                    half, rest = m // 2, m - m // 2
                    keys[2 * shorter, x:y] = mixed(stretch(sums, back, a, a + half) ^ (m * 4).astype(np.uint64))
                    keys[2 * shorter + 1, x:y] = mixed(stretch(sums, back, b - rest, b) ^ (m * 4 + 1).astype(np.uint64))
                sums, back = s.sums(1, lo, hi)
                two[x:y] = mixed(stretch(sums, back, a, b) + n[x:y].astype(np.uint64))
            order = np.lexsort((np.arange(len(lines)), two, one))
            new = np.concatenate([[True], (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])])
            again, keep = lines[order[~new]], np.sort(order[new])
            first = lines[order[new]][np.cumsum(new) - 1][~new]
            again = again[(s.ids[s.doc[again]] != s.ids[s.doc[first]]) | (s.no[again] != s.no[first])]
            spread(out, s.ids[s.doc[again]] % buckets, 0, lambda i: s.packed(np.sort(again[i])))
            lines, one, two, n, keys = lines[keep], one[keep], two[keep], n[keep], keys[:, keep]
            spread(out, (one % np.uint64(buckets)).astype(np.int64), 1, lambda i: s.packed(lines[i], one[i], two[i]))
            near = np.flatnonzero(n >= LEAST_EDIT)
            low = (one[near] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            keys, owner = keys[:, near].reshape(-1), np.tile(near, 4)
            low = np.tile(low, 4)
            order = np.argsort(owner, kind="stable")
            keys, owner, low = keys[order], owner[order], low[order]
            spread(out, ((keys >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), 2, lambda i: s.packed(lines[owner[i]], (keys[i] & np.uint64(0xFFFFFFFF)).astype(np.uint32), low[i]))
            yield rows("packed", out)

    return run


def opened(values: list[bytes]) -> list[np.ndarray]:
    parts = []
    for v in values:
        ids, *more = load(v)
        parts.append([np.cumsum(ids), *more])
    return [np.concatenate(c) for c in zip(*parts, strict=True)]


def mark(ids: np.ndarray, fps: np.ndarray, no: np.ndarray, kind: int, out: list[list]) -> None:
    if not len(ids):
        return
    order = np.lexsort((no, fps, ids))
    ids, fps, no = ids[order], fps[order], no[order]
    first = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (fps[1:] != fps[:-1])]))
    for a, b in zip(first, np.append(first[1:], len(ids)), strict=True):
        out[0].append(int(ids[a]))
        out[1].append(int(fps[a]))
        out[2].append(kind)
        out[3].append(np.unique(no[a:b]).astype(np.uint32).tobytes())


def groups(*keys: np.ndarray) -> np.ndarray:
    """Where a new group begins, in arrays sorted by the keys."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def met(group: pa.Table) -> pa.Table:
    """In a bucket: all but the earliest of equal lines are marked 0; different lines that share a half are marked 1."""
    out: list[list] = [[], [], [], []]
    by: dict[int, list[bytes]] = {0: [], 1: [], 2: []}
    for k, v in zip(group.column("kind").to_pylist(), group.column("packed").to_pylist(), strict=True):
        by[k].append(v)
    if by[0]:
        ids, fps, no = opened(by[0])
        mark(ids, fps, no, 0, out)
    if by[1]:
        ids, fps, no, one, two = opened(by[1])
        order = np.lexsort((no, ids, two, one))
        new = groups(one[order], two[order])
        first = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
        again = order[(ids[order] != ids[first]) | (no[order] != no[first])]
        mark(ids[again], fps[again], no[again], 0, out)
    if by[2]:
        ids, fps, no, keys, low = opened(by[2])
        order = np.lexsort((low, keys))
        k, x = keys[order], low[order]
        new = groups(k)
        group_no = np.cumsum(new) - 1
        first, last = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(k)) - 1
        mixed_up = (x[first] != x[last])[group_no]
        at = order[mixed_up]
        mark(ids[at], fps[at], no[at], 1, out)
    return pa.Table.from_batches([rows("marks", out)])


def marked(batch: pa.RecordBatch, s: Lines, kind: int) -> np.ndarray:
    lists = batch.column("marks").to_pylist()
    out = [np.zeros(0, np.int64)]
    for k, i in enumerate(s.order.tolist()):
        for m in lists[i] or ():
            if m["kind"] == kind and m["fp"] == s.fps[k]:
                out.append(np.frombuffer(m["packed"], np.uint32).astype(np.int64) + s.first[k])
    return np.unique(np.concatenate(out))


def variants(buckets: int):
    """The whole line (place -1) and its variants by deleting each place, for the lines that may have a partner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SLICE):
            s = Lines(batch)
            known, near = marked(batch, s, 0), marked(batch, s, 1)
            near = np.setdiff1d(near, known)
            out: list[list] = [[], [], []]
            spread(out, s.ids[s.doc[known]] % buckets, 0, lambda i: s.packed(known[i]))
            if len(near):
                run_len = s.n[near] + 1
                for part in np.array_split(np.arange(len(near)), max(1, int(run_len.sum()) // 1_000_000)):
                    line, n = near[part], s.n[near[part]]
                    owner = np.repeat(np.arange(len(line)), n + 1)
                    place = np.arange(len(owner)) - np.repeat(np.cumsum(n + 1) - (n + 1), n + 1) - 1
                    one, two = np.empty(len(owner), np.uint64), np.empty(len(owner), np.uint32)
                    ends = np.cumsum(n + 1)
                    for x, y in blocks(s.start[line]):
                        u, v = int(ends[x] - n[x] - 1), int(ends[y - 1])
                        lo, hi = int(s.start[line[x]]), int(s.end[line[y - 1]])
                        a, b = s.start[line][owner[u:v]] - lo, s.end[line][owner[u:v]] - lo
                        cut = np.maximum(a + place[u:v], a)
                        skip = (place[u:v] >= 0).astype(np.int64)

                        def hashed(which: int) -> np.ndarray:
                            sums, back = s.sums(which, lo, hi)
                            head = sums[cut] - sums[a]
                            tail = (sums[b] - sums[cut + skip]) * np.where(skip > 0, inverse(BASES[which]), np.uint64(1))
                            return mixed((head + tail) * back[a] + (b - a - skip).astype(np.uint64))

                        one[u:v], two[u:v] = hashed(0), hashed(1) >> np.uint64(32)
                    spread(out, (one % np.uint64(buckets)).astype(np.int64), 1, lambda i: s.packed(line[owner[i]], one[i], two[i], place[i].astype(np.int32)))
            yield rows("packed", out)

    return run


def settled(group: pa.Table) -> pa.Table:
    """In a bucket: the lines that an earlier line with the same variant removes."""
    out: list[list] = [[], [], [], []]
    by: dict[int, list[bytes]] = {0: [], 1: []}
    for k, v in zip(group.column("kind").to_pylist(), group.column("packed").to_pylist(), strict=True):
        by[k].append(v)
    if by[0]:
        ids, fps, no = opened(by[0])
        mark(ids, fps, no, 0, out)
    if by[1]:
        ids, fps, no, one, two, place = opened(by[1])
        order = np.lexsort((no, ids, place, two, one))
        ids, fps, no, one, two, place = (x[order] for x in (ids, fps, no, one, two, place))
        same = groups(one, two, place)
        first = np.flatnonzero(same)[np.cumsum(same) - 1]  # the earliest with this variant and place: one substitution
        gone = (ids != ids[first]) | (no != no[first])
        every = groups(one, two)
        begin = np.flatnonzero(every)
        number = np.cumsum(every) - 1
        whole = place[begin] == -1  # sorted first: the line itself, if it is here
        raw_id, raw_no = ids[begin][number], no[begin][number]
        cut = place >= 0
        gone |= cut & whole[number] & ((raw_id < ids) | ((raw_id == ids) & (raw_no < no)))
        rank = np.lexsort((no, ids, ~cut, number))  # the earliest longer line of each group
        lead = rank[groups(number[rank])]
        longer = cut[lead]
        other_id, other_no = ids[lead][number], no[lead][number]
        gone |= ~cut & longer[number] & ((other_id < ids) | ((other_id == ids) & (other_no < no)))
        mark(ids[gone], fps[gone], no[gone], 0, out)
    return pa.Table.from_batches([rows("marks", out)])


def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, most=SLICE):
        lost = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
        marks = batch.column("marks").to_pylist()
        texts, n_lines, removed = [], [], []
        for text, found, none in zip(batch.column("text").to_pylist(), marks, lost.tolist(), strict=True):
            lines = [] if text is None else text.split("\n")
            fp = fingerprint(text) if found and not none else 0
            gone = {i for m in found or () if m["kind"] == 0 and m["fp"] == fp for i in np.frombuffer(m["packed"], np.uint32).tolist()}
            texts.append(None if text is None else "\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else text)
            n_lines.append(len(lines))
            removed.append(len(gone))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_lines, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string()), batch.column("extra")], names=["doc_id", "n_lines", "n_removed", "kept_text", "extra"])


def line_dedup(docs: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Removes each line of at least LEAST characters that equals an earlier line, or is one edit from one, where both have LEAST_EDIT.

    Earlier is by (doc_id, line number); lines are split at \\n and judged on the input; characters are code points, those that aren't
    white space count for LEAST. Returns doc_id, n_lines, n_removed and kept_text (the other lines, joined by \\n), a row for each row
    of docs, and extra: a struct of the columns that `extra` names, as they are. A null text stays null. A row without doc_id keeps all lines and removes none.
    Rows that share a doc_id are one document: lines of the same number don't remove each other, so rows that repeat come out alike.
    """
    size = text_bytes(docs)
    buckets = max(32, size // BUCKET_BYTES)
    more = F.struct(*[F.col(c) for c in extra] or [F.lit(0).alias("none")]).alias("extra")
    texts = texts_of(docs, more)
    dealt = texts.where("doc_id is not null").repartition(max(32, size // BUCKET_BYTES), "doc_id")

    def with_marks(found: DataFrame, how: str) -> DataFrame:
        each = found.groupBy("doc_id").agg(F.collect_list(F.struct("fp", "kind", "packed")).alias("marks"))
        return dealt.join(each.hint("shuffle_hash"), "doc_id", how)

    first = texts_of(docs).where("doc_id is not null and text is not null").mapInArrow(tidy(offered(buckets)), PACKED).repartition(buckets, "bucket").groupBy("bucket").applyInArrow(tidy_group(met), MARKS)
    second = with_marks(first, "inner").mapInArrow(tidy(variants(buckets)), PACKED).repartition(buckets, "bucket").groupBy("bucket").applyInArrow(tidy_group(settled), MARKS)
    unnamed = texts.where("doc_id is null").withColumn("marks", F.lit(None))
    return with_marks(second, "left").unionByName(unnamed).mapInArrow(tidy(kept), f"{OUT}, extra {texts.schema['extra'].dataType.simpleString()}")


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
