"""N-gram Jaccard join by set-relation skipping, and its components.

Sets are word shingles; two link when 100 * |x and y| >= percent * |x or y|. Rare shingles come first in a global order (those
that many documents share are counted over all documents and come last), and each set is indexed under its first shingles,
its prefix, by size and position. Linked sets share a prefix shingle. Lists skip by relations of their sets:

* Equal sets are one set, by a 128-bit sum of shingle hashes; a slice of documents offers it once.
* Within a list, sets are ordered by size; a set is first compared to a few centres of the list and to the leader of its range of sizes.
  What their answers reach need not be asked again: pairs inside a component are skipped.
* Only lists that then still hold several components are probed whole. Their entries are blocked by position: a block whose
  best position can't leave enough shingles for the overlap is skipped, and within a block all but a range of sizes.

Exact parity bitmaps, written with the index, rule most pairs out. The others meet in cells, a hub and the sets that are to be compared
to it, whose whole texts travel once. A cell computes the hub's answers, and derives those of a set that the hub doesn't link from
them: with the shingles that two sets lack of the hub and have beyond it, their overlap is known without comparing them.
Components are smallest ids by label propagation with pointer jumping, on links between different sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bucket, deltas, dump, load, mixed, rolling, slices, stored, text_bytes, tidy, tidy_group, word_hashes, words_of
from .labelled import texts_of

GRAM, PERCENT = 3, 90
BUCKET_BYTES = 8_000_000
#: Text bytes that a Python worker holds as sets at once.
HELD_BYTES = 4_000_000
#: Shingles in so many documents of a slice are reported; those in so many of all may come last in the order, the commonest first among
#: HEAVY. This orders the index only; answers don't depend on it.
LOCAL, COMMON, HEAVY = 4, 40, 100_000
#: Sets of a list that all its others are compared to at first.
CENTRES = 3
#: Members of a cell at most; a hub with more has several cells.
CELL = 512
#: Bits of the filter that keeps texts which no pair names from travelling: WORDS rows are broadcast at most. It lets some others through.
WORDS = 1 << 19
INDEX = "kind int, bucket int, packed binary, doc_id long, n long, f1 long, f2 long, map binary"
FOUND = "kind int, a long, b long, list long, n int, pos int"


class Sets:
    """Distinct shingle hashes of each text, in the order of the documents' ids."""

    def __init__(self, batch: pa.RecordBatch, gram: int):
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        flat, offsets = words_of(pc.ascii_lower(batch.column("text").take(pa.array(order))))
        hashes, _ = word_hashes(flat)
        counts = np.diff(offsets)
        doc = np.repeat(np.arange(len(counts)), counts)
        left = offsets[doc + 1] - np.arange(len(hashes))
        whole = rolling(np.append(hashes, np.zeros(gram - 1, np.uint64)), gram) if len(hashes) else hashes
        keep = left >= gram
        short = np.flatnonzero((counts > 0) & (counts < gram))
        for d in short.tolist():  # the whole sequence is the one shingle
            value = np.uint64(counts[d])
            for h in hashes[offsets[d] : offsets[d + 1]]:
                value = mixed(np.array([value ^ h]))[0]
            whole[offsets[d]] = value
            keep[offsets[d]] = True
        doc, whole = doc[keep], whole[keep]
        order = np.argsort(whole)
        order = order[np.argsort(doc[order].astype(np.uint16) if len(counts) < 65536 else doc[order], kind="stable")]
        doc, whole = doc[order], whole[order]
        new = np.ones(len(whole), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (whole[1:] != whole[:-1])
        self.doc, self.hashes = doc[new], whole[new]
        self.n = np.bincount(self.doc, minlength=len(counts))
        self.offsets = np.concatenate([[0], np.cumsum(self.n)])

    def sums(self, salt: int) -> np.ndarray:
        out = np.zeros(len(self.n), np.uint64)
        full = np.flatnonzero(self.n)
        if len(full):
            out[full] = np.add.reduceat(mixed(self.hashes ^ np.uint64(salt)), self.offsets[full])
        return out


def needed(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap of linked sets of n and m."""
    return -(-percent * (n + m) // (100 + percent))


def common(gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=HELD_BYTES):
            found, counts = np.unique(Sets(batch, gram).hashes, return_counts=True)
            many = counts >= LOCAL
            yield pa.RecordBatch.from_arrays([pa.array(found[many].view(np.int64)), pa.array(counts[many].astype(np.int64))], names=["h", "c"])

    return run


def indexed(gram: int, percent: int, buckets: int, heavy: np.ndarray, rank: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=HELD_BYTES):
            s = Sets(batch, gram)
            f1, f2 = s.sums(0x51ED270B7F4A7C15), s.sums(0x2545F4914F6CDD1D)
            some = len(s.ids)
            columns: list[list] = [[0] * some, [0] * some, [None] * some]
            _, first = np.unique(np.stack([f1, f2, s.n.astype(np.uint64)]), axis=1, return_index=True)
            mine = np.zeros(some, bool)
            mine[first] = True
            mine &= s.n > 0
            at = np.searchsorted(heavy, s.hashes) if len(heavy) else np.zeros(len(s.hashes), np.int64)
            last = np.zeros(len(s.hashes), np.int64)
            if len(heavy):
                at = np.minimum(at, len(heavy) - 1)
                last = np.where(heavy[at] == s.hashes, rank[at] + 1, 0)
            order = np.lexsort((s.hashes, last, s.doc))
            pos = np.arange(len(order)) - s.offsets[s.doc]
            n = s.n[s.doc]
            prefix = n - -(-percent * n // 100) + 1
            take = np.flatnonzero((pos < prefix) & mine[s.doc])
            doc, pos, hashes = s.doc[take], pos[take], s.hashes[order[take]]
            where, found, cut = by_bucket((hashes >> np.uint64(32)).astype(np.int64) % buckets)
            for k, x in enumerate(found):
                i = where[cut[k] : cut[k + 1]]
                d = doc[i]
                columns[0].append(1)
                columns[1].append(int(x))
                columns[2].append(dump(deltas(s.ids[d]), f1[d], s.n[d].astype(np.uint32), pos[i].astype(np.uint32), (hashes[i] & np.uint64(0xFFFFFFFF)).astype(np.uint32)))
            more = len(columns[0]) - some
            tail = [None] * more
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary())] + [pa.array([*x.tolist(), *tail], pa.int64()) for x in (s.ids, s.n, f1.view(np.int64), f2.view(np.int64))] + [pa.array([*parities(s), *tail], pa.binary())],
                names=["kind", "bucket", "packed", "doc_id", "n", "f1", "f2", "map"],
            )

    return run


def fits(n: np.ndarray, p: np.ndarray, m: np.ndarray, q: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of n and m that first meet at positions p and q may link."""
    return (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (np.minimum(n - p, m - q) >= needed(n, m, percent))


def led(percent: int):
    """In a bucket's lists: pairs with centres and leader (kind 0), and the entries of longer lists (kind 1)."""

    def run(group: pa.Table) -> pa.Table:
        parts = [load(v) for v in group.column("packed").to_pylist()]
        ids, fps, n, pos, tokens = (np.concatenate(c) for c in zip(*[[np.cumsum(p[0]), *p[1:]] for p in parts], strict=True))
        # lists of one entry are most of all
        order = np.argsort(tokens, kind="stable")
        t = tokens[order]
        again = np.zeros(len(t), bool)
        again[1:] = t[1:] == t[:-1]
        again[:-1] |= again[1:]
        order = order[again]
        order = order[np.lexsort((ids[order], fps[order], n[order], tokens[order]))]
        tokens, n, fps, ids, pos = tokens[order], n[order].astype(np.int64), fps[order], ids[order], pos[order].astype(np.int64)
        new = np.ones(len(tokens), bool)  # the same set of other slices: the smallest id stands for it
        new[1:] = (tokens[1:] != tokens[:-1]) | (n[1:] != n[:-1]) | (fps[1:] != fps[:-1])
        tokens, n, ids, pos = tokens[new], n[new], ids[new], pos[new]
        begin = np.ones(len(tokens), bool)
        begin[1:] = tokens[1:] != tokens[:-1]
        first = np.flatnonzero(begin)
        number = np.cumsum(begin) - 1
        length = np.diff(np.append(first, len(tokens)))
        at = np.arange(len(tokens))
        # the leader is the first of a range of sizes that may link with one another
        sizes = (np.log(np.maximum(n, 1)) / np.log(100 / min(percent, 99))).astype(np.int64)
        lead = begin.copy()
        lead[1:] |= sizes[1:] != sizes[:-1]
        pairs = [(at, np.flatnonzero(lead)[np.cumsum(lead) - 1] if len(at) else at)]
        # the entries that stand first in their own prefixes have the fewest rare shingles: the centres of a group of near copies
        by_place = np.lexsort((ids, pos, number))
        for c in range(CENTRES):
            pairs.append((at, by_place[np.minimum(first + c, first + length - 1)][number]))
        i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
        ok = (ids[i] != ids[j]) & fits(n[i], pos[i], n[j], pos[j], percent)
        found = np.unique(np.stack([np.minimum(ids[i[ok]], ids[j[ok]]), np.maximum(ids[i[ok]], ids[j[ok]])]), axis=1)
        rest = np.flatnonzero(length[number] > 2)
        where = (group.column("bucket")[0].as_py() << 32) | tokens[rest].astype(np.int64)
        k, m = found.shape[1], len(rest)
        columns = [
            pa.array(np.repeat([0, 1], [k, m]), pa.int32()), pa.array(np.concatenate([found[0], ids[rest]]), pa.int64()), pa.concat_arrays([pa.array(found[1], pa.int64()), pa.nulls(m, pa.int64())]),
            *(pa.concat_arrays([pa.nulls(k, t), pa.array(c, t)]) for c, t in ((where, pa.int64()), (n[rest], pa.int32()), (pos[rest], pa.int32()))),
        ]
        return pa.table(columns, names=["kind", "a", "b", "list", "n", "pos"])

    return run


def probed(percent: int, width: int = 8, small: int = 128):
    """All pairs of a list that may link, of different components. Rows come sorted by list.

    A short list is compared whole; a longer one by blocks of position, and ranges of size within.
    """

    def pairs(n: np.ndarray, pos: np.ndarray, comp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def sift(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            ok = (comp[i] != comp[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])) & (np.minimum(n[i] - pos[i], n[j] - pos[j]) >= needed(n[i], n[j], percent))
            return i[ok], j[ok]

        if len(n) <= small:
            return sift(*np.triu_indices(len(n), 1))
        found = []
        number = pos // width
        for block in np.unique(number):
            at = np.flatnonzero(number == block)
            at = at[np.argsort(n[at], kind="stable")]
            sizes = n[at]
            for i in range(len(n)):
                # the most that this block's sets can still share with this one, against the least that they must
                lo = np.searchsorted(sizes, -(-percent * n[i] // 100), side="left")
                hi = np.searchsorted(sizes, n[i], side="right")
                if lo == hi or min(n[i] - pos[i], sizes[hi - 1] - block * width) < needed(n[i], sizes[lo], percent):
                    continue
                j = at[lo:hi]
                j = j[(n[j] < n[i]) | (j < i)]
                found.append(sift(np.full(len(j), i), j))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(columns: list[np.ndarray]) -> pa.RecordBatch:
            lists, ids, n, pos, comp = columns
            first = np.flatnonzero(np.concatenate([[True], lists[1:] != lists[:-1]])) if len(lists) else np.zeros(0, np.int64)
            left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for x, y in zip(first.tolist(), [*first[1:].tolist(), len(lists)], strict=False):
                i, j = pairs(n[x:y], pos[x:y], comp[x:y])
                left.append(ids[x + i])
                right.append(ids[x + j])
            a, b = np.concatenate(left), np.concatenate(right)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        held = None
        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("list", "a", "n", "pos", "comp")]
            if held is not None:
                columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
            last = np.searchsorted(columns[0], columns[0][-1], side="left") if len(columns[0]) else 0
            held = [c[last:] for c in columns]  # the last list may go on
            if last:
                yield linked([c[:last] for c in columns])
        if held is not None:
            yield linked(held)

    return run


def bits_of(n: int) -> int:
    return 1 << max(10, int(2 * n - 1).bit_length())


def parities(s: Sets) -> list[bytes | None]:
    """A bitmap of each set, of twice as many bits as shingles or more: each shingle flips one bit."""
    maps: list[bytes | None] = []
    for a, b in zip(s.offsets[:-1].tolist(), s.offsets[1:].tolist(), strict=True):
        size = bits_of(b - a)
        maps.append(np.packbits(np.bincount((s.hashes[a:b] & np.uint64(size - 1)).astype(np.int64), minlength=size).astype(np.uint8) & 1).tobytes() if b > a else None)
    return maps


def near(percent: int):
    """The pairs whose bitmaps differ in no more bits than linked sets may: a shingle that one set lacks flips at most one bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yes = []
            for n, m, x, y in zip(*(batch.column(c).to_pylist() for c in ("n", "m", "x", "y")), strict=True):
                x, y = np.unpackbits(np.frombuffer(x, np.uint8)), np.unpackbits(np.frombuffer(y, np.uint8))
                while len(x) != len(y):  # the larger one folds onto half its places
                    if len(x) > len(y):
                        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
                    else:
                        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
                both = -(-percent * (n + m) // (100 + percent))
                yes.append(int((x ^ y).sum()) <= n + m - 2 * both)
            at = pa.array(np.flatnonzero(yes))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at)], names=["a", "b"])

    return run


def answers(hub: np.ndarray, members: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links of a cell as pairs of numbers of members; -1 is the hub. A member that the hub doesn't link gets one link that the hub's answers give it, if there is one."""
    if not len(hub) or not members:
        return []
    n = np.array([len(m) for m in members])
    owner, all_of = np.repeat(np.arange(len(n)), n), np.concatenate(members)
    at = np.minimum(np.searchsorted(hub, all_of), len(hub) - 1)
    inside = hub[at] == all_of
    shared = np.bincount(owner[inside], minlength=len(n))
    yes = 100 * shared >= percent * (len(hub) + n - shared)
    out = [(-1, i) for i in np.flatnonzero(yes).tolist()]
    open_ = np.flatnonzero(~yes)
    if not len(open_) or len(n) < 2:
        return out
    lacks = np.ones((len(n), len(hub)), np.float32)  # what a member lacks of the hub
    lacks[owner[inside], at[inside]] = 0
    order = np.argsort(all_of[~inside], kind="stable")  # and what it has beyond it
    beyond, whose = all_of[~inside][order], owner[~inside][order]
    for f in open_.tolist():
        mine = beyond[whose == f]
        low, high = np.searchsorted(beyond, mine, side="left"), np.searchsorted(beyond, mine, side="right")
        places = np.repeat(low, high - low) + np.arange((high - low).sum()) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
        overlap = shared[f] + shared - len(hub) + (lacks @ lacks[f]).astype(np.int64) + np.bincount(whose[places], minlength=len(n))
        link = 100 * overlap >= percent * (n + n[f] - overlap)
        link[f] = False
        best = np.flatnonzero(link & yes) if (link & yes).any() else np.flatnonzero(link)
        out += [(int(best[0]), f)] if len(best) else []
    return out


def compared(gram: int, percent: int):
    """Links of cells; rows come sorted by cell, a cell's hub first. A cell that is longer than a slice is answered in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, hubs = None, []
        for batch in slices(batches, most=HELD_BYTES):
            s = Sets(pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column("text")], names=["doc_id", "text"]), gram)
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("hub", "salt")), strict=True))
            ids, is_member = batch.column("doc_id").to_pylist(), batch.column("member").to_pylist()
            sets = [s.hashes[a:b] for a, b in zip(s.offsets[:-1].tolist(), s.offsets[1:].tolist(), strict=True)]
            out: list[list[int]] = [[], []]
            i = 0
            while i < len(keys):
                if keys[i] != cell:
                    cell, hubs = keys[i], []
                j = i
                while j < len(keys) and keys[j] == cell:
                    j += 1
                hubs += [sets[x].copy() for x in range(i, j) if not is_member[x]]
                members = [x for x in range(i, j) if is_member[x]]
                for hub in hubs:
                    for x, y in answers(hub, [sets[m] for m in members], percent):
                        a, b = cell[0] if x < 0 else ids[members[x]], ids[members[y]]
                        out[0].append(min(a, b))
                        out[1].append(max(a, b))
                i = j
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["a", "b"])

    return run


def named(ids: DataFrame, texts: DataFrame) -> DataFrame:
    """The texts whose id is among ids, and some others: by a bitmap of a fixed number of bits, of which WORDS rows are broadcast at most."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(WORDS * 32))
    words = ids.select(F.shiftright(place, 5).alias("w"), F.expr("shiftleft(1L, cast(pmod(xxhash64(doc_id), 32) as int))").alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("bits"))
    bit = F.expr("shiftleft(1L, cast(pmod(xxhash64(doc_id), 32) as int))")
    return texts.join(F.broadcast(words), F.shiftright(place, 5) == F.col("w")).where(F.col("bits").bitwiseAND(bit) != 0).select("doc_id", "text")


def in_cells(pairs: DataFrame, texts: DataFrame, gram: int, percent: int, tasks: int) -> DataFrame:
    """Links among the hubs and members that pairs (hub, doc_id) name, those of all pairs among them."""
    salts = pairs.groupBy("hub").agg(F.ceil(F.count("*") / CELL).cast("int").alias("salts"))
    members = pairs.join(salts, "hub").select("doc_id", "hub", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int").alias("salt"), F.lit(True).alias("member"))
    hubs = salts.select(F.col("hub").alias("doc_id"), "hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(False).alias("member"))
    wanted = stored(members.unionByName(hubs), "wanted")
    rows = named(wanted.select("doc_id"), texts).join(wanted.hint("shuffle_hash"), "doc_id").select("hub", "salt", "member", "doc_id", "text")
    cells = rows.repartition(tasks, "hub", "salt").sortWithinPartitions("hub", "salt", "member", "doc_id")
    return stored(cells.mapInArrow(tidy(compared(gram, percent)), "a long, b long").distinct(), "links")


def verified(pairs: DataFrame, members: DataFrame, texts: DataFrame, gram: int, percent: int, tasks: int) -> DataFrame:
    """Links that join what all pairs (a < b, a table) that link would join: those that bitmaps can't rule out, by whole sets.

    Each set meets its smallest partner first; then the pairs whose ends aren't in one component by that.
    """
    maps = members.select("doc_id", "n", "map").where("n > 0")
    half = pairs.join(maps.select(F.col("doc_id").alias("a"), "n", F.col("map").alias("x")).hint("merge"), "a")
    both = half.join(maps.select(F.col("doc_id").alias("b"), F.col("n").alias("m"), F.col("map").alias("y")).hint("merge"), "b")
    close = stored(both.select("a", "b", "n", "m", "x", "y").mapInArrow(tidy(near(percent)), "a long, b long").distinct(), "near")
    links = in_cells(close.groupBy(F.col("b").alias("doc_id")).agg(F.min("a").alias("hub")), texts, gram, percent, tasks)
    labels = components(links)
    far = close.join(labels.select(F.col("v").alias("a"), F.col("l").alias("x")), "a", "left").join(labels.select(F.col("v").alias("b"), F.col("l").alias("y")), "b", "left")
    rest = far.where(F.coalesce("x", "a") != F.coalesce("y", "b")).select("a", "b").join(close.groupBy("b").agg(F.min("a").alias("a")), ["a", "b"], "left_anti")
    more = in_cells(stored(rest.select(F.col("a").alias("hub"), F.col("b").alias("doc_id")), "rest"), texts, gram, percent, tasks)
    return links.unionByName(more)


def components(links: DataFrame) -> DataFrame:
    """v and the smallest id that it reaches, for each id that links name."""
    both = stored(links.select("a", "b").union(links.select("b", "a")), "edges")
    labels = stored(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("l")), "labels")
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), "l"), "b").groupBy(F.col("a").alias("v")).agg(F.min("l").alias("m"))
        low = labels.join(near, "v").select("v", F.col("l").alias("was"), F.least("l", "m").alias("l"))
        jump = labels.select(F.col("v").alias("l"), F.col("l").alias("far"))
        after = stored(low.join(jump, "l", "left").select("v", "was", F.least("l", F.coalesce("far", "l")).alias("l")), "labels")
        if after.where("l < was").isEmpty():
            return after.select("v", "l")
        labels = after.select("v", "l")


def jaccard_join(docs: DataFrame, gram: int = GRAM, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles (distinct shingles of `gram` words) and component_id, a row for each row of docs.

    Words are runs of anything but white space (bytes 9 to 13 and 32), with A-Z in lower case. A text of fewer words has its whole
    sequence as the one shingle; a null text or one without words has none and links with nothing: its component is itself.
    component_id is the smallest doc_id reachable by links, itself included. Rows that share a doc_id are one document in
    links, also where their texts differ. A null doc_id takes no part and has a null component. Other columns are ignored.
    """
    texts = texts_of(docs)
    known = texts.where("doc_id is not null")
    buckets = max(32, text_bytes(docs) // BUCKET_BYTES)
    counts = known.mapInArrow(tidy(common(gram)), "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= COMMON)
    rows = sorted(((r["c"], r["h"]) for r in counts.orderBy(F.desc("c"), "h").limit(HEAVY).collect()))
    heavy = np.array([h for _, h in rows], np.int64).view(np.uint64)
    by_hash = np.argsort(heavy)
    index = stored(known.mapInArrow(tidy(indexed(gram, percent, buckets, heavy[by_hash], by_hash)), INDEX), "index")
    members = index.where("kind = 0").select("doc_id", "n", "f1", "f2", "map")
    lists = index.where("kind = 1").select("bucket", "packed").repartition(buckets, "bucket")
    found = stored(lists.groupBy("bucket").applyInArrow(tidy_group(led(percent)), FOUND), "lists")
    pairs = stored(found.where("kind = 0").select("a", "b").distinct(), "pairs")
    links = verified(pairs, members, known, gram, percent, buckets)
    entries = found.where("kind = 1").select("list", "a", "n", "pos")
    labels = components(links).select(F.col("v").alias("a"), F.col("l"))
    entries = entries.join(labels, "a", "left").select("list", "a", "n", "pos", F.coalesce("l", "a").alias("comp"))
    open_lists = stored(entries.groupBy("list").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("list"), "open")
    rest = entries.join(open_lists, "list").repartition("list").sortWithinPartitions("list").mapInArrow(tidy(probed(percent)), "a long, b long").distinct().join(pairs, ["a", "b"], "left_anti")
    more = verified(stored(rest, "pairs"), members, known, gram, percent, buckets)
    # components found first stand for their sets: each set's link to its component, and links between components
    one, two = labels.select("a", F.col("l").alias("x")), labels.select(F.col("a").alias("b"), F.col("l").alias("y"))
    across = more.join(one, "a", "left").join(two, "b", "left").select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")).distinct()
    links = labels.select("a", F.col("l").alias("b")).union(across).where("a <> b")
    # equal sets are one class, named by its smallest id; links join classes, and so does a document of several texts
    full = members.where("n > 0").select("doc_id", "n", "f1", "f2")
    classes = stored(full.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep")), "classes")
    of = stored(full.join(classes, ["f1", "f2", "n"]).select("doc_id", "rep").distinct(), "members")
    mine = of.groupBy("doc_id").agg(F.min("rep").alias("rep"), F.max("rep").alias("last"))
    ends = links.join(of.select(F.col("doc_id").alias("a"), F.col("rep").alias("ra")), "a").join(of.select(F.col("doc_id").alias("b"), F.col("rep").alias("rb")), "b")
    twofold = of.join(mine.where("rep < last").select("doc_id", F.col("rep").alias("ra")), "doc_id").select("ra", F.col("rep").alias("rb"))
    reps = components(ends.select("ra", "rb").union(twofold).where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
    named_by = mine.join(reps.select(F.col("v").alias("rep"), "l"), "rep", "left").select("doc_id", F.coalesce("l", "rep").alias("l"))
    part = members.select("doc_id", F.col("n").alias("n_shingles")).join(named_by, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("l", "doc_id").alias("component_id"))
    lost = texts.where("doc_id is null").select(F.col("doc_id").alias("was"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "text").mapInArrow(tidy(sizes(gram)), "doc_id long, n_shingles long, component_id long")
    return part.unionByName(lost)


def sizes(gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=HELD_BYTES):
            n = Sets(batch, gram).n
            none = pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.array(n.astype(np.int64)), none], names=["doc_id", "n_shingles", "component_id"])

    return run


def op2_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
