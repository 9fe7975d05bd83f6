"""BPE encoding and decoding by tree concatenation.

A long text is cut into halves, those into halves, down to leaves of at most `leaf` characters. Leaves are rows of their own, dealt
over tasks and encoded in parallel, then joined pairwise up the tree: the text around the join is encoded again in a
window that grows until its first and last tokens agree with what the left and right halves hold there, token by token and
place by place; only what lies between is replaced. Where the window reaches both ends, it is the direct encoding.

A text of a leaf or less is encoded directly; pre-tokens never cross white space, so equal runs between white space are encoded once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import deltas, dump, load, slices, text_bytes, tidy, words_of

#: Characters of a leaf; a text of up to that many is encoded directly.
LEAF = 32_768
#: Tokens on each side of a join that are encoded again at first.
GROW = 8
#: Text bytes that a task of leaves gets, about, and tasks that the copies of one long text are dealt over at most.
TASK_BYTES, SALTS = 8_000_000, 64
#: Leaves that a worker sends at once, runs that it encodes at once, characters of a line of them, runs that it keeps, and text bytes that it holds.
HELD, RUNS, LINE, KNOWN, HELD_BYTES = 32, 8_000, 800, 400_000, 2_000_000
VOCABULARY = "word_bpe_49k.json"
OUT = "doc_id long, ids array<int>, decoded string"
LEAVES = "key binary, salt int, no int, doc_id long, text string, packed binary"


def tokenizer(path: str):
    """The tokenizer of a file; each task opens it once."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallel part
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


class Piece:
    """Tokens of a stretch of text, with each token's first and last character there."""

    __slots__ = ("ends", "ids", "starts", "text")

    def __init__(self, text: str, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.text, self.ids, self.starts, self.ends = text, ids, starts, ends

    def agrees(self, a: int, other: Piece, b: int, n: int, shift: int) -> bool:
        """Whether n tokens from a are the other's from b, which lie `shift` characters further on here."""
        mine, its = slice(a, a + n), slice(b, b + n)
        return all(map(np.array_equal, (self.ids[mine], self.starts[mine], self.ends[mine]), (other.ids[its], other.starts[its] + shift, other.ends[its] + shift)))


def piece(text: str, found) -> Piece:
    spans = np.array(found.offsets, np.int64).reshape(-1, 2)
    return Piece(text, np.array(found.ids, np.int32), spans[:, 0], spans[:, 1])


class Runs:
    """Runs between white space, each encoded once: counts of tokens, where they start in ids, and their places from the run's start.

    At most KNOWN runs are kept, or those of one call; beyond that all are forgotten, and encoded again when they come again.
    """

    def __init__(self, tok, decode: bool = False):
        self.tok, self.decode = tok, decode
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        none = np.zeros(0, np.int64)
        self.counts, self.first, self.ids, self.starts, self.ends = none, none, none.astype(np.int32), none.astype(np.int32), none.astype(np.int32)
        self.said = pa.array([], pa.string())

    def numbers(self, runs: list[str]) -> np.ndarray:
        """The number of each run here."""
        new = [r for r in dict.fromkeys(runs) if r not in self.known]
        if len(self.known) + len(new) > KNOWN and self.known:
            self.forget()
            new = list(dict.fromkeys(runs))
        if new:
            found = [self.learned(new[k : k + RUNS]) for k in range(0, len(new), RUNS)]
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.counts, self.ids, self.starts, self.ends = (np.concatenate([old, *more]) for old, more in zip((self.counts, self.ids, self.starts, self.ends), zip(*(f[:4] for f in found), strict=True), strict=True))
            self.first = np.cumsum(self.counts) - self.counts
            self.said = pa.concat_arrays([self.said, *(f[4] for f in found)])
        return np.fromiter(map(self.known.__getitem__, runs), np.int64, len(runs))

    def learned(self, runs: list[str]) -> tuple:
        """Encodes runs, many to a line, and deals a line's tokens by where they start: counts, ids, starts, ends, decoded."""
        places = np.cumsum([0, *(len(r) + 1 for r in runs)])
        cuts = [0, *(np.flatnonzero(np.diff(places[:-1] // LINE)) + 1).tolist(), len(runs)]
        found = self.tok.encode_batch([" ".join(runs[x:y]) for x, y in zip(cuts[:-1], cuts[1:], strict=True)], add_special_tokens=False)
        ids = list(chain.from_iterable(e.ids for e in found))
        spans = np.fromiter(chain.from_iterable(chain.from_iterable(e.offsets for e in found)), np.int64, 2 * len(ids)).reshape(-1, 2)
        spans += np.repeat(places[cuts[:-1]], [len(e) for e in found])[:, None]
        owner = np.searchsorted(places, spans[:, 0], side="right") - 1
        spans -= places[owner][:, None]
        counts = np.bincount(owner, minlength=len(runs))
        ends = np.cumsum(counts)
        said = [self.tok.decode(ids[x:y], skip_special_tokens=False) if x < y else "" for x, y in zip((ends - counts).tolist(), ends.tolist(), strict=True)] if self.decode else []
        return counts, np.array(ids, np.int32), spans[:, 0].astype(np.int32), spans[:, 1].astype(np.int32), pa.array(said, pa.string())


def encoded(runs: Runs, text: str) -> Piece:
    """The direct encoding of a text, by its runs."""
    signs = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    solid = ~((signs == 32) | ((signs >= 9) & (signs <= 13)))
    first = np.flatnonzero(solid & ~np.concatenate([[False], solid[:-1]]))
    codes = runs.numbers(re.findall(r"[^\x20\x09-\x0D]+", text))
    at, counts = runs.first[codes], runs.counts[codes]
    shift = np.repeat(first, counts)
    return Piece(text, ragged(runs.ids, at, counts), ragged(runs.starts, at, counts) + shift, ragged(runs.ends, at, counts) + shift)


def concatenated(tok, left: Piece, right: Piece, grow: int = GROW) -> Piece:
    """The encoding of left.text + right.text."""
    text, n = left.text + right.text, len(left.text)
    back = forth = grow
    while True:
        a, b = max(0, len(left.ids) - back), min(len(right.ids), forth)
        start = int(left.starts[a]) if a else 0
        end = n + int(right.ends[b - 1]) if b < len(right.ids) else len(text)
        w = piece(text[start:end], tok.encode(text[start:end], add_special_tokens=False))
        # the first and last half of the window's old tokens must come out as they were, at their places
        keep_a, keep_b = (len(left.ids) - a) // 2 if a else 0, b // 2 if b < len(right.ids) else 0
        fits_a = not a or (keep_a > 0 and w.agrees(0, left, a, keep_a, -start) and boundary(left, a, keep_a))
        fits_b = b == len(right.ids) or (0 < keep_b <= len(w.ids) and w.agrees(len(w.ids) - keep_b, right, b - keep_b, keep_b, n - start) and boundary(right, b - keep_b, keep_b))
        if fits_a and fits_b:
            ids = np.concatenate([left.ids[:a], w.ids, right.ids[b:]])
            return Piece(text, ids, *(np.concatenate([x[:a], y + start, z[b:] + n]) for x, y, z in ((left.starts, w.starts, right.starts), (left.ends, w.ends, right.ends))))
        back, forth = back if fits_a else back * 2, forth if fits_b else forth * 2


def kind(c: str) -> str:
    return "letter" if c.isalpha() else "number" if c.isnumeric() else "other"


def boundary(p: Piece, first: int, count: int) -> bool:
    """Whether a pre-token surely ends among these tokens: only there is what lies on one side free of the other.

    White space; or a letter after a number, a number after a letter, or two numbers, in plain ASCII, so that no normalising joins them.
    """
    starts, ends = p.starts[first : first + count].tolist(), p.ends[first : first + count].tolist()
    for before, i in zip(ends[:-1], starts[1:], strict=True):
        if any(c in " \t\n\r\v\f" for c in p.text[before:i]):
            return True
        x, y = p.text[i - 1], p.text[i : i + 1]
        if before == i and x.isascii() and y.isascii() and x.isalnum() and y.isalnum() and "number" in (kind(x), kind(y)):
            return True
    return False


def halves(text: str, leaf: int) -> list[str]:
    """The text's leaves, in order."""
    parts = [text]
    while max(map(len, parts)) > leaf:
        parts = [h for p in parts for h in ((p[: len(p) // 2], p[len(p) // 2 :]) if len(p) > 1 else (p,))]
    return parts


def grown(tok, level: list[Piece]) -> Piece:
    """The encoding of the leaves' whole text."""
    while len(level) > 1:
        level = [concatenated(tok, *level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def tree(tok, text: str, leaf: int = LEAF) -> Piece:
    """The encoding of one text, from its leaves upwards, in one place."""
    runs = Runs(tok)
    return grown(tok, [encoded(runs, t) for t in halves(text, leaf)])


def ragged(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """values[s : s + n] for each start and count, one after another."""
    total = np.cumsum(counts)
    n = int(total[-1]) if len(total) else 0
    return values[np.arange(n) + np.repeat(starts - (total - counts), counts)]


def encoder(path: str):
    """Whole short texts, by their runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs(tokenizer(path), decode=True)
        for batch in slices(batches, most=HELD_BYTES):
            # a sign after a Latin letter (which stays a letter in any case and normal form) is a pre-token of its own; apart from it, the word has been seen before
            flat, offsets = words_of(pc.replace_substring_regex(batch.column("text"), r"([A-Za-zÀ-ÖØ-öø-ÿ])([.,;:!?])(\s|$)", r"\1 \2\3"))
            coded = flat.dictionary_encode()
            codes = runs.numbers(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
            counts = runs.counts[codes]
            ids = ragged(runs.ids, runs.first[codes], counts)
            ends = np.concatenate([[0], np.cumsum(counts)])[offsets]
            said = runs.said.take(pa.array(codes))
            some = counts > 0  # a run without tokens leaves no gap
            at = np.concatenate([[0], np.cumsum(some)])[offsets]
            decoded = pc.binary_join(pa.ListArray.from_arrays(pa.array(at, pa.int32()), said.filter(pa.array(some))), " ")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())), decoded.cast(pa.string())], names=["doc_id", "ids", "decoded"])

    return run


def leaf_rows(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.binary())
    columns = list(zip(*rows, strict=True)) if rows else [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["key", "salt", "no", "doc_id", "text", "packed"])


def cut(leaf: int):
    """For each long text a row that claims its encoding (no -1), and its leaves. Copies of a text share a key, up to their salt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=HELD_BYTES):
            rows: list[tuple] = []
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                key, salt = hashlib.sha256(text.encode()).digest()[:20], hash(i or 0) % SALTS
                rows.append((key, salt, -1, i, None, None))
                rows += [(key, salt, no, None, part, None) for no, part in enumerate(halves(text, leaf))]
            yield leaf_rows(rows)

    return run


def distinct_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of sorted batches, a leaf that repeats only once."""
    last = None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[2] < 0 or row[:3] != last:
                yield row
            last = row[:3]


def leaves(path: str):
    """Each leaf with its tokens and their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs(tokenizer(path))
        held: list[tuple] = []

        def flushed() -> pa.RecordBatch:
            told = (encoded(runs, r[4]) for r in held if r[2] >= 0)
            packs = (dump(p.ids, deltas(p.starts.astype(np.int32)), (p.ends - p.starts).astype(np.int32)) for p in told)
            return leaf_rows([(*r[:5], next(packs) if r[2] >= 0 else None) for r in held])

        for row in distinct_leaves(batches):
            held.append(row)
            if len(held) >= HELD:
                yield flushed()
                held = []
        if held:
            yield flushed()

    return run


def joined(path: str):
    """The rows that claim a text, with its tokens: a text at a time, its leaves joined up the tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        key, claims, parts = None, [], []

        def whole() -> pa.RecordBatch:
            ids = grown(tok, parts).ids.tolist()
            said = tok.decode(ids, skip_special_tokens=False)
            return pa.RecordBatch.from_arrays([pa.array(claims, pa.int64()), pa.array([ids] * len(claims), pa.list_(pa.int32())), pa.array([said] * len(claims), pa.string())], names=["doc_id", "ids", "decoded"])

        for batch in batches:
            for k, salt, no, i, text, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (k, salt) != key:
                    if parts:
                        yield whole()
                    key, claims, parts = (k, salt), [], []
                if no < 0:
                    claims.append(i)
                else:
                    ids, steps, sizes = load(packed)
                    starts = np.cumsum(steps, dtype=np.int64)
                    parts.append(Piece(text, ids, starts, starts + sizes))
        if parts:
            yield whole()

    return run


def after(run, then):
    """then's batches for run's, in the same worker."""
    return lambda batches: then(run(batches))


def bpe(docs: DataFrame, path: str, leaf: int = LEAF, then=None, columns: str = OUT) -> DataFrame:
    """Encodes each whole text and decodes the tokens: doc_id, ids, decoded, a row for each row of docs.

    then: a function from batches of these to batches of `columns`, which runs where the texts are encoded, so that tokens don't travel.

    A null text counts as empty: no ids, and decoded ''. Rows that repeat or have no doc_id come out as they are; other
    columns are ignored. A text of more than `leaf` characters is encoded as a tree, whose leaves several tasks encode. path: a tokenizer
    file whose pre-tokens don't cross white space and that has no decoder, so that tokens are joined by a space.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    is_long = F.coalesce(F.length("text"), F.lit(0)) > leaf
    tasks = max(32, text_bytes(docs) // TASK_BYTES)
    dealt = rows.where(is_long).mapInArrow(tidy(cut(leaf)), LEAVES).repartition(tasks, "key", "salt", "no").sortWithinPartitions("key", "salt", "no")
    whole = dealt.mapInArrow(tidy(leaves(path)), LEAVES).repartition(tasks, "key", "salt").sortWithinPartitions("key", "salt", "no")
    short, long = (after(run(path), then) if then else run(path) for run in (encoder, joined))
    return rows.where(~is_long).mapInArrow(tidy(short), columns).unionByName(whole.mapInArrow(tidy(long), columns))


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists, said = b.column("ids"), b.column("decoded").to_pylist()
        ids = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")
        at = lists.offsets.to_numpy().astype(np.int64)
        at -= at[0]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(np.diff(at), pa.int64()), pa.array([hashlib.sha256(ids[x:y].tobytes()).hexdigest() for x, y in zip(at[:-1], at[1:], strict=True)], pa.string()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in said], pa.string())],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    return bpe(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path(), then=digests, columns="doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
