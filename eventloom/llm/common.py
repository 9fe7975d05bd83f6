"""What the corpus operators share: words, hashes, packing, shared tables."""

from __future__ import annotations

import ctypes
import pickle
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a Python worker holds as words at once.
SLICE_BYTES = 6_000_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Seen only where the session names no shared folder, as in tests.
FALLBACK_DIR = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; set only where the session has none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        spark.sparkContext.setCheckpointDir(FALLBACK_DIR)
        found = FALLBACK_DIR
    return found


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again: its lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/eventloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of all texts: one pass that reads lengths and gives the number of buckets."""
    return docs.agg(F.sum(F.octet_length(column))).first()[0] or 0


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in runs of about `most` bytes of `column`, small batches joined and large ones cut; a longer text stands alone."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = 0
        for i, n in enumerate(sizes.tolist()):
            if size and size + n > most:
                held.append(batch.slice(start, i - start))
                yield joined(held)
                held, size, start = [], 0, i
            size += n
        held.append(batch.slice(start))
    if held:
        yield joined(held)


def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    whole = pa.Table.from_batches(parts).combine_chunks()
    return whole.to_batches()[0] if whole.num_rows else parts[0].slice(0, 0)


def released() -> None:
    """Gives the system back what this worker has freed: workers outlive their tasks, and a freed slice would stay with each."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def tidy(run: Callable) -> Callable:
    """run, whose worker keeps nothing of a task's slices when the task ends."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        released()

    return tidied


def tidy_group(run: Callable) -> Callable:
    """The same for a function of a group."""

    def tidied(group: pa.Table) -> pa.Table:
        out = run(group)
        released()
        return out

    return tidied


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts (runs of anything but space and bytes 9 to 13), and where each text's words start; null has none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.flatten()
    offsets -= offsets[0]
    keep = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    if not keep.all():
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        flat = flat.filter(pa.array(keep))
    return flat, offsets


def word_hashes(flat: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words, and their numbers in this array's own dictionary."""
    if not len(flat):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    coded = flat.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    unique = coded.dictionary.cast(pa.binary()).to_pylist()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, unique), np.uint64, len(unique))
    return hashes[codes], codes


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def rolling(hashes: np.ndarray, n: int, multiplier: np.uint64 = MULTIPLIER) -> np.ndarray:
    """Hash of every run of n words, by its first word."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:m].copy()
    for j in range(1, n):
        out *= multiplier
        out += hashes[j : j + m]
    return mixed(out)


CODEC = "zstd"


def dump(*arrays: np.ndarray) -> bytes:
    """Arrays as one value; those of small numbers are compressed."""
    out = []
    for a in arrays:
        raw = np.ascontiguousarray(a).tobytes()
        small = pa.compress(raw, codec=CODEC, asbytes=True) if len(raw) > 64 else raw
        out.append((a.dtype.str, len(raw), small if len(small) < len(raw) * 0.95 else raw))
    return pickle.dumps(out, protocol=5)


def load(value: bytes) -> list[np.ndarray]:
    return [np.frombuffer(x if len(x) == n else pa.decompress(x, decompressed_size=n, codec=CODEC, asbytes=True), dtype=t) for t, n, x in pickle.loads(value)]


def deltas(values: np.ndarray) -> np.ndarray:
    """Differences; undone by np.cumsum."""
    return np.diff(values, prepend=values.dtype.type(0))


def by_bucket(buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The stable order by bucket; the buckets that occur, and where each starts in that order (one more at the end)."""
    order = np.argsort(buckets.astype(np.uint16) if len(buckets) and buckets.max() < 65536 else buckets, kind="stable")
    found = buckets[order]
    first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if len(found) else np.zeros(0, np.int64)
    return order, found[first], np.append(first, len(found))


#: Values of a slice and bucket, and marks of a document, as line dedup sends them.
PACKED = "bucket int, kind int, packed binary"
MARKS = "doc_id long, fp long, kind int, packed binary"


def fingerprint(text: str | None) -> int:
    """Tells rows that share a doc_id apart."""
    return xxhash.xxh3_64_intdigest(text or "") >> 32


def rows(kind: str, columns: list[list]) -> pa.RecordBatch:
    types = {"packed": [pa.int32(), pa.int32(), pa.binary()], "marks": [pa.int64(), pa.int64(), pa.int32(), pa.binary()]}[kind]
    names = {"packed": ["bucket", "kind", "packed"], "marks": ["doc_id", "fp", "kind", "packed"]}[kind]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def in_hold_out(doc_id):
    """Whether crc32 of doc_id as text leaves 2 when divided by 4; false for null."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))
