"""A bounded sample of labelled documents to fit a classifier on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_hold_out, mixed, rolling, slices, word_hashes, words_of

#: Labelled documents of each class that a classifier is fitted on, at most.
PER_CLASS = 8_000


def texts_of(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id and text, cast only where their types differ: an alias less, and two uses of the same exchange are seen to be one."""
    types = dict(docs.dtypes)
    return docs.select(*[F.col(c) if types[c] == t else F.col(c).cast(t).alias(c) for c, t in (("doc_id", "bigint"), ("text", "string"))], *more)


def training(docs: DataFrame, labels: DataFrame, column: str, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, text and y of up to per_class documents of each class, none of them held out: those whose hash is smallest.

    A document with several labels counts by their maximum. The ids that are broadcast are 2 * per_class at most.
    """
    known = labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull() & ~in_hold_out("doc_id")).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(column).cast("int")).alias("y"))
    some = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        some = part if some is None else some.unionByName(part)
    return texts_of(docs).join(F.broadcast(some), "doc_id")


def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with the smallest of their three-word hashes under three hash functions: s0, s1, s2.

    A text of one or two words has its whole sequence as the one hash, one without words has 0. It depends on the text alone.
    """
    for b in slices(batches):
        flat, offsets = words_of(b.column("text"))
        words, _ = word_hashes(flat)
        counts = np.diff(offsets)
        hashes = rolling(np.append(words, np.zeros(2, np.uint64)), 3)
        valid = np.repeat(offsets[1:], counts) - np.arange(len(words)) >= 3
        for d in np.flatnonzero((counts > 0) & (counts < 3)).tolist():
            at = offsets[d]
            hashes[at] = mixed(words[at : at + 1] if counts[d] == 1 else words[at : at + 1] * np.uint64(3) + words[at + 1 : at + 2])[0]
            valid[at] = True
        full = np.flatnonzero(counts)
        out = []
        for salt in (1, 2, 3):
            least = np.zeros(len(counts), np.uint64)
            if len(full):
                least[full] = np.minimum.reduceat(np.where(valid, mixed(hashes ^ np.uint64(salt)), np.uint64(2**64 - 1)), offsets[full])
            out.append(pa.array(least.view(np.int64)))
        yield pa.RecordBatch.from_arrays([*b.columns, *out], names=[*b.schema.names, "s0", "s1", "s2"])


def independent(sample: DataFrame) -> DataFrame:
    """One document for each group of copies and near copies in a sample: their words are one piece of evidence, not many."""
    rows = sample.select("doc_id", "text", "y").mapInArrow(signed, "doc_id long, text string, y int, s0 long, s1 long, s2 long")
    for s in ("s0", "s1", "s2"):
        first = rows.groupBy("y", s).agg(F.min("doc_id").alias("doc_id")).select("doc_id")
        rows = rows.join(F.broadcast(first.distinct()), "doc_id", "left_semi")
    return rows.select("doc_id", "text", "y")
