"""Toxicity by weak supervision.

Voters are lexicons of whole words and patterns of word beginnings, mined from labelled documents outside the held-out fold. A
lexicon or pattern voter says toxic where it matches and otherwise abstains; a kind's summary voter says clean where
nothing of its kind matches. A generative model estimates, by expectation maximisation, how each voter answers on either class and
how voters go together within a class; voters that go together share their weight. Its posteriors are the labels that
a linear classifier on the matches is trained with; the classifier scores every document.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_hold_out, slices, stored, table, words_of
from .labelled import PER_CLASS, independent, texts_of, training

#: Kinds of patterns: whole words (0) and beginnings of so many letters.
KINDS = (0, 4, 5, 6, 7)
GROUPS = 6
#: In toxic documents at least, how much likelier there than elsewhere, and the least likelihood ratio (G) as a
#: multiple of the logarithm of the documents that patterns are mined from.
LEAST, LIFT, SURE = 3, 8.0, 3.0
THRESHOLD = 0.3
#: Letters of a word at most; a longer piece is several words.
LONG = 40
MARKS = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c)[0] == "M")
#: Thai, Lao, Tibetan, Burmese, Khmer, kana and Han.
SCRIPTS = "\u0e00-\u0eff\u0f00-\u0fff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
PIECE = re.compile(rf"[^\W_](?:[^\W_]|[{MARKS}])*")
UNSPACED = re.compile(f"[{SCRIPTS}]")
RUN = re.compile(f"[{SCRIPTS}]+|[^{SCRIPTS}]+")
#: Text bytes whose patterns, all of them, a Python worker holds at once.
MINED_BYTES = 1_000_000


def pieces_of(word: str) -> list[str]:
    """The runs of letters, digits and their combining marks; what is written without spaces apart from the rest."""
    return [word] if word.isascii() and word.isalnum() else [r for p in PIECE.findall(word) for r in RUN.findall(p)]


def patterns_of(word: str) -> Iterator[str]:
    """The patterns of a word, in lower case: each of its pieces and that one's beginnings.

    A piece without spaces between its words (by its script, or as long as no word is) may begin a word anywhere: its runs of so many
    characters count as beginnings, and shorter ones as words.
    """
    for w in pieces_of(word.lower()):
        if len(w) <= LONG and not UNSPACED.match(w):
            yield from (f"{k}:{w[:k] if k else w}" for k in KINDS if len(w) > (k and k - 1))
            continue
        yield f"0:{w}"
        for n in range(1, KINDS[-1] + 1):
            kind = n if n in KINDS else 0
            yield from {f"{kind}:{w[i : i + n]}" for i in range(len(w) - n + 1)}


def document_patterns(texts: pa.Array, wanted: dict[str, int] | None) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Distinct pairs of document and pattern; patterns by number of `wanted`, or of the list that is returned."""
    flat, offsets = words_of(texts)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    if not len(flat):
        return doc, doc, []
    coded = flat.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    names: dict[str, int] = {} if wanted is None else wanted
    lists = []
    for w in coded.dictionary.to_pylist():
        if wanted is None:
            lists.append([names.setdefault(p, len(names)) for p in patterns_of(w)])
        else:
            lists.append([names[p] for p in patterns_of(w) if p in names])
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    values = np.fromiter((x for y in lists for x in y), np.int64, int(counts.sum()))
    some = np.flatnonzero(counts[codes] > 0)
    pairs = np.unique(doc[some] * np.int64(len(lists)) + codes[some])
    d, c = pairs // len(lists), pairs % len(lists)
    n, start = counts[c], (np.cumsum(counts) - counts)[c]
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)
    both = np.unique(np.repeat(d, n) * np.int64(max(1, len(names))) + values[at])
    return both // max(1, len(names)), both % max(1, len(names)), list(names) if wanted is None else []


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, most=MINED_BYTES):
        y = b.column("y").to_numpy(zero_copy_only=False)
        doc, pattern, names = document_patterns(b.column("text"), None)
        pos = np.bincount(pattern[y[doc] == 1], minlength=len(names))
        neg = np.bincount(pattern[y[doc] == 0], minlength=len(names))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(pos, pa.int64()), pa.array(neg, pa.int64())], names=["pattern", "pos", "neg"])


def mined(sample: DataFrame, n_pos: int, n_neg: int) -> list[str]:
    """Patterns that mark toxic documents, the strongest first. They come from the sample, which is bounded, and each needs LEAST toxic documents of it."""
    found = sample.mapInArrow(counted, "pattern string, pos long, neg long").groupBy("pattern").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    lift = ((F.col("pos") + 0.5) / (n_pos + 1)) / ((F.col("neg") + 0.5) / (n_neg + 1))
    share = n_pos / (n_pos + n_neg)
    part = lambda c, p: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / ((F.col("pos") + F.col("neg")) * F.lit(p)))).otherwise(0.0)
    rows = found.withColumn("worth", 2 * (part("pos", share) + part("neg", 1 - share))).where((F.col("pos") >= LEAST) & (lift >= LIFT) & (F.col("worth") >= SURE * math.log(n_pos + n_neg)))
    return [r["pattern"] for r in rows.orderBy(F.desc("worth"), "pattern").collect()]


def voter_of(pattern: str) -> int:
    kind = KINDS.index(int(pattern.split(":")[0]))
    return kind * GROUPS + xxhash.xxh3_64_intdigest(pattern) % GROUPS


def votes(matches: list[np.ndarray], patterns: list[str]) -> np.ndarray:
    """Documents by voters: 1 toxic, 0 abstains, -1 clean. A kind's groups come first, then the kinds' summaries."""
    by = np.array([voter_of(p) for p in patterns], np.int64)
    out = np.zeros((len(matches), len(KINDS) * (GROUPS + 1)), np.int8)
    for i, m in enumerate(matches):
        out[i, by[m]] = 1
    for k in range(len(KINDS)):
        out[:, len(KINDS) * GROUPS + k] = np.where(out[:, k * GROUPS : (k + 1) * GROUPS].any(axis=1), 1, -1)
    return out


class LabelModel:
    """How voters answer on each class, and their weights."""

    def __init__(self, v: np.ndarray, y: np.ndarray, rounds: int = 20):
        kinds, at, times = np.unique(v, axis=0, return_inverse=True, return_counts=True)
        at = at.ravel()
        p = np.bincount(at, weights=y, minlength=len(kinds)) / times  # begins where labels point
        p = (p * times + 0.5) / (times + 1)
        self.prior = float(np.clip(y.mean(), 0.01, 0.99))  # the labels' share; the voters' own would drift
        answers = np.stack([kinds == a for a in (-1, 0, 1)]).astype(float)
        for _ in range(rounds):
            self.table = np.empty((2, 3, v.shape[1]))
            self.weight = np.ones(v.shape[1])
            together = np.zeros((v.shape[1], v.shape[1]))
            for c, share in enumerate(((1 - p) * times, p * times)):
                self.table[c] = (np.einsum("akv,k->av", answers, share) + 0.3) / (share.sum() + 0.9)
                mean = (kinds * share[:, None]).sum(0) / max(share.sum(), 1e-9)
                off = (kinds - mean) * np.sqrt(share)[:, None]
                cov = off.T @ off
                dev = np.sqrt(np.maximum(np.diag(cov), 1e-9))
                together += np.abs(cov / np.outer(dev, dev)) * (share.sum() / times.sum())
            np.fill_diagonal(together, 0)
            self.correlations = together
            self.weight = 1 / (1 + np.where(together > 0.1, together, 0).sum(1))
            p = self.posterior(kinds)

    def posterior(self, v: np.ndarray) -> np.ndarray:
        logs = np.log(self.table[1]) - np.log(self.table[0])
        logs[0], logs[1], logs[2] = np.minimum(logs[0], 0), 0, np.maximum(logs[2], 0)  # no voter speaks against what it says, or by abstaining
        said = logs[v.astype(int) + 1, np.arange(v.shape[1])]
        z = math.log(self.prior / (1 - self.prior)) + said @ self.weight
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Linear:
    """Logistic regression on the matched patterns and on how many there are, by gradient descent with soft labels."""

    def __init__(self, matches: list[np.ndarray], p: np.ndarray, width: int, rounds: int = 150):
        rows = np.repeat(np.arange(len(matches)), [len(m) for m in matches])
        cols = np.concatenate(matches) if len(rows) else np.zeros(0, np.int64)
        self.w, self.any, self.many, self.bias = np.zeros(width), 0.0, 0.0, 0.0
        count = np.bincount(rows, minlength=len(matches))
        seen = np.maximum(np.bincount(cols, minlength=width), 1)
        for _ in range(rounds):
            e = 1 / (1 + np.exp(-np.clip(self.logit(rows, cols, count), -40, 40))) - p
            self.w -= 1.0 * (np.bincount(cols, weights=e[rows], minlength=width) / np.sqrt(seen * max(1, len(p)))) + 1e-4 * self.w
            self.any -= 2.0 * (e * (count > 0)).mean()
            self.many -= 2.0 * (e * np.log1p(count)).mean()
            self.bias -= 2.0 * e.mean()

    def logit(self, rows: np.ndarray, cols: np.ndarray, count: np.ndarray) -> np.ndarray:
        return np.bincount(rows, weights=self.w[cols], minlength=len(count)) + self.any * (count > 0) + self.many * np.log1p(count) + self.bias


def fitted(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[list[str], Linear]:
    sample = stored(independent(training(docs, labels, "toxic", per_class)), "toxic-sample")
    n = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    patterns = mined(sample, n.get(1, 0), n.get(0, 0)) if len(n) == 2 else []
    wanted = {p: i for i, p in enumerate(patterns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            doc, pattern, _ = document_patterns(b.column("text"), wanted)
            parts = np.split(pattern, np.searchsorted(doc, np.arange(1, b.num_rows)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array([p.astype(np.int32).tobytes() for p in parts], pa.binary())], names=["doc_id", "y", "m"])

    rows = sample.mapInArrow(run, "doc_id long, y int, m binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["m"])))
    matches = [np.frombuffer(r["m"], np.int32).astype(np.int64) for r in rows]
    y = np.array([r["y"] for r in rows], float)
    if len(n) < 2:
        line = Linear([], np.zeros(0), 0, 0)
        share = (y.sum() + 1) / (len(y) + 2)
        line.bias = math.log(share / (1 - share))
        return patterns, line
    v = np.column_stack([votes(matches, patterns), (2 * y - 1).astype(np.int8)])  # a label is one more voter, that may err
    return patterns, Linear(matches, LabelModel(v, y).posterior(v), len(patterns))


def scores(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id and score (0 to 1, higher: toxic likelier) of each row of docs, by its text alone.

    A null or empty text matches nothing. Without labelled rows of both classes, every score is the share of label 1, counted with one
    more of each. Rows that repeat are scored alike; other columns are ignored.
    """
    texts = texts_of(docs)
    patterns, line = fitted(texts, labels, per_class)
    wanted = {p: i for i, p in enumerate(patterns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            doc, pattern, _ = document_patterns(b.column("text"), wanted)
            z = line.logit(doc, pattern, np.bincount(doc, minlength=b.num_rows))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.round(1 / (1 + np.exp(-np.clip(z, -40, 40))), 9), pa.float64())], names=["doc_id", "score"])

    return texts.mapInArrow(run, "doc_id long, score double")


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    out = scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", in_hold_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
