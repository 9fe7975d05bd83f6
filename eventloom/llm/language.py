"""Language ID of web pages by Bayesian evidence fusion.

Text likelihoods come from hashed byte trigrams, counted by language over all documents. A page's text posterior gives soft
counts, which grouped aggregation sums into the other evidence: how each language declares itself in the markup, which address
suffixes and path marks it has, and host priors, smoothed by those of the host's domain, and these by all pages'. The fused
posterior multiplies them.
"""

from __future__ import annotations

import html as markup
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored, table

ROWS = 1 << 15
#: Trigrams of a page count as so many at most, for they aren't independent; pages that a host's prior counts as.
EVIDENCE, SMOOTH_HOST = 40.0, 8.0
PIECES = "lang string, part int, counts binary"
PAGES = "page_id long, host string, domain string, suffix string, path string, declared string, logs array<double>"
SKIP = re.compile(r"(?is)<(script|style|nav|header|footer|aside)\b.*?</\1\s*>|<!--.*?-->|<div[^>]*class=[\"']?ad\b.*?</div>")
MAIN = re.compile(r"(?i)<(/?)(?:article|main)\b[^>]*>")
TAG = re.compile(r"(?s)<[^>]*>")
DECLARED = re.compile(r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})")
ADDRESS = re.compile(r"(?is)^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)[^/?#]*(/[^?#]*)?")


def trigrams(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64)
    return ((b[:-2] * np.uint32(0x01000193) ^ b[1:-1] * np.uint32(0x9E3779B1) ^ b[2:] * np.uint32(0x85EBCA6B)) >> np.uint32(11)).astype(np.int64) % ROWS


def plain(text: str | None) -> bytes:
    return b" " + re.sub(r"[\W\d_]+", " ", (text or "").lower()).strip().encode() + b" "


def main_text(body: str) -> str:
    """What stands inside articles and mains, several and nested ones too; the whole body where they hold no words or there are none."""
    parts, depth, start = [], 0, 0
    for m in MAIN.finditer(body):
        if depth:
            parts.append(body[start : m.start()])
        depth = max(0, depth - 1) if m[1] else depth + 1
        start = m.end()
    if depth:
        parts.append(body[start:])
    inside = markup.unescape(TAG.sub(" ", " ".join(parts)))
    return inside if any(map(str.isalpha, inside)) else markup.unescape(TAG.sub(" ", body))


def counted(languages: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {x: np.zeros(ROWS, np.int64) for x in languages}
        for batch in slices(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if lang in total:
                    total[lang] += np.bincount(trigrams(plain(text)), minlength=ROWS)
        found = [(x, c) for x, c in total.items() if c.any()]
        part = TaskContext.get().partitionId() // 128
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([part] * len(found), pa.int32()), pa.array([c.tobytes() for _, c in found], pa.binary())], names=["lang", "part", "counts"])

    return run


def summed(group: pa.Table) -> pa.Table:
    total = sum((np.frombuffer(x.as_py(), np.int64) for x in group.column("counts")), np.zeros(ROWS, np.int64))
    return pa.table([group.column("lang")[:1], group.column("part")[:1], pa.array([total.tobytes()], pa.binary())], names=["lang", "part", "counts"])


def trained(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """All languages in order, and the logarithm of each trigram row's share in each, from all documents; ROWS numbers for each language reach the driver."""
    known = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null and text is not null")
    languages = sorted(r["lang"] for r in known.select("lang").distinct().collect())
    piles = known.mapInArrow(counted(languages), PIECES).groupBy("lang", "part").applyInArrow(summed, PIECES)
    logs = np.zeros((len(languages), ROWS))
    for r in piles.groupBy("lang").applyInArrow(summed, PIECES).collect():
        c = np.frombuffer(r["counts"], np.int64) + 0.5
        logs[languages.index(r["lang"])] = np.log(c / c.sum())
    return languages, logs.astype(np.float32)


def evidence(languages: list[str], logs: np.ndarray):
    """What one page says by itself; its text's log likelihoods are kept within EVIDENCE trigrams' worth."""
    known = set(languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            out: list[list] = [[] for _ in range(7)]
            for i, url, page in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                m = ADDRESS.match(url or "")
                host = (m[1] if m else "").lower().strip(".")
                marks = [p.split(".")[0].lower() for p in (m[2] or "").split("/")] if m else []
                page = page or ""
                d = DECLARED.search(page)
                body = SKIP.sub(" ", page)
                grams = trigrams(plain(main_text(body)))
                said = logs[:, grams].sum(axis=1, dtype=np.float64) * min(1.0, EVIDENCE / max(1, len(grams))) if len(grams) else np.zeros(len(languages))
                values = (i, host, ".".join(host.split(".")[-2:]), host.split(".")[-1], next((p for p in marks if p in known), ""), d[1].lower() if d and d[1].lower() in known else "" if not d else "other", said.tolist())
                for c, v in zip(out, values, strict=True):
                    c.append(v)
            types = [pa.int64(), *[pa.string()] * 5, pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["page_id", "host", "domain", "suffix", "path", "declared", "logs"])

    return run


def language_id(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, host, declared, text_lang, lang and probability, a row for each row of pages.

    docs: doc_id, text and lang to learn text likelihoods from, of every language that occurs. A page's text is that of its articles and
    mains, all of them, else of its body, without navigation, headers, footers and asides. Null html or url say nothing; a page without any evidence has the
    prior of all pages. Ties go to the language that is first in order. Without labelled documents, lang is null. Rows that
    repeat come out alike; other columns are ignored.
    """
    languages, logs = trained(docs)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    if not languages:
        return rows.select("page_id", F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("declared"), F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"))
    n = len(languages)
    seen = stored(rows.mapInArrow(evidence(languages, logs), PAGES), "evidence")
    share = lambda a: F.transform(a, lambda x: F.exp(x - F.array_max(a)))
    ones = lambda a: F.transform(a, lambda x: x / F.aggregate(a, F.lit(0.0), lambda s, y: s + y))
    soft = seen.withColumn("e", share(F.col("logs"))).withColumn("p", ones(F.col("e"))).drop("e")

    def sums(key: str, name: str) -> DataFrame:
        return soft.groupBy(key).agg(F.array(*[F.sum(F.col("p")[i]) for i in range(n)]).alias(name))

    every = soft.agg(*[F.sum(F.col("p")[i]).alias(f"s{i}") for i in range(n)]).first()
    total = [float(x or 0) for x in every]
    all_pages = max(sum(total), 1e-9)
    overall = F.array(*[F.lit((x + 1) / (all_pages + n)) for x in total])
    # share of a language's pages that say so, for marks; share of a host's pages in a language, for priors
    said = lambda name: F.transform(F.col(name), lambda x, i: F.log((x + 0.5) / (F.element_at(F.array(*[F.lit(t) for t in total]), i + 1) + 2.0)))
    marks = [sums(k, k + "_n").select(k, said(k + "_n").alias(k + "_l")) for k in ("declared", "suffix", "path")]
    blend = lambda counts, prior: F.zip_with(counts, prior, lambda c, q: (c + SMOOTH_HOST * q) / (F.aggregate(counts, F.lit(0.0), lambda s, y: s + y) + SMOOTH_HOST))
    domains = sums("domain", "domain_n").select("domain", blend(F.col("domain_n"), overall).alias("domain_p"))
    hosts = soft.groupBy("host", "domain").agg(F.array(*[F.sum(F.col("p")[i]) for i in range(n)]).alias("host_n")).join(domains, "domain")
    priors = stored(hosts.select("host", F.transform(blend(F.col("host_n"), F.col("domain_p")), lambda x: F.log(x)).alias("prior")), "priors")
    out = soft.join(priors, "host")
    for k, m in zip(("declared", "suffix", "path"), marks, strict=True):
        out = out.join(stored(m, k), k)
    both = F.col("logs")
    for c in ("declared_l", "suffix_l", "path_l", "prior"):
        both = F.zip_with(both, F.col(c), lambda x, y: x + y)
    out = out.withColumn("z", both).withColumn("q", ones(share(F.col("z"))))
    name = lambda a: F.element_at(F.array(*[F.lit(x) for x in languages]), F.array_position(a, F.array_max(a)).cast("int"))
    return out.select("page_id", "host", "declared", name(F.col("p")).alias("text_lang"), name(F.col("q")).alias("lang"), F.round(F.array_max("q"), 6).alias("probability"))


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))
