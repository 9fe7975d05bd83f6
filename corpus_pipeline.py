"""Documents through five stages: quality, line dedup, near copies, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; all but the last return the columns
of docs. run() writes each stage's rows to the shared folder and reads them again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import bpe, common, jaccard, line_dedup, mixing, quality


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    found = quality.scores(docs, common.table(spark, sf_dir, "labels"), into="_quality")
    return found.where(F.col("_quality") >= quality.THRESHOLD).select(*docs.columns)


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that earlier ones hold; those left without a line go. n_chars is the new text's."""
    found = line_dedup.line_dedup(docs, tuple(c for c in docs.columns if c not in ("doc_id", "text")))
    left = found.where((F.col("n_removed") == 0) | F.coalesce(F.col("kept_text").rlike(r"\S"), F.lit(False)))
    column = {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(F.col("extra")["n_chars"] if "n_chars" in docs.columns else 0)}
    return left.select(*[column.get(c, F.col("extra")[c]).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8), the one of the smallest doc_id; those without doc_id stay."""
    groups = jaccard.jaccard_join(docs, gram=5, percent=80)
    gone = groups.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(common.stored(gone, "copies"), "doc_id", "left_anti").select(*docs.columns)


def sampled(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens follow the target weights."""
    found = mixing.mixed(docs)
    return found.where("kept").select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the text as the tokens decode it."""
    found = bpe.bpe(docs, bpe.vocabulary_path())
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [("quality", good), ("line_dedup", distinct_lines), ("near_copies", one_of_each), ("mixing", sampled), ("tokens", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{common.shared_dir(spark).rstrip('/')}/eventloom-stage-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
