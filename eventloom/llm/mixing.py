"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only.

Token counts are summed to cells of source, language and topic. Raking scales the cells' weights to the target share of each
source, language and topic in turn until all three hold. A cell's sampling rate is its weight per token, scaled so that the
expected tokens meet the budget, and 1 at most; each document is kept where its hash falls below its cell's rate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, table

DIMENSIONS = ("source", "lang", "topic")
#: Share of all tokens to sample; targets are shares to the power SMOOTH; rounds of raking at most, and the error that ends them.
BUDGET, SMOOTH, ROUNDS, ERROR = 0.5, {"source": 0.5, "lang": 0.7, "topic": 0.7}, 10, 1e-3
SEED = 17


def tokens_of(text: Column) -> Column:
    """Words of a text, as runs of anything but white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def topic_of(text: Column) -> Column:
    """A rule of plain marks, for documents without a topic of their own."""
    return (
        F.when(text.isNull() | (F.length(text) < 200), "short")
        .when(text.contains("icense") | text.contains("opyright"), "legal")
        .when(text.contains(" | "), "table")
        .when(text.contains("@") | text.contains("://"), "contact")
        .when(F.length(text) >= 8000, "long")
        .otherwise("prose")
    )


def uniform(doc_id: Column, text: Column, seed: int) -> Column:
    """A number in [0, 1) from the document's id, or its text where it has none."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.coalesce(doc_id.cast("long"), F.xxhash64(text))), 11)
    return bits.cast("double") / F.lit(float(1 << 53))


def placed(docs: DataFrame) -> DataFrame:
    """Each row as a struct, and its doc_id, text and the three dimensions ('' for null) under names that no column of docs can clash with."""
    topic = F.col("topic").cast("string") if "topic" in docs.columns else topic_of(F.col("text"))
    return docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("_text"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_source"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("_lang"), F.coalesce(topic, F.lit("")).alias("_topic"))


def smoothed(cells: DataFrame, smooth: dict[str, float]) -> dict[str, DataFrame]:
    """Target shares by dimension: shares of tokens to the power, made to add up to 1."""
    out = {}
    for d in DIMENSIONS:
        sums = cells.groupBy(f"_{d}").agg(F.pow(F.sum("tokens").cast("double"), F.lit(smooth[d])).alias("target")).where("target > 0")
        total = sums.agg(F.sum("target")).first()[0]
        out[d] = sums.select(f"_{d}", (F.col("target") / F.lit(total)).alias("target")) if total else sums
    return out


def raked(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS, error: float = ERROR) -> DataFrame:
    """cells with a column weight whose sums by each dimension are the targets', as far as the cells that exist allow."""
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    cells = cells.where("tokens > 0").withColumn("weight", F.col("tokens") / F.lit(float(max(total, 1))))
    for _ in range(rounds):
        off = []
        for d in DIMENSIONS:
            key = f"_{d}"
            sums = cells.groupBy(key).agg(F.sum("weight").alias("now")).join(targets[d], key, "left")
            factor = sums.select(key, (F.coalesce("target", F.lit(0.0)) / F.col("now")).alias("factor"))
            cells = cells.join(factor, key).withColumn("weight", F.col("weight") * F.col("factor")).withColumn(f"off_{d}", F.abs(F.col("factor") - 1)).drop("factor")
            off.append(F.max(f"off_{d}"))
        cells = stored(cells, "cells")
        worst = cells.agg(F.greatest(*off)).first()[0]
        cells = cells.drop(*(f"off_{d}" for d in DIMENSIONS))
        if worst is None or worst < error:
            break
    return cells


def off_by(cells: DataFrame, targets: dict[str, DataFrame]) -> dict[str, float]:
    """By dimension, the largest difference between the raked cells' share of a value and its target."""
    out = {}
    for d in DIMENSIONS:
        sums = cells.groupBy(f"_{d}").agg(F.sum("weight").alias("now")).join(targets[d], f"_{d}", "full")
        out[d] = float(sums.agg(F.max(F.abs(F.coalesce("now", F.lit(0.0)) - F.coalesce("target", F.lit(0.0))))).first()[0] or 0.0)
    return out


def calibrated(cells: DataFrame, budget: float) -> DataFrame:
    """Each cell's rate: least(1, k * weight / tokens), with k so that budget * tokens are expected."""
    aim = budget * float(cells.agg(F.sum("tokens")).first()[0] or 0)
    low, high = aim / 64 if aim else 0.0, max(aim, 1.0) * 4096
    for _ in range(3):
        steps = [low * (high / low) ** (i / 32) for i in range(33)] if low else [1.0]
        sums = cells.agg(*[F.sum(F.least(F.col("tokens").cast("double"), F.col("weight") * F.lit(k))) for k in steps]).first()
        under = [k for k, s in zip(steps, sums, strict=True) if (s or 0.0) <= aim]
        over = [k for k, s in zip(steps, sums, strict=True) if (s or 0.0) > aim]
        low, high = (under[-1] if under else low), (over[0] if over else high)
        if not over:
            break
    return cells.withColumn("rate", F.least(F.lit(1.0), F.col("weight") * F.lit(high) / F.col("tokens")))


def mixed(docs: DataFrame, targets: dict[str, DataFrame] | None = None, budget: float = BUDGET, seed: int = SEED) -> DataFrame:
    """docs with n_tokens, topic, probability and kept, a row for each row of docs.

    targets: for each of source, lang and topic a table with _source, _lang or _topic and target (shares); without, tokens' shares to the
    power SMOOTH. Raking ends when no factor is off by ERROR or more, or after ROUNDS; off_by() tells how far the marginals are then. Null source, language or topic count as ''. A document without words has probability 0. A value without
    a target is not sampled. Rows with the same doc_id are kept or not together; without doc_id, by their text. Columns of docs stay,
    but for any of these four names; a column topic is used where docs has one.
    """
    new = ("n_tokens", "topic", "probability", "kept")
    rows = placed(docs)
    counts = rows.groupBy("_source", "_lang", "_topic").agg(F.sum(tokens_of(F.col("_text"))).alias("tokens"))
    cells = stored(counts, "cells")
    rates = stored(calibrated(raked(cells, targets or smoothed(cells, SMOOTH)), budget).select("_source", "_lang", "_topic", "rate"), "rates")
    n = tokens_of(F.col("_text"))
    out = rows.join(rates, ["_source", "_lang", "_topic"], "left")
    probability = F.when(n > 0, F.coalesce("rate", F.lit(0.0))).otherwise(0.0)
    return out.select(*[F.col("_row")[c].alias(c) for c in docs.columns if c not in new], n.alias("n_tokens"), F.col("_topic").alias("topic"), probability.alias("probability"), (uniform(F.col("_id"), F.col("_text"), seed) < probability).alias("kept"))


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "source", "lang", "topic", "n_tokens", "probability", "kept")


