"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed per cell of source, language and topic. Starting from the tokens themselves, cell weights are raked to the target
share of every source, language and topic in turn, round after round, until no margin is off by more than `tolerance`; a cell never
gets more tokens than it has. The quotient of weight and tokens is the probability with which a document of the cell is sampled, by a
hash of its doc_id, so that a rerun samples the same documents.

Targets are shares by margin and value; values without a target get none. Where no targets are given for a margin, they are the
margin's token shares raised to its exponent, which lifts small sources and languages. Topic is the column `topic`, if there is one,
else the form of the text (`topic_of`).

Defined results: a null source, language or topic is a value of its own (no target can name it); null and empty texts have one token,
so that they can be weighed; rows with a null doc_id are sampled by their text; rows of one doc_id share their fate if they share a
cell; without rows the result is empty. Where the targets cannot be met, because a cell has too few tokens, the last round stands:
`fit` and the column deviation of `mix_plan` report how far its margins are off. Memory: one Arrow batch per task; the driver gets one number per round.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import free_name, require, stored, with_computed

MARGINS = ("source", "lang", "topic")
EXPONENTS = {"source": 0.5, "lang": 0.7, "topic": 1.0}
KEEP, ROUNDS, TOLERANCE, SEED = 0.5, 40, 1e-4, 20
FEW = 1 << 14  # cells that one task rakes
_ADDED = {"n_tokens": ("bigint", pa.int64()), "topic": ("string", pa.string())}


def topic_of(text: bytes, words: int) -> str:
    """The form of a text: tables by their bars, lists by their short lines, prose by its length."""
    if words == 0:
        return "empty"
    if 5 * text.count(b"|") >= words:
        return "table"
    if 8 * text.count(b"\n") >= words:
        return "list"
    return "note" if words < 100 else "article" if words < 1000 else "long"


def _measure(texts: list[bytes]) -> list[list]:
    counts = [len(text.split()) for text in texts]
    return [[max(1, count) for count in counts], [topic_of(text, count) for text, count in zip(texts, counts)]]


def with_tokens(docs: DataFrame) -> DataFrame:
    """`docs` with n_tokens and, unless they have a topic, the topic."""
    require(docs, "text", "source", "lang")
    if "topic" not in docs.columns:
        return with_computed(docs, "text", _ADDED, _measure)
    return with_computed(docs, "text", {"n_tokens": _ADDED["n_tokens"]}, lambda texts: _measure(texts)[:1])


def _value(margin: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(margin).cast("string")), F.lit(""))


def cells_of(docs: DataFrame) -> DataFrame:
    """(source, lang, topic, tokens) of documents with n_tokens; values with a leading =, null as the empty string."""
    return docs.groupBy(*[_value(margin).alias(margin) for margin in MARGINS]).agg(F.sum("n_tokens").cast("double").alias("tokens"))


def target_shares(cells: DataFrame, margin: str, targets: dict[str, float] | None, exponent: float) -> DataFrame:
    """(margin value, target): shares which sum to one."""
    spark = cells.sparkSession
    if targets is not None:
        total = sum(targets.values())
        rows = [("=" + value, share / total) for value, share in targets.items()]
        return spark.createDataFrame(rows, f"{margin} string, target double")
    raised = stored(cells.groupBy(margin).agg(F.pow(F.sum("tokens"), F.lit(exponent)).alias("raised")), "raised-tokens")
    total = raised.agg(F.sum("raised")).first()[0]
    return raised.select(margin, (F.col("raised") / F.lit(total)).alias("target"))


def _packed(cells: DataFrame, few: bool) -> DataFrame:
    """A few cells in one partition, where steps need no shuffle."""
    return cells.coalesce(1) if few else cells


def rake(cells: DataFrame, targets: dict[str, DataFrame], budget: float, rounds: int = ROUNDS,
         tolerance: float = TOLERANCE) -> tuple[DataFrame, float]:
    """`cells` with the column weight, and the largest deviation of a margin's share at the end."""
    few = cells.count() <= FEW
    cells = _packed(cells, few)
    targets = {margin: _packed(shares, few) for margin, shares in targets.items()}
    fitted, off = cells.withColumn("weight", F.col("tokens")), float("inf")
    for _ in range(rounds):
        fitted = fitted.withColumn("gap", F.lit(0.0))
        for margin in MARGINS:  # written after each margin: a sum and a join per step, whatever the number of steps before
            sums = (fitted.groupBy(margin).agg(F.sum("weight").alias("now")).join(targets[margin], margin, "left")
                    .select(margin, "now", (F.coalesce("target", F.lit(0.0)) * budget).alias("aim")))
            now, aim = F.col("now"), F.col("aim")
            step = fitted.join(sums, margin).select(
                *MARGINS, "tokens", F.when(now > 0, F.least(F.col("tokens"), F.col("weight") * aim / now)).otherwise(0.0).alias("weight"),
                F.greatest(F.col("gap"), F.abs(now - aim) / budget).alias("gap"))
            fitted = _packed(stored(step, "raked-cells"), few)
        before, off = off, fitted.agg(F.max("gap")).first()[0] or 0.0
        fitted = fitted.drop("gap")
        if off <= tolerance or abs(before - off) <= tolerance / 100:
            break
    return fitted, off


def fit(docs: DataFrame, keep: float = KEEP, targets: dict[str, dict[str, float]] | None = None,
        exponents: dict[str, float] | None = None) -> tuple[DataFrame, float]:
    """(source, lang, topic, probability) per cell of `docs` (with n_tokens and topic), and the largest deviation of a margin."""
    cells = stored(cells_of(docs), "cells")
    total = cells.agg(F.sum("tokens")).first()[0]
    if not total:
        return cells.select(*MARGINS, F.lit(0.0).alias("probability")), 0.0
    targets, exponents = targets or {}, {**EXPONENTS, **(exponents or {})}
    shares = {margin: stored(target_shares(cells, margin, targets.get(margin), exponents[margin]), "target-shares") for margin in MARGINS}
    fitted, off = rake(cells, shares, keep * total)
    return fitted.select(*MARGINS, F.round(F.col("weight") / F.col("tokens"), 9).alias("probability")), off


def with_probability(docs: DataFrame, cells: DataFrame, name: str, seed: int = SEED) -> DataFrame:
    """`docs` with the column `name`, a struct of the probability and whether the hash of the row is below it."""
    keys = {margin: free_name(docs, f"_{margin}") for margin in MARGINS}
    odds = cells.select(*[F.col(margin).alias(key) for margin, key in keys.items()], F.col("probability").alias(name))
    joined = docs.withColumns({key: _value(margin) for margin, key in keys.items()}).join(odds, list(keys.values())).drop(*keys.values())
    draw = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", F.lit(seed))).otherwise(F.xxhash64("text", F.lit(seed)))
    draw = F.shiftrightunsigned(draw, 11) / F.lit(float(1 << 53))
    return joined.withColumn(name, F.struct(F.col(name).alias("probability"), (draw < F.col(name)).alias("kept")))


def mix_plan(docs: DataFrame, keep: float = KEEP, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, probability, kept, deviation) of every row of `docs`; deviation, the same in all rows, is
    how far the share of a margin is off its target at most."""
    require(docs, "doc_id", "text", "source", "lang")
    names = ["doc_id", "source", "lang", "topic", "n_tokens"]
    measured = with_tokens(docs.select("doc_id", "text", *[m for m in MARGINS if m in docs.columns]))
    narrow = stored(measured.withColumn("text", F.when(F.col("doc_id").isNull(), F.col("text"))), "measured-documents")
    cells, off = fit(narrow, keep, targets)
    return with_probability(narrow, cells, "_drawn").select(*names, "_drawn.probability", "_drawn.kept", F.lit(off).alias("deviation"))


def sample_mix(docs: DataFrame, keep: float = KEEP, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """The sampled rows of `docs`, with n_tokens, topic and probability."""
    measured = with_tokens(docs)
    cells, _ = fit(measured, keep, targets)
    name = free_name(measured, "_drawn")
    rest = [F.col(f"`{column}`") for column in measured.columns if column != "probability"]
    return with_probability(measured, cells, name).filter(F.col(name)["kept"]).select(*rest, F.col(name)["probability"].alias("probability"))
