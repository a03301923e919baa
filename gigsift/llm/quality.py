"""Quality classifier: Bradley-Terry utilities learned from preference pairs, cut at a score quantile.

A pair is a document labelled good and one labelled bad; the utility w.x of features x of the whole text is fitted so that
sum log(1 + exp(-w.(x_good - x_bad))) plus a ridge is least, by Newton steps whose sums Spark makes over all pairs. The threshold is
the quantile of the labelled documents' utilities at the share of bad ones; a score is the probability that a document would be
preferred to one at the threshold, 1 / (1 + exp(threshold - utility)), and is 0.5 or more from the threshold on.

Pairs: labelled documents are dealt by a hash into groups of about GROUP rows; within each, every good one meets PARTNERS bad ones
in turn. All labelled rows outside the held-out part take part; the number of pairs grows in proportion to them.

Defined results: a null text is scored like an empty one; labels that are null, other than 0 and 1, or contradict each other for
one doc_id, are not learned from; without a good and a bad document to learn from, every score is 0.5; repeated rows are scored
each; features are the only input of a score, so other columns may be null or missing. Memory: one Arrow batch per task; the
driver gets the sums of a Newton step, as many numbers as features squared.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import free_name, held_out_part, require, stored, with_computed

PARTNERS, GROUP, RIDGE, STEPS = 4, 2000, 1e-3, 12
HELD_OUT_PARTS = 3
FEATURES = (
    "words", "word_size", "new_words", "new_words_grown", "echoes", "upper", "digits", "odd_signs", "shouts", "bars", "stops",
    "commas", "foreign", "lines", "spaces", "short_words", "long_words", "capitals", "odd_signs_any", "shouts_any", "bars_any",
    "echoes_any", "upper_any")
_ARRAY = {"_features": ("array<double>", pa.list_(pa.float64()))}


def text_features(text: bytes) -> list[float]:
    """Shares of characters and words of one text, in the order of FEATURES; those named _any saturate early."""
    marks = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256).astype(float)
    words = text.split()
    count, size = max(len(words), 1), max(len(text), 1)
    letters = max(marks[65:91].sum() + marks[97:123].sum() + marks[192:].sum(), 1.0)
    per_word = lambda signs: sum(marks[ord(sign)] for sign in signs) / count
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    upper, odd, shouts, bars = marks[65:91].sum() / letters, per_word("#%&*$@^~<>{}\\"), per_word("!"), per_word("|")
    echoes, fresh = sum(map(eq, words, words[1:])) / count, len(set(words))
    return [
        math.log1p(len(words)), min(letters / count, 20.0), fresh / count, fresh / count ** 0.8, echoes, upper,
        marks[48:58].sum() / size, min(odd, 3.0), min(shouts, 3.0), min(bars, 3.0), min(per_word(".?"), 3.0), min(per_word(",;:"), 3.0),
        marks[192:].sum() / letters, min(marks[10] / count, 1.0), min((marks[32] + marks[9]) / size, 1.0),
        float((sizes <= 3).sum()) / count, float((sizes >= 12).sum()) / count,
        sum(word[:1].isupper() for word in words) / count,
        min(1.0, 10 * odd), min(1.0, 10 * shouts), min(1.0, 10 * bars), min(1.0, 10 * echoes), min(1.0, 4 * upper)]


def with_features(docs: DataFrame, name: str) -> DataFrame:
    return with_computed(docs, "text", {name: _ARRAY["_features"]}, lambda texts: [[text_features(text) for text in texts]])


@dataclass(frozen=True)
class Ranking:
    """Means and spreads of the features, the weight of each, and the utility at which a document is good."""
    mean: tuple[float, ...]
    spread: tuple[float, ...]
    weights: tuple[float, ...]
    threshold: float

    def utility(self, features: str) -> Column:
        total = F.lit(0.0)
        for at, (mean, spread, weight) in enumerate(zip(self.mean, self.spread, self.weights)):
            value = (F.col(features)[at] - mean) / spread
            total = total + F.greatest(F.lit(-5.0), F.least(F.lit(5.0), value)) * weight
        return total

    def score(self, features: str) -> Column:
        return 1 / (1 + F.exp(F.lit(self.threshold) - self.utility(features)))


def labelled(features: DataFrame, labels: DataFrame, held_out: Column) -> DataFrame:
    """(doc_id, _features, good) of the documents to learn from."""
    known = (labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id")
             .agg(F.min("quality").alias("low"), F.max("quality").alias("high")).filter("low = high"))
    rows = features.filter(~held_out).select("doc_id", "_features")
    return rows.join(known, "doc_id").select("doc_id", "_features", (F.col("high") == 1).alias("good"))


def preference_pairs(rows: DataFrame, total: int, partners: int = PARTNERS) -> DataFrame:
    """(better, worse): the features of `partners` pairs per good document."""
    groups = max(1, round(total / GROUP))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(groups)))
    order = Window.partitionBy("part", "good").orderBy(F.xxhash64("doc_id"), "doc_id", "_features")
    ranked = dealt.withColumns({
        "rank": F.row_number().over(order) - 1,
        "bad": F.sum(F.when(F.col("good"), 0).otherwise(1)).over(Window.partitionBy("part"))})
    better = ranked.filter("good AND bad > 0").select(
        "part", F.col("_features").alias("better"), F.explode(F.transform(
            F.sequence(F.lit(0), F.lit(partners - 1)), lambda i: (F.col("rank") * partners + i) % F.col("bad"))).alias("rank"))
    worse = ranked.filter("NOT good").select("part", F.col("rank").cast("long").alias("rank"), F.col("_features").alias("worse"))
    return better.join(worse, ["part", "rank"]).select("better", "worse")


def _matrix(column: pa.Array, mean, spread) -> np.ndarray:
    flat = np.asarray(column.flatten()).reshape(len(column), len(mean))
    return np.clip((flat - mean) / spread, -5.0, 5.0)


def _newton_sums(pairs: DataFrame, mean, spread, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Gradient and Hessian of the pairs' loss, and their number."""
    size = len(weights)

    def run(batches):
        total = np.zeros(size + size * size + 1)
        for batch in batches:
            apart = _matrix(batch.column(0), mean, spread) - _matrix(batch.column(1), mean, spread)
            wrong = 1 / (1 + np.exp(np.clip(apart @ weights, -500, 500)))
            total[:size] -= wrong @ apart
            total[size:-1] += ((apart * (wrong * (1 - wrong))[:, None]).T @ apart).ravel()
            total[-1] += len(apart)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["at", "value"])

    sums = pairs.mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    total = np.zeros(size + size * size + 1)
    for at, value in sums:
        total[at] = value
    return total[:size], total[size:-1].reshape(size, size), total[-1]


def learn(rows: DataFrame, partners: int = PARTNERS, ridge: float = RIDGE, steps: int = STEPS) -> Ranking:
    """Fit utilities to `rows` (doc_id, _features, good) and set the threshold."""
    rows = stored(rows, "labelled-features")
    size = len(FEATURES)
    at = lambda k: F.col("_features")[k]
    first = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("good")).alias("bad"),
                     *[F.avg(at(k)).alias(f"m{k}") for k in range(size)], *[F.stddev_pop(at(k)).alias(f"s{k}") for k in range(size)]).first()
    n, bad = first["n"], first["bad"]
    if not 0 < bad < n:
        return Ranking((0.0,) * size, (1.0,) * size, (0.0,) * size, 0.0)
    mean = np.array([first[f"m{k}"] for k in range(size)])
    spread = np.array([first[f"s{k}"] for k in range(size)])
    spread = np.where(spread > 1e-9, spread, 1.0)
    pairs = stored(preference_pairs(rows, n, partners), "preference-pairs")
    weights = np.zeros(size)
    for _ in range(steps):
        gradient, hessian, count = _newton_sums(pairs, mean, spread, weights)
        if not count:
            break
        step = np.linalg.solve(hessian / count + ridge * np.eye(size), gradient / count + ridge * weights)
        step *= min(1.0, 4 / max(np.abs(step).max(), 1e-12))
        weights = weights - step
        if np.abs(step).max() < 1e-4:
            break
    plain = lambda values: tuple(float(value) for value in values)
    fitted = Ranking(plain(mean), plain(spread), plain(weights), 0.0)
    share = bad / n
    low, high = rows.agg(F.percentile_approx(fitted.utility("_features"), [share, min(1.0, share + 1 / n)], 100_000)).first()[0]
    return Ranking(fitted.mean, fitted.spread, fitted.weights, (low + high) / 2)


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of `docs`, learned from the rows outside the held-out part."""
    require(docs, "doc_id", "text")
    features = stored(with_features(docs.select(F.col("doc_id").cast("long"), "text"), "_features").drop("text"), "text-features")
    held_out = held_out_part(HELD_OUT_PARTS)
    ranking = learn(labelled(features, labels, held_out))
    return features.select("doc_id", held_out.alias("held_out"), ranking.score("_features").alias("score")).select(
        "doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` which the classifier accepts, with their columns."""
    features = stored(with_features(docs.select(F.col("doc_id").cast("long"), "text"), "_features").drop("text"), "text-features")
    ranking = learn(labelled(features, labels, held_out_part(HELD_OUT_PARTS)))
    name = free_name(docs, "_features")
    return with_features(docs, name).filter(ranking.score(name) >= 0.5).select(*docs.columns)
