import helpers
import numpy as np
import zlib
from pyspark.sql import functions as F

from gigsift.llm import quality as op


def corpus(spark, n=240):
    good = lambda i: ". ".join(helpers.words(i * 9 + k, 12) for k in range(6)) + "."
    bad = lambda i: " ".join(f"{w.upper()}!!" for w in helpers.words(i, 60).split()) if i % 4 else " | ".join(helpers.words(i, 60).split())
    texts = [bad(i) if i % 5 == 0 else good(i) for i in range(n)]
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(n)], "doc_id long, quality int, toxic int")
    return helpers.table(spark, texts), labels


def test_held_out_documents_are_told_apart_and_never_learned_from(spark):
    docs, labels = corpus(spark)
    rows = {r.doc_id: r for r in op.score_quality(docs, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in rows.items())
    assert all(r.predicted == int(i % 5 != 0) == int(r.score >= 0.5) and 0 <= r.score <= 1 for i, r in rows.items())
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    flipped = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in op.score_quality(docs, flipped).collect()}
    assert all(abs(again[i] - r.score) < 1e-9 for i, r in rows.items())
    kept = op.keep_good(docs, labels)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [i for i in range(240) if i % 5]


def test_newton_steps_reach_the_least_loss(spark):
    random = np.random.default_rng(0)
    size = len(op.FEATURES)
    better, worse = random.normal(0.2, 1, (500, size)), random.normal(0, 1, (500, size))
    pairs = spark.createDataFrame([(b.tolist(), w.tolist()) for b, w in zip(better, worse)], "better array<double>, worse array<double>")
    weights = random.normal(0, 0.1, size)
    gradient, hessian, count = op._newton_sums(pairs, np.zeros(size), np.ones(size), weights)
    apart = np.clip(better, -5, 5) - np.clip(worse, -5, 5)
    wrong = 1 / (1 + np.exp(apart @ weights))
    assert count == 500 and np.allclose(gradient, -(wrong @ apart)) and np.allclose(hessian, (apart.T * (wrong * (1 - wrong))) @ apart)


def test_pairs_grow_with_the_rows_and_meet_in_their_group(spark):
    rows = spark.createDataFrame([(i, [float(i)], i % 7 != 0) for i in range(5000)], "doc_id long, _features array<double>, good boolean")
    pairs = op.preference_pairs(rows, 5000).collect()
    assert len(pairs) == 4 * sum(i % 7 != 0 for i in range(5000))
    assert all(int(p.better[0]) % 7 and int(p.worse[0]) % 7 == 0 for p in pairs)


def test_odd_rows_and_odd_labels(spark):
    docs, labels = corpus(spark, 60)
    odd = helpers.odd(spark).unionByName(docs.withColumn("doc_id", F.col("doc_id") + 100))
    told = labels.withColumn("doc_id", F.col("doc_id") + 100).union(spark.createDataFrame(
        [(None, 1, 0), (101, None, None), (102, 7, 0), (103, 1, 0), (103, 0, 1)], "doc_id long, quality int, toxic int"))
    rows = op.score_quality(odd, told).collect()
    assert len(rows) == 70 and all(0 <= r.score <= 1 and r.held_out is not None for r in rows)
    assert {r.score for r in op.score_quality(docs, labels.filter("quality = 1")).collect()} == {0.5}
    assert op.score_quality(helpers.none(spark), labels).count() == 0 and op.keep_good(docs, labels.limit(0)).count() == 60
