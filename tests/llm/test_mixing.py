import helpers
import pytest
from pyspark.sql import functions as F

from gigsift.llm import mixing as op


def corpus(spark, n=600):
    texts = [helpers.words(i, 5 + 7 * (i % 40)) if i % 9 else " | ".join(helpers.words(i, 40).split()) for i in range(n)]
    docs = helpers.table(spark, texts)
    return docs.withColumns({"source": F.when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("doc_id") % 5)),
                             "lang": F.element_at(F.array(*map(F.lit, ("en", "de", "fr"))), (F.col("doc_id") % 7 % 3 + 1).cast("int"))})


def plain_fit(cells, keep, targets, exponents, rounds=op.ROUNDS):
    total = sum(cells.values())
    weights, aims = dict(cells), []
    for at, margin in enumerate(op.MARGINS):
        sums = {}
        for cell, tokens in cells.items():
            sums[cell[at]] = sums.get(cell[at], 0) + tokens
        shares = {v: s / sum(targets[margin].values()) for v, s in targets[margin].items()} if margin in targets else {
            v: s ** exponents[margin] / sum(x ** exponents[margin] for x in sums.values()) for v, s in sums.items()}
        aims.append({v: shares.get(v, 0) * keep * total for v in sums})
    for _ in range(rounds):
        for at in range(3):
            now = {}
            for cell, weight in weights.items():
                now[cell[at]] = now.get(cell[at], 0) + weight
            weights = {c: min(cells[c], w * aims[at][c[at]] / now[c[at]]) if now[c[at]] else 0 for c, w in weights.items()}
    return {c: w / cells[c] for c, w in weights.items()}


@pytest.mark.parametrize("keep,targets", [(0.3, {}), (0.2, {"lang": {"en": 0.6, "de": 0.4}, "source": {"hot": 1, "s1": 1, "s2": 2, "s4": 1}})])
def test_probabilities_match_a_plain_fit_and_meet_the_margins(spark, keep, targets):
    measured = op.with_tokens(corpus(spark)).cache()
    cells, off = op.fit(measured, keep, targets)
    found = {tuple(v.removeprefix("=") for v in r[:3]): r.probability for r in cells.collect()}
    tokens = {tuple(r[:3]): r.t for r in measured.groupBy(*op.MARGINS).agg(F.sum("n_tokens").alias("t")).collect()}
    expected = plain_fit(tokens, keep, targets, op.EXPONENTS)
    assert found.keys() == expected.keys() and all(abs(found[c] - expected[c]) < 2e-3 for c in found) and all(0 <= p <= 1 for p in found.values())
    assert off < 0.01
    if targets:
        share = sum(p * tokens[c] for c, p in found.items() if c[1] == "en") / sum(p * tokens[c] for c, p in found.items())
        assert abs(share - 0.6) < 0.01 and all(p == 0 for c, p in found.items() if c[0] == "s3")


def test_sample_follows_the_plan_and_is_repeatable(spark):
    docs = corpus(spark)
    plan = op.mix_plan(docs).collect()
    kept = {r.doc_id for r in plan if r.kept}
    sample = op.sample_mix(docs)
    assert {r.doc_id for r in sample.collect()} == kept and len(plan) == 600
    expected = sum(r.probability for r in plan)
    assert abs(len(kept) - expected) < 4 * expected ** 0.5
    assert set(docs.columns) <= set(sample.columns)


def test_odd_rows(spark):
    rows = op.mix_plan(helpers.odd(spark)).collect()
    assert len(rows) == 10 and all(0 <= r.probability <= 1 and r.n_tokens >= 1 for r in rows)
    assert op.mix_plan(helpers.none(spark)).count() == 0 and op.sample_mix(helpers.none(spark)).count() == 0
    assert op.sample_mix(helpers.odd(spark), keep=1.0).count() <= 10
    topics = op.mix_plan(corpus(spark).withColumn("topic", F.lit("one")))
    assert {r.topic for r in topics.collect()} == {"one"}
