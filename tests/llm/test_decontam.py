import itertools
import random

import helpers
import numpy as np
import pytest
from pyspark.sql import functions as F

from gigsift.llm import decontam as op


def brute(texts, items, window=op.WINDOW, similarity=op.SIMILARITY):
    """(doc, item) -> most agreeing words of an aligned stretch, over all alignments."""
    split = lambda text: op._WORD.findall((text or "").lower())
    found = {}
    for i, text in enumerate(texts):
        doc = split(text)
        for k, item_text in enumerate(items):
            item = split(item_text)
            if len(item) < op.MIN_ITEM:
                continue
            size, best = min(window, len(item)), 0
            for offset in range(size - len(item), len(doc) - size + 1):
                same = [0 <= p + offset < len(doc) and doc[p + offset] == item[p] for p in range(len(item))]
                inside = [p for p in range(len(item)) if 0 <= p + offset < len(doc)]
                for p in range(len(item) - size + 1):
                    if p in inside and p + size - 1 in inside:
                        best = max(best, sum(same[p:p + size]))
            if best >= similarity * size:
                found[i, k] = best
    return found


def changed(words, n, draw):
    words = list(words)
    for at in draw.sample(range(len(words)), n):
        words[at] = f"sub{at}"
    return words


def corpus():
    draw = random.Random(6)
    items = [helpers.words(100 + i, n, 3000) for i, n in enumerate((14, 20, 33, 59, 8, 9, 7))] + [None, "", helpers.words(100, 14, 3000)]
    texts = []
    for i in range(60):
        item = items[i % 6].split()
        part = changed(item, len(item) * (i // 6 % 4) // 10, draw)
        around = helpers.words(i, 30, 3000).split()
        texts.append(" ".join([*around[:i % 30], *part, *around[i % 30:]]))
    texts += [items[3].upper().replace(" ", ",\n"), " ".join(items[3].split()[:19]), " ".join(items[3].split()[30:51]), None, "", helpers.words(1, 500)]
    return texts, items


def test_matches_brute_force(spark):
    texts, items = corpus()
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.matched for r in op.leaks(helpers.table(spark, texts), bench).collect()}
    assert found == brute(texts, items) and {i for i, _ in found} >= {0, 1, 2, 3, 4, 5, 60}
    kept = op.without_leaks(helpers.table(spark, texts), bench)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(range(len(texts))) - {i for i, _ in found})
    assert kept.columns == helpers.table(spark, []).columns


@pytest.mark.parametrize("length", range(op.MIN_ITEM, op.WINDOW + 1))
def test_masks_hit_every_stretch_that_is_similar_enough(length):
    places = [sum(1 << (start + at) for at, sign in enumerate(mask) if sign == "1") for mask in op.MASKS for start in range(length - len(mask) + 1)]
    for bad in itertools.combinations(range(length), length - -(-length * 8 // 10)):
        wrong = sum(1 << at for at in bad)
        assert any(not place & wrong for place in places)


def test_the_field_loses_no_seed(spark):
    _, items = corpus()
    known = op.item_seeds(op.item_tokens(spark.createDataFrame(list(enumerate(items)), "item_id long, text string")))
    bits = op.bit_field(known)
    for text in filter(None, items):
        tokens = op.Tokens()(text)
        if len(tokens) >= op.MIN_ITEM:
            assert len(op._sieved(tokens, bits)[0]) == len(op.seeds(tokens)[0])
    assert len(op._sieved(op.Tokens()(helpers.words(5, 20_000, 9_000_000)), bits)[0]) == 0


def test_odd_rows(spark):
    _, items = corpus()
    bench = spark.createDataFrame([(1, helpers.words(1, 60_000)), (2, None), (None, items[0]), (1, items[1])], "item_id long, text string")
    found = op.leaks(helpers.odd(spark), bench).collect()
    assert [(r.doc_id, r.item_id, r.matched) for r in found] == [(4, 1, 20)]
    assert op.leaks(helpers.none(spark), bench).count() == 0 and op.leaks(helpers.odd(spark), bench.limit(0)).count() == 0
    left = sorted(str(r.doc_id) for r in op.without_leaks(helpers.odd(spark), bench).collect())
    assert left == ["1", "2", "3", "5", "5", "6", "None", "None"]
    assert np.array_equal(op.Tokens(2)("a b c a"), op.Tokens()("a b c a"))


def test_rows_without_an_id_are_searched(spark):
    items = [helpers.words(900, 30, 5000)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = [helpers.words(1, 50), f"{helpers.words(2, 20)} {items[0]}", helpers.words(3, 60)]
    docs = helpers.table(spark, texts).withColumn("doc_id", F.when(F.col("doc_id") > 1, F.col("doc_id")))
    assert sorted(r.text for r in op.without_leaks(docs, bench).collect()) == sorted([texts[0], texts[2]])
