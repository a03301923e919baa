import math
import random
import re
from collections import Counter

import helpers
import numpy as np
from pyspark.sql import functions as F

from gigsift.llm import ranked_search as op

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top=op.TOP):
    counted = [(doc_id, Counter(plain_terms(text))) for doc_id, text in docs]
    counted = [(doc_id, tfs) for doc_id, tfs in counted if tfs]
    big_n, big_l = len(counted), sum(sum(tfs.values()) for _, tfs in counted)
    df = Counter(term for _, tfs in counted for term in tfs)
    out = []
    for item_id, text in items:
        scored = []
        for doc_id, tfs in counted:
            m = 75 + 25 * sum(tfs.values()) * big_n // big_l
            score = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * (10 ** 9 * tfs[t] // (1000 * tfs[t] + 12 * m)) for t in plain_terms(text) if t in tfs)
            if score > 0 and doc_id is not None:
                scored.append((-score, doc_id))
        out += [(item_id, rank, doc_id, -score) for rank, (score, doc_id) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


def benchmark(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def rows(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_ranks_are_those_of_a_scan(spark):
    texts = [helpers.words(i, 5 + i % 90, 60) for i in range(300)] + ["the same text"] * 30 + ["Ünïcode-Ä É\x85x w1 W1", ""]
    items = [(i, " ".join(helpers.words(i * 31 % 7, 20, 60).split()[:8] + helpers.words(i, 6, 60).split())) for i in range(25)]
    items += [(90, "the same SAME text"), (91, "nothing-here matches"), (92, "ünïcode É\x85x"), (93, "Ünïcode"), (94, "")]
    found = rows(op.search(helpers.table(spark, texts), benchmark(spark, items)))
    assert found == brute(list(enumerate(texts)), items)
    assert [r[2] for r in sorted(r for r in found if r[0] == 90)] == list(range(300, 320))


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    texts = [helpers.words(i, 30, 40) for i in range(120)]
    items = [(i, helpers.words(i, 12, 40)) for i in range(30)]
    monkeypatch.setattr(op, "BLOCK_TERMS", 100)
    monkeypatch.setattr(op, "CELLS", 64)
    monkeypatch.setattr(op, "LONGEST", 0)
    assert rows(op.search(helpers.table(spark, texts), benchmark(spark, items), 5)) == brute(list(enumerate(texts)), items, 5)


def test_shared_sets_are_added_once():
    draw = random.Random(4)
    sets = [draw.sample(range(200), 12) for _ in range(10)]
    items = [[(t, 1 + (t % 5 == 0)) for t in sorted({*sets[i % 10], *sets[(i * 3 + 1) % 10], 200 + i})] for i in range(80)]
    graph = op.Sharing(items, 300)
    plain = sum(map(len, items))
    assert graph.additions() < plain / 3 and graph.levels
    docs, terms = (np.array([draw.randrange(n) for _ in range(500)]) for n in (7, 300))
    values = np.array([draw.randrange(1000) for _ in range(500)])
    table = np.zeros((300, 7), dtype=np.int64)
    np.add.at(table, (terms, docs), values)
    used = sorted({t for item in items for t, _ in item})
    kept = np.isin(terms, used)
    scores = graph.scores(docs[kept], terms[kept], values[kept], 7)
    assert (scores == [sum(c * table[t] for t, c in item) for item in items]).all()


def test_odd_rows(spark):
    items = [(1, "one two"), (1, "three"), (None, "id at all"), (2, None), (3, "")]
    found = rows(op.search(helpers.odd(spark), benchmark(spark, items)))
    docs = [(r.doc_id, r.text) for r in helpers.odd(spark).collect()]
    assert found == brute(docs, items) and found
    assert op.search(helpers.none(spark), benchmark(spark, items)).count() == 0
    assert op.search(helpers.odd(spark), benchmark(spark, [])).count() == 0
    extra = benchmark(spark, items).withColumns({"score": F.lit("x"), "item": F.lit("y"), "block": F.lit(1)})
    assert rows(op.search(helpers.odd(spark), extra)) == found
