import random

import helpers
import numpy as np
import pytest

from gigsift.llm import metric_join as op


def plain_set(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[i:i + 4]) for i in range(max(1, len(words) - 3))} if words else set()


def brute(docs):
    """(doc_id, n_shingles, component_id) of (doc_id, text) rows, by all pairs."""
    sets = [plain_set(text) for _, text in docs]
    root = list(range(len(docs)))
    for i, a in enumerate(sets):
        for k in range(i):
            if a and sets[k] and 100 * len(a & sets[k]) >= 85 * len(a | sets[k]) and root[i] != root[k]:
                low, high = sorted((root[i], root[k]))
                root = [low if r == high else r for r in root]
    names = {}
    for (doc_id, _), r in zip(docs, root):
        if doc_id is not None:
            names[r] = min(doc_id, names.get(r, doc_id))
    return sorted(((d, len(s), names.get(r) if s else d) for (d, _), s, r in zip(docs, sets, root)), key=str)


def rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=str)


def edited(words, draw, edits):
    words = list(words)
    for _ in range(edits):
        words[draw.randrange(len(words))] = f"e{draw.randrange(10 ** 9)}"
    return " ".join(words)


def family(seed, size, length, most):
    """Copies of one text with up to `most` words changed, so that distances lie on both sides of the radius."""
    draw, base = random.Random(seed), helpers.words(seed, length, 5000).split()
    return [edited(base, draw, draw.randrange(most + 1)) for _ in range(size)]


def test_links_on_the_border_are_exact(spark):
    texts = []
    for i in range(120):  # heads of one sequence of distinct words: similarities of 0.80 to 0.90, some exactly 0.85
        base = [f"d{i}x{k}" for k in range(103 if i % 3 else 23)]
        texts += [" ".join(base), " ".join(base[:round((len(base) - 3) * (80 + i % 11) / 100) + 3])]
    found = rows(op.joined(helpers.table(spark, texts)))
    assert found == brute(list(enumerate(texts)))
    assert 40 < len({r[2] for r in found}) < 240


@pytest.mark.parametrize("options", [{}, {"hot": 5, "leaf": 4, "pivots": 3, "rounds": 2, "block": 8}, {"hot": 3, "leaf": 2, "pivots": 2, "rounds": 4, "block": 4}])
def test_families_are_joined_exactly(spark, options):
    common = helpers.words(77, 50, 5000)
    texts = family(1, 90, 120, 6) + family(2, 60, 60, 4) + [f"{common} {helpers.words(300 + i, 8, 5000)}" for i in range(60)]
    texts += family(3, 70, 200, 30) + [helpers.words(900 + i, 40, 5000) for i in range(40)]
    texts += [texts[0]] * 30 + [texts[1].upper()] + ["", " \n", "one two", "One  two", "one two three"]
    random.Random(5).shuffle(texts)
    found = rows(op.joined(helpers.table(spark, texts), **options))
    assert found == brute(list(enumerate(texts)))


def test_sketches_never_overstate_a_difference():
    draw = np.random.default_rng(2)
    for size in (1, 5, 63, 64, 65, 300, 3000, 30_000):
        a = np.unique(draw.integers(0, 1 << 63, size).astype(np.uint64))
        b = np.unique(np.concatenate([a[size // 3:], draw.integers(0, 1 << 63, size // 4 + 1).astype(np.uint64)]))
        exact = len(np.setxor1d(a, b))
        assert op.least_difference(op.sketch_of(a), op.sketch_of(b)) <= exact
        shared = len(np.intersect1d(a, b))
        assert bool(op.may_link(exact, len(a) + len(b))) == (100 * shared >= 85 * (len(a) + len(b) - shared))


def test_counts_of_frequent_shingles_span_tasks(spark):
    texts = [f"{helpers.words(1, 20, 9000)} {helpers.words(10 + i, 30, 9000)}" for i in range(80)]
    bits = op.slot_bits(80 * 47)
    found = {r.slot: r.n for r in op.frequent_shingles(helpers.table(spark, texts).repartition(7), bits, 64).collect()}
    shared = op.Shingles()(helpers.words(1, 20, 9000).encode())
    assert found == {int(h >> np.uint64(32 - bits)): 80 for h in shared}


def test_odd_rows(spark):
    docs = [(r.doc_id, r.text) for r in helpers.odd(spark).collect()]
    assert rows(op.joined(helpers.odd(spark))) == brute(docs)
    assert rows(op.joined(helpers.odd(spark), hot=1, leaf=1)) == brute(docs)
    assert op.joined(helpers.none(spark)).count() == 0
