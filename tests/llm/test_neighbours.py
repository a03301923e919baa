import math

import numpy as np
from pyspark.sql import functions as F

from gigsift.llm import neighbours as op

query = lambda: F.col("vec_id") % 50 == 0


def exact(rows, queries, k=5):
    found = {}
    for q in queries:
        own = np.array(rows[q])
        scores = sorted((-(own @ (v := np.array(x))) / (math.sqrt(own @ own) * math.sqrt(v @ v)), i) for i, x in rows.items() if i != q)
        found[q] = [(i, -s) for s, i in scores[:k]]
    return found


def run(spark, rows, **options):
    table = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in rows], "vec_id long, embedding array<float>, label int")
    found = {}
    for r in sorted(op.nearest(table, query(), **options).collect(), key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(found[r.query_id])
    return found


def test_small_tables_are_exact(spark):
    random = np.random.default_rng(0)
    rows = {i: random.normal(size=24).astype(np.float32).tolist() for i in range(400)}
    found, expected = run(spark, rows.items()), exact(rows, range(0, 400, 50))
    assert {q: [i for i, _ in hits] for q, hits in found.items()} == {q: [i for i, _ in hits] for q, hits in expected.items()}
    assert all(abs(a[1] - b[1]) < 1e-12 for q in found for a, b in zip(found[q], expected[q]))


def test_recall_with_narrow_windows(spark):
    random = np.random.default_rng(1)
    centres = random.normal(size=(40, 32))
    rows = {i: (centres[i % 40] + 0.5 * random.normal(size=32)).astype(np.float32).tolist() for i in range(3000)}
    found, expected = run(spark, rows.items(), block=128, reach=1), exact(rows, range(0, 3000, 50))
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in expected[q]}) for q in expected)
    assert hits / (5 * len(expected)) >= 0.9


def test_windows_grow_so_that_recall_of_isotropic_data_holds():
    """The curves and windows that nearest() uses for this many points, without Spark."""
    n, size = 200_000, 64
    random = np.random.default_rng(2)
    rows = random.normal(size=(n, size)).astype(np.float32)
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    asked = np.arange(0, n, n // 50)
    block, reach = op.window_of(n)
    seen = np.zeros((len(asked), n), dtype=bool)
    for frame, shift in zip(*op.curve_frames(size)):
        cells = np.clip(((rows @ frame + 1) / 4 + shift / 2) * (1 << op.BITS), 0, (1 << op.BITS) - 1).astype(np.int64)
        blocks = np.empty(n, dtype=np.int64)
        blocks[np.argsort(op.hilbert_keys(cells, op.BITS))] = np.arange(n) // block
        seen |= np.abs(blocks[asked][:, None] - blocks[None, :]) <= reach
    best = np.argsort(-(rows[asked] @ rows.T), axis=1)[:, 1:6]
    assert np.take_along_axis(seen, best, axis=1).mean() >= 0.9
    assert op.window_of(2000) == (op.BLOCK, op.REACH) and op.window_of(10**8)[0] == op.WIDEST
    assert all((2 * r + 1) * b >= c * op.SHARE for c in (10**3, 10**5, 10**6, 10**8) for b, r in [op.window_of(c)])


def test_ties_copies_and_useless_vectors(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(700, 0, -1)] + [(0, [1.0, 2.0, 3.0]), (0, [1.0, 2.0, 3.0]), (750, [-0.0, 0.0, 1.0]), (751, [0.0, 0.0, 2.0]), (752, [0.0, 0.0, 1.0])]
    rows += [(800, None), (801, [0.0, 0.0, 0.0]), (802, [1.0, None, 1.0]), (803, [1.0, float("nan"), 0.0]), (850, [float("inf"), 1.0, 1.0]), (900, [1.0]), (None, [1.0, 2.0, 3.0])]
    found = run(spark, rows)
    assert sorted(found) == [*range(0, 701, 50), 750]
    assert [i for i, _ in found[0]] == [1, 2, 3, 4, 5] and [i for i, _ in found[300]] == [0, 1, 2, 3, 4]
    assert [i for i, _ in found[750]][:2] == [751, 752] and len(found[750]) == 5
    assert run(spark, []) == {} and run(spark, [(0, [1.0, 1.0])]) == {}
    assert len(run(spark, [(0, [1.0, 1.0]), (1, [1.0, 0.0])])[0]) == 1


def test_lengths_are_compared_within_themselves(spark):
    random = np.random.default_rng(6)
    short = {i: random.normal(size=8).astype(np.float32).tolist() for i in range(120)}
    long = {i: random.normal(size=9).astype(np.float32).tolist() for i in range(150, 170)}
    found = run(spark, [*short.items(), *long.items(), (201, [1.0] * 10)])
    expected = {**exact(short, (0, 50, 100)), **exact(long, (150,))}
    assert {q: [i for i, _ in hits] for q, hits in found.items()} == {q: [i for i, _ in hits] for q, hits in expected.items()}


def test_hilbert_keys_visit_every_cell_in_unit_steps():
    for size, bits in ((2, 4), (3, 3), (4, 2)):
        axes = np.indices((1 << bits,) * size).reshape(size, -1).T
        keys = op.hilbert_keys(axes, bits)
        assert sorted(keys.tolist()) == list(range(len(axes)))
        walk = axes[np.argsort(keys)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()
