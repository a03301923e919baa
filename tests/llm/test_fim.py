import hashlib
import random
import re

import helpers
import numpy as np
import pytest
from pyspark.sql import functions as F

from gigsift.llm import fim as op

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def plain(text, doc_id):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]
    if not text or h[2] % 100 >= 90 or any(mark in text for mark in ("<P>", "<S>", "<M>")):
        return text, "plain", len(units), None, None
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return f"<S>{s}<P>{p}<M>{m}", "spm", len(units), len(p), len(m)
    return f"<P>{p}<S>{s}<M>{m}", "psm", len(units), len(p), len(m)


def noise(seed, n):
    draw = random.Random(seed)
    return "".join(draw.choice("abZ é\U0001f600\n<PSM>\x85 0") for _ in range(n))


@pytest.mark.parametrize("block,step", [(1, 1), (3, 9), (8, 64), (256, 1 << 22)])
def test_cuts_are_those_of_a_scan(block, step):
    for seed in range(40):
        text = noise(seed, seed * 7)
        units, laid = UNIT.findall(text), op.Text(text.encode(), block, step)
        assert (laid.n, laid.chars) == (len(units), len(text))
        for k in range(len(units) + 1):
            head = "".join(units[:k])
            assert laid.cut(k) == (len(head.encode()), len(head))


def test_tree_nodes_hold_the_sums_below_them():
    counts = np.arange(1, 14)
    units, _ = op.Fenwick(counts, counts).trees
    assert all(units[i] == counts[i - (i & -i):i].sum() for i in range(1, 14))


def test_outputs_and_restored_texts(spark):
    texts = [noise(i, i * 3) for i in range(200)] + ["<", ">", "<S", "S><M>", "a<P", "<P<S<M" * 30, "x" * 5000, helpers.words(1, 30_000)]
    rows = op.fill_in_middle(helpers.table(spark, texts)).withColumn("back", op.restored()).collect()
    assert len(rows) == len(texts) and {r.form for r in rows} == {"plain", "psm", "spm"}
    for r in rows:
        assert (r.output, r.form, r.n, r.prefix_chars, r.middle_chars) == plain(texts[r.doc_id], r.doc_id)
        assert r.back == texts[r.doc_id]


def test_odd_rows(spark):
    docs = helpers.odd(spark).withColumns({"form": F.lit("mine"), "Output": F.lit("mine")}).drop("Output")
    found = op.fill_in_middle(docs).withColumn("back", op.restored()).collect()
    assert len(found) == 10 and all((r.output, r.form, r.n, r.prefix_chars, r.middle_chars) == plain(r.text, r.doc_id) for r in found)
    assert all(r.back == (r.text or "") for r in found) and op.fill_in_middle(helpers.none(spark)).count() == 0


def test_a_long_text_is_cut_without_being_scanned():
    text = ("word, " * 2_000_000).encode()
    laid = op.Text(text)
    assert laid.n == 6_000_000 and laid.cut(3_000_000) == (6_000_000, 6_000_000)
