"""The stages against brute force, each on the rows its predecessor kept."""

import os
import re
import sys

import helpers
import test_decontam
import test_line_dedup

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
import corpus_pipeline
from gigsift.llm import line_dedup, quality

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def folder(spark, path):
    items = [helpers.words(500 + i, 30, 3000) for i in range(3)]
    common = "Subscribe to our letter today."
    texts = []
    for i in range(160):
        body = ". ".join(helpers.words(i * 9 + k, 14, 3000) for k in range(6)) + "."
        if i % 8 == 0:
            body = " ".join(f"{w.upper()}!!" for w in body.split())
        elif i % 8 == 1:
            body = f"{body}\n{common}"
        elif i % 8 == 2:
            body = f"{body} {items[i % 3]}"
        elif i % 8 == 3:
            body = ". ".join(helpers.words(i // 40 * 1000 + k, 14, 3000) for k in range(6)) + "."
        texts.append(body)
    texts += [None, ""]
    docs = [(i, t, ["en", "de"][i % 2], f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 8 != 0), 0) for i in range(0, 160)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return docs, items


def plain_groups(texts):
    """The first place of the group of each text, groups being connected by a Jaccard similarity of 0.8 over distinct five-word shingles."""
    sets = []
    for text in texts:
        found = text.encode().lower().split()
        sets.append({tuple(found[i:i + 5]) for i in range(max(1, len(found) - 4))} if found else set())
    root = list(range(len(texts)))
    for i, own in enumerate(sets):
        for k in range(i):
            if own == sets[k] or 5 * len(own & sets[k]) >= 4 * len(own | sets[k]):
                a, b = sorted((root[i], root[k]))
                root = [a if r == b else r for r in root]
    return root


def test_stages_match_brute_force(spark, tmp_path):
    docs, items = folder(spark, tmp_path)
    assert [re.match(r"\w+", name)[0] for name, _ in corpus_pipeline.STAGES] == ["quality", "line", "simhash", "benchmark", "source"]
    rows, frame = {d[0]: d for d in docs}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    out = []
    for _, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, str(tmp_path)).cache()
        out.append({r.doc_id: r for r in frame.collect()})
        if len(out) < 5:
            assert frame.schema == spark.createDataFrame([], COLUMNS).schema
    good, lines, single, clean, mixed = out
    features = {i: quality.text_features((t or "").encode()) for i, t, *_ in docs}
    assert set(good) - {160, 161} == {i for i in features if i % 8 and i < 160} and all(good[i].text == rows[i][1] for i in good)
    order = sorted(good)
    brute = {i: n for i, _, n, _ in test_line_dedup.brute([(i, good[i].text) for i in order], line_dedup.MIN_DOCS)}
    assert set(lines) == set(good) and all((lines[i].text or "") == (good[i].text or "").replace("\nSubscribe to our letter today.", "") for i in order)
    assert sum(brute.values()) == sum((good[i].text or "").count("Subscribe") for i in order) > 0
    assert all(lines[i].n_chars == len(lines[i].text) for i in order)
    order = sorted(lines)
    assert set(single) == {order[r] for r in plain_groups([lines[i].text or "" for i in order])}
    order = sorted(single)
    leaky = {order[i] for i, _ in test_decontam.brute([single[i].text for i in order], items)}
    assert set(clean) == set(order) - leaky and leaky
    assert set(mixed) <= set(clean) and 0 < len(mixed) < len(clean) and all(mixed[i].text == clean[i].text for i in mixed)
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(mixed)


def test_empty_tables(spark, tmp_path):
    folder(spark, tmp_path)
    empty = spark.createDataFrame([], COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
