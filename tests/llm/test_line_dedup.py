import hashlib
from collections import Counter

import helpers
import numpy as np
import xxhash

from gigsift.llm import line_dedup as op
from gigsift.llm.cuckoo import CuckooFilter


def brute(rows, least):
    keys = [[line.strip(" \t\n\x0b\x0c\r").encode().lower() for line in (text or "").split("\n")] for _, text in rows]
    counts = Counter(key for found in keys for key in set(found) if key)
    kept = [[line for line, key in zip((text or "").split("\n"), found) if counts[key] < least or not key] for (_, text), found in zip(rows, keys)]
    return sorted((str(i), len(found), len(found) - len(k), hashlib.sha256("\n".join(k).encode()).hexdigest()) for (i, _), found, k in zip(rows, keys, kept))


def found(df):
    return sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_sha256) for r in df.select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect())


def test_matches_brute_force_with_a_hot_line(spark):
    texts = [f"COMMON line \n own {i}\n\n common LINE\t\npair {i // 3}" if i % 3 else f"other {i % 7}\n own {i}" for i in range(90)]
    docs = helpers.table(spark, texts)
    for least in (2, 3, 10):
        assert found(op.dedup_lines(docs, least)) == brute(list(enumerate(texts)), least)


def test_odd_rows_and_other_columns(spark):
    docs = helpers.odd(spark)
    out = op.dedup_lines(docs, 2)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert found(out) == brute(rows, 2)
    assert set(docs.columns) - {"n_lines"} < set(out.columns) and dict(out.dtypes)["n_lines"] == "bigint"
    assert op.dedup_lines(helpers.none(spark)).count() == 0


def test_deletion_undoes_insertion(spark):
    first, second = helpers.table(spark, ["a\nb", "b\nc", "b"]), helpers.table(spark, ["c\nd", "c", None], start=10)
    rows = lambda df: sorted(map(tuple, df.collect()))
    before = op.count_keys(op.line_keys(first))
    after = op.insert_documents(before, second)
    assert rows(op.delete_documents(after, second)) == rows(before)
    assert op.delete_documents(before, first).count() == 0
    shards = 3
    filters = op.build_filters(before, 2, shards)
    grown = op.update_filters(filters, before, after, 2, shards)
    shrunk = op.update_filters(grown, after, before, 2, shards)
    pairs = op.line_keys(first.union(second))
    hits = lambda f: {bytes(r.key) for r in op.filter_hits(pairs, f, shards).collect()}
    digest = lambda text: xxhash.xxh3_128_digest(text)
    assert hits(filters) == hits(shrunk) == {digest(b"b")} and hits(grown) == {digest(b"b"), digest(b"c")}


def test_filters_grow_with_their_keys(spark):
    """Twenty times the keys, then another number of shards: nothing is left over in lists, and what is found equals a rebuild."""
    lines = lambda begin, end: spark.range(begin, end).selectExpr("cast(id as string) AS text", "explode(array(1, 2)) AS doc_id")
    counts = op.count_keys(op.line_keys(lines(0, 300))).cache()
    after = op.insert_documents(counts, lines(300, 6_300)).cache()
    probes = op.line_keys(lines(0, 9_000)).cache()
    read = lambda f: [CuckooFilter.from_bytes(r.filter) for r in f.collect()]
    hits = lambda f, n: sorted((r.doc_id, bytes(r.key)) for r in op.filter_hits(probes, f, n).collect())
    small = op.build_filters(counts, 2, 2)
    for shards in (2, 5):
        grown = op.update_filters(small, counts, after, 2, shards).cache()
        rebuilt = op.build_filters(after, 2, shards)
        assert sorted(len(f.table) for f in read(grown)) == sorted(len(f.table) for f in read(rebuilt)) and not any(f.stash for f in read(grown))
        assert hits(grown, shards) == hits(rebuilt, shards) and len(hits(grown, shards)) >= 12_600
    # what has room is changed in place
    more = op.insert_documents(after, lines(6_300, 6_400))
    again = op.update_filters(grown, after, more, 2, 5)
    assert sorted(len(f.table) for f in read(again)) == sorted(len(f.table) for f in read(grown))
    assert set(hits(op.build_filters(more, 2, 5), 5)) >= {h for h in hits(grown, 5)} and len(hits(again, 5)) >= 12_800


def test_parts_follow_the_lines():
    assert op.parts_for(0, 1) == op.parts_for(10**6, 8) == op.SPREAD and op.parts_for(10**12, 1000) == -(-10**9 // op.PART_LINES)


def test_cuckoo_filter_keeps_every_key_until_it_is_deleted():
    random = np.random.default_rng(3)
    keys = random.integers(0, 1 << 63, (20_000, 2)).astype(np.uint64)
    full = CuckooFilter.for_items(15_000)  # too small: kicks and stash are used
    full.insert(keys)
    again = CuckooFilter.from_bytes(full.to_bytes())
    assert again.contains(keys).all()
    others = random.integers(0, 1 << 63, (50_000, 2)).astype(np.uint64)
    assert again.contains(others).mean() < 0.001
    again.delete(keys[:10_000])
    assert again.contains(keys[10_000:]).all() and again.contains(keys[:10_000]).mean() < 0.001
    again.delete(keys[10_000:])
    assert not again.table.any() and not again.stash
