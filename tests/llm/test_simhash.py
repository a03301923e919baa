import helpers
import numpy as np
import xxhash

from gigsift.llm import simhash as op
from gigsift.llm.graph import components


def plain_print(text, size=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(prints, budget=3):
    label = list(range(len(prints)))
    def root(i):
        while label[i] != i:
            i = label[i]
        return i
    for i, a in enumerate(prints):
        for j in range(i):
            if bin(a ^ prints[j]).count("1") <= budget:
                a_root, b_root = root(i), root(j)
                label[max(a_root, b_root)] = min(a_root, b_root)
    return [root(i) for i in range(len(prints))]


def test_fingerprints_and_components_match_brute_force(spark):
    base = helpers.words(2, 300).split()
    texts = [" ".join(base[:i % 5] + ["X" * (i % 3)] + base[i % 5:]) for i in range(20)] + [helpers.words(i, 50) for i in range(20)] + [None, "", "One two", "one TWO"]
    docs = helpers.table(spark, texts)
    rows = {r.doc_id: r for r in op.near_duplicates(docs).collect()}
    prints = [plain_print(t) for t in texts]
    assert [rows[i].fingerprint for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [rows[i].component_id for i in range(len(texts))] == linked(prints)


def test_trie_join_matches_all_pairs_for_every_split():
    random = np.random.default_rng(1)
    centres = random.integers(0, 1 << 63, 60).astype(np.uint64)
    leaves = np.unique(np.concatenate([centres] + [centres ^ (np.uint64(1) << random.integers(0, 64, 60).astype(np.uint64))
                                                   ^ (np.uint64(1) << random.integers(0, 64, 60).astype(np.uint64)) for _ in range(8)]))
    expected = linked(leaves.tolist())
    assert op.trie_join(leaves, 0).tolist() == expected == op.trie_join(leaves, 0, walk=50).tolist()


def test_every_link_is_found_in_some_turn(spark):
    random = np.random.default_rng(4)
    base = random.integers(-(1 << 62), 1 << 62, 400)
    flips = np.array([sum(1 << int(b) for b in random.choice(64, 3, replace=False)) for _ in range(400)], dtype=np.uint64).view(np.int64)
    prints = np.unique(np.concatenate([base, base ^ flips]))
    frame = spark.createDataFrame([(int(p),) for p in prints], "fp long")
    label = {r.node: r.root for r in components(op.near_links(frame)).collect()}
    assert all(label[int(a)] == label[int(a ^ f)] for a, f in zip(base, flips)) and len(set(label.values())) == 400


def similarity(a, b, size=5):
    sets = [{tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} for w in (a.split(), b.split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_similar_groups_hold_what_is_similar_and_nothing_else(spark):
    random, texts = np.random.default_rng(7), []
    for i in range(60):
        base = helpers.words(i, 120 + 5 * i, 3000).split()
        texts.append(" ".join(base))
        for _ in range(3):
            copy = list(base)
            for at in random.choice(len(copy), max(1, len(copy) // (60 + i)), replace=False):
                copy[at] = f"edit{random.integers(1 << 30)}"
            texts.append(" ".join(copy))
    texts += [helpers.words(1000 + i, 150, 3000) for i in range(60)]
    found = {r.doc_id: r.component_id for r in op.similar_groups(helpers.table(spark, texts)).collect()}
    signed = [int.from_bytes(op.signature(t.encode().lower().split())) for t in texts]
    assert [found[i] for i in range(len(texts))] == linked(signed, op.MOST)
    pairs = [(i, j) for i in range(0, 240, 4) for j in (i + 1, i + 2, i + 3) if similarity(texts[i], texts[j]) >= 0.85]
    assert len(pairs) > 90 and sum(found[i] == found[j] for i, j in pairs) >= 0.97 * len(pairs)
    assert all(found[i] == i for i in range(240, 300))


def test_links_are_those_of_a_similarity_of_four_fifths(spark):
    texts, random = [], np.random.default_rng(11)
    for i in range(150):  # neighbours of 0.70 to 0.90, cut from one sequence of distinct words
        size = int(random.integers(60, 300))
        base = [f"d{i}x{k}" for k in range(size)]
        shared = round((0.70 + 0.2 * i / 150) * (size - 4))
        texts += [" ".join(base), " ".join(base[:shared + 4])]
    found = {r.doc_id: r.component_id for r in op.similar_groups(helpers.table(spark, texts)).collect()}
    alike = [similarity(texts[k], texts[k + 1]) >= 0.8 for k in range(0, 300, 2)]
    linked_pairs = [found[k] == found[k + 1] for k in range(0, 300, 2)]
    assert not any(got and not true for got, true in zip(linked_pairs, alike)) and 50 < sum(alike) < 100
    assert sum(linked_pairs) >= 0.99 * sum(alike)


def test_the_first_walk_decides_the_work_alone(spark, monkeypatch):
    base, texts = [helpers.words(50 + i, 60) for i in range(6)], []
    for number, own in enumerate(base):
        own = own.split() if isinstance(own, str) else list(own)
        for change in range(8):  # from equal texts to such just below the bound
            texts.append(" ".join([*own[:len(own) - change], *(f"new{number}x{change}y{k}" for k in range(change))]))
    found = []
    for early in (1, op.PRINTS):
        monkeypatch.setattr(op, "EARLY", early)
        found.append({r.doc_id: r.component_id for r in op.similar_groups(helpers.table(spark, texts)).collect()})
    assert found[0] == found[1] and len(found[0]) == len(texts) and 6 <= len(set(found[0].values())) < len(texts)


def test_repeated_shingles_count_once(spark):
    head, tail = helpers.words(1, 60, 9000), helpers.words(2, 40, 9000)
    texts = [f"{head} " + "again and again and over " * 60, "again and again and over " * 60 + tail]
    found = {r.doc_id: r.component_id for r in op.similar_groups(helpers.table(spark, texts)).collect()}
    assert similarity(*texts) < 0.5 and found == {0: 0, 1: 1}


def test_a_dense_group_is_walked_without_all_its_pairs():
    random = np.random.default_rng(3)
    noise = lambda n: sum((np.uint64(1) << random.integers(0, 64, n).astype(np.uint64)) for _ in range(1))
    leaves = np.unique(np.uint64(random.integers(1 << 62)) ^ noise(20_000) ^ noise(20_000))
    compared = []
    label = op.trie_join(leaves, 0, walk=4096, agree=lambda a, b: compared.append(len(a)) or np.ones(len(a), dtype=bool))
    assert (label == 0).all() and sum(compared) < len(leaves) ** 2 / 4


def test_odd_rows(spark):
    rows = [tuple(r) for r in op.near_duplicates(helpers.odd(spark)).collect()]
    assert len(rows) == 10 and sorted(str(r[0]) for r in rows if r[1] == "0" * 16) == ["1", "2", "3", "None"]
    assert {r[2] for r in rows if r[1] == "0" * 16} == {1} and op.near_duplicates(helpers.none(spark)).count() == 0


def test_one_of_each_group_stays(spark):
    texts = ["a b c d", "a b c d", helpers.words(1, 80), helpers.words(2, 80), "a  B c d"]
    kept = op.keep_one(helpers.table(spark, texts))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3] and kept.columns == helpers.table(spark, []).columns
    odd = op.keep_one(helpers.odd(spark))
    assert sorted(str(r.doc_id) for r in odd.collect()) == ["1", "4", "5", "5", "6", "None"]


def test_components_of_a_long_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(500)] + [(1000, 1000 + i) for i in range(1, 300)]
    found = {r.node: r.root for r in components(spark.createDataFrame(chain, "low long, high long")).collect()}
    assert all(found[i] == 0 for i in range(501)) and all(found[1000 + i] == 1000 for i in range(300))
