"""SimHash near-dedup: 64-bit fingerprints, linked by a binary trie joined with itself.

Fingerprints at most `budget` differing bits apart are linked. The bits are cut into budget + 1 blocks; two linked fingerprints
agree in at least one block. For every block there is a trie over the fingerprints turned so that this block comes first. Its
subtrees below the first block are dealt over the tasks, and within a subtree node pairs are walked down together: both children
of both nodes are paired, differing bits are added up, and a pair is dropped as soon as it exceeds the budget.

Equal fingerprints are one leaf, so exact copies cost nothing. A task returns a spanning forest of the links it finds instead of
the links themselves, at most one row per leaf; components are joined up in Spark.

Defined results: a null or empty text, or one without words, has fingerprint zero and is linked like any other; with fewer words
than a shingle, the whole sequence is the one shingle; shingles count as often as they occur; rows of one doc_id are documents of
their own with the same name; a null doc_id is no candidate for a component's name and is null if its component has no other.
Memory: a task walks CHUNK leaves at a time, or one subtree if that is larger, and WALK node pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import free_name, mix, record_batch, require, stored, utf8, words_of
from .graph import components
from .metric_join import OF, block_pairs, sketch_of

SHINGLE, BUDGET, SEED, BITS = 3, 3, 42, 64
CHUNK, WALK = 1 << 18, 1 << 19

_PRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
_LINKS = pa.schema([("low", pa.int64()), ("high", pa.int64())])


def fingerprint(words: list[bytes], shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of a sequence of words."""
    if not words:
        return 0
    if len(words) < shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        joined = b" ".join(words)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(sizes + 1) - 1
        begins = (ends - sizes).tolist()
        view, digest = memoryview(joined), xxhash.xxh64_intdigest
        hashes = [digest(view[b:e], SEED) for b, e in zip(begins, ends[shingle - 1:].tolist())]
    counts = np.zeros(BITS, dtype=np.int64)
    for part in range(0, len(hashes), 1 << 16):
        lane = np.array(hashes[part:part + (1 << 16)], dtype=">u8")
        counts += np.unpackbits(lane.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long."""
    require(docs, "doc_id", "text")

    def run(batches):
        for batch in batches:
            prints = np.array([fingerprint(words_of(text), shingle) for text in utf8(batch.column(1))], dtype=np.uint64)
            yield record_batch(_PRINTS, (batch.column(0), prints.view(np.int64)))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def _unite(label: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Join the trees of label[] at the given links; afterwards every label is the smallest of its tree. Returns the links that joined
    two trees, which are a forest."""
    used = [(left[:0], right[:0])]
    while True:
        a, b = label[left], label[right]
        apart = a != b
        if not apart.any():
            return tuple(np.concatenate(ends) for ends in zip(*used))
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        upper, lower = np.maximum(a, b), np.minimum(a, b)
        np.minimum.at(label, upper, lower)
        hooks = np.flatnonzero(label[upper] == lower)
        hooks = hooks[np.unique(upper[hooks], return_index=True)[1]]
        used.append((left[hooks], right[hooks]))
        while not np.array_equal(up := label[label], label):
            label[:] = up


def trie_join(leaves: np.ndarray, depth: int, budget: int = BUDGET, walk: int = WALK, counted: int = BITS, agree=None) -> np.ndarray:
    """For sorted distinct uint64 leaves: the label of each, equal for leaves connected by links of at most `budget` differing
    bits, among leaves which agree in their first `depth` bits. Bits from `counted` on only tell leaves apart; `agree`, given two
    arrays of places, says which links hold.

    A node is a range of leaves with a common prefix. The frontier holds node pairs of one level; where it outgrows `walk` pairs,
    it is halved and the halves are walked one after the other. Pairs of nodes whose leaves are all connected already are left out,
    so a dense group costs about as much as a tree over it, not as all its pairs.
    """
    label = np.arange(len(leaves))
    for _ in trie_links(leaves, depth, budget, label, walk, counted, agree):
        pass
    return label


def trie_links(leaves: np.ndarray, depth: int, budget: int, label: np.ndarray, walk: int = WALK, counted: int = BITS, agree=None, unite: bool = True):
    """The links trie_join finds between trees of label[] (the smallest place of each leaf's tree), some at a time: with `unite` a
    spanning forest, which label[] is joined by; without it, all links between the trees given, and label[] stays."""
    size = len(leaves)
    tops = leaves >> np.uint64(BITS - depth) if depth else np.zeros(size, dtype=np.uint64)
    begins = np.flatnonzero(np.concatenate([[True], tops[1:] != tops[:-1]])) if size else np.empty(0, dtype=np.int64)
    ends = np.append(begins[1:], size)
    many = ends - begins > 1
    ones: dict[int, np.ndarray] = {}
    stack = [(depth, begins[many], ends[many], begins[many], ends[many], np.zeros(int(many.sum()), dtype=np.int8))]
    breaks, mask = None, np.uint64(((1 << counted) - 1) << (BITS - counted))
    while stack:
        level, a0, a1, b0, b1, errors = stack.pop()
        if breaks is None:
            breaks = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])
        open_pairs = (label[a0] != label[b0]) | (breaks[a1 - 1] != breaks[a0]) | (breaks[b1 - 1] != breaks[b0])
        a0, a1, b0, b1, errors = (part[open_pairs] for part in (a0, a1, b0, b1, errors))
        if len(a0) > walk:
            half = len(a0) // 2
            stack += [(level, a0[half:], a1[half:], b0[half:], b1[half:], errors[half:]),
                      (level, a0[:half], a1[:half], b0[:half], b1[:half], errors[:half])]
            continue
        leaf = (a1 - a0 == 1) & (b1 - b0 == 1)  # what is left of the paths has no branches: compare it at once
        if leaf.any():
            left, right = a0[leaf], b0[leaf]
            near = np.bitwise_count((leaves[left] ^ leaves[right]) & mask) <= budget
            left, right = left[near], right[near]
            if agree is not None and len(left):
                holds = agree(left, right)
                left, right = left[holds], right[holds]
            if len(left) and unite:
                yield _unite(label, left, right)
                breaks = None
            elif len(left):
                yield left, right
            a0, a1, b0, b1, errors = (part[~leaf] for part in (a0, a1, b0, b1, errors))
        if not len(a0):
            continue
        if level not in ones:
            bits = (leaves >> np.uint64(BITS - 1 - level)) & np.uint64(1)
            ones[level] = np.concatenate([[0], np.cumsum(bits.astype(np.int64))])
        count, cost = ones[level], int(level < counted)
        am, bm = a1 - (count[a1] - count[a0]), b1 - (count[b1] - count[b0])
        other = a0 != b0
        children = ((a0, am, b0, bm, errors, None), (am, a1, bm, b1, errors, None),
                    (a0, am, bm, b1, errors + cost, None), (am, a1, b0, bm, errors + cost, other))
        following = []
        for c0, c1, d0, d1, spent, only in children:
            keep = (c1 > c0) & (d1 > d0) & (spent <= budget) & ~((c0 == d0) & (c1 - c0 == 1))
            keep = keep if only is None else keep & only
            following.append([part[keep] for part in (c0, c1, d0, d1, spent)])
        stack.append((level + 1, *(np.concatenate(parts) for parts in zip(*following))))


def _turned(prints: np.ndarray, by: int) -> np.ndarray:
    return prints if by % BITS == 0 else (prints << np.uint64(by)) | (prints >> np.uint64(BITS - by))


def near_links(prints: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(low, high) links of distinct fingerprints (column fp) which connect just what is connected at `budget` differing bits."""
    block = BITS // (budget + 1)

    def run(batches):
        kept: list[np.ndarray] = []
        turn, waiting = None, 0

        def walk(leaves):
            label = trie_join(leaves, block, budget)
            tied = np.flatnonzero(label != np.arange(len(leaves)))
            ends = [_turned(leaves[at], (BITS - turn * block) % BITS).view(np.int64) for at in (label[tied], tied)]
            return record_batch(_LINKS, (np.minimum(*ends), np.maximum(*ends)))

        for batch in batches:
            turns = batch.column(0).to_numpy()
            leaves = batch.column(1).to_numpy().view(np.uint64) ^ np.uint64(1 << 63)
            cuts = [0, *(np.flatnonzero(np.diff(turns)) + 1).tolist(), len(turns)]
            for begin, end in zip(cuts, cuts[1:]):
                if begin == end:
                    continue
                if turn is not None and turns[begin] != turn and kept:
                    yield walk(np.concatenate(kept))
                    kept, waiting = [], 0
                turn = int(turns[begin])
                kept.append(leaves[begin:end])
                waiting += end - begin
                if waiting >= CHUNK:  # cut at the last border between subtrees
                    everything = np.concatenate(kept)
                    tops = everything >> np.uint64(BITS - block)
                    border = int(np.searchsorted(tops, tops[-1]))
                    if border:
                        yield walk(everything[:border])
                    kept, waiting = [everything[border:]], len(everything) - border
        if kept:
            yield walk(np.concatenate(kept))

    turns = F.explode(F.sequence(F.lit(0), F.lit(budget))).alias("turn")
    spun = prints.select("fp", turns).withColumn("leaf", F.expr(
        f"CASE WHEN turn = 0 THEN fp ELSE shiftleft(fp, turn * {block}) | shiftrightunsigned(fp, {BITS} - turn * {block}) END"))
    # leaves are sorted as signed longs; flipping the first bit makes that the unsigned order
    dealt = spun.select("turn", F.col("leaf").bitwiseXOR(F.lit(-(1 << 63))).alias("leaf"))
    subtree = F.shiftright("leaf", BITS - block)
    return (dealt.repartition(F.col("turn"), subtree).sortWithinPartitions("turn", "leaf")
            .mapInArrow(run, "low long, high long"))


def near_groups(prints: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(fp, component_id) for every distinct fingerprint of `prints` (doc_id, fp): the smallest doc_id connected with it."""
    groups = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprints")
    tied = components(near_links(groups.select("fp"), budget)).withColumnRenamed("node", "fp")
    named = stored(tied.join(groups, "fp"), "fingerprint-groups")
    roots = named.groupBy("root").agg(F.min("first").alias("smallest"))
    joined = groups.join(named.select("fp", "root").join(roots, "root"), "fp", "left")
    return joined.select("fp", F.coalesce("smallest", "first").alias("component_id"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of `docs`."""
    prints = stored(fingerprints(docs, shingle), "document-fingerprints")
    return prints.join(near_groups(prints, budget), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- near duplicates by similarity -----------------------------------------------------------------------------------
#
# Two documents are linked if the Jaccard similarity of their distinct shingles is SIMILAR or more, which is computed from the sets
# themselves. Signatures only find candidates: at 0.8, fingerprints of 64 bits differ in about ten, more than any trie can spend, so a
# signature is PRINTS short fingerprints, and two documents are candidates if one of these differs in no more than `budget` of its SLICE
# bits, which the trie join finds, if the first SENT lanes of 64 bits differ in no more than their share of `most`, and if their numbers
# of shingles allow SIMILAR.
#
# Candidates are verified in passes, so that a dense group is not compared pair by pair: first one candidate of each point, then a forest of
# candidates for every trie of the first EARLY fingerprints, which connects most of what is alike. The tries of all fingerprints are walked
# then, for what is not connected yet: within each family that candidates connect, blocks of points are compared by sketches, which refuse
# no link, and what these let pass is verified. What EARLY leaves out is thus found later; it decides the work alone.

PRINTS, SLICE, SIMILAR_SHINGLE = 24, 32, 5
EARLY = 8
SIMILAR = (4, 5)  # as a fraction, compared in whole numbers
MOST = 192  # of 768 bits: 116 differ on average at a similarity of 0.8, give or take 10, and 384 between unrelated texts
LANES, SENT = PRINTS * SLICE // BITS, 4
PART_CHUNK, PART_WALK = 1 << 16, 1 << 17
_SIGNED = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("shingles", pa.binary()), ("size", pa.int32()), ("signature", pa.binary()),
                     ("sketch", pa.binary())])
_SETS = pa.schema([("shingles", pa.binary()), ("hashes", pa.list_(pa.int64()))])
_DEALT = pa.schema([("part", pa.int32()), ("rest", pa.int32()), ("point", pa.int64()), ("root", pa.int64()), ("size", pa.int32()), ("bits", pa.binary())])
_OFFSETS = mix(np.arange(11, 11 + LANES, dtype=np.uint64))


def shingle_set(words: list[bytes], shingle: int = SIMILAR_SHINGLE) -> np.ndarray:
    """Hashes of the distinct shingles, sorted; none for a text without words."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    width = min(shingle, len(words))
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    return np.unique(np.array([digest(view[b:e], SEED) for b, e in zip((ends - sizes).tolist(), ends[width - 1:].tolist())], dtype=np.uint64))


def _signature(hashes: np.ndarray) -> bytes:
    counts = np.zeros(LANES * BITS, dtype=np.int64)
    for part in range(0, len(hashes), 1 << 14):
        lanes = mix(hashes[part:part + (1 << 14), None] ^ _OFFSETS[None, :])
        counts += np.unpackbits(lanes.view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes)).tobytes()


def signature(words: list[bytes], shingle: int = SIMILAR_SHINGLE) -> bytes:
    """PRINTS fingerprints of SLICE bits each over the distinct shingles; all zero for a text without words."""
    return _signature(shingle_set(words, shingle))


def _set_name(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def signatures(docs: DataFrame, shingle: int = SIMILAR_SHINGLE) -> DataFrame:
    """(doc_id, text_hash, shingles, size, signature, sketch) of every row: a name of the set of its shingles, their number, its signature,
    and its sketch, of which two differ in no more bits than the sets differ in shingles."""
    def run(batches):
        for batch in batches:
            sets = [shingle_set(words_of(text), shingle) for text in utf8(batch.column(2))]
            yield record_batch(_SIGNED, (batch.column(0), batch.column(1), list(map(_set_name, sets)), list(map(len, sets)), list(map(_signature, sets)),
                                         list(map(sketch_of, sets))))

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
        run, "doc_id long, text_hash long, shingles binary, size int, signature binary, sketch binary")


def similar_links(points: DataFrame, most: int = MOST, budget: int = BUDGET, unite: bool = True, prints: int = PRINTS) -> DataFrame:
    """(low, high) candidates among `points` (point, root, size, signature) of different roots, by the first `prints` fingerprints: with
    `unite` those of a spanning forest for every trie, without it all."""
    turns, block = budget + 1, SLICE // (budget + 1)
    allowed = most * SENT // LANES
    numerator, denominator = SIMILAR

    def deal(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            slices = np.frombuffer(b"".join(batch.column(3).to_pylist()), dtype=">u4").reshape(-1, PRINTS).astype(np.uint32)
            sent = pa.array([bits[:SENT * BITS // 8] for bits in batch.column(3).to_pylist()], pa.binary())
            for place in range(prints):
                for turn in range(turns):
                    by = np.uint32(turn * block)
                    own = slices[:, place] if turn == 0 else (slices[:, place] << by) | (slices[:, place] >> np.uint32(SLICE - turn * block))
                    part = ((place * turns + turn) << block) + (own >> np.uint32(SLICE - block)).astype(np.int64)
                    rest = (own & np.uint32((1 << (SLICE - block)) - 1)).astype(np.int32)
                    yield record_batch(_DEALT, (part, rest, *batch.columns[:3], sent))

    def walk(parts, rests, points, roots, sizes, packed):
        # leaf: number of the part, the rest of the slice, and a number that tells equal ones apart
        group = np.concatenate([[0], np.cumsum(parts[1:] != parts[:-1])]).astype(np.uint64)
        new = np.concatenate([[True], (parts[1:] != parts[:-1]) | (rests[1:] != rests[:-1])])
        numbers = (np.arange(len(parts)) - np.flatnonzero(new)[np.cumsum(new) - 1]).astype(np.uint64)
        if int(numbers.max()) >> 24 or int(group[-1]) >> 16:
            raise OverflowError("more equal slices in a part than a leaf can number")
        leaves = (group << np.uint64(48)) | (rests.astype(np.uint64) << np.uint64(24)) | numbers
        lanes = np.frombuffer(packed, dtype=np.uint64).reshape(-1, SENT)
        _, first, own = np.unique(roots, return_index=True, return_inverse=True)

        def agree(left, right):
            a, b = sizes[left].astype(np.int64), sizes[right].astype(np.int64)
            return ((np.bitwise_count(lanes[left] ^ lanes[right]).sum(axis=1) <= allowed)
                    & (denominator * np.minimum(a, b) >= numerator * np.maximum(a, b)) & (roots[left] != roots[right]))

        for left, right in trie_links(leaves, 16, budget, first[own], walk=PART_WALK, counted=16 + SLICE - block, agree=agree, unite=unite):
            yield record_batch(_LINKS, (np.minimum(points[left], points[right]), np.maximum(points[left], points[right])))

    def run(batches):
        kept: list[tuple] = []
        waiting = 0

        def finish(rows):
            return walk(*(np.concatenate([row[k] for row in rows]) for k in range(5)), b"".join(row[5] for row in rows))

        for batch in batches:
            if not batch.num_rows:
                continue
            kept.append((*(batch.column(k).to_numpy() for k in range(5)), b"".join(batch.column(5).to_pylist())))
            waiting += batch.num_rows
            if waiting >= PART_CHUNK:  # cut at the last border between parts
                last = kept[-1]
                border = int(np.searchsorted(last[0], last[0][-1]))
                if border or (len(kept) > 1 and kept[-2][0][-1] != last[0][-1]):
                    size = SENT * BITS // 8
                    yield from finish([*kept[:-1], (*(column[:border] for column in last[:5]), last[5][:border * size])])
                    kept = [(*(column[border:] for column in last[:5]), last[5][border * size:])]
                    waiting = len(kept[0][0])
        if waiting:
            yield from finish(kept)

    dealt = points.select("point", "root", "size", "signature").mapInArrow(deal, "part int, rest int, point long, root long, size int, bits binary")
    return dealt.repartition("part").sortWithinPartitions("part", "rest").mapInArrow(run, "low long, high long").distinct()


def shingle_sets(links: DataFrame, points: DataFrame, docs: DataFrame, shingle: int = SIMILAR_SHINGLE) -> DataFrame:
    """(point, hashes) of the points that `links` (low, high) join. The sets are made again from the texts of these points."""
    def run(batches):
        for batch in batches:
            sets = [shingle_set(words_of(text), shingle) for text in utf8(batch.column(0))]
            yield record_batch(_SETS, (list(map(_set_name, sets)), [own.view(np.int64) for own in sets]))

    ends = links.select(F.col("low").alias("point")).union(links.select("high")).distinct()
    wanted = stored(points.join(ends, "point").select("point", "shingles", F.col("first").alias("wanted")), "linked-points")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = texts.join(wanted.select("wanted").distinct(), F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi").select("text")
    made = texts.mapInArrow(run, "shingles binary, hashes array<long>")
    return stored(wanted.select("point", "shingles").join(made, "shingles").dropDuplicates(["point"]).select("point", "hashes"), "shingle-sets")


def verified(links: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of `links` (low, high) whose points have shingles of a similarity of SIMILAR or more; each link meets its two sets in joins."""
    both = (links.join(sets.select(F.col("point").alias("low"), F.col("hashes").alias("a")), "low")
            .join(sets.select(F.col("point").alias("high"), F.col("hashes").alias("b")), "high"))
    shared, total = F.size(F.array_intersect("a", "b")), F.size("a") + F.size("b")
    # shared / (total - shared) >= numerator / denominator
    return both.filter((SIMILAR[0] + SIMILAR[1]) * shared >= SIMILAR[0] * total).select("low", "high")


def _apart(links: DataFrame, trees: DataFrame) -> DataFrame:
    """Those of `links` whose ends `trees` (node, root) does not connect."""
    root = lambda end: trees.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
    met = links.join(root("low"), "low", "left").join(root("high"), "high", "left")
    return met.filter("coalesce(low_root, low) <> coalesce(high_root, high)").select("low", "high")


def similar_roots(docs: DataFrame, shingle: int = SIMILAR_SHINGLE, most: int = MOST) -> DataFrame:
    """(doc_id, text_hash, root) of every row of `docs`: rows have one root if links of a similarity of SIMILAR or more connect them."""
    signed = stored(signatures(docs, shingle), "document-signatures")
    points = stored(signed.groupBy("shingles").agg(F.min("doc_id").alias("first"), F.first("size").alias("size"), F.first("signature").alias("signature"),
                                                        F.first("sketch").alias("sketch"))
                    .withColumn("point", F.monotonically_increasing_id()), "signatures")
    forest = stored(similar_links(points.withColumn("root", F.col("point")), most, prints=EARLY), "candidates")
    sets = shingle_sets(forest, points, docs, shingle)
    # of the candidates of a point the first one alone, then those between points that nothing connects yet
    first = stored(forest.groupBy("high").agg(F.min("low").alias("low")).select("low", "high"), "first-candidates")
    held = stored(verified(first, sets), "verified-links")
    trees = stored(components(held), "trees")
    rest = _apart(forest.join(first, ["low", "high"], "left_anti"), trees)
    held = stored(held.union(verified(rest, sets)), "verified-links")
    trees = stored(components(held), "trees")
    rooted = stored(points.join(trees.withColumnRenamed("node", "point"), "point", "left").withColumn("root", F.coalesce("root", "point")), "rooted-points")
    # families: what candidates between different trees connect; all pairs of different trees in a family are compared by their sketches
    loose = similar_links(rooted, most)
    tree = lambda end: rooted.select(F.col("point").alias(end), F.col("root").alias(f"{end}_root"))
    between = loose.join(tree("low"), "low").join(tree("high"), "high").select(
        F.least("low_root", "high_root").alias("low"), F.greatest("low_root", "high_root").alias("high")).filter("low < high")
    families = components(between).select(F.col("node").alias("root"), F.col("root").alias("region"))
    regions = stored(rooted.join(families, "root").select("region", "point", "root"), "families")
    alike = OF * SIMILAR[0] // SIMILAR[1]
    others = stored(block_pairs(regions, points.select("point", "size", "sketch"), alike=alike), "candidates")
    more = verified(others, shingle_sets(others, points, docs, shingle))
    tied = components(held.union(more)).withColumnRenamed("node", "point")
    named = points.join(tied, "point", "left").select("shingles", F.coalesce("root", "point").alias("root"))
    return signed.join(named, "shingles").select("doc_id", "text_hash", "root")


def similar_groups(docs: DataFrame, shingle: int = SIMILAR_SHINGLE, most: int = MOST) -> DataFrame:
    """(doc_id, component_id) of every row of `docs`: the smallest doc_id connected by links of a similarity of SIMILAR or more."""
    rooted = stored(similar_roots(docs, shingle, most), "rooted-documents")
    smallest = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rooted.join(smallest, "root").select("doc_id", "component_id")


def keep_one(docs: DataFrame, shingle: int = SIMILAR_SHINGLE, most: int = MOST) -> DataFrame:
    """One row of each group of near duplicates: the one of the smallest doc_id, null after all others, and of these the one of the
    smallest hash of its text. Rows are told apart by doc_id and text together, so different texts under one doc_id both stay."""
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    best = similar_roots(docs, shingle, most).groupBy("root").agg(F.min(place).alias("best")).select("best.*")
    name, text = free_name(docs, "_name"), free_name(docs, "_text")
    key = lambda hashed: (F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias(name), F.xxhash64(hashed, F.col("doc_id").isNull()).alias(text))
    chosen = best.select(*key(F.col("text_hash")))
    keyed = docs.select("*", *key(F.xxhash64("text")))
    return keyed.join(chosen, [name, text], "left_semi").dropDuplicates([name, text]).select(*docs.columns)
