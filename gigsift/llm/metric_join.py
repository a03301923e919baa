"""N-gram Jaccard join in metric space: pivots, Voronoi regions, triangle-inequality windows.

Documents are sets of distinct SHINGLE-word shingles under the Jaccard distance d, a metric; two are linked if d <= RADIUS. Equal sets are
one point, named by a 64-bit hash of the set.

The first pivots are the shingles themselves. A set is nearest to the pivot {s} that comes first in one order of all shingles, and a linked
set shares at least ceil((1 - RADIUS) * size) shingles with it, so it is enough to copy each set to the regions of its first
size - ceil((1 - RADIUS) * size) + 1 shingles: any two linked sets meet in a region. In the order, shingles of HOT documents or more come
last; thus a region either has fewer than HOT rows, or the sets copied to it consist of frequent shingles for the most part.

Small regions are compared inside. The sets of large regions (families of near copies) start as one region per connected family and
are split again and again by pivots taken from among them: every set is measured against the PIVOTS pivots of its region, exactly; it
belongs to the nearest, at distance m, and is copied to all within m + 2 RADIUS, since a set linked with it may belong there; regions whose
sets are all connected are done. Regions small enough, and those that pivots do not split, are compared in blocks of BLOCK sets, blocks
of one connected group never with each other.

Comparisons within regions use sketches: the parity of the number of shingles per slot. Two sketches differ in no more bits than the sets
differ in shingles, so what they refuse has no link; what remains is decided by the sets themselves. First one candidate per set is
verified, then those between sets that are not connected yet.

Defined results: a null or empty text, or one without words, has no shingle, and is its own component; with fewer words than a shingle, the
whole sequence is the one shingle; rows of one doc_id are documents of their own with the same name; a null doc_id names no component, and
is null if its component has no other. Different sets are taken for equal with a probability of points squared over 2 to the 65.
Memory: an Arrow batch, a part of PART shingles, two blocks, or the sets of at most PIVOT_SETS pivots; the driver gets up to
HOT_MOST frequent shingles and a field of bits of fixed size.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import decontam
from .common import mix, record_batch, require, stored, utf8, words_of
from .graph import components

SHINGLE, SEED = 4, 42
ALIKE, OF = 85, 100  # linked if OF * intersection >= ALIKE * union
HOT, HOT_MOST = 64, 1 << 20
LEAF, PIVOTS, ROUNDS, BLOCK = 64, 8, 4, 256
PIVOT_SETS = 1 << 22  # shingles of the pivots that are broadcast
PART, FLUSH, SEEN = 1 << 21, 1 << 20, 1 << 18
LEAST_BITS, MOST_BITS = 64, 1 << 14
_FACTORS = mix(np.arange(1, 1 + SHINGLE, dtype=np.uint64)) | np.uint64(1)
_SIGNED = pa.schema([("doc_id", pa.int64()), ("point", pa.int64()), ("size", pa.int32()), ("sketch", pa.binary())])
_COUNTS = pa.schema([("part", pa.int32()), ("rests", pa.binary()), ("counts", pa.binary())])
_FREQUENT = pa.schema([("slot", pa.int64()), ("n", pa.int64())])
_CELLS = pa.schema([("point", pa.int64()), ("size", pa.int32()), ("cold", pa.list_(pa.int64())), ("hot", pa.list_(pa.int64())), ("hashes", pa.list_(pa.int64()))])
_PAIRS = pa.schema([("low", pa.int64()), ("high", pa.int64())])
_SETS = pa.schema([("point", pa.int64()), ("hashes", pa.list_(pa.int64()))])


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = found = xxhash.xxh64_intdigest(word, SEED)
        return found


class Shingles:
    """Sorted hashes of the distinct shingles of texts."""

    def __init__(self, width: int = SHINGLE):
        self.width, self.known = width, _Hashes()

    def __call__(self, text: bytes) -> np.ndarray:
        words = words_of(text)
        if not words:
            return np.empty(0, dtype=np.uint64)
        if len(words) < self.width:
            return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED + 1)], dtype=np.uint64)
        if len(self.known) > SEEN:
            self.known.clear()
        hashes = np.fromiter(map(self.known.__getitem__, words), dtype=np.uint64, count=len(words))
        runs = len(words) - self.width + 1
        return np.unique(mix(reduce(np.add, (hashes[k:k + runs] * _FACTORS[k] for k in range(self.width)))))


def point_of(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes(), SEED)).view(np.int64))


def sketch_of(hashes: np.ndarray) -> bytes:
    """One bit per slot: whether the number of shingles in it is odd. There are as many slots as shingles or up to twice as many."""
    slots = min(MOST_BITS, max(LEAST_BITS, 1 << max(0, len(hashes) - 1).bit_length()))
    odd = np.bincount((hashes & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def folded(sketches: np.ndarray, width: int) -> np.ndarray:
    """Sketches (a row each) of fewer slots, `width` bytes."""
    while sketches.shape[-1] > width:
        half = sketches.shape[-1] // 2
        sketches = sketches[..., :half] ^ sketches[..., half:]
    return sketches


def may_link(differing, total, alike: int = ALIKE):
    """Whether sets of `total` shingles together which differ in `differing` or more can be linked: the rule of links, solved for it."""
    return (alike + OF) * differing <= (OF - alike) * total


def least_difference(left: bytes, right: bytes) -> int:
    a, b = np.frombuffer(left, dtype=np.uint8), np.frombuffer(right, dtype=np.uint8)
    width = min(len(a), len(b))
    return int(np.bitwise_count(folded(a, width) ^ folded(b, width)).sum())


def copies(size: int) -> int:
    """How many of its first shingles a set is copied to."""
    return size - (ALIKE * size + OF - 1) // OF + 1


class _Seen:
    """Whether a point came before in this task, as far as SEEN points remember."""

    def __init__(self):
        self.points: set[int] = set()

    def __call__(self, point: int) -> bool:
        if point in self.points:
            return True
        if len(self.points) >= SEEN:
            self.points.clear()
        self.points.add(point)
        return False


# --- points, frequent shingles, regions ------------------------------------------------------------------------------


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, point, size, sketch) of every row."""
    def run(batches):
        shingles = Shingles()
        for batch in batches:
            sets = [shingles(text) for text in utf8(batch.column(1))]
            yield record_batch(_SIGNED, (batch.column(0), list(map(point_of, sets)), list(map(len, sets)), list(map(sketch_of, sets))))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, point long, size int, sketch binary")


def slot_bits(total: int) -> int:
    """Bits of a shingle that name its part, so that a part has about PART of `total`."""
    return min(20, max(3, (total // PART).bit_length()))


def frequent_shingles(docs: DataFrame, bits: int, least: int = HOT) -> DataFrame:
    """(slot, n): shingles that occur in `least` rows or more, by their first bits + 32 bits. Counts are added up per task first, and travel
    packed, one row per task and part."""
    low = np.uint64(64 - 32 - bits)

    def count(batches):
        shingles = Shingles()
        kept, waiting = [], 0

        def flush():
            slots, counts = np.unique(np.concatenate(kept) >> low, return_counts=True)
            parts = (slots >> np.uint64(32)).astype(np.int32)
            begins = np.flatnonzero(np.concatenate([[True], parts[1:] != parts[:-1]]))
            ends = np.append(begins[1:], len(parts))
            rests, many = slots.astype(np.uint32), np.minimum(counts, 65535).astype(np.uint16)
            return record_batch(_COUNTS, (parts[begins], [rests[b:e].tobytes() for b, e in zip(begins, ends)], [many[b:e].tobytes() for b, e in zip(begins, ends)]))

        for batch in batches:
            for text in utf8(batch.column(0)):
                kept.append(shingles(text))
                waiting += len(kept[-1])
                if waiting >= FLUSH:
                    yield flush()
                    kept, waiting = [], 0
        if waiting:
            yield flush()

    def add_up(batches):
        part, rests, counts = None, [], []

        def finish():
            slots, many = np.concatenate(rests), np.concatenate(counts)
            order = np.argsort(slots, kind="stable")
            slots = slots[order]
            begins = np.flatnonzero(np.concatenate([[True], slots[1:] != slots[:-1]]))
            sums = np.add.reduceat(many[order], begins, dtype=np.int64)
            often = sums >= least
            return record_batch(_FREQUENT, ((part << 32) | slots[begins][often].astype(np.int64), sums[often]))

        for batch in batches:
            for at in range(batch.num_rows):
                if (own := batch.column(0)[at].as_py()) != part:
                    if rests:
                        yield finish()
                    part, rests, counts = own, [], []
                rests.append(np.frombuffer(batch.column(1)[at].as_py(), dtype=np.uint32))
                counts.append(np.frombuffer(batch.column(2)[at].as_py(), dtype=np.uint16))
        if rests:
            yield finish()

    packed = docs.select("text").mapInArrow(count, "part int, rests binary, counts binary")
    return packed.repartition("part").sortWithinPartitions("part").mapInArrow(add_up, "slot long, n long")


def hot_slots(frequent: DataFrame) -> np.ndarray:
    """The slots of the most frequent shingles, sorted, HOT_MOST at most. Which they are decides the order of shingles only, so any choice
    gives the same links."""
    sizes = {row["power"]: row["n"] for row in frequent.groupBy(F.floor(F.log2("n")).alias("power")).agg(F.count(F.lit(1)).alias("n")).collect()}
    kept, least = 0, 0
    for power in sorted(sizes, reverse=True):
        if kept + sizes[power] > HOT_MOST:
            least = power + 1
            break
        kept += sizes[power]
    slots = frequent.filter(F.col("n") >= F.lit(2.0 ** least)).select("slot").toArrow().column(0).to_numpy()
    return np.sort(slots).astype(np.uint64)


def regions_of(docs: DataFrame, slots, bits: int) -> DataFrame:
    """(point, size, cold, hot, hashes): the shingles a set is copied to, frequent ones apart; hashes is the set if there are any of these.
    Sets that repeat in a task come once."""
    low = np.uint64(64 - 32 - bits)

    def run(batches):
        shingles, seen, known = Shingles(), _Seen(), slots.value
        for batch in batches:
            rows = []
            for text in utf8(batch.column(0)):
                own = shingles(text)
                if not len(own) or seen(point := point_of(own)):
                    continue
                mine, often = own >> low, np.zeros(len(own), dtype=bool)
                if len(known):
                    often = known[np.minimum(np.searchsorted(known, mine), len(known) - 1)] == mine
                wanted = copies(len(own))
                cold = own[~often][:wanted]
                hot = own[often][:wanted - len(cold)]
                rows.append((point, len(own), cold.view(np.int64), hot.view(np.int64), own.view(np.int64) if len(hot) else None))
            yield record_batch(_CELLS, ([row[k] for row in rows] for k in range(5)))

    return docs.select("text").mapInArrow(run, "point long, size int, cold array<long>, hot array<long>, hashes array<long>")


def _fits(a, b):
    return OF * np.minimum(a, b) >= ALIKE * np.maximum(a, b)


def cold_pairs(cells: DataFrame) -> DataFrame:
    """(low, high) of points that share a region of an infrequent shingle and are of like size. A region has fewer rows than HOT."""
    def pairs(regions, points, sizes):
        begins = np.flatnonzero(np.concatenate([[True], regions[1:] != regions[:-1]]))
        lengths = np.diff(np.append(begins, len(regions)))
        for length in np.unique(lengths[lengths > 1]).tolist():
            places = begins[lengths == length][:, None] + np.arange(length)
            left, right = np.triu_indices(length, 1)
            step = max(1, (1 << 20) // len(left))
            for at in range(0, len(places), step):
                a, b = places[at:at + step, left].ravel(), places[at:at + step, right].ravel()
                near = _fits(sizes[a], sizes[b]) & (points[a] != points[b])
                a, b = points[a[near]], points[b[near]]
                yield record_batch(_PAIRS, (np.minimum(a, b), np.maximum(a, b)))

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().astype(np.int64)]
            if held is not None:
                columns = [np.concatenate(pair) for pair in zip(held, columns)]
            border = int(np.searchsorted(columns[0], columns[0][-1]))  # the last region may go on
            held = [column[border:] for column in columns]
            if border:
                yield from pairs(*(column[:border] for column in columns))
        if held is not None:
            yield from pairs(*held)

    dealt = cells.select(F.explode("cold").alias("region"), "point", "size").repartition("region").sortWithinPartitions("region")
    return dealt.mapInArrow(run, "low long, high long").distinct()


# --- large regions -----------------------------------------------------------------------------------------------------


def _families(dense: DataFrame) -> DataFrame:
    """(region, point): points that large regions connect."""
    held = dense.select("point", F.explode("hot").alias("cell"))
    first = held.groupBy("cell").agg(F.min("point").alias("low"))
    links = held.join(first, "cell").filter("low < point").select("low", F.col("point").alias("high")).distinct()
    tied = components(links).select(F.col("root").alias("region"), F.col("node").alias("point"))
    return tied


def _with_roots(regions: DataFrame, links: DataFrame | None) -> DataFrame:
    """`regions` with the root of each point under the links so far, without regions that have one root only; n is the region's size."""
    rooted = regions.withColumn("root", F.col("point"))
    if links is not None:
        roots = components(links).withColumnRenamed("node", "point")
        rooted = regions.join(roots, "point", "left").select("region", "point", F.coalesce("root", "point").alias("root"))
    rooted = stored(rooted, "rooted-regions")
    apart = rooted.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("a"), F.max("root").alias("b")).filter("a < b")
    return stored(rooted.join(apart.select("region", "n"), "region"), "open-regions")


def _measured(pairs: DataFrame, sets: DataFrame, pivots: DataFrame) -> DataFrame:
    """(point, pivot, shared, total) of distinct `pairs` (point, pivot)."""
    ends = stored(pivots.select("pivot").distinct().join(sets.withColumnRenamed("point", "pivot"), "pivot").select("pivot", F.col("hashes").alias("theirs")), "pivots")
    size = ends.agg(F.sum(F.size("theirs"))).first()[0] or 0
    met = pairs.join(sets, "point").join(F.broadcast(ends) if size <= PIVOT_SETS else ends, "pivot")
    return met.select("point", "pivot", F.size(F.array_intersect("hashes", "theirs")).alias("shared"), (F.size("hashes") + F.size("theirs")).alias("total"))


def split_regions(regions: DataFrame, sets: DataFrame, number: int, pivots: int = PIVOTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links, regions, stuck): exact links with the pivots of each region, what is left of the regions around the pivots, and those regions
    which pivots do not split: all their sets are about as far from every pivot."""
    bucket = F.pmod(F.xxhash64("root", F.lit(number)), F.lit(pivots))
    first = F.min(F.struct(F.xxhash64("point").alias("order"), "point"))["point"].alias("pivot")
    chosen = stored(regions.groupBy("region", bucket.alias("bucket")).agg(first).select("region", "pivot"), "region-pivots")
    pairs = regions.join(chosen, "region")
    known = stored(_measured(pairs.select("point", "pivot").distinct(), sets, chosen), "pivot-distances")
    links = known.filter((F.col("point") != F.col("pivot")) & (OF * F.col("shared") >= ALIKE * (F.col("total") - F.col("shared")))).select(
        F.least("point", "pivot").alias("low"), F.greatest("point", "pivot").alias("high"))
    far = 1 - F.col("shared") / (F.col("total") - F.col("shared"))
    placed = pairs.join(known.select("point", "pivot", far.alias("far")), ["point", "pivot"])
    window = 2 * (OF - ALIKE) / OF + 1e-9
    near = placed.groupBy("region", "point").agg(F.min("n").alias("n"), F.min("far").alias("m"), F.collect_list(F.struct("pivot", "far")).alias("all"))
    kept = near.filter(~F.array_contains(F.col("all")["pivot"], F.col("point"))).select(
        "region", "point", "n", F.explode(F.filter("all", lambda p: p["far"] <= F.col("m") + window)).alias("p"))
    copied = stored(kept.select("region", "point", "n", F.xxhash64("region", "p.pivot").alias("part")), "region-copies")
    sizes = copied.groupBy("region").agg(F.count(F.lit(1)).alias("all"), F.max("n").alias("n"))
    split = sizes.filter(2 * F.col("all") <= 3 * F.col("n")).select("region")
    parts = copied.join(split, "region", "left_semi").select(F.col("part").alias("region"), "point")
    stuck = copied.join(split, "region", "left_anti").select("region", "point").distinct()
    return links, parts, stuck


def block_pairs(regions: DataFrame, points: DataFrame, block: int = BLOCK, alike: int = ALIKE) -> DataFrame:
    """(low, high) in one of `regions` (region, point, root) and of different roots, which their sketches do not refuse. `points` has the
    size and the sketch of each point."""
    rows = regions.join(points, "point")
    sizes = regions.groupBy("region", "root").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.withColumn("own", F.when(F.col("n") >= block, F.col("root")))
    groups = sizes.groupBy("region", "own").agg(F.sum("n").alias("group_n"))
    placed = rows.join(sizes.select("region", "root", "own"), ["region", "root"]).join(
        groups.withColumnRenamed("own", "_own"), on=(F.col("own").eqNullSafe(F.col("_own"))) & (rows["region"] == groups["region"])).drop(groups["region"])
    named = placed.withColumn("block", F.pmod(F.xxhash64("point"), F.ceil(F.col("group_n") / block)))
    listed = lambda name: F.transform(F.col("all"), lambda row: row[name])
    packed = stored(named.groupBy("region", "own", "block").agg(F.collect_list(F.struct("point", "root", "size", "sketch")).alias("all")).select(
        F.monotonically_increasing_id().alias("id"), "region", "own", *[listed(name).alias(name) for name in ("point", "root", "size", "sketch")]), "blocks")
    heads = packed.select("id", "region", "own")
    others = heads.select(F.col("id").alias("other"), "region", F.col("own").alias("other_own"))
    both = heads.join(others, "region").filter("id <= other AND NOT (own IS NOT NULL AND own <=> other_own)").select("id", "other")
    right = packed.select(F.col("id").alias("other"), *[F.col(name).alias(f"b_{name}") for name in ("point", "root", "size", "sketch")])
    met = both.join(packed.drop("region", "own"), "id").join(right, "other").drop("id", "other")

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                sides = [[np.asarray(batch.column(4 * side + k)[at].values) for k in range(3)] for side in (0, 1)]
                marks = [[np.frombuffer(mark, dtype=np.uint8) for mark in batch.column(4 * side + 3)[at].as_py()] for side in (0, 1)]
                widths = [np.array(list(map(len, own))) for own in marks]
                for one in np.unique(widths[0]).tolist():
                    for two in np.unique(widths[1]).tolist():
                        yield compared(sides, marks, widths, one, two)

    def compared(sides, marks, widths, one, two):
        width = min(one, two)
        places = [np.flatnonzero(widths[0] == one), np.flatnonzero(widths[1] == two)]
        left, right = (folded(np.stack([marks[side][k] for k in places[side]]), width).view(np.uint64) for side in (0, 1))
        (points_a, roots_a, sizes_a), (points_b, roots_b, sizes_b) = ([column[places[side]] for column in sides[side]] for side in (0, 1))
        found = []
        step = max(1, (1 << 21) // max(1, len(right) * right.shape[1]))
        for begin in range(0, len(left), step):
            differing = np.bitwise_count(left[begin:begin + step, None, :] ^ right[None, :, :]).sum(axis=2, dtype=np.int64)
            total = sizes_a[begin:begin + step, None].astype(np.int64) + sizes_b[None, :]
            open_ = may_link(differing, total, alike) & (roots_a[begin:begin + step, None] != roots_b[None, :])
            a, b = np.nonzero(open_)
            found.append((points_a[begin + a], points_b[b]))
        a, b = (np.concatenate(side) for side in zip(*found))
        return record_batch(_PAIRS, (np.minimum(a, b), np.maximum(a, b)))

    return met.mapInArrow(run, "low long, high long").distinct()


def dense_links(cells: DataFrame, points: DataFrame, leaf: int = LEAF, pivots: int = PIVOTS, rounds: int = ROUNDS, block: int = BLOCK) -> tuple[DataFrame | None, DataFrame | None]:
    """(links, candidates) among the points of large regions."""
    dense = cells.filter(F.size("hot") > 0).dropDuplicates(["point"])
    dense = stored(dense.select("point", "hot", "hashes"), "dense-points")
    if dense.isEmpty():
        return None, None
    sets = dense.select("point", "hashes")
    regions, links, rest = _families(dense), None, []
    for number in range(rounds + 1):
        left = _with_roots(regions, links)
        final = left.filter(F.col("n") <= leaf) if number < rounds else left
        rest.append(stored(block_pairs(final.drop("n"), points, block), "candidates"))
        large = left.filter(F.col("n") > leaf)
        if number == rounds or large.isEmpty():
            break
        found, regions, stuck = split_regions(large, sets, number, pivots)
        links = stored(found if links is None else links.union(found), "pivot-links")
        rest.append(stored(block_pairs(_with_roots(stuck, links).drop("n"), points, block), "candidates"))
    return links, reduce(DataFrame.union, rest).distinct()


# --- verification and results ------------------------------------------------------------------------------------------


def passed_sketches(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """Those of `pairs` (low, high) whose sketches do not refuse a link."""
    side = lambda end, mark: points.select(F.col("point").alias(end), F.col("size").alias(f"{mark}_size"), F.col("sketch").alias(f"{mark}_sketch"))
    met = pairs.join(side("low", "a"), "low").join(side("high", "b"), "high").select("low", "high", "a_size", "b_size", "a_sketch", "b_sketch")

    def run(batches):
        for batch in batches:
            differing = [least_difference(a, b) for a, b in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())]
            total = batch.column(2).to_numpy().astype(np.int64) + batch.column(3).to_numpy()
            keep = may_link(np.array(differing, dtype=np.int64), total)
            yield record_batch(_PAIRS, (batch.column(k).to_numpy()[keep] for k in (0, 1)))

    return met.mapInArrow(run, "low long, high long")


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(point, hashes) of the points `wanted` (point). A field of bits tells which texts may have one, so only their sets travel."""
    field = docs.sparkSession.sparkContext.broadcast(decontam.bit_field(wanted.select(F.col("point").alias("seed"))))
    mask = np.uint64(decontam.FIELD_BITS - 1)

    def run(batches):
        shingles, seen, bits = Shingles(), _Seen(), field.value
        for batch in batches:
            rows = []
            for text in utf8(batch.column(0)):
                own = shingles(text)
                point = point_of(own)
                name = np.uint64(np.int64(point).view(np.uint64))
                places = (name & mask, (name >> np.uint64(32)) & mask)
                if len(own) and all((bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) for place in places) and not seen(point):
                    rows.append((point, own.view(np.int64)))
            yield record_batch(_SETS, ([row[k] for row in rows] for k in range(2)))

    made = docs.select("text").mapInArrow(run, "point long, hashes array<long>")
    kept = stored(made.join(wanted, "point", "left_semi").dropDuplicates(["point"]), "shingle-sets")
    field.destroy()
    return kept


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of `pairs` whose sets are linked."""
    both = (pairs.join(sets.select(F.col("point").alias("low"), F.col("hashes").alias("a")), "low")
            .join(sets.select(F.col("point").alias("high"), F.col("hashes").alias("b")), "high"))
    shared, total = F.size(F.array_intersect("a", "b")), F.size("a") + F.size("b")
    return both.filter((ALIKE + OF) * shared >= ALIKE * total).select("low", "high")


def joined(docs: DataFrame, hot: int = HOT, leaf: int = LEAF, pivots: int = PIVOTS, rounds: int = ROUNDS, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of `docs`: the smallest doc_id that links connect it with."""
    require(docs, "doc_id", "text")
    named = stored(signed(docs), "signed-documents")
    points = stored(named.filter("size > 0").groupBy("point").agg(F.first("size").alias("size"), F.first("sketch").alias("sketch")), "points")
    bits = slot_bits(named.agg(F.sum(F.col("size").cast("long"))).first()[0] or 0)
    slots = docs.sparkSession.sparkContext.broadcast(hot_slots(stored(frequent_shingles(docs, bits, hot), "frequent-shingles")))
    cells = stored(regions_of(docs, slots, bits), "regions")
    slots.destroy()
    near = stored(passed_sketches(cold_pairs(cells), points), "candidates")
    links, dense = dense_links(cells, points, leaf, pivots, rounds, block)
    if dense is not None:
        near = stored(near.union(dense).distinct(), "candidates")
    ends = near.select(F.col("low").alias("point")).union(near.select("high")).distinct()
    sets = sets_of(docs, stored(ends, "candidate-points"))
    # one candidate for each point first; then those between points that nothing connects yet
    first = near.groupBy("high").agg(F.min("low").alias("low")).select("low", "high")
    held = stored(verified(first, sets) if links is None else verified(first, sets).union(links), "links")
    roots = stored(components(held), "trees")
    root = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
    open_ = (near.join(first, ["low", "high"], "left_anti").join(root("low"), "low", "left").join(root("high"), "high", "left")
             .filter("coalesce(low_root, low) <> coalesce(high_root, high)").select("low", "high"))
    tied = stored(components(held.union(verified(open_, sets))), "groups").withColumnRenamed("node", "point")
    grouped = named.join(tied, "point", "left").select("doc_id", "size", F.when(F.col("size") > 0, F.coalesce("root", "point")).alias("root"))
    grouped = stored(grouped, "rooted-documents")
    smallest = grouped.filter("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("smallest"))
    return grouped.join(smallest, "root", "left").select(
        "doc_id", F.col("size").cast("long").alias("n_shingles"), F.when(F.col("size") > 0, F.col("smallest")).otherwise(F.col("doc_id")).alias("component_id"))
