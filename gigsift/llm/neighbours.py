"""Approximate nearest neighbours by shifted space-filling curves.

Unit vectors are projected on CURVES blocks of DIMENSIONS orthonormal directions; each block is a small cube, shifted at random and
walked by a Hilbert curve. Rows are range-partitioned by curve and key, which gives every row a rank on every curve; rows of consecutive
ranks are a block, of BLOCK rows at least. A query is compared with the rows of its own block and of some blocks on either side, REACH at
least, on every curve, and the best of all windows are merged. Scores are exact cosines in double precision.

Rows with equal vectors are one point of the curves, with the smallest of their ids, so a vector that many rows share neither fills a
block nor pushes others out of a window.

The directions and shifts follow from SEED alone: nothing is fitted, every row is indexed. Windows hold a SHARE of all rows at least, so
that recall does not fall as isotropic data grow; work per query grows with the table. Blocks grow first, up to WIDEST rows, then the
number of blocks in a window. Up to BLOCK * REACH rows the result is exact.

Defined results: vectors that are null, zero, or hold nulls or non-finite numbers take no part; vectors of one length are
compared with each other, on curves of their own; rows that share id and vector are one; a null vec_id takes no part; fewer candidates than asked for are all returned; ties go to
the smaller id; an empty table has no result. Memory: a task holds one block of WIDEST rows at most, one Arrow batch and SCORES scores.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .common import record_batch, require, stored

CURVES, DIMENSIONS, BITS = 16, 4, 15
BLOCK, REACH, SEED = 1024, 2, 9
SHARE, WIDEST, SCORES = 1 / 16, 8192, 1 << 20
NEAREST, EVERY = 5, 50

_KEYS = pa.schema([("curve", pa.int32()), ("key", pa.int64()), ("point", pa.int64())])
_RANKS = pa.schema([("curve", pa.int32()), ("point", pa.int64()), ("part", pa.int64()), ("place", pa.int64())])
_FOUND = pa.schema([("query", pa.int64()), ("score", pa.float64()), ("ids", pa.list_(pa.int64()))])


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of integer coordinates (n, m) of `bits` bits, after Skilling (2004): undo the excess work of
    the Gray code from the highest bit down, then interleave."""
    axes = [cells[:, i].astype(np.uint64) for i in range(cells.shape[1])]
    for at in range(bits - 1, 0, -1):
        high, low = np.uint64(1 << at), np.uint64((1 << at) - 1)
        for i, axis in enumerate(axes):
            inverted = (axis & high) != 0
            swap = np.where(inverted, np.uint64(0), (axes[0] ^ axis) & low)
            axes[0] = np.where(inverted, axes[0] ^ low, axes[0] ^ swap)
            if i:
                axes[i] = axis ^ swap
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    flips = np.zeros(len(cells), dtype=np.uint64)
    for at in range(bits - 1, 0, -1):
        flips ^= np.where((axes[-1] >> np.uint64(at)) & np.uint64(1), np.uint64((1 << at) - 1), np.uint64(0))
    key = np.zeros(len(cells), dtype=np.uint64)
    for at in range(bits - 1, -1, -1):
        for axis in axes:
            key = (key << np.uint64(1)) | (((axis ^ flips) >> np.uint64(at)) & np.uint64(1))
    return key


def curve_frames(size: int, curves: int = CURVES, dimensions: int = DIMENSIONS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Directions (curves, size, dimensions), orthonormal as far as `size` allows, and shifts (curves, dimensions)."""
    random = np.random.default_rng(seed)
    wide, columns = min(dimensions, size), []
    while len(columns) < curves * wide:
        columns.extend(np.linalg.qr(random.normal(size=(size, size)))[0].T)
    frames = np.array(columns[:curves * wide]).reshape(curves, wide, size).transpose(0, 2, 1)
    return frames, random.random((curves, wide))


def window_of(count: int) -> tuple[int, int]:
    """Rows of a block, and blocks on either side of a query's own, for so many points."""
    rows = count * SHARE
    block = min(WIDEST, max(BLOCK, math.ceil(rows / (2 * REACH + 1))))
    return block, max(REACH, math.ceil((rows / block - 1) / 2))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def points_of(vectors: DataFrame, keep: int) -> DataFrame:
    """(point, vector, ids): the distinct vectors of (vec_id, vector), each with its `keep` smallest ids."""
    order = Window.partitionBy("vector").orderBy("vec_id")
    # the row limit is applied before the shuffle, too, so that rows of one vector do not meet in one task
    first = vectors.distinct().withColumn("n", F.row_number().over(order)).filter(F.col("n") <= keep)
    groups = first.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    return groups.select(F.monotonically_increasing_id().alias("point"), "vector", "ids")


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, vector) of the vectors that can be compared."""
    require(embeddings, "vec_id", "embedding")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    # adding zero makes minus zero plain zero: equal vectors are then equal arrays
    return rows.filter(F.col("vec_id").isNotNull() & fine).withColumn("vector", F.transform("vector", lambda x: x + 0.0))


def ranked_points(points: DataFrame, block: int = BLOCK) -> DataFrame:
    """(curve, point, block) of every point on every curve of its length."""
    def keys(batches):
        frames = {}
        for batch in batches:
            lengths = pc.list_value_length(batch.column(1)).to_numpy()
            for length in np.unique(lengths).tolist():
                own = batch.filter(pa.array(lengths == length))
                matrix = _matrix(own.column(1))
                matrix = matrix / np.abs(matrix).max(axis=1, keepdims=True)
                matrix = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
                if length not in frames:
                    frames[length] = curve_frames(length)
                for curve, (frame, shift) in enumerate(zip(*frames[length])):
                    cells = np.clip(((matrix @ frame + 1) / 4 + shift / 2) * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
                    yield record_batch(_KEYS, (np.full(len(cells), length * CURVES + curve), hilbert_keys(cells, BITS).view(np.int64), own.column(0)))

    def places(batches):
        from pyspark import TaskContext
        part, at, last = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            curves = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(curves)) + 1).tolist(), len(curves)]
            counted = []
            for begin, end in zip(cuts, cuts[1:]):
                if begin < end:
                    at = at if curves[begin] == last else 0
                    last = curves[begin]
                    counted.append(np.arange(at, at + end - begin))
                    at += end - begin
            if counted:
                yield record_batch(_RANKS, (batch.column(0), batch.column(1), np.full(len(curves), part), np.concatenate(counted)))

    keyed = stored(points.select("point", "vector").mapInArrow(keys, "curve int, key long, point long"), "curve-keys")
    ordered = keyed.repartitionByRange("curve", "key", "point").sortWithinPartitions("curve", "key", "point").select("curve", "point")
    placed = stored(ordered.mapInArrow(places, "curve int, point long, part long, place long"), "curve-places")
    sizes = placed.groupBy("curve", "part").agg(F.max("place").alias("last"))  # one row per curve and task
    before = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("curve", "part", F.coalesce(F.sum(F.col("last") + 1).over(before), F.lit(0)).alias("offset"))
    return placed.join(offsets, ["curve", "part"]).select("curve", "point", F.floor((F.col("offset") + F.col("place")) / block).alias("block"))


def nearest(embeddings: DataFrame, is_query, k: int = NEAREST, block: int | None = None, reach: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row for which the condition `is_query` on vec_id holds. Windows that
    are not given follow from the number of points."""
    rows = stored(usable(embeddings), "vectors")
    points = stored(points_of(rows, k + 1), "points")
    if block is None or reach is None:
        widths = window_of(points.count())
        block, reach = widths[0] if block is None else block, widths[1] if reach is None else reach
    asked = stored(rows.filter(is_query).distinct().join(points.select("vector", "point"), "vector").select(
        F.col("vec_id").alias("query_id"), "point"), "queries")
    ranked = stored(ranked_points(points, block), "curve-blocks")
    none = F.lit(None).cast("array<bigint>")
    members = ranked.join(points, "point").select("curve", "block", F.lit(0).alias("kind"), "point", "vector", "ids")
    around = F.explode(F.sequence(F.greatest(F.col("block") - reach, F.lit(0)), F.col("block") + reach)).alias("block")
    askers = (ranked.join(asked.select("point").distinct(), "point").select("curve", around, "point").join(points.select("point", "vector"), "point")
              .select("curve", "block", F.lit(1).alias("kind"), "point", "vector", none.alias("ids")))

    def compare(batches):
        here, matrix, norms, ids = None, [], None, []
        for batch in batches:
            curve, number, kind = (batch.column(i).to_numpy() for i in range(3))
            cuts = [0, *(np.flatnonzero((np.diff(curve) != 0) | (np.diff(number) != 0) | (np.diff(kind) != 0)) + 1).tolist(), len(kind)]
            for begin, end in zip(cuts, cuts[1:]):
                if begin == end:
                    continue
                if here != (curve[begin], number[begin]):
                    here, matrix, norms, ids = (curve[begin], number[begin]), [], None, []
                vectors = _matrix(batch.column(4).slice(begin, end - begin))
                if kind[begin] == 0:
                    matrix.append(vectors)
                    ids.extend(batch.column(5).slice(begin, end - begin).to_pylist())
                    continue
                if not ids:
                    continue
                if norms is None:
                    block_rows = np.concatenate(matrix)
                    norms = np.sqrt(np.einsum("bd,bd->b", block_rows, block_rows))
                asking = batch.column(3).slice(begin, end - begin).to_numpy()
                firsts = np.array([own[0] for own in ids])
                step = max(1, SCORES // len(ids))
                for at in range(0, len(vectors), step):
                    part = vectors[at:at + step]
                    sizes = np.sqrt(np.einsum("qd,qd->q", part, part))
                    # a plain sum per pair: equal pairs get equal scores in every block
                    scores = np.einsum("qd,bd->qb", part, block_rows) / (sizes[:, None] * norms[None, :])
                    if len(ids) > k + 1:  # only what is no worse than the last one kept is sorted
                        least = np.partition(scores, len(ids) - k - 1, axis=1)[:, len(ids) - k - 1]
                        row, column = np.nonzero(scores >= least[:, None])
                    else:
                        row, column = (places.ravel() for places in np.indices(scores.shape))
                    order = np.lexsort((firsts[column], -scores[row, column], row))
                    row, column = row[order], column[order]
                    best = np.arange(len(row)) - np.searchsorted(row, row) <= k
                    row, column = row[best], column[best]
                    yield record_batch(_FOUND, (asking[at:at + step][row], scores[row, column], [ids[i] for i in column]))

    dealt = members.union(askers).repartition("curve", "block").sortWithinPartitions("curve", "block", "kind")
    found = dealt.mapInArrow(compare, "query long, score double, ids array<bigint>")
    pairs = F.flatten(F.transform(F.collect_set(F.struct("score", "ids")), lambda hit: F.transform(
        hit["ids"], lambda vec_id: F.struct((-hit["score"]).alias("less"), vec_id.alias("vec_id")))))
    merged = found.groupBy(F.col("query").alias("point")).agg(F.slice(F.array_sort(pairs), 1, k + 1).alias("hits"))
    answers = asked.join(merged, "point").select("query_id", F.slice(F.filter(
        "hits", lambda hit: hit["vec_id"] != F.col("query_id")), 1, k).alias("hits"))
    return answers.select("query_id", F.posexplode("hits").alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.less")).alias("score"))
