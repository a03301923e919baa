"""Benchmark decontamination by spaced seeds.

A seed is the hash of the words that a fixed mask leaves of a run of words; the words in between may differ. Seeds of the
benchmark and of the documents are joined, and around every hit the aligned words are compared: a document leaks an item where a
stretch of WINDOW aligned words (the whole item, if it is shorter) agrees in at least `similarity` of them. The masks hit every such
stretch at 0.8 and the default window, wherever the substituted words stand (tests enumerate that).

Before the join, documents are sieved by a bit field over the benchmark's seeds, whose size is fixed: a larger benchmark lets more
seeds through to the join, but none is lost. Only the words around sieved seeds leave the task.

Words are runs of letters, digits and underscores in lower case; punctuation and line breaks make no difference.

Defined results: null and empty texts leak nothing, and items of fewer than MIN_ITEM words are no passage and match nothing;
repeated documents are reported once per doc_id and item, repeated items by the id of each; a null doc_id or item_id takes no part in the report,
but `without_leaks` searches rows without a doc_id too;
columns beyond the ids and texts are not looked at. Memory: a task holds the bit field and one Arrow batch.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import free_name, mix, record_batch, require, stored

MASKS = ("110101", "1100101")
WINDOW, MIN_ITEM, SIMILARITY = 20, 8, 0.8
FIELD_BITS = 1 << 26  # 8 MB
_WORD = re.compile(r"\w+")
_SEEDS = pa.schema([("item_id", pa.int64()), ("at", pa.int32()), ("seed", pa.int64())])
_ITEMS = pa.schema([("item_id", pa.int64()), ("item", pa.list_(pa.int64()))])
_PARTS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("part", pa.list_(pa.int64())),
                    ("at", pa.list_(pa.int32())), ("seed", pa.list_(pa.int64()))])
_LEAKS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("matched", pa.int32()), ("compared", pa.int32()),
                    ("doc_word", pa.int64()), ("item_word", pa.int64())])
_RANDOM = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


class Tokens:
    """Hashes of words as an array; keeps those of the words met last."""

    def __init__(self, size: int = 1 << 18):
        self.known, self.size = {}, size

    def __call__(self, text: str | None) -> np.ndarray:
        words, known = _WORD.findall((text or "").lower()), self.known
        for word in set(words):
            if word not in known:
                if len(known) >= self.size:
                    known.clear()
                    return self._plain(words)
                known[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"))
        return np.array([known[word] for word in words], dtype=np.uint64)

    @staticmethod
    def _plain(words: list[str]) -> np.ndarray:
        return np.array([xxhash.xxh64_intdigest(word.encode("utf-8", "replace")) for word in words], dtype=np.uint64)


def seeds(tokens: np.ndarray, masks=MASKS) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of all seeds of a sequence of words."""
    places, hashes = [], []
    for number, mask in enumerate(masks):
        count = len(tokens) - len(mask) + 1
        if count > 0:
            total = np.full(count, number, dtype=np.uint64)
            for order, offset in enumerate(at for at, sign in enumerate(mask) if sign == "1"):
                total += tokens[offset:offset + count] * _RANDOM[order]
            places.append(np.arange(count, dtype=np.int32))
            hashes.append(mix(total))
    if not places:
        return np.empty(0, dtype=np.int32), np.empty(0, dtype=np.uint64)
    return np.concatenate(places), np.concatenate(hashes)


def best_stretch(part: np.ndarray, item: np.ndarray, offset: int, window: int) -> tuple[int, int, int]:
    """(matched, compared, first word of the stretch in the item) of the best aligned stretch; item word i lies at i + offset."""
    size = min(window, len(item))
    first, last = max(0, -offset), min(len(item), len(part) - offset)
    if last - first < size:
        return 0, size, 0
    same = np.concatenate([[0], np.cumsum(part[first + offset:last + offset] == item[first:last])])
    sums = same[size:] - same[:-size]
    at = int(sums.argmax())
    return int(sums[at]), size, first + at


def item_tokens(benchmark: DataFrame, min_item: int = MIN_ITEM) -> DataFrame:
    """(item_id, item): the hashed words of every item that is long enough."""
    require(benchmark, "item_id", "text")

    def run(batches):
        tokens = Tokens()
        for batch in batches:
            rows = [(item_id, found.view(np.int64)) for item_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                    if item_id is not None and len(found := tokens(text)) >= min_item]
            yield record_batch(_ITEMS, ([r[0] for r in rows], [r[1] for r in rows]))

    return benchmark.select(F.col("item_id").cast("long"), "text").mapInArrow(run, "item_id long, item array<long>")


def item_seeds(items: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for item_id, item in zip(batch.column(0).to_pylist(), batch.column(1)):
                places, hashes = seeds(np.asarray(item.values).view(np.uint64))
                yield record_batch(_SEEDS, (np.full(len(places), item_id), places, hashes.view(np.int64)))

    return items.mapInArrow(run, "item_id long, at int, seed long")


def _field_places(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(FIELD_BITS - 1)
    return hashes & mask, (hashes >> np.uint64(32)) & mask


def bit_field(found: DataFrame) -> np.ndarray:
    """Two bits set for each seed, of FIELD_BITS; the driver gets no more than one row per 64 bits."""
    mask = FIELD_BITS - 1
    bits = found.select(F.explode(F.array(
        F.col("seed").bitwiseAND(F.lit(mask)), F.shiftrightunsigned("seed", 32).bitwiseAND(F.lit(mask)))).alias("bit"))
    words = bits.groupBy(F.shiftright("bit", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(bit & 63 AS INT))")).alias("bits")).toPandas()
    field = np.zeros(FIELD_BITS // 64, dtype=np.uint64)
    field[words["word"].to_numpy().astype(np.int64)] = words["bits"].to_numpy().astype(np.int64).view(np.uint64)
    return field


def _sieved(found: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    places, hashes = seeds(found)
    for which in (0, 1):
        position = _field_places(hashes)[which]
        keep = np.flatnonzero((bits[position >> np.uint64(6)] >> (position & np.uint64(63))) & np.uint64(1))
        places, hashes = places[keep], hashes[keep]
    return places, hashes


def seeded_parts(docs: DataFrame, field, window: int = WINDOW) -> DataFrame:
    """(doc_id, start, part, at, seed): the stretches of documents around sieved seeds, as hashed words, and the seeds in them."""

    def run(batches):
        tokens, bits = Tokens(), field.value
        span = max(map(len, MASKS))
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if doc_id is None:
                    continue
                found = tokens(text)
                places, hashes = _sieved(found, bits)
                if not len(places):
                    continue
                order = np.argsort(places, kind="stable")
                places, hashes = places[order], hashes[order]
                cuts = [0, *(np.flatnonzero(np.diff(places) > 2 * window + span) + 1).tolist(), len(places)]
                for begin, end in zip(cuts, cuts[1:]):
                    start = max(0, int(places[begin]) - window)
                    stop = min(len(found), int(places[end - 1]) + span + window)
                    rows.append((doc_id, start, found[start:stop].view(np.int64), places[begin:end] - start, hashes[begin:end].view(np.int64)))
            yield record_batch(_PARTS, ([row[k] for row in rows] for k in range(5)))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, start long, part array<long>, at array<int>, seed array<long>")


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, matched, compared, doc_word, item_word): one row per document and item it leaks, with its best stretch."""
    require(docs, "doc_id", "text")
    items = stored(item_tokens(benchmark), "benchmark-words")
    known = stored(item_seeds(items), "benchmark-seeds")
    field = docs.sparkSession.sparkContext.broadcast(bit_field(known))
    parts = stored(seeded_parts(docs, field, window), "seeded-parts")
    hits = parts.select("doc_id", "start", F.explode(F.arrays_zip("at", "seed")).alias("hit")).select(
        "doc_id", "start", F.col("hit.at").alias("place"), F.col("hit.seed").alias("seed"))
    aligned = hits.join(known, "seed").select("doc_id", "start", "item_id", (F.col("place") - F.col("at")).alias("offset")).distinct()
    checked = aligned.join(parts.select("doc_id", "start", "part"), ["doc_id", "start"]).join(items, "item_id").select(
        "doc_id", "item_id", "start", "offset", "part", "item")

    def verify(batches):
        for batch in batches:
            rows = []
            ids, names, starts, offsets = (batch.column(k).to_pylist() for k in range(4))
            for at, (doc_id, item_id, start, offset) in enumerate(zip(ids, names, starts, offsets)):
                part, item = np.asarray(batch.column(4)[at].values), np.asarray(batch.column(5)[at].values)
                matched, compared, first = best_stretch(part, item, offset, window)
                if matched >= similarity * compared:
                    rows.append((doc_id, item_id, matched, compared, start + offset + first, first))
            yield record_batch(_LEAKS, ([row[k] for row in rows] for k in range(6)))

    found = checked.mapInArrow(verify, "doc_id long, item_id long, matched int, compared int, doc_word long, item_word long")
    best = F.min(F.struct((-F.col("matched")).alias("m"), "doc_word", "item_word", "compared")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", (-F.col("best.m")).alias("matched"), "best.compared", "best.doc_word", "best.item_word")


def without_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of `docs` which leak no item. Rows are named by a hash of their text, so those without a doc_id are searched too."""
    name = free_name(docs, "_text")
    keyed = docs.withColumn(name, F.xxhash64("text"))
    found = leaks(keyed.select(F.col(name).alias("doc_id"), "text"), benchmark, window, similarity)
    return keyed.join(found.select(F.col("doc_id").alias(name)).distinct(), name, "left_anti").select(*docs.columns)
