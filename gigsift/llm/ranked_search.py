"""Ranked search of many items at once, with what the items share computed once per document.

Every item is scored against every document: the weight of each of its terms times the saturated frequency of the term, added up over its
terms. Items share terms, so their sums share parts. These are mined from the items: terms that occur equally often in the same items are
one atom; each item is a sequence of atoms and counts in one fixed order, and the pair of neighbours found in most items becomes a node of
its own, again and again, so that nodes are sets of terms that several items share. Nodes form a graph in which each has two parts. For a
batch of documents, an accumulator per atom is filled from the terms, every node is added up once from its parts, level by level, and
each item adds the few nodes left in it. How much is shared decides the cost, never the result: all arithmetic is in whole numbers.

Two passes over the documents: the first counts terms and writes those which the items hold, from which Spark sums document frequencies;
the second scores. A task keeps the `top` best per item, and these meet in two steps, over PARTS parts of each item and then over items.
Items are dealt by hash to blocks of BLOCK_TERMS / 2 terms on average, each searched on its own, so that what passes the driver and is sent
to the tasks is bounded at any number of items.

Defined results: a null text has no term; documents without terms count nowhere, items without terms find nothing; each row of the items
is an item, with its item_id if null too; each row of the documents is a document; one without a doc_id counts but is not ranked, as
nothing can name it. Equal scores go by doc_id; rows that share both are ranked one after the other.
Memory: a batch of documents times the nodes of a block, CELLS numbers at most per level, and `top` candidates per item of a block.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import record_batch, require, stored, utf8

TOP, BLOCK_TERMS, ROUNDS, PARTS, CELLS, LONGEST = 20, 1 << 18, 64, 64, 1 << 21, 1 << 16
_SEPARATORS = bytes(range(0x30)) + bytes(range(0x3A, 0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x80))
_PLAIN = bytes.maketrans(_SEPARATORS + b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b" " * len(_SEPARATORS) + b"abcdefghijklmnopqrstuvwxyz")
_ITEMS = pa.schema([("item", pa.int64()), ("term", pa.binary()), ("count", pa.int64())])
_COUNTED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32()))])
_RANKED = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def terms_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and all code points beyond ASCII, with A-Z in lower case."""
    return text.translate(_PLAIN).split()


def item_terms(items: DataFrame) -> DataFrame:
    """(item, term, count) for `items` (item, text)."""
    def run(batches):
        for batch in batches:
            found = [(item, term, count) for item, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)))
                     for term, count in Counter(terms_of(text)).items()]
            yield record_batch(_ITEMS, ([row[k] for row in found] for k in range(3)))

    return items.select("item", "text").mapInArrow(run, "item long, term binary, count long")


class Sharing:
    """The query-sharing graph of a block of items.

    `items` holds for each item the pairs (term, count). Columns of an accumulator table are first the atoms, then the nodes; `levels` has
    for each level the nodes' columns and their two parts; `rest` has per item the columns and counts that are left to add.
    """

    def __init__(self, items: list[list[tuple[int, int]]], terms: int, rounds: int = ROUNDS):
        users: dict[int, list[tuple[int, int]]] = {}
        for item, pairs in enumerate(items):
            for term, count in sorted(pairs):
                users.setdefault(term, []).append((item, count))
        # an atom: terms of the same items, equally often in each
        alike: dict[tuple, list[int]] = {}
        for term, where in users.items():
            alike.setdefault(tuple(where), []).append(term)
        groups = sorted(alike.items(), key=lambda group: (-len(group[0]), group[1][0]))
        self.atom_of = np.zeros(terms, dtype=np.int64)
        sequences: list[list[tuple[int, int]]] = [[] for _ in items]
        for atom, (where, members) in enumerate(groups):
            self.atom_of[members] = atom
            for item, count in where:
                sequences[item].append((atom, count))
        for sequence in sequences:
            sequence.sort(key=lambda symbol: symbol[1])  # only symbols counted alike make a node: they stand together
        self.atoms, self.parts, depth = len(groups), [], {}
        for _ in range(rounds):
            pairs = Counter(pair for sequence in sequences for pair in zip(sequence, sequence[1:]) if pair[0][1] == pair[1][1])
            # a pair becomes a node if none of its parts is wanted by a pair found more often
            chosen, taken = {}, set()
            for (left, right), found in sorted(pairs.items(), key=lambda pair: (-pair[1], pair[0])):
                if found < 2:
                    break
                if left not in taken and right not in taken:
                    taken |= {left, right}
                    node = self.atoms + len(self.parts)
                    chosen[left, right] = (node, left[1])
                    self.parts.append((left[0], right[0]))
                    depth[node] = 1 + max(depth.get(left[0], 0), depth.get(right[0], 0))
            if not chosen:
                break
            for at, sequence in enumerate(sequences):
                made, k = [], 0
                while k < len(sequence):
                    pair = chosen.get(tuple(sequence[k:k + 2]))
                    made.append(pair or sequence[k])
                    k += 2 if pair else 1
                sequences[at] = made
        order = np.array([depth[self.atoms + k] for k in range(len(self.parts))], dtype=np.int64)
        ends = np.array(self.parts, dtype=np.int64).reshape(-1, 2)
        self.levels = [(self.atoms + (at := np.flatnonzero(order == level)), ends[at, 0], ends[at, 1]) for level in range(1, int(order.max(initial=0)) + 1)]
        self.busy = np.array([item for item, sequence in enumerate(sequences) if sequence], dtype=np.int64)
        flat = [pair for sequence in sequences for pair in sequence]
        self.rest = np.array([column for column, _ in flat], dtype=np.int64)
        self.counts = np.array([count for _, count in flat], dtype=np.int64)
        self.begins = np.cumsum([0, *(len(sequences[item]) for item in self.busy)])[:-1]
        self.width = self.atoms + len(self.parts)

    def additions(self) -> int:
        """Numbers added per document."""
        return len(self.parts) + len(self.rest)

    def scores(self, docs: np.ndarray, terms: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
        """(busy item, document) scores of `size` documents from the values of their terms."""
        table = np.zeros((self.width, size), dtype=np.int64)
        np.add.at(table, (self.atom_of[terms], docs), values)
        for nodes, left, right in self.levels:
            table[nodes] = table[left] + table[right]
        out = np.empty((len(self.busy), size), dtype=np.int64)
        step, begin = max(1, CELLS // max(1, size)), 0
        while begin < len(self.busy):  # whole items, about CELLS numbers at a time
            end = max(begin + 1, int(np.searchsorted(self.begins, self.begins[begin] + step)))
            low, high = self.begins[begin], self.begins[end] if end < len(self.begins) else len(self.rest)
            picked = table[self.rest[low:high]] * self.counts[low:high, None]
            out[begin:end] = np.add.reduceat(picked, self.begins[begin:end] - low, axis=0)
            begin = end
        return out


def counted_terms(docs: DataFrame, places) -> DataFrame:
    """(doc_id, n, terms, tfs) of every row: its number of terms, and the numbers and frequencies of those that `places`, a broadcast
    dictionary, knows."""
    def run(batches):
        known = places.value
        for batch in batches:
            counts, terms, tfs = [], [], []
            for text in utf8(batch.column(1)):
                found = terms_of(text)
                met = Counter(place for place in map(known.get, found) if place is not None)
                counts.append(len(found))
                terms.append(list(met))
                tfs.append(list(met.values()))
            yield record_batch(_COUNTED, (batch.column(0), counts, terms, tfs))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


class _Best:
    """The `top` best documents of each item so far."""

    def __init__(self, items: int, top: int):
        self.top, self.floor, self.waiting = top, np.zeros(items, dtype=np.int64), 0
        self.kept = [np.empty(0, dtype=np.int64)] * 3

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        rows, columns = np.nonzero((scores > 0) & (scores >= self.floor[:, None]))
        self.kept = [np.concatenate(pair) for pair in zip(self.kept, (rows, ids[columns], scores[rows, columns]))]
        if len(self.kept[0]) > 2 * self.top * len(self.floor) + LONGEST:
            self.cut()

    def cut(self) -> list[np.ndarray]:
        items, ids, scores = self.kept
        order = np.lexsort((ids, -scores, items))
        items, ids, scores = items[order], ids[order], scores[order]
        begins = np.flatnonzero(np.concatenate([[True], items[1:] != items[:-1]])) if len(items) else np.empty(0, dtype=np.int64)
        sizes = np.diff(np.append(begins, len(items)))
        rank = np.arange(len(items)) - np.repeat(begins, sizes)
        full = sizes >= self.top
        self.floor[items[begins[full]]] = scores[begins[full] + self.top - 1]
        self.kept = [column[rank < self.top] for column in (items, ids, scores)]
        return self.kept


def best_of(counted: DataFrame, shared, documents: int, length: int, top: int = TOP) -> DataFrame:
    """(item, doc_id, score): for each item of the block the `top` best documents of each task."""
    def run(batches):
        graph, names, weights = shared.value
        size = max(1, min(4096, CELLS // max(1, graph.width)))
        best = _Best(len(graph.busy), top)
        for batch in batches:
            for begin in range(0, batch.num_rows, size):
                part = batch.slice(begin, size)
                ids, n = part.column(0).to_numpy(), part.column(1).to_numpy()
                held = part.column(2).flatten().to_numpy()
                docs = np.repeat(np.arange(len(ids)), part.column(2).value_lengths().to_numpy())
                tf = part.column(3).flatten().to_numpy().astype(np.int64)
                m = 75 + (25 * n * documents) // length
                values = weights[held] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[docs]))
                best.add(graph.scores(docs, held, values, len(ids)), ids)
        items, ids, scores = best.cut()
        yield record_batch(_RANKED, (names[graph.busy[items]], ids, scores))

    named = counted.filter("doc_id IS NOT NULL AND size(terms) > 0")
    return named.mapInArrow(run, "item long, doc_id long, score long")


def _ranks(found: DataFrame, *groups: str, top: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*groups).orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` documents of `docs` of highest score above zero for each row of `items`."""
    require(docs, "doc_id", "text")
    require(items, "item_id", "text")
    spark = docs.sparkSession
    numbered = stored(items.select("item_id", "text").withColumn("item", F.monotonically_increasing_id()), "items")
    terms = stored(item_terms(numbered), "item-terms")
    count = max(1, -(-2 * terms.count() // BLOCK_TERMS))
    found = None
    for number in range(count):
        block = terms.filter(F.pmod(F.xxhash64("item"), F.lit(count)) == number).orderBy("item", "term").toArrow()
        if not block.num_rows:
            continue
        ranked = _search_block(docs, block, top)
        found = ranked if found is None else found.unionByName(ranked)
    if found is None:
        found = spark.createDataFrame([], "item long, rank int, doc_id long, score long")
    return numbered.select("item", "item_id").join(found, "item").select("item_id", "rank", "doc_id", "score")


def _search_block(docs: DataFrame, block: pa.Table, top: int) -> DataFrame:
    spark = docs.sparkSession
    keys, words, counts = (block.column(k).to_pylist() for k in range(3))
    vocabulary = {word: place for place, word in enumerate(sorted(set(words)))}
    names = sorted(set(keys))
    at = {key: place for place, key in enumerate(names)}
    held: list[list[tuple[int, int]]] = [[] for _ in names]
    for key, word, count in zip(keys, words, counts):
        held[at[key]].append((vocabulary[word], count))
    counted = stored(counted_terms(docs, places := spark.sparkContext.broadcast(vocabulary)), "counted-terms")
    documents, length = counted.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    df = np.zeros(len(vocabulary), dtype=np.int64)
    if documents:
        for row in counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect():
            df[row["term"]] = row["df"]
    weights = np.array([math.floor(1000 * math.log((2 * (documents or 0) + 2) / (2 * int(n) + 1))) for n in df], dtype=np.int64)
    shared = spark.sparkContext.broadcast((Sharing(held, len(vocabulary)), np.array(names, dtype=np.int64), weights))
    found = best_of(counted, shared, documents or 0, max(1, length or 0), top)
    # a part of an item gets `top` rows of each task, an item `top` of each of its parts
    halfway = _ranks(found.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))), "item", "part", top=top).drop("rank", "part")
    ranked = stored(_ranks(halfway, "item", top=top), "ranked-documents")
    places.destroy()
    shared.destroy()
    return ranked.select("item", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
