"""Line dedup: exact reference counts per line key, with sharded cuckoo filters in front of them.

State is two tables. `counts` (key, n) has the exact number of documents per line key. `filters` (shard, n_shards, filter) has
one cuckoo filter per shard over the keys that have reached the threshold. Both take insertions and deletions of documents:
deleting what was inserted gives the former counts, and keys that fall below the threshold leave their filter. A filter that has no
room for its keys any more, or is of another number of shards, is built again from the exact counts, with room for twice as many.

Lines of documents are first tested against the filters, and what they let pass is verified against the exact counts.

Defined results: every row is a document of its own, also if rows or ids repeat; a null or empty text is one empty line; the
empty key is never counted, so empty lines stay; a text that loses all lines becomes empty; rows with a null doc_id are treated
like others; columns beyond doc_id and text pass through, and result columns replace columns of the same name. Memory: a task
holds one filter (at most FILTER_KEYS keys in expectation) and one Arrow batch.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import free_name, record_batch, require, stored, utf8
from .cuckoo import LOAD, CuckooFilter

MIN_DOCS = 10
FILTER_KEYS = 1 << 18  # keys that one filter is meant for
SPREAD = 32            # parts over which the lines of a shard, thus also those of one very common line, are dealt at least
PART_LINES = 1 << 22   # lines of a shard per part

_PAIRS = pa.schema([("doc_id", pa.int64()), ("key", pa.binary())])
_FILTERS = pa.schema([("shard", pa.int32()), ("n_shards", pa.int32()), ("filter", pa.binary())])


def line_key(line: bytes) -> bytes:
    """Stripped of [\\x20\\x09-\\x0D] at both ends, A-Z in lower case; bytes.strip and bytes.lower know just these characters."""
    return line.strip().lower()


def key_digest(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def line_keys(docs: DataFrame) -> DataFrame:
    """(doc_id, key): each distinct non-empty line key of each row of `docs`, as a 128-bit digest."""
    require(docs, "doc_id", "text")

    def split(batches):
        for batch in batches:
            ids, keys = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                found = {line_key(line) for line in text.split(b"\n")}
                found.discard(b"")
                ids.extend([doc_id] * len(found))
                keys.extend(map(key_digest, found))
            yield record_batch(_PAIRS, (ids, keys))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(split, "doc_id long, key binary")


def count_keys(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def insert_documents(counts: DataFrame, docs: DataFrame) -> DataFrame:
    """The counts after `docs` have been added."""
    return _changed(counts, docs, 1)


def delete_documents(counts: DataFrame, docs: DataFrame) -> DataFrame:
    """The counts after `docs`, which must have been added before, are taken away; keys of no document leave the table."""
    return _changed(counts, docs, -1)


def _changed(counts: DataFrame, docs: DataFrame, sign: int) -> DataFrame:
    changes = line_keys(docs).select("key", F.lit(sign).cast("long").alias("n"))
    return counts.select("key", "n").union(changes).groupBy("key").agg(F.sum("n").alias("n")).filter("n > 0")


def _digests(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u8").reshape(-1, 2)


def _shard(n_shards: int):
    return F.pmod(F.xxhash64("key"), F.lit(n_shards)).cast("int")


def shards_for(keys: int) -> int:
    return max(1, math.ceil(keys / FILTER_KEYS))


def build_filters(counts: DataFrame, min_docs: int = MIN_DOCS, n_shards: int = 1) -> DataFrame:
    """One filter per shard over the keys found in at least `min_docs` documents."""
    empty = counts.sparkSession.createDataFrame([], "shard int, n_shards int, filter binary")
    changes = counts.filter(F.col("n") >= min_docs).select("key", F.lit(1).alias("step"))
    return _apply(empty, changes, n_shards)


def update_filters(filters: DataFrame, before: DataFrame, after: DataFrame, min_docs: int = MIN_DOCS, n_shards: int = 1) -> DataFrame:
    """The filters after the counts went from `before` to `after`: keys which crossed the threshold enter or leave in place. Shards
    without a filter that has room for their keys get a new one, with all of them."""
    held = lambda counts, step: counts.filter(F.col("n") >= min_docs).select(
        "key", _shard(n_shards).alias("shard"), F.lit(step).alias("step"))
    steps = held(before, -1).union(held(after, 1)).groupBy("key", "shard").agg(F.sum("step").cast("int").alias("step")).filter("step != 0")
    sizes = held(after, 1).groupBy("shard").agg(F.count(F.lit(1)).alias("keys"))
    room = F.length("filter") / 2 * LOAD  # two bytes a slot
    roomy = stored(filters.filter(F.col("n_shards") == n_shards).join(sizes, "shard", "left")
                   .filter(F.coalesce("keys", F.lit(0)) <= room).select("shard"), "roomy-shards")
    changes = steps.join(roomy, "shard", "left_semi").unionByName(held(after, 1).join(roomy, "shard", "left_anti"))
    return _apply(filters.join(roomy, "shard", "left_semi"), changes.select("key", "step"), n_shards)


def _apply(filters: DataFrame, changes: DataFrame, n_shards: int) -> DataFrame:
    """Stream the changes of each shard into its filter. A shard without a filter gets one that fits its keys."""

    def run(batches):
        shard, current, steps = None, None, {1: [], -1: []}

        def finish():
            keys = {step: np.concatenate(parts) if parts else np.empty((0, 2), "<u8") for step, parts in steps.items()}
            chosen = current or CuckooFilter.for_items(2 * len(keys[1]))
            chosen.delete(keys[-1])
            chosen.insert(keys[1])
            return record_batch(_FILTERS, ([shard], [n_shards], [chosen.to_bytes()]))

        for batch in batches:
            shards, step = batch.column(0).to_numpy(), batch.column(3).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
            for begin, end in zip(cuts, cuts[1:]):
                if begin == end:
                    continue
                if shard is not None and shards[begin] != shard:
                    yield finish()
                    current, steps = None, {1: [], -1: []}
                shard = int(shards[begin])
                for way in (0, 1, -1):
                    rows = np.flatnonzero(step[begin:end] == way) + begin
                    if way == 0 and len(rows):
                        current = CuckooFilter.from_bytes(batch.column(2)[int(rows[0])].as_py())
                    elif len(rows):
                        steps[way].append(_digests(batch.column(1).take(pa.array(rows))))
        if shard is not None:
            yield finish()

    old = filters.select("shard", F.lit(None).cast("binary").alias("key"), "filter", F.lit(0).alias("step"))
    new = changes.select(_shard(n_shards).alias("shard"), "key", F.lit(None).cast("binary").alias("filter"), "step")
    return (old.union(new).repartition("shard").sortWithinPartitions("shard", F.abs("step"))
            .mapInArrow(run, "shard int, n_shards int, filter binary"))


def parts_for(lines: int, n_shards: int) -> int:
    """Parts per shard: a part has about PART_LINES lines at most, whatever the number of shards."""
    return max(SPREAD, math.ceil(lines / n_shards / PART_LINES))


def filter_hits(pairs: DataFrame, filters: DataFrame, n_shards: int, parts: int = SPREAD) -> DataFrame:
    """The (doc_id, key) which the filter of their shard may contain. Lines of a shard are dealt over `parts` parts, each with a
    copy of the filter, and are streamed past it."""

    def probe(batches):
        shard, current = None, None
        for batch in batches:
            shards, given = batch.column(0).to_numpy(), batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
            for begin, end in zip(cuts, cuts[1:]):
                if begin == end:
                    continue
                if shards[begin] != shard:
                    shard, current = shards[begin], None
                copies = np.flatnonzero(~given[begin:end]) + begin  # one before the lines of every part
                if len(copies):
                    current = CuckooFilter.from_bytes(batch.column(3)[int(copies[0])].as_py())
                if current is not None:
                    rows = np.flatnonzero(given[begin:end]) + begin
                    rows = pa.array(rows[current.contains(_digests(batch.column(2).take(pa.array(rows))))])
                    yield record_batch(_PAIRS, (batch.column(1).take(rows), batch.column(2).take(rows)))

    part = F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")
    rows = pairs.select(_shard(n_shards).alias("shard"), "doc_id", "key", F.lit(None).cast("binary").alias("filter"), part.alias("part"))
    copies = filters.select("shard", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("key"), "filter",
                            F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    dealt = rows.union(copies).withColumn("part", F.coalesce("part", F.lit(0)))
    return (dealt.repartition("shard", "part").sortWithinPartitions("shard", "part", F.col("key").isNotNull())
            .drop("part").mapInArrow(probe, "doc_id long, key binary"))


def frequent_lines(pairs: DataFrame, counts: DataFrame, filters: DataFrame, min_docs: int, n_shards: int) -> DataFrame:
    """(doc_id, key) of the lines whose key is in at least `min_docs` documents: filter hits, verified by the exact counts."""
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SPREAD)).cast("int")
    exact = counts.filter(F.col("n") >= min_docs).select("key", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("salt"))
    hits = filter_hits(pairs, filters, n_shards, parts_for(pairs.count(), n_shards))
    return hits.withColumn("salt", salt).join(exact, ["key", "salt"]).select("doc_id", "key")


def without_lines(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """`docs` with the lines of `dropped` (doc_id, key) left out of their texts, and the columns n_lines, n_dropped, kept_sha256."""
    require(docs, "doc_id", "text")
    added = {"n_lines": pa.int64(), "n_dropped": pa.int64(), "kept_sha256": pa.string()}
    base = docs.drop(*added)
    keys, owner = free_name(base, "_keys"), free_name(base, "_owner")
    drops = dropped.groupBy(F.col("doc_id").alias(owner)).agg(F.collect_set("key").alias(keys))
    joined = base.join(drops, F.col("doc_id").cast("long").eqNullSafe(F.col(owner)), "left").drop(owner)
    text_at, names = base.columns.index("text"), base.columns

    def rebuild(batches):
        for batch in batches:
            texts, counts, gone, sums = [], [], [], []
            lists = batch.column(len(names)).to_pylist()
            for text, drop in zip(utf8(batch.column(text_at)), lists):
                lines = text.split(b"\n")
                kept = lines
                if drop:
                    drop = set(drop)
                    kept = [line for line in lines if not (key := line_key(line)) or key_digest(key) not in drop]
                text = b"\n".join(kept)
                texts.append(text)
                counts.append(len(lines))
                gone.append(len(lines) - len(kept))
                sums.append(hashlib.sha256(text).hexdigest())
            columns = list(batch.columns[:len(names)])
            columns[text_at] = pa.array(texts, pa.binary()).cast(pa.string())
            columns += [pa.array(values, kind) for values, kind in zip((counts, gone, sums), added.values())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *added])

    schema = ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in base.schema),
                        "n_lines long", "n_dropped long", "kept_sha256 string"])
    return joined.mapInArrow(rebuild, schema)


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """`docs` without the lines whose key is found in at least `min_docs` of them; columns as `without_lines`."""
    pairs = stored(line_keys(docs), "line-keys")
    counts = stored(count_keys(pairs), "line-counts")
    n_shards = shards_for(counts.filter(F.col("n") >= min_docs).count())
    filters = stored(build_filters(counts, min_docs, n_shards), "line-filters")
    return without_lines(docs, frequent_lines(pairs, counts, filters, min_docs, n_shards))
