"""Substring dedup by sliding sentence spans.

A text is cut into sentences, which end at . ! ? before white space, at their full-width forms and at line breaks. Sentences of more
than LONGEST words are cut into pieces, which count as sentences, where the hash of two neighbouring words is the smallest among the REACH
to both sides: that depends on the words around alone, so a passage is cut alike wherever it begins. Every run of RUN consecutive sentences
with LEAST_WORDS words or more is hashed, and of RUN - 1 with ENOUGH_WORDS (a text of fewer sentences is one run; a run that two such
shorter ones cover is left out). Runs are joined globally: the first occurrence is that of the smallest doc_id, and in it the first;
sentences covered by any other occurrence are removed. Case and white space make no difference.

Defined results: null and empty texts have no sentences; every row is a document of its own; rows that share a doc_id come in the
order in which they are read, so of equal rows one stays whole; rows with a null doc_id come before all others; other columns pass through.
Memory: one Arrow batch per task; what is grouped by row are the spans within that row. A run that a large share of documents holds meets
its first occurrence in a sort-merge join, whose partitions adaptive execution splits. Work on a text is linear in its length.
"""

from __future__ import annotations

import re
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .common import ddl_of, free_name, mix, record_batch, require, stored

RUN, LONGEST, LEAST_WORDS, ENOUGH_WORDS, REACH = 3, 16, 8, 24, 4
_BREAK = re.compile(r"\n|[.!?](?=\s)|[。！？]")
_WORD, _SPACE = re.compile(r"\S+"), re.compile(r"\s*")
_RANDOM = mix(np.arange(101, 133, dtype=np.uint64)) | np.uint64(1)
_RUNS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int32()), ("size", pa.int32()), ("start", pa.int32()),
                   ("end", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64())])


def cuts(sentences: list[list[str]], longest: int = LONGEST, reach: int = REACH) -> list[list[int]]:
    """Places before which long sentences are cut, the first and the last included; no piece has more than twice `longest` words."""
    between = [b"\xff" * 8 * reach]  # no hash beside them is larger, so sentences do not see each other
    digests = list(between)
    for words in sentences:
        coded = " ".join(words).encode("utf-8", "replace").split(b" ")
        digests += map(xxhash.xxh3_64_digest, map(b" ".join, pairwise(coded)))
        digests += between
    wide = np.frombuffer(b"".join(digests), dtype=">u8").astype(np.uint64)
    size = len(wide) - 2 * reach
    hashes = wide[reach:reach + size]
    low = np.ones(size, dtype=bool)
    for step in range(1, reach + 1):
        low &= (hashes < wide[reach - step:reach - step + size]) & (hashes <= wide[reach + step:reach + step + size])
    lowest, offsets = np.flatnonzero(low) + 1, np.cumsum([0, *(len(words) - 1 + reach for words in sentences)])
    groups = np.searchsorted(lowest, offsets, side="right").tolist()
    lowest, made = lowest.tolist(), []
    for words, offset, (first, last) in zip(sentences, offsets.tolist(), pairwise(groups)):
        found = []
        for begin, end in pairwise([0, *(place - offset for place in lowest[first:last]), len(words)]):
            found.extend(range(begin, end, 2 * longest))
        made.append([*found, len(words)])
    return made


def word_places(text: str, start: int, end: int) -> tuple[list[int], list[int]]:
    """Starts and ends of the words between two places of a text, where a word begins and ends."""
    sizes = list(map(len, text[start:end].split()))
    if sum(sizes) + len(sizes) - 1 == end - start:  # one space each
        ends = [start + at + place for at, place in enumerate(accumulate(sizes))]
        return [stop - size for stop, size in zip(ends, sizes)], ends
    places = [m.span() for m in _WORD.finditer(text, start, end)]
    return [first for first, _ in places], [last for _, last in places]


def sentences_and_words(text: str, longest: int = LONGEST):
    """Start, end and lower-case words of every sentence, without the white space around it."""
    at, whole = 0, []
    for stop in [*(m.end() for m in _BREAK.finditer(text)), len(text)]:
        part = text[at:stop]
        words = part.lower().split()
        if words:
            whole.append((stop - len(part.lstrip()), at + len(part.rstrip()), words))
        at = stop
    long = [words for _, _, words in whole if len(words) > longest]
    cut = iter(cuts(long, longest) if long else ())
    found = []
    for sentence in whole:
        start, end, words = sentence
        if len(words) <= longest:
            found.append(sentence)
            continue
        starts, ends = word_places(text, start, end)
        found.extend((starts[first], ends[last - 1], words[first:last]) for first, last in pairwise(next(cut)))
    return found


def sentences(text: str, longest: int = LONGEST) -> list[tuple[int, int]]:
    """Start and end of every sentence."""
    return [(start, end) for start, end, _ in sentences_and_words(text, longest)]


def runs_of(text: str, run: int = RUN, least: int = LEAST_WORDS, enough: int = ENOUGH_WORDS) -> tuple[np.ndarray, ...]:
    """First sentence, number of sentences, start, end and two hashes of every run of a text."""
    found = sentences_and_words(text)
    if not found:
        return tuple(np.empty(0, dtype=np.int64) for _ in range(6))
    begins, ends, words = zip(*found)
    begins, ends, sums = np.array(begins), np.array(ends), np.cumsum([0, *map(len, words)])
    digests = b"".join(xxhash.xxh3_128_digest(" ".join(w).encode("utf-8", "replace")) for w in words)
    lanes = np.frombuffer(digests, dtype="<u8").reshape(-1, 2)
    most = min(run, len(words))
    made = []
    for size in sorted({most, max(min(run - 1, most), 2)} & set(range(1, most + 1))):
        count = len(words) - size + 1
        totals = np.full((count, 2), size, dtype=np.uint64)
        for step in range(size):
            totals += lanes[step:step + count] * _RANDOM[2 * step:2 * step + 2]
        hashes, length = mix(totals).view(np.int64), sums[size:] - sums[:-size]
        at = np.flatnonzero(length >= (least if size == most else enough))
        if size == most == run > 2:  # the two shorter runs in it have enough words by themselves
            at = at[(sums[at + run - 1] - sums[at] < enough) | (sums[at + run] - sums[at + 1] < enough)]
        made.append((at, np.full(len(at), size), begins[at], ends[at + size - 1], hashes[at, 0], hashes[at, 1]))
    return tuple(np.concatenate(parts) for parts in zip(*made))


def sentence_runs(docs: DataFrame, run: int = RUN, least: int = LEAST_WORDS) -> DataFrame:
    """(row, doc_id, at, size, start, end, h1, h2) of every run of every row; `docs` has a number `row` for each."""
    require(docs, "doc_id", "text")

    def split(batches):
        for batch in batches:
            found = [runs_of(text or "", run, least) for text in batch.column(2).to_pylist()]
            if found:
                owner = pa.array(np.repeat(np.arange(len(found)), [len(made[0]) for made in found]))
                owners = (batch.column(0).take(owner), batch.column(1).take(owner))
                yield record_batch(_RUNS, (*owners, *(np.concatenate(parts) for parts in zip(*found))))

    return docs.select("row", F.col("doc_id").cast("long"), "text").mapInArrow(
        split, "row long, doc_id long, at int, size int, start int, end int, h1 long, h2 long")


def spans_by_row(runs: DataFrame) -> DataFrame:
    """(row, doc_id, start, end, n_sentences, first_doc_id) of the stretches to remove."""
    firsts = (runs.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "row", "at")).alias("first"), F.count(F.lit(1)).alias("n"))
              .filter("n > 1").select("h1", "h2", F.col("first.doc_id").alias("first_doc_id"), F.col("first.row").alias("first_row"),
                                      F.col("first.at").alias("first_at")))
    # two numbers in one where rows are shuffled
    packed = runs.select("h1", "h2", "row", "doc_id", F.expr("shiftleft(cast(at as long), 32) | size").alias("place"),
                         F.expr("shiftleft(cast(start as long), 32) | end").alias("span"))
    again = (packed.join(firsts, ["h1", "h2"]).filter("row != first_row OR shiftright(place, 32) != first_at")
             .select("row", "doc_id", "place", "span", "first_doc_id").distinct()
             .withColumns({"at": F.expr("int(shiftright(place, 32))"), "size": F.expr("int(place & 4294967295)"),
                           "start": F.expr("int(shiftright(span, 32))"), "end": F.expr("int(span & 4294967295)")}))
    before = Window.partitionBy("row").orderBy("at", "size", "start", "end", "first_doc_id")
    reach = F.max(F.col("at") + F.col("size")).over(before.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce((F.col("at") > reach).cast("int"), F.lit(1))
    stretches = again.withColumn("fresh", fresh).withColumn("stretch", F.sum("fresh").over(before))
    return stretches.groupBy("row", "stretch").agg(
        F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.max("end").alias("end"),
        (F.max(F.col("at") + F.col("size")) - F.min("at")).cast("long").alias("n_sentences"),
        F.min(F.struct("at", "first_doc_id"))["first_doc_id"].alias("first_doc_id")).drop("stretch")


def repeated_spans(docs: DataFrame, run: int = RUN, least: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, start, end, n_sentences, first_doc_id): the stretches of sentences to remove, in code points, end exclusive;
    first_doc_id has the first occurrence of the stretch's first run."""
    require(docs, "doc_id", "text")
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return spans_by_row(stored(sentence_runs(numbered, run, least), "sentence-runs")).drop("row")


def without_repeats(docs: DataFrame, run: int = RUN, least: int = LEAST_WORDS) -> DataFrame:
    """`docs` without the repeated sentences and the white space after them."""
    spans, number, owner = (free_name(docs, name) for name in ("_spans", "_row", "_owner"))
    numbered = stored(docs.withColumn(number, F.monotonically_increasing_id()), "numbered-texts")
    runs = stored(sentence_runs(numbered.select(F.col(number).alias("row"), "doc_id", "text"), run, least), "sentence-runs")
    found = spans_by_row(runs).groupBy(F.col("row").alias(owner)).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(spans))
    joined = numbered.join(found, F.col(number) == F.col(owner), "left").drop(owner, number)
    at, names = docs.columns.index("text"), docs.columns

    def cut(batches):
        for batch in batches:
            texts = []
            for text, gone in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist()):
                if gone:
                    kept, begin = [], 0
                    for span in gone:
                        kept.append(text[begin:span["start"]])
                        begin = _SPACE.match(text, span["end"]).end()
                    text = "".join([*kept, text[begin:]])
                texts.append(text)
            columns = list(batch.columns[:len(names)])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(cut, ddl_of(docs))
