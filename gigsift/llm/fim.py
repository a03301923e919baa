"""Fill-in-middle transformation: a text is cut into prefix, middle and suffix between units, and put together in another order.

A unit is a run of ASCII letters or any other single code point. Two cuts are drawn from a digest of the doc_id; the text then reads
plain, `<P>`prefix`<S>`suffix`<M>`middle (psm) or `<S>`suffix`<P>`prefix`<M>`middle (spm).

The UTF-8 bytes of a text are taken in blocks of BLOCK. Of each block the units and code points that begin in it are counted, and the
counts stand in two Fenwick trees. A cut after k units is found by descending the tree in powers of two to the block in which unit k + 1
begins; the code points before that block come from the other tree along the same path, and only that block is looked at again.

Defined results: null and empty texts, and texts that hold a marker, stay plain; a null doc_id is drawn as if it were empty text; rows of
one doc_id are cut each on their own, by the same digest; columns of the names added are replaced, others stay.
Memory: an Arrow batch and its results, 16 bytes per block of the text at hand, and masks of STEP bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import ddl_of, require, utf8

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, PLAIN_FROM, SPM_BELOW = "1:", 90, 20
BLOCK, STEP = 256, 1 << 22
ADDED = {"output": "string", "form": "string", "n": "bigint", "prefix_chars": "bigint", "middle_chars": "bigint"}
_KINDS = (pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.int64())
_MARKS = tuple(mark.encode() for mark in (PREFIX, SUFFIX, MIDDLE))


def _begins(part: np.ndarray, after_letter: bool) -> tuple[np.ndarray, np.ndarray]:
    """Where units and where code points begin in a stretch of UTF-8 bytes."""
    letter = ((part | 0x20) - np.uint8(97)) < 26
    points = (part & 0xC0) != 0x80
    inside = np.empty_like(letter)
    inside[:1] = after_letter
    inside[1:] = letter[:-1]
    return points & ~(letter & inside), points


class Fenwick:
    """Counts per block, added up along binary-indexed trees of units and of code points."""

    def __init__(self, units: np.ndarray, points: np.ndarray):
        self.size = 1 << max(0, int(len(units) - 1).bit_length())
        self.trees = []
        for counts in (units, points):
            tree = np.zeros(self.size + 1, dtype=np.int64)
            tree[1:len(counts) + 1] = counts
            step = 1
            while step < self.size:  # node i holds the sum of the last (i and -i) blocks
                tree[2 * step::2 * step] += tree[step:self.size + 1 - step:2 * step]
                step *= 2
            self.trees.append(tree)

    def descend(self, k: int) -> tuple[int, int, int]:
        """(block, units before it, code points before it) for the block in which unit k + 1 begins."""
        units, points = self.trees
        at = before = chars = 0
        step = self.size
        while step:
            if at + step <= self.size and before + units[at + step] <= k:
                at += step
                before += int(units[at])
                chars += int(points[at])
            step //= 2
        return at, before, chars


class Text:
    """A text of which cuts can be asked for."""

    def __init__(self, text: bytes, block: int = BLOCK, step: int = STEP):
        self.bytes, self.block = np.frombuffer(text, dtype=np.uint8), block
        sums = []
        for begin in range(0, len(text), step):  # step is a multiple of block
            part = self.bytes[begin:begin + step]
            edges = np.arange(0, len(part), block)
            sums.append([np.add.reduceat(mask, edges, dtype=np.int64) for mask in _begins(part, self._after_letter(begin))])
        units, points = (np.concatenate(parts) for parts in zip(*sums)) if sums else (np.zeros(1, dtype=np.int64),) * 2
        self.tree, self.n, self.chars = Fenwick(units, points), int(units.sum()), int(points.sum())

    def _after_letter(self, at: int) -> bool:
        return at > 0 and 0 <= int(self.bytes[at - 1] | 0x20) - 97 < 26

    def cut(self, k: int) -> tuple[int, int]:
        """(bytes, code points) before unit k + 1, or of the whole text after its last unit."""
        if k >= self.n:
            return len(self.bytes), self.chars
        block, before, chars = self.tree.descend(k)
        begin = block * self.block
        units, points = _begins(self.bytes[begin:begin + self.block], self._after_letter(begin))
        at = int(np.flatnonzero(units)[k - before])
        return begin + at, chars + int(np.count_nonzero(points[:at]))


def draws(doc_id: int | None) -> list[int]:
    """The first four groups of eight digits of the digest of a doc_id."""
    digest = hashlib.sha256(f"{SEED}{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[at:at + 8], 16) for at in (0, 8, 16, 24)]


def transform(text: bytes, doc_id: int | None) -> tuple:
    """(output, form, units, code points of the prefix, of the middle) of one text."""
    laid = Text(text)
    first, second, kind, order = draws(doc_id)
    if not text or kind % 100 >= PLAIN_FROM or any(mark in text for mark in _MARKS):
        return text, "plain", laid.n, None, None
    low, high = sorted((first % (laid.n + 1), second % (laid.n + 1)))
    (a, a_chars), (b, b_chars) = laid.cut(low), laid.cut(high)
    prefix, middle, suffix = (_MARKS[0], text[:a]), (_MARKS[2], text[a:b]), (_MARKS[1], text[b:])
    spm = order % 100 < SPM_BELOW
    parts = (suffix, prefix, middle) if spm else (prefix, suffix, middle)
    return b"".join(piece for part in parts for piece in part), "spm" if spm else "psm", laid.n, a_chars, b_chars - a_chars


def fill_in_middle(docs: DataFrame) -> DataFrame:
    """`docs` and the columns output, form, n, prefix_chars and middle_chars of each row."""
    require(docs, "doc_id", "text")
    base = docs.drop(*ADDED)
    names, at, by = base.columns, base.columns.index("text"), base.columns.index("doc_id")

    def run(batches):
        for batch in batches:
            rows = [transform(text, doc_id) for text, doc_id in zip(utf8(batch.column(at)), batch.column(by).to_pylist())]
            made = [pa.array([row[k] for row in rows], kind) for k, kind in enumerate(_KINDS)]
            made[0] = made[0].cast(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*names, *ADDED])

    return base.mapInArrow(run, ", ".join([ddl_of(base), *(f"`{name}` {kind}" for name, kind in ADDED.items())]))


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output was made of. Texts with markers are plain, so the first marker of each kind is the one set."""
    whole = F.col(output)
    past = lambda text, head, mark: F.substring(text, F.length(head) + F.lit(len(mark) + 1), F.length(text))
    body = F.substring(whole, F.lit(len(PREFIX) + 1), F.length(whole))

    def apart(mark: str) -> tuple[Column, Column, Column]:
        first = F.substring_index(body, mark, 1)
        rest = past(body, first, mark)
        second = F.substring_index(rest, MIDDLE, 1)
        return first, second, past(rest, second, MIDDLE)

    (prefix, suffix, middle), (suffix_first, prefix_second, middle_last) = apart(SUFFIX), apart(PREFIX)
    return (F.when(F.col(form) == "psm", F.concat(prefix, middle, suffix))
            .when(F.col(form) == "spm", F.concat(prefix_second, middle_last, suffix_first)).otherwise(whole))
