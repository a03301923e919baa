"""A cuckoo filter over 16-byte keys which takes insertions and deletions."""

from __future__ import annotations

import struct

import numpy as np

from .common import mix

SLOTS, MAX_KICKS, LOAD = 4, 200, 0.85


class CuckooFilter:
    """Two candidate buckets of four 16-bit fingerprints per key; keys that find no place are kept in a small stash, so that
    no insertion is lost. A key may be deleted as often as it was inserted."""

    def __init__(self, table: np.ndarray, stash: list[tuple[int, int]] | None = None):
        self.table, self.stash = table, stash or []

    @classmethod
    def for_items(cls, items: int) -> CuckooFilter:
        buckets = 1
        while buckets * SLOTS * LOAD < items:
            buckets *= 2
        return cls(np.zeros((buckets, SLOTS), dtype=np.uint16))

    def to_bytes(self) -> bytes:
        head = struct.pack("<II", len(self.table), len(self.stash))
        return head + self.table.tobytes() + b"".join(struct.pack("<QH", bucket, mark) for bucket, mark in self.stash)

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        buckets, kept = struct.unpack_from("<II", data)
        end = 8 + buckets * SLOTS * 2
        table = np.frombuffer(data[8:end], dtype=np.uint16).reshape(buckets, SLOTS).copy()
        return cls(table, [struct.unpack_from("<QH", data, end + 10 * i) for i in range(kept)])

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint and both buckets of keys given as an (n, 2) array of uint64."""
        marks = ((mix(keys[:, 0]) >> np.uint64(48)).astype(np.uint16) | np.uint16(1))
        mask = np.uint64(len(self.table) - 1)
        first = mix(keys[:, 1]) & mask
        return marks, first, first ^ (mix(marks.astype(np.uint64)) & mask)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        marks, first, second = self.places(keys)
        found = (self.table[first] == marks[:, None]).any(axis=1) | (self.table[second] == marks[:, None]).any(axis=1)
        for bucket, mark in self.stash:
            found |= (marks == mark) & ((first == bucket) | (second == bucket))
        return found

    def insert(self, keys: np.ndarray) -> None:
        mask = len(self.table) - 1
        jump = {}
        for mark, first, second in zip(*(part.tolist() for part in self.places(keys))):
            for bucket in (first, second):
                row = self.table[bucket]
                free = np.flatnonzero(row == 0)
                if len(free):
                    row[free[0]] = mark
                    break
            else:
                bucket = second
                for step in range(MAX_KICKS):
                    slot = (mark + step) % SLOTS
                    mark, self.table[bucket, slot] = int(self.table[bucket, slot]), mark
                    if mark not in jump:
                        jump[mark] = int(mix(np.array([mark], dtype=np.uint64))[0]) & mask
                    bucket ^= jump[mark]
                    free = np.flatnonzero(self.table[bucket] == 0)
                    if len(free):
                        self.table[bucket, free[0]] = mark
                        break
                else:
                    self.stash.append((bucket, mark))

    def delete(self, keys: np.ndarray) -> None:
        for mark, first, second in zip(*(part.tolist() for part in self.places(keys))):
            entry = next((e for e in ((first, mark), (second, mark)) if e in self.stash), None)
            if entry:
                self.stash.remove(entry)
                continue
            for bucket in (first, second):
                slots = np.flatnonzero(self.table[bucket] == mark)
                if len(slots):
                    self.table[bucket, slots[0]] = 0
                    break
