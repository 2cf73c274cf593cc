"""A cuckoo filter in numpy whose inserts, lookups and deletions go by whole batches.

A key's 64-bit hash gives a 16-bit fingerprint and two buckets of four slots;
either bucket follows from the other and the fingerprint. Keys that find no slot
after ``MAX_TURNS`` rounds of moves go to a short list beside the slots, so a
lookup never misses a key that is in. Keys that share fingerprint and buckets
have a slot each, so deleting one leaves the other.
"""

from __future__ import annotations

import numpy as np

SLOTS = 4
MAX_TURNS = 400
LOAD = 0.85


class CuckooFilter:
    def __init__(self, capacity: int):
        """Room for ``capacity`` keys at a load of ``LOAD``."""
        buckets = 1
        while buckets * SLOTS * LOAD < capacity:
            buckets *= 2
        self.slots = np.zeros((buckets, SLOTS), np.uint16)
        self.rest = np.zeros((0, 2), np.int64)  # (bucket, fingerprint), the lesser of the two buckets
        self.n = 0

    @property
    def capacity(self) -> int:
        return int(len(self.slots) * SLOTS * LOAD)

    def _other(self, at: np.ndarray, print_: np.ndarray) -> np.ndarray:
        return at ^ (print_.astype(np.int64) * 0x5BD1E995 & len(self.slots) - 1)

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first bucket, fingerprint) of each hash; a fingerprint is never zero."""
        hashes = hashes.astype(np.uint64, copy=False)
        prints = np.maximum(hashes & np.uint64(0xFFFF), np.uint64(1)).astype(np.uint16)
        return (hashes >> np.uint64(16)).astype(np.int64) & len(self.slots) - 1, prints

    def insert(self, hashes: np.ndarray) -> None:
        """Adds keys that aren't in yet."""
        at, prints = self._places(np.sort(hashes))
        self.n += len(prints)
        for turn in range(MAX_TURNS):
            if not len(prints):
                return
            order = np.argsort(at, kind="stable")
            at, prints = at[order], prints[order]
            index = np.arange(len(at))
            first = np.concatenate([[True], at[1:] != at[:-1]])
            rank = index - np.maximum.accumulate(np.where(first, index, 0))
            free = self.slots[at] == 0
            pick = free & (np.cumsum(free, axis=1) == rank[:, None] + 1)
            placed = pick.any(axis=1)
            self.slots[at[placed], pick[placed].argmax(axis=1)] = prints[placed]
            at, prints = at[~placed], prints[~placed]
            if turn == 0:
                at = self._other(at, prints)
            elif len(at):
                # One key of a full bucket takes a slot; what stood there moves to its other bucket.
                swap = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                slot = (prints[swap].astype(np.int64) * 0x9E3779B1 + turn * 0x85EBCA6B >> 7) % SLOTS
                out = self.slots[at[swap], slot]
                self.slots[at[swap], slot] = prints[swap]
                prints[swap] = out
                moved = out > 0
                at[swap[moved]] = self._other(at[swap[moved]], out[moved])
                kept = np.ones(len(at), bool)
                kept[swap[~moved]] = False  # the slot was free after all
                at, prints = at[kept], prints[kept]
        self.rest = np.concatenate([self.rest, self._pairs(at, prints)])

    def _pairs(self, at: np.ndarray, prints: np.ndarray) -> np.ndarray:
        return np.stack([np.minimum(at, self._other(at, prints)), prints.astype(np.int64)], axis=1)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        """True for each key that is in; for others too, with a chance of about 8 in 65536."""
        at, prints = self._places(hashes)
        found = (self.slots[at] == prints[:, None]).any(axis=1)
        found |= (self.slots[self._other(at, prints)] == prints[:, None]).any(axis=1)
        if len(self.rest):
            rest = self.rest[:, 0] << 16 | self.rest[:, 1]
            pairs = self._pairs(at, prints)
            found |= np.isin(pairs[:, 0] << 16 | pairs[:, 1], rest)
        return found

    def delete(self, hashes: np.ndarray) -> None:
        """Takes out keys that are in."""
        at, prints = self._places(hashes)
        pairs = self._pairs(at, prints)
        codes = np.sort(pairs[:, 0] << 16 | pairs[:, 1])
        while len(codes):
            first = np.concatenate([[True], codes[1:] != codes[:-1]])
            now, codes = codes[first], codes[~first]  # equal pairs take turns, one slot each
            at, prints = now >> 16, (now & 0xFFFF).astype(np.uint16)
            for _ in range(2):
                hit = self.slots[at] == prints[:, None]
                has = hit.any(axis=1)
                self.slots[at[has], hit[has].argmax(axis=1)] = 0
                at, prints, now = at[~has], prints[~has], now[~has]
                at = self._other(at, prints)
            for code in now.tolist():
                same = np.flatnonzero((self.rest[:, 0] << 16 | self.rest[:, 1]) == code)
                if not len(same):
                    raise KeyError("a key to delete isn't in the filter")
                self.rest = np.delete(self.rest, same[0], axis=0)
        self.n -= len(hashes)

    def to_bytes(self) -> bytes:
        head = np.array([len(self.slots), len(self.rest), self.n], "<i8")
        return head.tobytes() + self.slots.astype("<u2").tobytes() + self.rest.astype("<i8").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        buckets, rest, n = np.frombuffer(data, "<i8", 3).tolist()
        out = cls(0)
        out.slots = np.frombuffer(data, "<u2", buckets * SLOTS, 24).reshape(buckets, SLOTS).copy()
        out.rest = np.frombuffer(data, "<i8", rest * 2, 24 + buckets * SLOTS * 2).reshape(rest, 2).copy()
        out.n = n
        return out
