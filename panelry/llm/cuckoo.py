"""A cuckoo filter over 128-bit keys, worked on by whole arrays of keys."""

from __future__ import annotations

import numpy as np

SLOTS, ROUNDS, EMPTY = 4, 200, 0


def halves(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of 16 bytes as two unsigned numbers each."""
    pairs = np.frombuffer(keys, "<u8").reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; what finds no place is kept in a stash of pairs.

    A key lies in one of two buckets that its fingerprint leads between, so it can be taken out
    again without the others' keys.  Every key must be added once and removed once.
    """

    def __init__(self, buckets: int, slots: bytes = b"", stash: bytes = b""):
        self.mask = np.uint64(buckets - 1)
        self.slots = (np.frombuffer(slots, "<u2").copy() if slots else np.zeros(buckets * SLOTS, "<u2")).reshape(-1, SLOTS)
        self.stash = np.frombuffer(stash, "<u4").reshape(-1, 2).copy() if stash else np.zeros((0, 2), "<u4")

    def placed(self, keys: bytes) -> tuple[np.ndarray, np.ndarray]:
        """First bucket and fingerprint of each key."""
        low, high = halves(keys)
        return (low & self.mask).astype(np.int64), (high % np.uint64(65535) + np.uint64(1)).astype("<u2")

    def other(self, bucket: np.ndarray, print_: np.ndarray) -> np.ndarray:
        step = print_.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)
        return bucket ^ (step & self.mask).astype(np.int64)

    def contains(self, keys: bytes) -> np.ndarray:
        bucket, print_ = self.placed(keys)
        there = self.other(bucket, print_)
        found = (self.slots[bucket] == print_[:, None]).any(1) | (self.slots[there] == print_[:, None]).any(1)
        if len(self.stash):
            first = self.stashed(np.minimum(bucket, there), print_)
            found |= np.isin(first, self.stashed(self.stash[:, 0], self.stash[:, 1]))
        return found

    @staticmethod
    def stashed(bucket: np.ndarray, print_: np.ndarray) -> np.ndarray:
        return bucket.astype(np.int64) << 16 | print_.astype(np.int64)

    def add(self, keys: bytes, seed: int = 5) -> None:
        bucket, print_ = self.placed(keys)
        random = np.random.default_rng(seed)
        for turn in range(ROUNDS):
            if not len(bucket):
                return
            order = np.argsort(bucket, kind="stable")
            bucket, print_ = bucket[order], print_[order]
            rank = np.arange(len(bucket)) - np.searchsorted(bucket, bucket)
            taken = self.slots[bucket] != EMPTY
            fits = rank < SLOTS - taken.sum(1)
            free = np.argsort(taken[fits], axis=1, kind="stable")
            self.slots[bucket[fits], free[np.arange(len(free)), rank[fits]]] = print_[fits]
            bucket, print_, rank = bucket[~fits], print_[~fits], rank[~fits]
            if not turn:
                bucket = self.other(bucket, print_)
                continue
            # full: the first of each bucket drives one of its fingerprints to that one's other bucket
            _, one = np.unique(bucket, return_index=True)
            at = random.integers(0, SLOTS, len(one))
            driven = self.slots[bucket[one], at].copy()
            self.slots[bucket[one], at] = print_[one]
            print_ = print_.copy()
            print_[one] = driven
            bucket = bucket.copy()
            bucket[one] = self.other(bucket[one], driven)
        first = np.minimum(bucket, self.other(bucket, print_))
        self.stash = np.concatenate([self.stash, np.stack([first, print_], 1).astype("<u4")])

    def remove(self, keys: bytes) -> None:
        """Take one copy of each key's fingerprint out; the keys must have been added."""
        bucket, print_ = self.placed(keys)
        while len(bucket):
            there = self.other(bucket, print_)
            cells = np.concatenate([self.slots[bucket], self.slots[there]], 1) == print_[:, None]
            column = cells.argmax(1)
            held = cells.any(1)
            row = np.where(column < SLOTS, bucket, there)
            flat = row * SLOTS + column % SLOTS
            _, one = np.unique(np.where(held, flat, -1 - np.arange(len(flat))), return_index=True)
            self.slots.reshape(-1)[flat[one][held[one]]] = EMPTY
            stashed = one[~held[one]]
            if len(stashed):
                first = self.stashed(np.minimum(bucket, there), print_)[stashed]
                known = self.stashed(self.stash[:, 0], self.stash[:, 1]).tolist()
                for pair in first.tolist():
                    known.remove(pair)
                known = np.array(known, np.int64)
                self.stash = np.stack([known >> 16, known & 0xFFFF], 1).astype("<u4").reshape(-1, 2)
            rest = np.ones(len(bucket), bool)
            rest[one] = False
            bucket, print_ = bucket[rest], print_[rest]
