"""A minimal perfect hash over 128-bit digests, in flat numpy arrays."""

from __future__ import annotations

import numpy as np


def _mix(keys: np.ndarray, level: int) -> np.ndarray:
    """One 64-bit hash for each row of an ``(n, columns)`` array of unsigned longs; another family for each level."""
    h = np.full(len(keys), (0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for column in keys.T:
        h = (h ^ column) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(32)
    return h


class SlotTable:
    """Slots ``0 .. n-1`` for ``n`` distinct keys.

    Each level hashes the keys left over into a bit array twice their number; a key alone at its bit is placed
    there and its slot is the rank of the bit, the others go on to the next level.  The keys lie in slot order, and
    every lookup compares its key with the one at the slot, so that a key outside the table is never mistaken for
    one inside.
    """

    def __init__(self, keys: np.ndarray, room: float = 2.0):
        keys = np.ascontiguousarray(keys, np.uint64)
        self.keys = np.empty_like(keys)
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        left, base = keys, 0
        while len(left):
            bits = max(64, int(room * len(left)))
            at = (_mix(left, len(self.levels)) % np.uint64(bits)).astype(np.int64)
            alone = np.bincount(at, minlength=bits) == 1
            rank = np.cumsum(alone) - 1
            placed = alone[at]
            self.keys[base + rank[at[placed]]] = left[placed]
            self.levels.append((alone, rank, base))
            base += int(placed.sum())
            left = left[~placed]
            if len(self.levels) > 100:
                raise ValueError("keys of a slot table must be distinct")

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of every key, -1 for a key that the table does not hold."""
        keys = np.ascontiguousarray(keys, np.uint64)
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for k, (alone, rank, base) in enumerate(self.levels):
            at = (_mix(keys[left], k) % np.uint64(len(alone))).astype(np.int64)
            hit = alone[at]
            out[left[hit]] = base + rank[at[hit]]
            left = left[~hit]
        found = np.flatnonzero(out >= 0)
        out[found[(self.keys[out[found]] != keys[found]).any(axis=1)]] = -1
        return out
