"""A minimal perfect hash over distinct 128-bit digests, in NumPy: level by level, every key that falls alone
into its place of a bit array keeps it, the others go on to the next level; a key's slot is the rank
of its place. Slots hold their digest, so a foreign key is told apart."""
from __future__ import annotations

import numpy as np

from .shingles import mix

_GROW = 2       # places for each key of a level


class PerfectHash:
    """Slots 0 .. n-1 for ``n`` distinct keys (hi, lo)."""

    def __init__(self, hi: np.ndarray, lo: np.ndarray):
        hi, lo = hi.view(np.uint64), lo.view(np.uint64)
        self.levels = []        # (places, rank of each taken place or -1)
        left, taken = np.arange(len(hi)), 0
        while len(left):
            if len(self.levels) > 64:       # half the keys at least leave a level; equal ones never do
                raise ValueError("keys are not distinct")
            size = _GROW * len(left)
            at = self._place(hi[left], lo[left], len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            rank = np.where(alone, taken + np.cumsum(alone) - 1, -1)
            self.levels.append(rank)
            taken += int(alone.sum())
            left = left[~alone[at]]
        self.hi, self.lo = np.zeros(len(hi), np.uint64), np.zeros(len(hi), np.uint64)
        slot = self._slots(hi, lo)
        self.hi[slot], self.lo[slot] = hi, lo
        if ((self.hi[slot] != hi) | (self.lo[slot] != lo)).any():
            raise ValueError("two digests share a slot")

    @staticmethod
    def _place(hi: np.ndarray, lo: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix(hi ^ mix(lo + np.uint64(level))) % np.uint64(size)).astype(np.int64)

    def _slots(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        out = np.full(len(hi), -1, np.int64)
        left = np.arange(len(hi))
        for level, rank in enumerate(self.levels):
            got = rank[self._place(hi[left], lo[left], level, len(rank))]
            out[left] = got
            left = left[got < 0]
        return out

    def find(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Slots of the keys, -1 for keys that are not in the table."""
        hi, lo = hi.view(np.uint64), lo.view(np.uint64)
        slot = self._slots(hi, lo)
        if len(self.hi):
            slot[(self.hi[slot] != hi) | (self.lo[slot] != lo)] = -1
        return slot
