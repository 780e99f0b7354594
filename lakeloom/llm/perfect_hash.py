"""A minimal perfect hash over 128-bit digests, in numpy.

Level by level the keys fall on a bit array half as long again as they are many; a key
alone on its bit is placed there, the others go to the next level. A key's slot is the
number of set bits before its own. Looking a digest up compares it with the one stored
in the slot, so a strange digest is told from the keys."""

from __future__ import annotations

import numpy as np

from .textbytes import mix64

_U = np.uint64
ROOM = 1.5
LEVELS = 64


def _spot(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    seed = _U(level * 0x9E3779B97F4A7C15 % (1 << 64))
    return (mix64(a + mix64(b + seed)) % _U(size)).astype(np.int64)


class SlotTable:
    """Slots 0 to n - 1 of n distinct digests (a, b)."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.levels: list[np.ndarray] = []  # rank of every bit among all set ones, or -1
        left, placed = np.arange(len(a)), 0
        slots = np.empty(len(a), np.int64)
        while len(left):
            if len(self.levels) == LEVELS:
                raise ValueError("equal digests have no slots of their own")
            size = int(len(left) * ROOM) + 1
            spot = _spot(a[left], b[left], len(self.levels), size)
            alone = np.bincount(spot, minlength=size) == 1
            rank = np.where(alone, placed + np.cumsum(alone) - 1, -1)
            self.levels.append(rank)
            done = alone[spot]
            slots[left[done]] = rank[spot[done]]
            placed += int(done.sum())
            left = left[~done]
        self.slots = slots
        self.a, self.b = np.empty(len(a), _U), np.empty(len(a), _U)
        self.a[slots], self.b[slots] = a, b

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of every digest, -1 where it is none of the keys."""
        out = np.full(len(a), -1)
        left = np.arange(len(a))
        for level, rank in enumerate(self.levels):
            at = rank[_spot(a[left], b[left], level, len(rank))]
            out[left[at >= 0]] = at[at >= 0]
            left = left[at < 0]
        known = out >= 0
        known[known] = (self.a[out[known]] == a[known]) & (self.b[out[known]] == b[known])
        return np.where(known, out, -1)
