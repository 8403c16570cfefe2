"""Polynomial hashes of byte strings, vectorised over positions."""

from __future__ import annotations

import numpy as np


class Roller:
    """Polynomial hashes of all strings of a given length in a byte array."""

    BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self, size: int):
        powers = np.full(size + 1, self.BASE, dtype=np.uint64)
        powers[0] = 1
        inverse = np.full(size + 1, pow(self.BASE, -1, 1 << 64), dtype=np.uint64)
        inverse[0] = 1
        self.up, self.down = np.multiply.accumulate(powers), np.multiply.accumulate(inverse)

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=out[1:])
        return out

    def hashes(self, sums: np.ndarray, at: np.ndarray | slice, width: int | np.ndarray) -> np.ndarray:
        if isinstance(at, slice):
            n = len(sums) - width
            h = (sums[width:] - sums[:n]) * self.down[:n]
        else:
            h = (sums[at + width] - sums[at]) * self.down[at]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        return h | np.uint64(1)
