"""Hashes of all parts of a text from one running sum: a part's hash is the difference of two sums, moved to a common place."""

from __future__ import annotations

import numpy as np

#: Odd multipliers of two independent hashes.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


class Rolling:
    """Sums of table[byte] * base**place modulo 2**64, for texts of any length."""

    def __init__(self, base: int = BASES[0]):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.table = np.random.Generator(np.random.PCG64(base)).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        self.up = self.down = np.ones(1, np.uint64)
        self._grow(1 << 12)

    def _grow(self, n: int) -> None:
        n = max(n, 2 * len(self.up))
        for name, step in (("up", self.base), ("down", self.inverse)):
            powers = np.full(n, step, np.uint64)
            powers[0] = 1
            setattr(self, name, np.multiply.accumulate(powers))

    def sums(self, data: np.ndarray) -> np.ndarray:
        """Sum before each place and after the last, of an array of bytes."""
        n = len(data)
        if n + 1 > len(self.up):
            self._grow(n + 1)
        out = np.zeros(n + 1, np.uint64)
        np.cumsum(self.table[data] * self.up[:n], out=out[1:])
        return out

    def parts(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of data[start:end]."""
        return (sums[end] - sums[start]) * self.down[start]
