"""Rolling hashes by prefix sums modulo 2^64.

Powers of an odd base are invertible there, so the hash of any run of codes is
read off two prefix sums, without rolling through the ones before it.
"""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
STEP = 1 << 18
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2^64, up to the n-th at least."""
    if len(_powers[0]) < n:
        size = -(-n // STEP) * STEP  # no doubling: the powers stay in a worker as long as it lives
        for i, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            run = np.full(size, base, dtype=np.uint64)
            run[0] = 1
            _powers[i] = np.cumprod(run)
    return _powers[0], _powers[1]


def mixed(h: np.ndarray) -> np.ndarray:
    """Well-spread bits; changes ``h`` in place."""
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


class Rolling:
    """Hashes of runs of ``codes`` at any places."""

    def __init__(self, codes: np.ndarray) -> None:
        n = len(codes)
        up, self.down = powers_to(n + 1)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        run = codes.astype(np.uint64)
        run += np.uint64(1)
        run *= up[:n]
        np.cumsum(run, out=self.sums[1:])

    def at(self, places: np.ndarray, k: int) -> np.ndarray:
        """A mixed hash of the k codes from each place on."""
        h = self.sums[places + k]
        h -= self.sums[places]
        h *= self.down[places]
        return mixed(h)

    def everywhere(self, k: int) -> np.ndarray:
        """The hashes of all runs of k codes."""
        h = self.sums[k:] - self.sums[:-k]
        h *= self.down[: len(h)]
        return mixed(h)
