"""Texts as arrays of code points, and hashes of runs of them.

A rolling hash is a difference of prefix sums: with an odd M, sum(c[j] * M^-j) over a run, times
M^end, is the same wherever the run stands. So a hash of any length costs one subtraction and one
product for each position, however long the run.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

M = 0x9E3779B97F4A7C15
_INVERSE = pow(M, -1, 1 << 64)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


@lru_cache(4)
def _powers(exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """M^k and M^-k for k below 2^exponent."""
    out = []
    for base in (M, _INVERSE):
        powers = np.ones(1, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(exponent):
                powers = np.concatenate([powers, powers * np.uint64(pow(base, 1 << k, 1 << 64))])
        out.append(powers)
    return out[0], out[1]


class Runs:
    """Hashes of runs of an array of codes."""

    def __init__(self, codes: np.ndarray) -> None:
        self.up, down = _powers(max(4, (len(codes) + 1).bit_length()))
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * down[: len(codes)], dtype=np.uint64)])
        self.after = self.sums[1:]

    def hashes(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The hash of the codes from `first` to `last`, both included."""
        with np.errstate(over="ignore"):
            out = self.after.take(last)
            out -= self.sums.take(first)
            out *= self.up.take(last)
        return out
