"""Hashes of sliding windows over concatenated sequences, with NumPy."""

from __future__ import annotations

import numpy as np
import xxhash

BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


class Hashes(dict):
    """Word to 64-bit hash; so many are kept for the next texts."""

    KEPT = 200_000

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.KEPT and len(word) < 64:
            self[word] = h
        return h


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def grams(h: np.ndarray, size: int, base: np.uint64) -> np.ndarray:
    """Polynomial hash of each run of `size` entries, by doubling."""
    if len(h) < size:
        return h[:0]
    done, out, power, step, width = 0, None, base, h, 1
    while True:
        if size & width:
            n = len(h) - (done + width) + 1
            if out is None:
                out = step[:n]
            else:
                out = out[:n] * power + step[done : done + n]
            done += width
        if done == size:
            return out
        n = len(step) - width
        step, width = step[:n] * power + step[width : width + n], width * 2
        with np.errstate(over="ignore"):
            power = power * power


def sliding(f: np.ufunc, x: np.ndarray, size: int) -> np.ndarray:
    """Minimum or maximum over each run of `size` entries."""
    width = 1
    while 2 * width <= size:
        x = f(x[:-width] if width else x, x[width:])
        width *= 2
    rest = size - width
    return f(x[: len(x) - rest], x[rest:]) if rest else x
