"""Words of texts as numbers, for the operators that hash runs of words in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

# Distinct words remembered in a Python worker, before the memory is emptied.
REMEMBERED = 250_000
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_BITS = 64


def _inverse(odd: np.uint64) -> np.uint64:
    return np.uint64(pow(int(odd), -1, 1 << _BITS))


def mixed(h: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit numbers in which every input bit moves every output bit."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class WordNumbers:
    """128-bit numbers of words, as two columns of 64 bits."""

    def __init__(self):
        self.place: dict[bytes, int] = {}
        self.table = np.zeros((0, 2), np.uint64)

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self.place) > REMEMBERED:
            self.place.clear()
            self.table = self.table[:0]
        new = set(words).difference(self.place)
        if new:
            digests = b"".join(map(xxhash.xxh3_128_digest, new))
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
            self.table = np.concatenate([self.table, np.frombuffer(digests, np.uint64).reshape(-1, 2)])
        return self.table[np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))]


def runs(numbers: np.ndarray, width: int, lane: int) -> np.ndarray:
    """A 64-bit hash of every run of ``width`` numbers, by position of its first (modulo-2^64 polynomials)."""
    base = _BASES[lane]
    n = len(numbers)
    if n < width:
        return np.zeros(0, np.uint64)
    powers = np.cumprod(np.full(n, base, np.uint64))
    back = np.cumprod(np.full(n - width + 1, _inverse(base), np.uint64))
    sums = np.append(np.uint64(0), np.cumsum(numbers * powers, dtype=np.uint64))
    return mixed((sums[width:] - sums[:-width]) * back)
