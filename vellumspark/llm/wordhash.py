"""Word and window hashes for whole texts, vectorised per batch inside Spark tasks."""

from __future__ import annotations

import numpy as np
import xxhash

# The odd multiplier of the rolling hash, and A-Z to a-z as a byte table.
BASE = np.uint64(0x9E3779B97F4A7C15)
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


class WordHashes(dict):
    """64-bit hash of a word's bytes; keeps the words seen, up to a bound."""

    room = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.room:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


WORDS = WordHashes()


def rolling(h: np.ndarray, size: int) -> np.ndarray:
    """Rabin-Karp value, modulo 2^64, of every run of `size` consecutive hashes."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, size):
        out *= BASE
        out += h[j : n + j]
    return out
