"""Words of texts as hashes, for operators on word windows and shingles."""

from __future__ import annotations

import numpy as np
import xxhash

#: Odd multipliers of the two rolling hashes, and of the finishing mix.
M1, M2, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)


class WordHashes(dict):
    """Hash of each word (bytes); emptied when it has grown to ``limit`` words."""

    def __init__(self, limit: int = 200_000):
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.limit:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def rolling(hashes: np.ndarray, n: int, multiplier=M1) -> np.ndarray:
    """Hash of every run of n words (modulo 2**64, then mixed)."""
    if len(hashes) < n:
        return np.empty(0, dtype=np.uint64)
    out = hashes[: len(hashes) - n + 1].copy()
    for k in range(1, n):
        out *= multiplier
        out += hashes[k : len(hashes) - n + 1 + k]
    out ^= out >> np.uint64(32)
    out *= MIX
    out ^= out >> np.uint64(29)
    return out
