"""Word shingles of whole texts as sorted arrays of distinct 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


class Words(dict):
    """Hash of each word seen, kept while there are at most ``most``."""

    most = 1 << 18

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * _C
    h = h ^ (h >> np.uint64(29))
    h = h * _B
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None, words: Words, size: int = 3) -> np.ndarray:
    """Distinct ``size``-word shingles, A-Z lower-cased, words cut at ASCII blanks; a shorter text is one shingle of all its words."""
    found = text.encode("utf-8", "replace").lower().split() if text else []
    if not found:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(words.__getitem__, found), dtype=np.uint64, count=len(found))
    size = min(size, len(h))
    out = np.full(len(h) - size + 1, size, dtype=np.uint64)
    for i in range(size):
        out = mix(out * _A + h[i : len(h) - size + 1 + i])
    return np.unique(out)
