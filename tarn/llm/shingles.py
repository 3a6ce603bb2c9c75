"""Word shingle sets as sorted 64-bit hashes, computed a document at a time inside Python workers."""

from __future__ import annotations

import numpy as np
import xxhash

_A, _B = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_33 = np.uint64(33)
WORDS_KEPT = 150_000  # hashes of words that a worker keeps: some 30 MB


def mixed(x: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of MurmurHash3."""
    x = (x ^ (x >> _33)) * _A
    x = (x ^ (x >> _33)) * _B
    return x ^ (x >> _33)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


class Shingler:
    """text -> sorted distinct hashes of its shingles of ``width`` words.

    A-Z become lower case and words are split at the ASCII white space characters, which is what methods of bytes do.
    A text with fewer words is one shingle of all its words; a text without words has none.
    """

    def __init__(self, width: int):
        self.width, self.look = width, _Words().__getitem__

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        h = mixed(np.fromiter(map(self.look, words), np.uint64, len(words)))
        k = min(self.width, len(words))
        out = np.full(len(words) - k + 1, k, np.uint64)
        for i in range(k):
            out = mixed(out * _STEP + h[i : len(words) - k + 1 + i])
        return np.unique(out)
