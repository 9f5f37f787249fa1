"""Distinct word shingles of a text as sorted 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

_MUL = np.uint64(0x9FB21C651E98DF25)
#: Words whose hashes a task keeps: about 15 MB.
_CACHE_WORDS = 100_000


class Shingler:
    """Words are runs without ASCII white space, A-Z lower-cased."""

    def __init__(self, words: int):
        self.words, self._known = words, {}

    def _word(self, word: bytes) -> int:
        if len(self._known) >= _CACHE_WORDS:
            self._known.clear()
        h = self._known[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def __call__(self, text: bytes | None) -> np.ndarray:
        """The set; fewer words than a shingle are one shingle, no words are an empty set."""
        tokens = (text or b"").lower().split()
        if not tokens:
            return np.zeros(0, np.uint64)
        get, word = self._known.get, self._word
        h = np.fromiter((get(t) or word(t) for t in tokens), np.uint64, len(tokens))
        size = min(self.words, len(tokens))
        n = len(tokens) - size + 1
        out = np.full(n, size, np.uint64)
        with np.errstate(over="ignore"):
            for j in range(size):
                out = (out ^ h[j : j + n]) * _MUL
                out ^= out >> np.uint64(29)
            out *= _MUL
            out ^= out >> np.uint64(32)
        return np.unique(out)
