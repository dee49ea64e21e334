"""Words as numbers and hashes, remembered per task."""

from __future__ import annotations

import itertools

import numpy as np
import xxhash

# Distinct words a task remembers.
VOCABULARY = 1_000_000


class _Numbering(dict):
    """Numbers a key the first time it is asked for."""

    def __missing__(self, key: bytes) -> int:
        n = self[key] = len(self)
        return n


class Words:
    """Numbers for words, and a hash of each; a number holds within one text."""

    def __init__(self):
        self._reset()

    def _reset(self):
        self.number = _Numbering()
        self.hashes = np.zeros(1 << 16, np.uint64)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        if len(self.number) > VOCABULARY:
            self._reset()
        number = self.number
        start = len(number)
        out = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        if len(number) > start:
            if len(number) > len(self.hashes):
                self.hashes = np.resize(self.hashes, 2 * len(number))
            fresh = itertools.islice(reversed(number), len(number) - start)  # the latest first
            self.hashes[start : len(number)] = [xxhash.xxh3_64_intdigest(w) for w in fresh][::-1]
        return out
