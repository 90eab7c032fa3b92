"""Hashes of words and of runs of words, whole texts at a time in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

from pricelake.llm import memory

#: Words a worker remembers at most; beyond that it starts anew.
REMEMBERED = 400_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


class WordHashes(dict):
    """word -> 64-bit hash, the same in every process."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def forget(self) -> None:
        self.clear()


_known = WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    memory.use(_known)
    return np.fromiter(map(_known.__getitem__, words), dtype=np.uint64, count=len(words))


_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def _up_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 1 << 16)
        _powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE)]), dtype=np.uint64)
        _inverses = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _INVERSE)]), dtype=np.uint64)
    return _powers[:n], _inverses[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads all bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def rolling(words: np.ndarray, width: int) -> np.ndarray:
    """The hash of every run of width words, by its first word's position."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    powers, inverses = _up_to(len(words))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(words * powers, dtype=np.uint64)])
    return mixed((sums[width:] - sums[:n]) * inverses[:n])
