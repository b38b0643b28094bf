"""Numpy helpers for hashing words, shingles and occurrences."""

from __future__ import annotations

import numpy as np
import xxhash

U64 = np.uint64
_M1, _M2 = U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53)
_S = U64(33)
# Distinct words kept hashed per task; about 100 MB.
WORD_MEMO = 500_000


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every input bit reaches every output bit."""
    x = (x ^ (x >> _S)) * _M1
    x = (x ^ (x >> _S)) * _M2
    return x ^ (x >> _S)


def constants(n: int, seed: int) -> np.ndarray:
    """`n` fixed odd 64-bit numbers."""
    return mix64(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)) | U64(1)


class WordHashes(dict):
    """Word to 64-bit hash, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_MEMO:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U64, len(words))


def occurrences(x: np.ndarray) -> np.ndarray:
    """For each element, how many equal ones stand before it."""
    order = np.argsort(x, kind="stable")
    ordered = x[order]
    start = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    if len(start) == len(x):
        return np.zeros(len(x), U64)
    run = np.arange(len(x)) - np.repeat(start, np.diff(np.r_[start, len(x)]))
    out = np.empty(len(x), U64)
    out[order] = run.astype(U64)
    return out


def longest_increasing(x: np.ndarray) -> int:
    """Length of the longest strictly increasing subsequence, n log n."""
    from bisect import bisect_left

    if len(x) < 2 or (x[1:] > x[:-1]).all():
        return len(x)
    tails: list[int] = []
    for value in x.tolist():
        at = bisect_left(tails, value)
        if at == len(tails):
            tails.append(value)
        else:
            tails[at] = value
    return len(tails)
