"""Word and shingle hashes of many texts at once, in numpy.

The texts of a batch stand in one buffer. A word's hash is the difference of two prefix sums of byte * P^place, brought
back to place 0 by the inverse power (all modulo 2^64, P odd) and mixed with the word's length; no loop runs over words.
"""

from __future__ import annotations

import numpy as np

_P = 0x9E3779B97F4A7C15 | 1
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^i and P^-i for i up to n at least; grown by doubling."""
    if not _powers or len(_powers[0]) <= n:
        size = 1 << max(16, n.bit_length())
        _powers[:] = []
        for base in (_P, pow(_P, -1, 1 << 64)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers.append(np.cumprod(table, dtype=np.uint64))
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Words:
    """hashes, and begin and end (bytes in the buffer) of all words; first[i]:first[i + 1] are those of text i, which begins at starts[i]."""

    def __init__(self, texts: list[bytes], lower: bool = False, seed: int = 0):
        self.buffer = b"\n".join([*texts, b""])
        raw = np.frombuffer(self.buffer, np.uint8)
        edge = np.diff(np.concatenate([[False], ~_WHITE[raw], [False]]).astype(np.int8))
        self.begin, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        up, down = _power_tables(len(raw))
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((_LOWER[raw] if lower else raw).astype(np.uint64) * up[: len(raw)], out=sums[1:])
        self._sums, self._down, self._seed = sums, down, np.uint64(seed)
        self.hashes = self.hash_of(self.begin, self.end)
        self.starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
        self.first = np.searchsorted(self.begin, self.starts)

    def hash_of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of stretches of the buffer."""
        value = (self._sums[end] - self._sums[begin]) * self._down[begin]
        return mix(value + (end - begin).astype(np.uint64) * np.uint64(0xA0761D6478BD642F) + self._seed)


def windows(hashes: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A hash for every n consecutive words, by Horner's rule over the words' hashes."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    out = np.full(len(hashes) - n + 1, np.uint64(seed + 1))
    for i in range(n):
        out = out * np.uint64(0xE7037ED1A0B428DB) + hashes[i : len(hashes) - n + 1 + i]
    return mix(out)


def bounded(texts, most: int = 4_000_000):
    """Slices of a list of texts (bytes), of about `most` bytes each."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield slice(begin, i + 1)
            begin, size = i + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))
