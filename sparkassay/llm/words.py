"""Hashes of words and of runs of words, vectorised over one text's bytes."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BASE, _RUN = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95  # odd, so that they have inverses modulo 2**64


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown as needed."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse, self.n = base, pow(base, -1, 1 << 64), 0
        self.up = self.down = np.empty(0, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(2 * self.n, n, 1 << 16)
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(self.n - 1, x, np.uint64)])) for x in (self.base, self.inverse))
        return self.up[:n], self.down[:n]


_bytes, _runs = _Powers(_BASE), _Powers(_RUN)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit over all (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bounds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words, parted by space and the characters from tab to carriage return."""
    edge = np.diff(_SPACE[np.frombuffer(text, np.uint8)].astype(np.int8), prepend=1, append=1)
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word, by a polynomial over its bytes modulo 2**64, then mixed."""
    start, end = bounds(text)
    if not len(start):
        return np.empty(0, np.uint64)
    up, down = _bytes.of(len(text) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1)) * up[: len(text)])])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of ``n`` word hashes; none if there are fewer."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    up, down = _runs.of(len(words) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[: len(words)])])
    return mix((total[n:] - total[:-n]) * down[: len(words) - n + 1] + np.uint64(n))


def span_hashes(words: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the word hashes from each start to before the end; spans may be empty."""
    up, down = _runs.of(len(words) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[: len(words)])])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
