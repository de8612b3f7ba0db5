"""Rolling hashes of word sequences in numpy, modulo 2**64."""

from __future__ import annotations

import numpy as np
import xxhash

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = [np.ones(1, U), np.ones(1, U)]


def mix(z: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    z = (z ^ (z >> U(30))) * U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> U(27))) * U(0x94D049BB133111EB)
    return z ^ (z >> U(31))


class Words(dict):
    """word -> 64-bit hash, remembering a bounded number; about 150 bytes each."""

    def __init__(self, most: int = 500_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        v = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.most:
            self[word] = v
        return v


_words = Words()


def word_hashes(docs: list[list[bytes]], known: Words = _words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the documents one after another, and each document's end."""
    ends = np.cumsum(np.array([len(w) for w in docs], np.int64))
    total = int(ends[-1]) if len(ends) else 0
    return np.fromiter((h for w in docs for h in map(known.__getitem__, w)), U, total), ends


def powers(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for i, b in enumerate((_BASE, _INVERSE)):
            p = np.full(n + n // 4, b, U)
            p[0] = 1
            _powers[i] = np.cumprod(p, dtype=U)
    return _powers


class Rolled:
    """Hashes of any span of a sequence of word hashes, in constant time each."""

    def __init__(self, h: np.ndarray):
        up, self.down = powers(len(h) + 1)
        self.sums = np.zeros(len(h) + 1, U)
        np.cumsum(h * up[: len(h)], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def windows(self, n: int) -> np.ndarray:
        """The hash of the n words from each place on, where there are n."""
        if len(self.sums) <= n:
            return np.zeros(0, U)
        return mix((self.sums[n:] - self.sums[:-n]) * self.down[: len(self.sums) - n])


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, by doubling."""
    if len(a) < width:
        return a[:0]
    n = 1
    while 2 * n <= width:
        a = np.minimum(a[:-n], a[n:])
        n *= 2
    rest = width - n
    return np.minimum(a[: len(a) - rest], a[rest:]) if rest else a
