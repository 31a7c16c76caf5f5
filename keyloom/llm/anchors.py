"""Content-defined anchors and window hashes of byte strings, in numpy.

Every ``length``-byte window of a text owns one anchor: the leftmost smallest gram hash
among its first ``reach`` positions. The anchor's distance from the window's start
depends on the window's bytes alone, so equal windows have anchors at equal distances.
Consecutive windows with one anchor form a run.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
GRAM = 8
BASES = (U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93))
INDEX_BITS = U(24)


def inverse(b: np.uint64) -> np.uint64:
    return U(pow(int(b), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[:1] = U(1)
    return np.multiply.accumulate(out)


_powers: dict[int, list[np.ndarray]] = {}


def tables(n: int) -> list[np.ndarray]:
    """Powers of both bases and of their inverses, kept for the longest buffer so far."""
    if not _powers or len(_powers[0]) < n:
        for i, b in enumerate((*BASES, *map(inverse, BASES))):
            _powers[i] = powers(b, n + n // 4)
    return [_powers[i] for i in range(4)]


class Buffer:
    """Several texts in one byte buffer, with running hashes of all of it."""

    def __init__(self, texts: list[bytes]) -> None:
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        data = np.frombuffer(b"".join(texts) + bytes(GRAM), np.uint8)
        two = data[:-1] | (data[1:].astype(np.uint16) << np.uint16(8))
        four = two[:-2] | (two[2:].astype(np.uint32) << np.uint32(16))
        eight = four[:-4].astype(U) | (four[4:].astype(U) << U(32))
        self.grams = mix(eight)[: int(self.ends[-1]) if len(texts) else 0]
        self.data = data[: len(self.grams)]
        self._sums: list[np.ndarray] = []

    def hashes(self, lo: np.ndarray, hi: np.ndarray, lane: int) -> np.ndarray:
        """Of the bytes [lo, hi), at least GRAM each, wherever they stand."""
        t = tables(len(self.grams) + 1)
        while len(self._sums) <= lane:
            n = len(self.grams)
            s = np.zeros(n + 1, U)
            np.cumsum(self.grams * t[len(self._sums)][:n], out=s[1:])
            self._sums.append(s)
        s = self._sums[lane]
        return mix((s[hi - GRAM + 1] - s[lo]) * t[2 + lane][lo] + (hi - lo).astype(U))

    def runs(self, length: int, reach: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, first window, last window, anchor) of each run, as buffer positions. Windows begin at the first ``most`` bytes of a text."""
        n = len(self.grams)
        none = np.zeros(0, np.int64)
        starts_ok = self.sizes >= length
        if not starts_ok.any():
            return none, none, none, none
        key = (self.grams >> INDEX_BITS << INDEX_BITS) | np.arange(n, dtype=U)
        padded = np.full(-(-(n + reach) // reach) * reach, ~U(0), U)
        padded[:n] = key
        grid = padded.reshape(-1, reach)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        anchor = (np.minimum(behind[: n - length + 1], ahead[reach - 1 : reach + n - length]) & ((U(1) << INDEX_BITS) - U(1))).astype(np.int64)
        edge = np.zeros(n + 2, np.int8)
        edge[self.starts[starts_ok]] += 1
        stops = np.minimum(self.ends - length + 1, self.starts + most)
        edge[stops[starts_ok]] -= 1
        valid = np.cumsum(edge[: len(anchor)]) > 0
        new = valid.copy()
        new[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1]
        new[self.starts[starts_ok]] = True
        first = np.flatnonzero(new)
        text = np.searchsorted(self.ends, first, side="right")
        last = np.minimum(np.append(first[1:], n), stops[text]) - 1
        return text, first, last, anchor[first]
