"""Hashed word shingles and their one-permutation MinHash sketches, for use inside Arrow tasks."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

U = np.uint64
GOLDEN = U(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


class Shingler:
    """Distinct word shingles of a text as sorted 64-bit hashes.

    Words are the runs of bytes other than space and ``\\x09-\\x0D`` after A-Z are lower-cased; a text with
    fewer words than a shingle gives its whole sequence as one shingle; null and blank texts give none.
    """

    def __init__(self, words: int, remembered: int = 200_000):
        self.words, self.remembered, self.memo = words, remembered, {}

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = text.lower().split() if text else []
        if not words:
            return np.empty(0, U)
        memo, get = self.memo, self.memo.get
        if len(memo) > self.remembered:
            memo.clear()
        hashes = np.empty(len(words), U)
        for i, word in enumerate(words):
            h = get(word)
            if h is None:
                h = memo[word] = xxhash.xxh3_64_intdigest(word)
            hashes[i] = h
        n = min(self.words, len(words))
        last = len(words) - n + 1
        x = mixed(hashes[:last] + U(n))
        for i in range(1, n):
            x = mixed(x * GOLDEN + hashes[i : last + i])
        return np.unique(x)


def digest(shingles: np.ndarray) -> bytes:
    """128 bits that name a shingle set."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


class Sketcher:
    """One-permutation hashing: the hash range is cut into bins, a bin keeps its least hash.

    Optimal densification: an empty bin borrows the value of the first non-empty bin in its own fixed random
    sequence of bins, so borrowed values agree between two sets with the probability that kept ones do.
    """

    def __init__(self, bins: int, rows: int):
        self.bins, self.rows = bins, rows
        edges = [(i << 64) // bins for i in range(bins + 1)]
        self.edges = np.array(edges[:-1], dtype=U)
        tries = np.arange(bins, dtype=U)[:, None] * U(1 << 20) + np.arange(1, 64 * 1024 // bins * 4, dtype=U)[None, :]
        self.probes = (mixed(tries * GOLDEN + U(1)) % U(bins)).astype(np.int64)
        self.salt = mixed(np.arange(bins // rows, dtype=U) * GOLDEN + U(7))

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        at = np.searchsorted(shingles, self.edges)
        ends = np.append(at[1:], len(shingles))
        full = at < ends
        values = np.where(full, shingles[np.minimum(at, len(shingles) - 1)], U(0))
        empty = np.flatnonzero(~full)
        out, step = values.copy(), 0
        while len(empty):
            source = self.probes[empty, step] if step < self.probes.shape[1] else np.full(len(empty), np.flatnonzero(full)[0])
            hit = full[source]
            out[empty[hit]] = values[source[hit]]
            empty, step = empty[~hit], step + 1
        return out

    def bands(self, signature: np.ndarray) -> np.ndarray:
        """One 64-bit key for each band of rows; keys of different bands do not meet."""
        used = len(self.salt)
        x = self.salt.copy()
        for column in signature[: used * self.rows].reshape(used, self.rows).T:
            x = mixed(x * GOLDEN + column)
        return x.view(np.int64)

    @staticmethod
    def bits(signature: np.ndarray) -> np.ndarray:
        """One bit for each bin, as 64-bit words: two sets agree in (1 + similarity) / 2 of them on average."""
        bit = (mixed(signature ^ U(0x5851F42D4C957F2D)) >> U(63)).astype(np.uint8)
        padded = np.zeros(-(-len(bit) // 64) * 64, np.uint8)
        padded[: len(bit)] = bit
        return np.packbits(padded).view(np.int64)


def odd_sketch(shingles: np.ndarray, bits: int = 256) -> np.ndarray:
    """Which of ``bits`` buckets hold an odd number of shingles, as 64-bit words.

    Two sets differ in no more of these bits than in shingles, so many differing bits prove many differing shingles.
    """
    parity = np.bincount((mixed(shingles ^ U(0x2545F4914F6CDD1D)) % U(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.int64)


def banding(threshold: float, bins: int = 252, missed: float = 1e-6) -> tuple[int, int]:
    """(bands, rows): the most selective banding that misses a pair at the threshold with at most this probability."""
    for rows in range(12, 1, -1):
        bands = bins // rows
        if (1 - threshold**rows) ** bands <= missed:
            return bands, rows
    return bins, 1
