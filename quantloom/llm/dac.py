"""Directly addressable codes for token ids: chunk levels, continuation bitmaps and rank directories.

Layout of one segment (little-endian):

    magic ``DAC1`` | chunk bits u8 | levels u8 | two zero bytes | ids u64
    for each level: entries u64
    for each level: chunks (u8 or u16) | continuation bitmap (u8, low bit first) | rank directory (u32, ones before each block)

An id is cut into chunks of 8 or 16 bits, low chunk first. Level 0 has the first chunk of every id; bit i of its
bitmap says whether id i goes on, and the number of ones before it is its place in the next level.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"DAC1"
BLOCK = 512  # bits of a bitmap to one entry of its rank directory
HEAD = struct.Struct("<4sBBxxQ")


def encode(ids: np.ndarray, chunk_bits: int = 8) -> bytes:
    """One segment of unsigned 32-bit ids; no ids give a segment of one empty level."""
    kind = {8: np.dtype("<u1"), 16: np.dtype("<u2")}[chunk_bits]
    rest = np.asarray(ids, dtype=np.uint32)
    count, sizes, body = len(rest), [], []
    while True:
        chunks = rest.astype(kind)  # keeps the low bits
        rest = rest >> np.uint32(chunk_bits)
        more = rest != 0
        ones = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.int64) if len(more) else np.empty(0, np.int64)
        ranks = np.concatenate([[0], np.cumsum(ones)[:-1]]).astype("<u4") if len(ones) else np.empty(0, "<u4")
        sizes.append(len(chunks))
        body += [chunks.tobytes(), np.packbits(more, bitorder="little").tobytes(), ranks.tobytes()]
        if not more.any():
            break
        rest = rest[more]
    return HEAD.pack(MAGIC, chunk_bits, len(sizes), count) + struct.pack(f"<{len(sizes)}Q", *sizes) + b"".join(body)


class Segment:
    """Random access to the ids of one encoded segment, without decoding others."""

    def __init__(self, data: bytes):
        magic, self.chunk_bits, levels, self.count = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        sizes = struct.unpack_from(f"<{levels}Q", data, HEAD.size)
        at, kind, self.levels = HEAD.size + 8 * levels, np.dtype(f"<u{self.chunk_bits // 8}"), []
        for size in sizes:
            parts = []
            for dtype, length in ((kind, size), (np.dtype("u1"), -(-size // 8)), (np.dtype("<u4"), -(-size // BLOCK))):
                parts.append(np.frombuffer(data, dtype, length, at))
                at += length * dtype.itemsize
            self.levels.append(parts)

    def __len__(self) -> int:
        return self.count

    def __getitem__(self, i: int) -> int:
        """Id at place i: one chunk, one bit and one rank for each level it reaches."""
        if not 0 <= i < self.count:
            raise IndexError(i)
        value = 0
        for level, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << (level * self.chunk_bits)
            if not bits[i >> 3] >> (i & 7) & 1:
                return value
            i = self._rank(bits, ranks, i)
        return value

    @staticmethod
    def _rank(bits: np.ndarray, ranks: np.ndarray, i: int) -> int:
        """Ones before bit i."""
        block = i // BLOCK
        first = block * BLOCK // 8
        whole = int(np.bitwise_count(bits[first : i >> 3]).sum())
        tail = bin(int(bits[i >> 3]) & ((1 << (i & 7)) - 1)).count("1") if i & 7 else 0
        return int(ranks[block]) + whole + tail

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Ids from ``start`` up to ``stop``: the run of each level that they reach."""
        out = np.zeros(max(0, stop - start), np.uint32)
        where, low, high = np.arange(len(out)), start, stop
        for level, (chunks, bits, ranks) in enumerate(self.levels):
            if low >= high:
                break
            out[where] |= chunks[low:high].astype(np.uint32) << np.uint32(level * self.chunk_bits)
            first = low >> 3
            more = np.unpackbits(bits[first : -(-high // 8)], bitorder="little")[low - 8 * first : high - 8 * first].astype(bool)
            if level + 1 == len(self.levels):
                break
            low = self._rank(bits, ranks, low)
            high = low + int(more.sum())
            where = where[more]
        return out
