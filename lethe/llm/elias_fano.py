"""Elias-Fano sequences: n non-decreasing integers in about 2 + log2(range / n) bits each, with select.

A value's low bits are packed as they are; its high part h at index i sets bit h + i of a bit vector. The value
at i is (select1(i) - i) << low | low_bits(i), so the vector needs no table of 64-bit offsets: a sample of the
position of every 256th set bit bounds each search.
"""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 256
_HEAD = struct.Struct("<QqBQQ")


class EliasFano:
    def __init__(self, n: int, base: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.base, self.low_bits, self.low, self.high, self.samples = n, base, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.int64)
        n = len(v)
        if n == 0:
            return cls(0, 0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, np.uint32))
        if (np.diff(v) < 0).any():
            raise ValueError("values must not decrease")
        base = int(v[0])
        x = v.view(np.uint64) - np.uint64(base & 0xFFFFFFFFFFFFFFFF)
        low_bits = max(0, (int(x[-1]) // n).bit_length() - 1)
        if low_bits:
            low = np.packbits(((x[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        else:
            low = np.zeros(0, np.uint8)
        at = (x >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(at[-1]) + 1, np.uint8)
        bits[at] = 1
        return cls(n, base, low_bits, low, np.packbits(bits, bitorder="little"), at[::SAMPLE].astype(np.uint32))

    def select(self, i: int) -> int:
        """The value at i, reading a few hundred bits."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        first = int(self.samples[i // SAMPLE])
        left, byte = i % SAMPLE + 1, first // 8
        window = self.high[byte : byte + 1] >> (first % 8) << (first % 8)
        while (ones := int(np.bitwise_count(window).sum())) < left:
            left -= ones
            byte += len(window)
            window = self.high[byte : byte + 64]
        position = byte * 8 + int(np.flatnonzero(np.unpackbits(window, bitorder="little"))[left - 1])
        value = (position - i) << self.low_bits
        if self.low_bits:
            start = i * self.low_bits
            part = np.unpackbits(self.low[start // 8 : (start + self.low_bits + 7) // 8], bitorder="little")
            part = part[start % 8 : start % 8 + self.low_bits]
            value |= int((part.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum())
        return (value + self.base + (1 << 63)) % (1 << 64) - (1 << 63)

    def selects(self, first: int, last: int) -> np.ndarray:
        """The values at first to last - 1, reading only the bits between their samples."""
        if not 0 <= first <= last <= self.n:
            raise IndexError((first, last))
        if first == last:
            return np.zeros(0, np.int64)
        begin, end = first // SAMPLE, (last - 1) // SAMPLE + 1
        byte = int(self.samples[begin]) // 8
        stop = int(self.samples[end]) // 8 + 1 if end < len(self.samples) else len(self.high)
        at = np.flatnonzero(np.unpackbits(self.high[byte:stop], bitorder="little")) + byte * 8
        at = at[np.searchsorted(at, int(self.samples[begin])) :][first - begin * SAMPLE : last - begin * SAMPLE]
        x = (at - np.arange(first, last)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            start = first * self.low_bits
            bits = np.unpackbits(self.low[start // 8 : (last * self.low_bits + 7) // 8], bitorder="little")
            part = bits[start % 8 : start % 8 + (last - first) * self.low_bits].reshape(-1, self.low_bits)
            x |= (part.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(1, dtype=np.uint64)
        return (x + np.uint64(self.base & 0xFFFFFFFFFFFFFFFF)).view(np.int64)

    def values(self) -> np.ndarray:
        """All values, by one pass."""
        return self.selects(0, self.n)

    def to_bytes(self) -> bytes:
        return _HEAD.pack(self.n, self.base, self.low_bits, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, b: bytes | memoryview) -> tuple[EliasFano, int]:
        """The sequence and the number of bytes read."""
        n, base, low_bits, nl, nh = _HEAD.unpack_from(b)
        at = _HEAD.size
        low = np.frombuffer(b, np.uint8, nl, at)
        high = np.frombuffer(b, np.uint8, nh, at + nl)
        ns = (n + SAMPLE - 1) // SAMPLE
        samples = np.frombuffer(b, "<u4", ns, at + nl + nh)
        return cls(n, base, low_bits, low, high, samples), at + nl + nh + 4 * ns
