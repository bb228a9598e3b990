"""Elias-Fano coding of a non-decreasing integer sequence.

n values below u take about n * (2 + log2(u / n)) bits: the low bits of each value stand in a packed array, the high bits
are in unary in a bit vector, where value i sets bit high(i) + i. A directory with the place of every 256th set bit makes
select, and so the value at any index, local: no table of 64-bit offsets is kept.
"""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<QBQQQ")
_EVERY = 256


class EliasFano:
    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, directory: np.ndarray):
        self.n, self.width, self.low, self.high, self.directory = n, width, low, high, directory

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        if n and (np.diff(values.astype(np.int64)) < 0).any():
            raise ValueError("the values must not decrease")
        u = int(values[-1]) + 1 if n else 1
        width = max(0, (u // max(n, 1)).bit_length() - 1)
        high_at = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(high_at[-1]) + 1 if n else 0, np.uint8)
        bits[high_at] = 1
        low_bits = ((values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
        return cls(n, width, np.packbits(low_bits, bitorder="little"), np.packbits(bits, bitorder="little"), high_at[::_EVERY].astype(np.uint64))

    def select(self, start: int, stop: int) -> np.ndarray:
        """Places of the set bits number `start` to `stop` - 1; only the bytes between their directory entries are read."""
        if not 0 <= start <= stop <= self.n:
            raise IndexError((start, stop))
        if start == stop:
            return np.zeros(0, np.int64)
        first, last = start // _EVERY, (stop - 1) // _EVERY + 1
        a = int(self.directory[first]) // 8
        b = int(self.directory[last]) // 8 + 1 if last < len(self.directory) else len(self.high)
        found = np.flatnonzero(np.unpackbits(self.high[a:b], bitorder="little")) + 8 * a
        found = found[found >= int(self.directory[first])]
        return found[start - first * _EVERY : stop - first * _EVERY]

    def values(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """The values at `start` to `stop` - 1 as int64."""
        stop = self.n if stop is None else stop
        high = self.select(start, stop) - np.arange(start, stop)
        if not self.width:
            return high
        a, b = start * self.width, stop * self.width
        bits = np.unpackbits(self.low[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a].reshape(-1, self.width)
        return (high << self.width) + bits.astype(np.int64) @ (np.int64(1) << np.arange(self.width, dtype=np.int64))

    def to_bytes(self) -> bytes:
        head = _HEAD.pack(self.n, self.width, len(self.low), len(self.high), len(self.directory))
        return head + self.low.tobytes() + self.high.tobytes() + self.directory.astype("<u8").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, width, n_low, n_high, n_dir = _HEAD.unpack_from(data)
        at = _HEAD.size
        low = np.frombuffer(data, np.uint8, n_low, at)
        high = np.frombuffer(data, np.uint8, n_high, at + n_low)
        return cls(n, width, low, high, np.frombuffer(data, "<u8", n_dir, at + n_low + n_high))
