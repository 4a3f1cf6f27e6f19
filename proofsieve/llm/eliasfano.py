"""Elias-Fano sequences: sorted integers in about 2 + log2(universe / n) bits each.

The arrays lie in one buffer and are read from it in place, so a sequence can be opened over a
memory-mapped file or an Arrow buffer without a copy.
"""

from __future__ import annotations

import numpy as np

#: For each byte value and k: the place of its k-th zero bit, from the lowest.
ZERO_AT = np.array([[*(z := [i for i in range(8) if not b >> i & 1]), *[8] * (8 - len(z))] for b in range(256)], np.int64)
ZEROS = np.array([8 - bin(b).count("1") for b in range(256)], np.int64)
#: Low bits are read as part of a 64-bit word at any byte.
MOST_LOW = 56


def pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays one after the other, each with its type and length ahead."""
    out = [np.array([len(arrays)], np.int64).tobytes()]
    for x in arrays:
        raw = np.ascontiguousarray(x).tobytes()
        out += [x.dtype.str.encode().ljust(8), np.array([len(x)], np.int64).tobytes(), raw, b"\0" * (-len(raw) % 8)]
    return b"".join(out)


def unpack(buffer: bytes | memoryview | np.ndarray) -> list[np.ndarray]:
    """The arrays of ``pack``, as views of ``buffer``."""
    view = np.frombuffer(buffer, np.uint8)
    out, at = [], 8
    for _ in range(int(view[:8].view(np.int64)[0])):
        kind, n = np.dtype(view[at : at + 8].tobytes().decode().strip()), int(view[at + 8 : at + 16].view(np.int64)[0])
        size = n * kind.itemsize
        out.append(view[at + 16 : at + 16 + size].view(kind))
        at += 16 + size + -size % 8
    return out


class EliasFano:
    """Sorted distinct or repeated 64-bit unsigned integers from ``base`` on."""

    def __init__(self, head: np.ndarray, low: np.ndarray, high: np.ndarray, zeros: np.ndarray):
        self.n, self.bits, self.base, self.buckets = (int(x) for x in head)
        self.head, self.low, self.high, self.zeros = head, low, high, zeros
        self.words = np.ndarray((max(0, len(low) - 7),), "<u8", low, strides=(1,)) if self.n else np.zeros(0, "<u8")

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n, base = len(values), values[0] if len(values) else np.uint64(0)
        values = values - base
        universe = int(values[-1]) + 1 if n else 1
        bits = min(MOST_LOW, max(0, (universe // max(n, 1)).bit_length() - 1))
        high = (values >> np.uint64(bits)).astype(np.int64)
        buckets = (universe - 1 >> bits) + 1
        ones = np.zeros((n + buckets + 63) // 64 * 64, np.uint8)
        ones[n + buckets :] = 1  # no zeros but one for each bucket
        ones[high + np.arange(n)] = 1
        packed_high = np.packbits(ones, bitorder="little")
        low = []
        for k in range(0, n, 1 << 16):
            part = np.ascontiguousarray(values[k : k + (1 << 16)]).view(np.uint8).reshape(-1, 8)
            low.append(np.unpackbits(part, axis=1, bitorder="little")[:, :bits].ravel())
        lows = np.packbits(np.concatenate([*low, np.zeros(0, np.uint8)]), bitorder="little")
        per_word = ZEROS[packed_high].reshape(-1, 8).sum(axis=1)
        zeros = (np.cumsum(per_word) - per_word).astype(np.int32 if buckets < 1 << 31 else np.int64)
        return cls(np.array([n, bits, base, buckets], np.uint64), np.concatenate((lows, np.zeros(8, np.uint8))), packed_high, zeros)

    def arrays(self) -> list[np.ndarray]:
        return [self.head, self.low, self.high, self.zeros]

    def _select_zero(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th zero of the high bits, from 0 on."""
        word = np.searchsorted(self.zeros, k, "right") - 1
        rest, at = k - self.zeros[word], word * 8
        out = np.full(len(k), -1, np.int64)
        for step in range(8):
            byte = self.high[at + step]
            here = ZEROS[byte]
            inside = (out < 0) & (rest < here)
            out[inside] = (at[inside] + step) * 8 + ZERO_AT[byte[inside], rest[inside]]
            rest = np.where(out < 0, rest - here, rest)
        return out

    def lows(self, i: np.ndarray) -> np.ndarray:
        bit = i * self.bits
        return (self.words[bit >> 3] >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.bits) - 1)

    def buckets_of(self, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of the values whose high part is ``high``."""
        before = np.where(high > 0, self._select_zero(np.maximum(high - 1, 0)) + 1, 0)
        return before - high, self._select_zero(high) - high

    def successor(self, values: np.ndarray, low: np.ndarray | None = None, high: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first entry of at least ``values``, whether it is equal), looked for in the places [low, high) where these
        are given; a place past the range if there is none."""
        if not self.n:
            return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
        values = values.astype(np.uint64)
        under = values < np.uint64(self.base)
        moved = np.where(under, np.uint64(0), values - np.uint64(self.base))
        part = (moved >> np.uint64(self.bits))
        over = part >= np.uint64(self.buckets)
        part = np.where(over, np.uint64(self.buckets - 1), part).astype(np.int64)
        a, b = self.buckets_of(part)
        if low is not None:
            a, b = np.clip(a, low, high), np.clip(b, low, high)
        wanted = moved & np.uint64((1 << self.bits) - 1)
        a, last = np.where(over, b, a), b
        while (open_ := a < b).any():
            mid = np.where(open_, (a + b) >> 1, 0)
            less = self.lows(mid) < wanted
            a, b = np.where(open_ & less, mid + 1, a), np.where(open_ & ~less, mid, b)
        inside = (a < last) & ~over & ~under
        return a, inside & (self.lows(np.where(inside, a, 0)) == wanted)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The values at the places ``i``."""
        a, b = np.zeros(len(i), np.int64), np.full(len(i), self.buckets - 1, np.int64)
        while (a < b).any():  # the first bucket that ends after i
            mid = (a + b) >> 1
            ends = self._select_zero(mid) - mid
            a, b = np.where(ends > i, a, mid + 1), np.where(ends > i, mid, b)
        return (a.astype(np.uint64) << np.uint64(self.bits) | self.lows(i)) + np.uint64(self.base)

    def values(self) -> np.ndarray:
        """All values, read in one pass."""
        ones = np.flatnonzero(np.unpackbits(self.high, count=self.n + self.buckets, bitorder="little"))
        i = np.arange(self.n)
        return ((ones - i).astype(np.uint64) << np.uint64(self.bits) | self.lows(i)) + np.uint64(self.base) if self.n else np.zeros(0, np.uint64)
