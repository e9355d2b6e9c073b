"""64-bit hashes of byte ranges in numpy: any range in constant time from one running sum."""

from __future__ import annotations

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_TABLE = np.random.Generator(np.random.PCG64(20240501)).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer: every input bit changes every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * _M1
    x ^= x >> np.uint64(29)
    x = x * _M2
    x ^= x >> np.uint64(32)
    return x


def _grow(n: int) -> None:
    if len(_powers[0]) <= n:
        size = max(1 << 20, 1 << int(n + 1).bit_length())
        for i, base in enumerate((_P, _P_INV)):
            steps = np.full(size, base)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)


class Ranges:
    """Hashes of ranges of one block of bytes. Equal bytes give equal hashes, in any block."""

    def __init__(self, data: np.ndarray):
        self._add(_TABLE[data])

    @classmethod
    def over(cls, hashes: np.ndarray) -> Ranges:
        """Of ranges of one block of items, given as their 64-bit hashes."""
        made = cls.__new__(cls)
        made._add(hashes | np.uint64(1))
        return made

    def _add(self, values: np.ndarray) -> None:
        _grow(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * _powers[0][: len(values)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * _powers[1][start]
        return mix(raw + (end - start).astype(np.uint64) * _M2)

    def fixed(self, length: int) -> np.ndarray:
        """Of every range of this length."""
        n = len(self.sums) - length
        if n <= 0:
            return np.zeros(0, np.uint64)
        raw = (self.sums[length:] - self.sums[:n]) * _powers[1][:n]
        return mix(raw + np.uint64(length * int(_M2) & (1 << 64) - 1))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage
    return. No word crosses a row's end."""
    solid = ~_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    starts_of_rows = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[starts_of_rows] = solid[starts_of_rows]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    ends_of_rows = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[ends_of_rows] = solid[ends_of_rows]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words (see ``word_bounds``), their rows, and the first word of each row (rows + 1 values)."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    if lower:
        data = _LOWER[data]
    start, end = word_bounds(data, offsets)
    rows = np.searchsorted(offsets, start, "right") - 1
    return Ranges(data).of(start, end), rows, np.searchsorted(start, offsets)
