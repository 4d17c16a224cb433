"""Rolling hashes of all byte windows of a buffer, in numpy."""

from __future__ import annotations

from functools import cache

import numpy as np

#: Bytes that one call takes; longer texts go through in overlapping parts. A task's arrays are some hundred times that.
MOST = 1 << 18
BASE = 0x9E3779B97F4A7C15


@cache
def _tables(seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random word for each byte, and the powers of the base and of its inverse modulo 2**64."""
    rng = np.random.default_rng(seed)
    word = rng.integers(0, 1 << 64, 256, dtype=np.uint64)
    base = (BASE + 2 * int(rng.integers(0, 1 << 32))) % (1 << 64) | 1

    def powers(x: int) -> np.ndarray:
        out = np.full(MOST + 1, x, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return word, powers(base), powers(pow(base, -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Rolling:
    """Hashes of a buffer of at most MOST bytes: ``windows`` of one width, or ``spans`` of any."""

    def __init__(self, buffer: np.ndarray, seed: int = 1):
        if len(buffer) > MOST:
            raise ValueError("buffer too long")
        word, power, self._inverse = _tables(seed)
        self._sums = np.zeros(len(buffer) + 1, np.uint64)
        np.cumsum(word[buffer] * power[: len(buffer)], out=self._sums[1:])

    def windows(self, width: int) -> np.ndarray:
        n = len(self._sums) - width
        if n <= 0:
            return np.empty(0, np.uint64)
        return mixed((self._sums[width:] - self._sums[:n]) * self._inverse[:n])

    def spans(self, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Of the bytes from each start; the length is part of the hash."""
        raw = (self._sums[starts + lengths] - self._sums[starts]) * self._inverse[starts]
        return mixed(raw ^ (lengths.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))


def least_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` values in a row."""
    n = len(values)
    if n < width:
        return values[:0]
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    rows = padded.reshape(-1, width)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - width + 1], before[width - 1 : n])
