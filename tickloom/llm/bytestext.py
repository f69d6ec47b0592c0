"""Texts of an Arrow column as one byte array, with positional hashes in numpy.

Words are runs of bytes other than 0x20 and 0x09-0x0D. Hashes are polynomials modulo the
prime 2**61 - 1, followed by a mixer to 64 bits: two different strings of n letters share one for at most
n of the 2**61 bases. (Modulo a power of two some strings collide for every base.) Equal byte
strings always have equal hashes, on every machine.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


P = U((1 << 61) - 1)
_LOW, _MID = U((1 << 31) - 1), U((1 << 30) - 1)


def _reduced(x: np.ndarray) -> np.ndarray:
    """Numbers of 64 bits modulo P."""
    x = (x & P) + (x >> U(61))
    # Below zero wraps to the largest numbers.
    return np.minimum(x, x - P)


def _halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x >> U(31), x & _LOW


def _product(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Products modulo P of numbers given as halves; 2**61 counts as 1."""
    middle = a[0] * b[1] + a[1] * b[0]
    return _reduced((a[0] * b[0] << U(1)) + (middle >> U(30)) + ((middle & _MID) << U(31)) + a[1] * b[1])


class Roll:
    """Sums of letters times powers of a base up to each place: hashes of all substrings.

    Sums are kept as two columns, of the upper and the lower halves of their terms, so that
    adding up never leaves 64 bits.
    """

    def __init__(self, seed: int):
        self.seed = seed
        self.base = int(mix(np.array([seed + 77], U))[0]) % int(P)
        self.inverse = pow(self.base, -1, int(P))
        self.powers = self.backs = _halves(np.ones(1, U))

    def __reduce__(self) -> tuple:
        # Tables of powers stay behind when code travels to workers.
        return Roll, (self.seed,)

    def _grow(self, n: int) -> None:
        if len(self.powers[0]) >= n:
            return
        size = 1 << max(16, (n - 1).bit_length())
        for name, base in (("powers", self.base), ("backs", self.inverse)):
            have, step = np.ones(1, U), base
            while len(have) < size:
                have = np.concatenate([have, _product(_halves(have), _halves(np.array([step], U)))])
                step = step * step % int(P)
            setattr(self, name, _halves(have))

    def prefixes(self, data: np.ndarray) -> np.ndarray:
        """Sums up to each of the bytes, or of the 64-bit values."""
        n = len(data)
        self._grow(n + 1)
        high, low = self.powers[0][:n], self.powers[1][:n]
        if data.dtype == np.uint8:
            # A byte's letter is one more than it, so zero bytes count too: both products have at most 40 bits.
            letters = data.astype(U) + U(1)
            high, low = high * letters, low * letters
        else:
            high, low = _halves(_product((high, low), _halves(_reduced(data))))
        out = np.zeros((2, n + 1), U)
        np.cumsum(high, out=out[0, 1:])
        np.cumsum(low, out=out[1, 1:])
        return out

    def _hash(self, high: np.ndarray, low: np.ndarray, backs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        total = ((high & _MID) << U(31)) + (high >> U(30)) + (low & P) + (low >> U(61))
        return mix(_product(_halves((total & P) + (total >> U(61))), backs))

    def spans(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        high, low = sums
        return self._hash(high[ends] - high[starts], low[ends] - low[starts], (self.backs[0][starts], self.backs[1][starts]))

    def windows(self, sums: np.ndarray, first: int, last: int, length: int) -> np.ndarray:
        """Hashes of the substrings of one length that start at first..last-1."""
        high, low = sums[:, first + length : last + length] - sums[:, first:last]
        return self._hash(high, low, (self.backs[0][first:last], self.backs[1][first:last]))


ROLLS = (Roll(1), Roll(2))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows and the offsets of rows; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if len(column) else pa.array([], pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def give_back() -> None:
    """Return memory that is free to the system: a worker serves many tasks and would keep the most any of them held."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function of batches that leaves no free memory behind in its worker."""

    @functools.wraps(task)
    def run(batches: Iterator) -> Iterator:
        give_back()
        yield from task(batches)
        give_back()

    return run


def slices(offsets: np.ndarray, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `size` bytes; a longer row stands alone."""
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, last
        first = last


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each row the number of words before it."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    finishes = inside.copy()
    finishes[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(finishes) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    roll = ROLLS[which]
    return roll.spans(roll.prefixes(data), starts, ends)


def runs_of_words(words: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """A hash for each `length` consecutive words, by the first word's number; runs may cross rows."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, U)
    roll = ROLLS[which]
    return roll.windows(roll.prefixes(words), 0, n, length)


def sliding(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """best over values[i : i + width] for each i at which all of them exist."""
    have, span = values, 1
    while span * 2 <= width:
        have = best(have[:-span], have[span:])
        span *= 2
    return best(have[: len(have) - (width - span)], have[width - span :]) if span < width else have


def counted(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... counts[0] of them, then those of the next."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    return np.arange(total, dtype=np.int64) + shift
