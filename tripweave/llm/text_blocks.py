"""Words of many texts at once, as numpy arrays over the bytes of an Arrow column.

A column's UTF-8 bytes are taken as they lie in memory, in blocks of whole texts, and words are runs of
bytes of a given class. Hashes are sums of a random number per byte value times a random number per
place, so equal words, lines or windows have equal 64-bit hashes and others differ but for chance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def numbered(n: int, seed: int) -> np.ndarray:
    """Numbers that look random, the same for every place whatever ``n`` is."""
    steps = np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)
    return mixed(steps * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def byte_class(allowed) -> np.ndarray:
    """A table of 256 flags from a test of the byte value."""
    return np.array([bool(allowed(b)) for b in range(256)])


def lower_ascii() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


# Words between blanks and control blanks, and words of letters, digits and non-ASCII characters.
NOT_BLANK = byte_class(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
LETTERS_DIGITS = byte_class(
    lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or 0x41 <= b <= 0x5A
)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    values = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return values, at


@dataclass
class Block:
    """Whole texts ``first`` up to ``last`` of a column; ``offsets`` start at 0."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def texts(self) -> int:
        return self.last - self.first

    def words(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin and end of each run of bytes of the class, and each text's range of runs."""
        inside = table[self.data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        full = self.offsets[:-1] < self.offsets[1:]
        heads = self.offsets[:-1][full]
        tails = self.offsets[1:][full] - 1
        begins[heads] = inside[heads]
        ends[tails] = inside[tails]
        starts = np.flatnonzero(begins)
        return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, self.offsets)


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of about ``limit`` bytes; a longer text is a block of its own."""
    data, offsets = utf8(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        at = offsets[first : last + 1]
        yield Block(first, last, data[at[0] : at[-1]], at - at[0])
        first = last


class Hasher:
    """Hashes of byte runs; ``fold`` maps bytes first, for example to lower case."""

    def __init__(self, seed: int = 1, fold: np.ndarray | None = None):
        values = numbered(256, seed)
        self.values = values if fold is None else values[fold]
        self.seed = seed + 1
        self.places = numbered(1 << 16, self.seed)

    def runs(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """One hash per run; runs are in order and not empty."""
        if len(starts) == 0:
            return np.empty(0, np.uint64)
        lengths = ends - starts
        longest = int(lengths.max())
        if longest > len(self.places):
            self.places = numbered(2 * longest, self.seed)
        firsts = np.zeros(len(starts), np.int64)
        np.cumsum(lengths[:-1], out=firsts[1:])
        total = int(firsts[-1] + lengths[-1])
        place = np.arange(total, dtype=np.int64) - np.repeat(firsts, lengths)
        at = place + np.repeat(starts, lengths)
        weighted = self.values[data[at]] * self.places[place]
        return mixed(np.add.reduceat(weighted, firsts) + lengths.astype(np.uint64))


def windows(hashes: np.ndarray, size: int, seed: int = 9) -> np.ndarray:
    """Hash of ``size`` consecutive hashes from each place on (fewer places than hashes)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    factors = numbered(size, seed)
    total = np.full(n, np.uint64(size), np.uint64)
    for step in range(size):
        total += hashes[step : step + n] * factors[step]
    return mixed(total)


def window_owner(bounds: np.ndarray, size: int, n: int) -> np.ndarray:
    """For each window start of a block the text that holds it whole, or -1 if two texts share it."""
    owner = np.full(max(n, 0), -1, np.int64)
    if n > 0:
        text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        inside = text[:n] == text[size - 1 : size - 1 + n]
        owner[inside] = text[:n][inside]
    return owner
