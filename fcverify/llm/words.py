"""Vectorised words and rolling hashes of text columns, for use inside Arrow tasks.

A word is a run of bytes other than space and 0x09-0x0D. UTF-8 never uses these bytes inside a
character, so words and their hashes are computed on the raw bytes of a whole batch at once.
Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
MASK = (1 << 64) - 1
SLICE_BYTES = 2 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = True
_FOLD = np.arange(256)
_FOLD[ord("A"):ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit value over all bits."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


@lru_cache(maxsize=None)
def byte_table(seed: int, fold: bool = False) -> np.ndarray:
    """A 64-bit value per byte; with fold, A-Z have the values of a-z."""
    table = mix((np.arange(256, dtype=U64) + U64(1 + 256 * seed)) * U64(0x9E3779B97F4A7C15))
    return table[_FOLD] if fold else table


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. n-1 modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        steps = np.full(size, U64(base), dtype=U64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=U64)
        if size <= 2 * SLICE_BYTES:
            _POWERS[base] = have
    return have[:n]


def _base(seed: int) -> tuple[int, int]:
    base = (0x9E3779B97F4A7C15 * (2 * seed + 3) | 1) & MASK
    return base, pow(base, -1, 1 << 64)


def prefix_hash(values: np.ndarray, seed: int) -> np.ndarray:
    """Prefix sums of values[i] * base**i; ``span_hash`` takes differences of them."""
    base, _ = _base(seed)
    out = np.zeros(len(values) + 1, dtype=U64)
    np.cumsum(values * powers(base, len(values)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """Hash of each span [start, end), the same wherever an equal span stands."""
    _, inverse = _base(seed)
    return mix((prefix[ends] - prefix[starts]) * powers(inverse, len(prefix))[starts])


def window_hash(values: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Hash of every ``width`` consecutive values."""
    n = max(len(values) - width + 1, 0)
    at = np.arange(n)
    return span_hash(prefix_hash(values, seed), at, at + width, seed)


@dataclass
class Texts:
    """Some whole texts: their joined bytes, the bounds of each, and the rows they come from."""

    first: int
    bytes: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def words(self, seeds: tuple[int, ...] = (0,), fold: bool = False, space: np.ndarray = _SPACE) -> Words:
        """``space`` has a bit for each byte that separates words."""
        return Words(self, seeds, fold, space)


class Words:
    """Word starts and ends (in the joined bytes), the text of each word, and hashes by seed."""

    def __init__(self, texts: Texts, seeds: tuple[int, ...], fold: bool, space: np.ndarray):
        data, bounds = texts.bytes, texts.bounds
        inside = ~space[data]
        before = np.empty_like(inside)
        after = np.empty_like(inside)
        if len(data):
            before[0], before[1:] = False, inside[:-1]
            after[-1], after[:-1] = False, inside[1:]
            cuts = bounds[(bounds > 0) & (bounds < len(data))]
            before[cuts] = False
            after[cuts - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        #: words of text i are first[i] .. first[i + 1]
        self.first = np.searchsorted(self.starts, bounds)
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.hashes = []
        for seed in seeds:
            prefix = prefix_hash(byte_table(seed, fold)[data], seed)
            self.hashes.append(span_hash(prefix, self.starts, self.ends, seed))

    def __len__(self) -> int:
        return len(self.starts)

    def windows(self, width: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """First words of all windows of ``width`` words inside one text, and their hashes by seed."""
        n = len(self) - width + 1
        if n <= 0:
            return np.zeros(0, dtype=np.int64), [np.zeros(0, dtype=U64) for _ in self.hashes]
        at = np.flatnonzero(self.text[:n] == self.text[width - 1:])
        return at, [window_hash(h, width, 101 + i)[at] for i, h in enumerate(self.hashes)]


def as_bytes(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # no chunk at all
        column = pa.array([], column.type)
    return pc.fill_null(column.cast(pa.large_binary()), b"")


def texts(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[Texts]:
    """The texts of a column in slices of about ``limit`` bytes, at least one text each."""
    array = as_bytes(column)
    if not len(array):
        return
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset:array.offset + len(array) + 1]
    buffer = array.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(array):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield Texts(at, data[offsets[at]:offsets[end]], offsets[at:end + 1] - offsets[at])
        at = end


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n positions lie in one of the spans [start, start + width)."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + width, n), -1)
    return np.cumsum(edge[:n]) > 0
