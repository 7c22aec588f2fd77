"""Texts of Arrow batches as byte arrays: words, lines and their hashes, in numpy.

Everything works on blocks of whole texts of about ``BLOCK`` bytes, so memory follows the
block (or one very long text), not the batch. Null texts are empty texts. Hashes are 64 bits
wide and depend on the bytes alone, so they agree between tasks and reruns.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_codes(seed: int) -> np.ndarray:
    return mix64(np.arange(256, dtype=np.uint64) + np.uint64(seed * 1_000_003 + 17))


def space_table() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[32, 9, 10, 11, 12, 13]] = True
    return table


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """(base ** i, base ** -i) for i in 0..n modulo 2 ** 64."""
    base = np.full(n + 1, _BASE, np.uint64)
    back = np.full(n + 1, pow(_BASE, -1, 1 << 64), np.uint64)
    base[0] = back[0] = 1
    return np.cumprod(base), np.cumprod(back)


def raw_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls are empty."""
    if pa.types.is_null(column.type):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if places is not None and places.size else np.zeros(len(column) + 1, np.int64)
    body = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, offsets - offsets[0]


def text_blocks(column: pa.Array, limit: int = BLOCK):
    """Yields (first row, bytes, offsets) for runs of whole texts of about ``limit`` bytes."""
    data, offsets = raw_text(column)
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of flags inside each text."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


@dataclass
class Hasher:
    """Hashes of any byte ranges of one block, by prefix sums."""

    sums: np.ndarray
    back: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, seed: int = 1) -> Hasher:
        up, back = powers(len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(byte_codes(seed)[data] * up[: len(data)], out=sums[1:])
        return cls(sums, back)

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        value = (self.sums[ends] - self.sums[starts]) * self.back[starts]
        return mix64(value + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_ranges(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, bounds): words are runs without white space; the words of text i are
    those from bounds[i] to bounds[i + 1]."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~space_table()[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def owners(bounds: np.ndarray) -> np.ndarray:
    """The number of the text each of its items belongs to."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def distinct_pairs(owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, value) in order, with their counts."""
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(order), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return owner[at], value[at], np.diff(np.append(at, len(order)))


def crc32_text(value) -> object:
    """Column: crc32 of a value written as text."""
    from pyspark.sql import functions as F

    return F.crc32(F.coalesce(value.cast("string"), F.lit("")))
