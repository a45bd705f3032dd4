"""Vectorised hashing of words and word shingles over the UTF-8 buffers of Arrow batches.

No Python object is made for a word: boundaries, word hashes and shingle hashes come from array operations on
the bytes. Memory is bounded by ``SLICE_BYTES`` of text at a time, or by one document where that is longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2**64
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_PLACE = _RNG.integers(1, 2**63, 16, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def sorted_unique(x: np.ndarray) -> np.ndarray:
    """The distinct values in order. (np.unique may hash integers, which is far slower on packed keys.)"""
    x = np.sort(x)
    keep = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=keep[1:])
    return x[keep]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(max(n, SLICE_BYTES), base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers


def text_slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, starts and end of its rows) for consecutive rows of a string column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, side="right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash of each word (A-Z lower-cased), and for each row the place of its first word, plus the end."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(starts), np.int64)
    inside = np.zeros(len(data) + 2, bool)
    np.logical_not(_IS_SPACE[data], out=inside[1:-1])
    edge = inside[1:] != inside[:-1]
    first, last = inside[1:] & edge, inside[:-1] & edge
    cut = starts[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    both = cut[inside[cut] & inside[cut + 1]]  # two rows' words touch there
    first[both] = True
    last[both] = True
    begin, end = np.flatnonzero(first), np.flatnonzero(last)
    power, inverse = _power_tables(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[_LOWER[data]] * power[: len(data)], out=total[1:])
    hashes = (total[end] - total[begin]) * inverse[begin]
    return mix64(hashes + (end - begin).astype(np.uint64) * _PLACE[15]), np.searchsorted(begin, starts)


def span_hashes(codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of code points."""
    power, inverse = _power_tables(len(codes))
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(mix64(codes.astype(np.uint64) + _PLACE[14]) * power[: len(codes)], out=total[1:])
    return mix64((total[end] - total[begin]) * inverse[begin] + (end - begin).astype(np.uint64) * _PLACE[15])


def shingle_sets(data: np.ndarray, starts: np.ndarray, width: int = 5) -> Iterator[np.ndarray]:
    """For each row the sorted distinct 64-bit hashes of its word shingles; a shorter text is one shingle, no word none."""
    words, at = word_hashes(data, starts)
    n = max(0, len(words) - width + 1)
    rolled = np.full(n, np.uint64(width))
    for k in range(width):
        rolled += words[k : k + n] * _PLACE[k]
    rolled = mix64(rolled)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= width:
            yield sorted_unique(rolled[a : b - width + 1])
        elif b > a:
            yield mix64(np.array([(words[a:b] * _PLACE[: b - a]).sum() + np.uint64(b - a)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)
