"""Words of whole batches of texts at once, on their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]`, once lower-cased, and of `[^\x20\x09-\x0D]`.
ALNUM = np.ones(256, bool)
ALNUM[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False
SOLID = np.ones(256, bool)
SOLID[[0x20, *range(9, 14)]] = False
_R = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    text = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = text.buffers()
    if not len(text):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1]
    return np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about size bytes each, at least a row."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = min(rows, max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1))
        yield first, last
        first = last


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_R), -1, 1 << 64))
    both = [np.full(size, x, np.uint64) for x in (_R, inverse)]
    for x in both:
        x[0] = 1
    return tuple(np.multiply.accumulate(x) for x in both)


@cache
def _letters() -> np.ndarray:
    return np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


@dataclass
class Words:
    low: np.ndarray  # bytes, A-Z lower-cased
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    ends: np.ndarray  # by row, the number of words up to its end


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> Words:
    """Words of rows; one never crosses from a row to the next. Equal words have equal hashes."""
    low = LOWER[data]
    n = len(low)
    inside = kind[low]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    edges = offsets[offsets < n]
    before[edges] = False
    edges = offsets[offsets > 0] - 1
    after[edges] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    size = 1 << max(16, (n - 1).bit_length()) if n else 1
    power, inverse = _powers(size)
    total = _letters()[low]
    total *= power[:n]
    np.add.accumulate(total, out=total)
    first = np.where(start > 0, total[start - 1], np.uint64(0)) if n else np.zeros(0, np.uint64)
    code = mix((total[end - 1] - first) * inverse[start]) if len(start) else np.zeros(0, np.uint64)
    return Words(low, start, end, code, np.searchsorted(start, offsets[1:]))
