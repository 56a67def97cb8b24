"""Numpy kernels that work on the bytes of a whole Arrow batch at once: words, hashes and slices of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RANDOM = np.random.Generator(np.random.PCG64(20240607))
#: A random 64-bit value for each byte; in LOWER, A-Z share those of a-z.
EXACT = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64)
LOWER = EXACT.copy()
LOWER[65:91] = EXACT[97:123]
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1), modulo 2 ** 64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if len(have) <= 1 << 23:
            _powers[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of x."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and where each value starts; the last entry is the end."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that a slice has about `limit` bytes of text; a longer text is a slice of its own."""
    for batch in batches:
        _, at = flat(batch.column(column))
        i, n = 0, batch.num_rows
        while i < n:
            j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j


def prefix_hash(data: np.ndarray, table: np.ndarray, base: np.uint64 = BASE) -> np.ndarray:
    """Running polynomial hash; the hash of data[i:j] is (h[j] - h[i]) * base ** -i."""
    h = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * powers(base, len(data)), out=h[1:])
    return h


def word_bounds(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the index of each word's text."""
    space = SPACE[data]
    first = np.ones(len(data) + 1, bool)
    first[1:-1] = space[:-1]
    first[at] = True
    starts = np.flatnonzero(~space & first[:-1])
    last = np.ones(len(data) + 1, bool)
    last[:-1] = first[:-1]
    last[:-1] |= space
    ends = np.flatnonzero(~space & last[1:]) + 1
    return starts, ends, np.searchsorted(at, starts, "right") - 1


def span_hash(h: np.ndarray, starts: np.ndarray, ends: np.ndarray, inverse: np.uint64 = INVERSE) -> np.ndarray:
    return mix((h[ends] - h[starts]) * powers(inverse, len(h))[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, at: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word, and the index of its text."""
    starts, ends, doc = word_bounds(data, at)
    return span_hash(prefix_hash(data, LOWER if lower else EXACT), starts, ends), doc


def counts_of(doc: np.ndarray, n: int) -> np.ndarray:
    """Where the items of each of n texts start, doc being sorted; the last entry is the end."""
    return np.searchsorted(doc, np.arange(n + 1))
