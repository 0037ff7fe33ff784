"""Vectorised text primitives over Arrow string columns: words as 64-bit hashes, shingles, letter runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240607))
#: Random value of each byte; A-Z share the values of a-z, so hashing lower-cases ASCII and nothing else.
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
BYTE[65:91] = BYTE[97:123]
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
SOLID = ~SPACE
BASE = U(0x9E3779B97F4A7C15)
BASE_INV = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
ORDER = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * U(2) + U(1)

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, 1 << 16)
        for k, base in enumerate((BASE, BASE_INV)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows (one more than rows); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose bytes together stay near `most`; a longer row stands alone."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+ of each row: starts, ends (bytes), 64-bit hashes, and each row's first word."""
    starts, ends, first = runs(SOLID[data], offs)
    return starts, ends, span_hashes(data, starts, ends), first


def runs(solid: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of true values that don't cross rows: starts, ends, and each row's first run."""
    n = len(solid)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    fresh = np.zeros(n + 1, bool)
    fresh[offs] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | fresh[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | fresh[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums from which the hash of any span follows, of values of bytes or characters."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power(len(values) + 1)[0][: len(values)], out=total[1:], dtype=np.uint64)
    return total


def hashes_of(total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    down = _power(len(total))[1]
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return hashes_of(prefix_sums(BYTE[data]), starts, ends)


def row_shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Distinct k-word shingles of one row as sorted 64-bit hashes; fewer words make one shingle."""
    n = len(hashes)
    if not n:
        return hashes
    if n < k:
        return mix((hashes * ORDER[:n]).sum(keepdims=True, dtype=np.uint64) + U(n))
    total = hashes[: n - k + 1] * ORDER[0]
    for j in range(1, k):
        total = total + hashes[j : n - k + 1 + j] * ORDER[j]
    return np.unique(mix(total + U(k)))
