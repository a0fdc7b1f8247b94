"""Whole columns of texts as numpy arrays: byte slices, words and their hashes, without a Python step for each word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 17
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RANDOM = np.random.Generator(np.random.PCG64(20240501)).integers(0, 1 << 63, 4096, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
BYTE_CODE = _RANDOM[:256]
CONSTANT = _RANDOM[256:]
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    known = _powers.get(int(base))
    if known is None or len(known) < n:
        known = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        known[0] = 1
        known = _powers[int(base)] = np.multiply.accumulate(known)
    return known[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit of a 64-bit number over all others."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of texts, and where each text begins and ends in them; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    edges = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[edges[0] : edges[-1]], edges - edges[0]


def slices(edges: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `limit` bytes together; a longer text is a range of its own."""
    at = 0
    while at < len(edges) - 1:
        stop = max(at + 1, int(np.searchsorted(edges, edges[at] + limit, "right")) - 1)
        yield at, stop
        at = stop


def words(raw: np.ndarray, edges: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, begin, end and hash of each word of the texts raw[edges[i] : edges[i + 1]]; edges[0] is 0.

    The hash is a polynomial over random byte codes, taken from prefix sums, and mixed with the length.
    """
    n = len(raw)
    if lower:
        raw = _LOWER[raw]
    space = np.ones(n + 1, bool)
    np.take(_SPACE, raw, out=space[:n])
    first = np.zeros(n + 1, bool)
    first[edges] = True
    begin = np.flatnonzero(~space[:n] & (first[:n] | np.concatenate(([True], space[: n - 1])))) if n else np.zeros(0, np.int64)
    end = np.flatnonzero(~space[:n] & (first[1:] | space[1:])) + 1 if n else begin
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_CODE[raw] * powers(BASE, n), out=total[1:])
    h = mix((total[end] - total[begin]) * powers(INVERSE, n + 1)[begin] + (end - begin).astype(np.uint64))
    return np.searchsorted(edges, begin, "right") - 1, begin, end, h


def rolling(h: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash of every `width` consecutive values: element i covers h[i : i + width]."""
    n = len(h)
    if n < width:
        return np.zeros(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(h * powers(BASE, n), out=total[1:])
    return mix((total[width:] - total[: n - width + 1]) * powers(INVERSE, n - width + 1))
