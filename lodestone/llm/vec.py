"""Vectorised text primitives over Arrow string columns.

A column is seen as one byte buffer with row offsets, so words, lines and
hashes of many rows come from a few numpy passes and memory stays bounded by
the slice at hand (``slices``).
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_SEGMENT = 1 << 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


_INVERSE = np.uint64(_inverse(int(_MULTIPLIER)))
_BYTE = np.random.default_rng(20240131).integers(0, 2**64, 256, dtype=np.uint64)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]

#: \x20 and \x09-\x0D
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    data = column.buffers()[2]
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str | int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """batch in runs of rows whose texts hold about ``most`` bytes; a longer text is alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < len(sizes):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """run, after which a worker returns free memory to the system: idle workers are kept, and stages that need none would pay for it."""

    def done(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return done


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 100_000) -> Iterator[pa.RecordBatch]:
    """Batches put together until they hold so many rows: for columns of fixed width, whose batches arrive small."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            yield pa.concat_batches(held)
            held, size = [], 0
    if size:
        yield pa.concat_batches(held)


def spans_between(breaks: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes that are no break and cross no row boundary, as (starts, ends)."""
    n = len(breaks)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    held = ~breaks
    first = held.copy()
    first[1:] &= breaks[:-1] | edge[1:n]
    last = held.copy()
    last[:-1] &= breaks[1:] | edge[1:n]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def words(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words, split at ASCII white space only."""
    return spans_between(WHITE[body], offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    held = _POWERS.get(int(base))
    if held is None or len(held) < n:
        size = max(n, 1 << 16)
        held = np.full(size, base, np.uint64)
        held[0] = 1
        held = np.cumprod(held)
        if size <= 2 * _SEGMENT:
            _POWERS[int(base)] = held
    return held[:n]


def hash_spans(body: np.ndarray, starts: np.ndarray, ends: np.ndarray, folded: bool = False) -> np.ndarray:
    """64-bit hash of each span (spans sorted by start); folded: ASCII letters regardless of case."""
    table = _FOLDED if folded else _BYTE
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = int(starts[at])
        to = max(at + 1, int(np.searchsorted(starts, base + _SEGMENT)))
        top = int(ends[at:to].max())
        part = table[body[base:top]] * _powers(_MULTIPLIER, top - base)
        total = np.empty(len(part) + 1, np.uint64)
        total[0] = 0
        np.cumsum(part, out=total[1:])
        s, e = starts[at:to] - base, ends[at:to] - base
        value = (total[e] - total[s]) * _powers(_INVERSE, top - base + 1)[s]
        out[at:to] = mix(value + (e - s).astype(np.uint64) * _MULTIPLIER)
        at = to
    return out


def rows_of(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The row that holds each start."""
    return np.searchsorted(offsets, starts, "right") - 1


def grouped_arange(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each c of counts, one after the other."""
    total = int(counts.sum())
    return np.arange(total, dtype=np.int64) - np.repeat(np.cumsum(counts) - counts, counts)


def lists(values: pa.Array, counts: np.ndarray) -> pa.Array:
    """A list column of consecutive runs of values."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)
