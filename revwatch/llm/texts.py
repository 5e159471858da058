"""Text columns of Arrow batches as byte buffers: numpy works on whole batches, without a Python object per text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 4_000_000

# Space and the ASCII control characters 09 to 0D: what ``[^\x20\x09-\x0D]+`` leaves out.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

# Bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z were lower-cased: digits, a-z, everything beyond ASCII.
WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows, from 0) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    o = np.frombuffer(offsets, kind, len(column) + 1, column.offset * kind().itemsize).astype(np.int64)
    b = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.empty(0, np.uint8)
    return b, o - o[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows (first, end, bytes, offsets) of at most ``limit`` bytes; a longer text is a run of its own."""
    data, offsets = flat(column)
    first, rows = 0, len(offsets) - 1
    while first < rows:
        end = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        end = min(max(end, first + 1), rows)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and per-row counts of the maximal runs of True; a run never crosses a row's border."""
    if not len(inside):
        empty = np.empty(0, np.int64)
        return empty, empty, np.zeros(len(offsets) - 1, np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    borders = offsets[:-1][np.diff(offsets) > 0]
    first[borders] = inside[borders]
    ends_at = offsets[1:][np.diff(offsets) > 0] - 1
    last[ends_at] = inside[ends_at]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.diff(np.searchsorted(starts, offsets))


def binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column over a byte buffer, without copying it."""
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(),
        len(offsets) - 1,
        [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))],
    )


def distinct(column: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    """For every value its number among the distinct values, and those values in order of appearance."""
    coded = column.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words (maximal runs of ``inside`` bytes) of all rows as one binary column, and how many each row has."""
    starts, ends, per_row = spans(inside, offsets)
    borders = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=borders[1:])
    return binary(data[inside], borders), per_row


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of consecutive runs: ``start .. start + length - 1`` for every pair, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
