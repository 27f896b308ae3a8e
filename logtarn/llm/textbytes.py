"""Texts of an Arrow batch as one array of bytes, and what numpy finds in it."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20


def byte_set(members: bytes) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(members)] = True
    return found


SPACE = byte_set(b"\x20\x09\x0a\x0b\x0c\x0d")
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and where each text begins and ends; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.empty(0, np.uint8), ends - ends[0]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def pieces(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about a megabyte of text; a row is never cut.

    Working arrays are several times as large as the text, so it is the bytes at a time, not
    the rows, that bound a worker's memory.
    """
    for batch in batches:
        _, ends = utf8(batch.column(text))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(ends, ends[start] + PIECE_BYTES, "right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def runs(inside: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each maximal run of marked bytes; a run never crosses texts."""
    if not len(inside):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    edge = np.zeros(len(inside) + 1, bool)
    edge[ends] = True
    begin = inside & (edge[:-1] | np.concatenate([[True], ~inside[:-1]]))
    end = inside & (edge[1:] | np.concatenate([~inside[1:], [True]]))
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def owner(positions: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The text each position lies in."""
    return np.searchsorted(ends, positions, "right") - 1


def named(data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A number for each string, the same for equal strings. ``data`` has them end to end."""
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    strings = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data)]
    )
    return strings.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def total(flags: np.ndarray) -> np.ndarray:
    """How many are marked before each position; one entry more than there are positions."""
    found = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=found[1:])
    return found


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (finaliser of splitmix64)."""
    x = values.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
