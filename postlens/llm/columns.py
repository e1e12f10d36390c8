"""Arrow text columns as flat numpy buffers: whole batches are handled at once, without a Python string per row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

WHITESPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(WHITESPACE)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and the row offsets (len + 1); null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def row_starts(size: int, offsets: np.ndarray) -> np.ndarray:
    """True at the first byte of each row, and one past the last byte."""
    at = np.zeros(size + 1, bool)
    at[offsets] = True
    return at


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte spans [start, end) of the words (runs of non-space bytes within a row), and each row's word offsets."""
    solid = ~IS_SPACE[data]
    first = row_starts(len(data), offsets)
    before = np.zeros(len(data), bool)
    before[1:] = solid[:-1]
    before &= ~first[:-1]
    starts = np.flatnonzero(solid & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = solid[1:]
    after &= ~first[1:]
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def distinct_values(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Dictionary-encode the byte strings that tile ``data``: index of each, and the distinct strings."""
    if len(offsets) < 2:
        return np.zeros(0, np.int32), pa.array([], pa.large_binary())
    offsets = np.ascontiguousarray(offsets, np.int64)
    data = np.ascontiguousarray(data)
    array = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    coded = array.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def binary_buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a large_binary array."""
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, np.int64)[array.offset:array.offset + len(array) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def distinct_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Index of each word and the distinct words (bytes)."""
    lengths = ends - starts
    keep = np.zeros(len(data) + 1, np.int8)
    keep[starts] += 1
    keep[ends] -= 1
    packed = data[np.cumsum(keep[:-1], dtype=np.int8).astype(bool)]
    return distinct_values(packed, np.concatenate([[0], np.cumsum(lengths)]))


def slices(column: pa.Array, most_bytes: int = 16 << 20):
    """(begin, end) row ranges of at most ``most_bytes`` of text; a longer row stands alone, whole."""
    _, offsets = text_buffers(column)
    at = 0
    while at < len(offsets) - 1:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most_bytes, "right")) - 1)
        yield at, end
        at = end


def as_table(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
