"""Views of Arrow string buffers as numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def string_column(column) -> pa.LargeStringArray:
    """One contiguous large_string array without nulls (null becomes empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return column.cast(pa.large_string()).fill_null("")


def raw_bytes(column: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows in sequence and the row offsets in them."""
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def code_points(column: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all rows, row offsets in code points, byte position of each code point (and the end), the bytes."""
    data, at = raw_bytes(column)
    lead = (data & 0xC0) != 0x80
    chars = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    byte_at = np.append(np.flatnonzero(lead), len(data))
    return chars, np.searchsorted(byte_at, at), byte_at, data


def slices(lengths: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Row ranges whose summed length stays within ``most`` (a single longer row is a range of its own)."""
    out, start, used = [], 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > start and used + n > most:
            out.append((start, i))
            start, used = i, 0
        used += n
    if start < len(lengths):
        out.append((start, len(lengths)))
    return out


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start+1, ... of each range, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
