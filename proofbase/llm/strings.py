"""Strings cut out of texts as Arrow arrays, so that equal ones meet exactly and not by a hash."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def cut(data: np.ndarray, inside: np.ndarray, start: np.ndarray) -> pa.Array:
    """The strings that begin at each of start and hold the inside bytes up to the next one."""
    before = np.cumsum(inside)
    offsets = np.append(before[start] - 1, before[-1] if len(before) else 0).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[inside])))


def begins(inside: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where a run of inside bytes begins; none goes on from one row to the next."""
    found = inside.copy()
    found[1:] &= ~inside[:-1]
    edge = at[:-1][at[:-1] < at[1:]]
    found[edge] = inside[edge]
    return found


def encoded(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Each value's place among the distinct ones, and these."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    held = values.dictionary_encode()
    return held.indices.to_numpy(zero_copy_only=False).astype(np.int64), held.dictionary
