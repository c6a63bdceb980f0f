"""Exact integer vectors from Arrow list columns, used inside tasks."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa


def safe(dim: int) -> int:
    """Components below this stay exact in int64 through differences, their squares and sums over ``dim`` of them."""
    return math.isqrt((1 << 60) // max(dim, 1))


def finite_rows(column: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, values, offsets): the rows whose vector is not null (and has ``dim`` components, if given)
    and holds no null or non-finite component, and their components one after the other as doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()  # the components of the rows that are not null
    values = flat.cast(pa.float64()).fill_null(math.nan).to_numpy(zero_copy_only=False)
    ends = np.cumsum(np.maximum(size, 0))
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    keep = (size >= 0) & (bad[ends] == bad[ends - np.maximum(size, 0)])
    if dim is not None:
        keep &= size == dim
    row = np.flatnonzero(keep)
    inside = np.repeat(keep[size >= 0], size[size >= 0])
    return row, values[inside], np.concatenate([[0], np.cumsum(size[row])])


def scaled(values: np.ndarray, scale: int, dim: int) -> np.ndarray:
    """floor(scale * x) of doubles, exactly: int64, or Python integers where one is not ``safe`` in vectors of ``dim``."""
    if not len(values) or np.abs(values).max() < safe(dim) / scale - 1:
        return np.floor(values * scale).astype(np.int64)
    out = np.empty(len(values), object)
    out[:] = [math.floor(v) * scale + math.floor((v - math.floor(v)) * scale) for v in values.tolist()]
    return out
