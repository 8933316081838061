"""Vector columns: which rows can be used, and Arrow lists as numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vec: Column) -> Column:
    """True for a vector that is not null and has only finite components."""
    def finite(x):
        d = x.cast("double")
        return x.isNotNull() & ~F.isnan(d) & (F.abs(d) < float("inf"))
    return F.coalesce(vec.isNotNull() & F.forall(vec, finite), F.lit(False))


def matrix(col: pa.Array | pa.ChunkedArray, dtype) -> np.ndarray:
    """Rows of a list column, all of one length, as a matrix."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    flat = col.flatten().to_numpy(zero_copy_only=False)
    n = len(col)
    return np.ascontiguousarray(flat, dtype=dtype).reshape(n, len(flat) // n if n else 0)


def directions(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in double precision and safe against overflow."""
    if not x.size:
        return x
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
