"""Integer vectors of a table of embeddings, and exact sums of their products."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components stop at this magnitude, so that squared distances fit a long.
LIMIT = 1 << 26
#: Below this magnitude sums of products of a few thousand components are exact in doubles.
EXACT = 1 << 20


def usable(vector: Column) -> Column:
    """Not null, and no component null or not finite."""
    wrong = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vector.isNotNull() & ~wrong


def integers(vector: Column, scale: int = 1024) -> Column:
    """``floor(scale * x)`` of every component as a double, within plus or minus ``LIMIT``."""
    return F.transform(vector, lambda v: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(v.cast("double") * scale))).cast("int"))


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of an Arrow list column as an int64 matrix; shorter vectors end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (size == width).all():
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A matrix as an Arrow list column."""
    n, width = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(x.reshape(-1)).cast(kind))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows: by doubles where those hold every partial sum."""
    top = max((int(np.abs(m).max(initial=0)) for m in (a, b)), default=0)
    if top <= EXACT and a.shape[1] <= 1 << 12:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def profile(rows: DataFrame, x: str = "x") -> tuple[int, int]:
    """Number of rows and the greatest length of their vectors."""
    r = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(x)).alias("width")).first()
    return r.n, r.width or 0
