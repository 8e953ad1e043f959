"""Vectors as numpy blocks, shared by the embedding operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F


def usable(embedding: str = "embedding") -> Column:
    """Not null, not empty, and no null, NaN or infinite component."""
    x = F.col(embedding)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == F.lit(float("inf"))))
    return x.isNotNull() & (F.size(x) > 0) & ~F.coalesce(bad, F.lit(True))


def matrix(column: pa.ChunkedArray | pa.Array, dtype: type) -> np.ndarray:
    """A list column without nulls whose lists have one length, as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    return values.reshape(len(column), -1)
