"""What the operators on vectors share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(embedding: str = "embedding") -> Column:
    """Not null, not empty, all components finite numbers, not all zero."""
    v = F.col(embedding).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def finite(embedding: str = "embedding") -> Column:
    """Not null and all components finite numbers; empty and zero vectors are fine."""
    v = F.col(embedding).cast("array<double>")
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def whole_numbers(vectors: np.ndarray, scale: int, most: int) -> np.ndarray:
    """floor(scale * component) as integers, held within ``most`` in size."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(vectors * scale), -most, most).astype(np.int64)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column of equal lengths as doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
