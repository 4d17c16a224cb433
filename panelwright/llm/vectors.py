"""What the operators on embeddings share: which vectors take part, and matrices of Arrow columns."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vec: Column) -> Column:
    """False for null vectors and those with a null, NaN or infinite component; never null."""
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return vec.isNotNull() & F.coalesce(fine, F.lit(False))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors as rows of doubles; shorter ones end in zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (lengths == dims).all():
        return values.reshape(len(lengths), dims)
    out = np.zeros((len(lengths), dims))
    out[np.arange(dims) < lengths[:, None]] = values
    return out


def scaled(column: pa.Array, dims: int, scale: float, limit: int | None = None) -> np.ndarray:
    """floor(scale * x) in doubles, each a whole number; beyond ``limit`` it stays at the limit."""
    out = np.floor(scale * matrix(column, dims))
    return out if limit is None else np.clip(out, -float(limit), float(limit))
