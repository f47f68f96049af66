"""Vectors of integers in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are numbers."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False))


def scaled(vector: Column, scale: int, most: int) -> Column:
    """floor(scale * x) of each component as an int, held between ``-most`` and ``most``."""
    return F.transform(vector, lambda x: F.greatest(F.least(F.floor(x.cast("double") * scale), F.lit(most)), F.lit(-most)).cast("int"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A column of int vectors of one length as a matrix."""
    return np.asarray(column.flatten()).reshape(-1, dims)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of integers, exact: in floating point where all sums stay under 2**53, else in integers."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def blocks_of(df: DataFrame, size: int) -> int:
    """How many blocks of about ``size`` rows a table has, one at least."""
    return max(1, -(-df.count() // size))
