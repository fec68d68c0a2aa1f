"""What the two operators on embeddings share: finite vectors as exact integers."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: From this size on a double is a whole number.
_WHOLE = 2.0**53


def finite(vector: Column) -> Column:
    """True for a vector that isn't null and has neither null nor non-finite components (true for an empty one)."""
    return F.coalesce(F.forall(vector.cast("array<double>"), lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x)), F.lit(False))


def finite_vectors(table: DataFrame, *names: str) -> DataFrame:
    """vec_id as long, ``names``, and the components as doubles of all rows whose vector takes part."""
    return table.where(finite(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), *names, F.col("embedding").cast("array<double>").alias("embedding"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Arrow lists as rows of doubles; shorter vectors are filled up with zeros."""
    values = np.asarray(column.flatten(), dtype=np.float64)
    sizes = np.asarray(pa.compute.list_value_length(column), dtype=np.int64)
    if len(sizes) and (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def scaled_floor(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) for a power of two ``scale``: int64, or Python integers where these are too small.

    A power of two scales a double exactly.
    """
    if not x.size or np.abs(x).max() * scale < 2.0**62:
        return np.floor(x * scale).astype(np.int64)
    whole = [math.floor(v * scale) if abs(v) < _WHOLE else int(v) * scale for v in x.ravel().tolist()]
    out = np.empty(x.size, dtype=object)
    out[:] = whole
    return out.reshape(x.shape)


def as_longs(values: np.ndarray) -> pa.Array:
    """Integers of any size as longs; null where a long can't hold one."""
    if values.dtype != object:
        return pa.array(values, pa.int64())
    return pa.array([int(v) if -(2**63) <= v < 2**63 else None for v in values.tolist()], pa.int64())
