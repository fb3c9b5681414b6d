"""Rows of vectors as matrices, and merging of the best of many blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Whether a vector has components, none of them null, NaN or infinite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite, F.lit(False))


def widest(rows: DataFrame, column: str) -> int:
    """The number of components of the longest vector."""
    return int(rows.agg(F.max(F.size(column))).first()[0] or 0)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as doubles, one in a row; a shorter one counts as zero beyond its end."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (sizes == width).all():
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width))
    rows = np.repeat(np.arange(len(column)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def best_of_each(owner: np.ndarray, score: np.ndarray, name: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of every owner: by owner, then higher score, then smaller name."""
    order = np.lexsort((name, -score, owner))
    if not len(order):
        return order
    sorted_owner = owner[order]
    first = np.flatnonzero(np.append(True, sorted_owner[1:] != sorted_owner[:-1]))
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return order[rank < k]
