"""Distances between vectors, as columns and as NumPy blocks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vicinal.functions.sparse import Rows, pair_squares, vector_size


def matrix(column: pa.Array) -> np.ndarray:
    """An Arrow list column as a float64 matrix; rows must have one length and finite values."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    if rows == 0:
        return np.empty((0, 0))
    if column.null_count:
        raise ValueError("a feature vector is null")
    lengths = pc.min_max(pc.list_value_length(column)).as_py()
    if lengths["min"] != lengths["max"]:
        raise ValueError(f"feature vectors differ in length: {lengths['min']} and {lengths['max']}")
    values = column.flatten()
    if values.null_count:
        raise ValueError("a feature vector holds a null")
    x = values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(rows, lengths["min"])
    if not np.isfinite(x).all():
        raise ValueError("a feature vector holds a value that is not finite")
    return x


def fold_squares(left: np.ndarray, right: np.ndarray, i=slice(None), j=slice(None)) -> np.ndarray:
    """Squared distances of rows left[i] and right[j], given transposed (dimension first).

    Adds one dimension after another, as the column form does, so both give the same bits.
    """
    total = 0.0
    for x, y in zip(left, right):
        gap = x[i] - y[j]
        total = total + gap * gap
    return total


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two array columns, as a native expression."""
    gaps = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return _of_one_length(a, b, F.aggregate(gaps, F.lit(0.0), lambda total, gap: total + gap * gap))


def _of_one_length(a: Column, b: Column, value: Column) -> Column:
    """`value`, or a failure where the arrays differ in length; null where one is null."""
    told = F.concat(F.lit("feature vectors differ in length: "), F.size(a), F.lit(" and "), F.size(b))
    return F.when(F.size(a) != F.size(b), F.raise_error(told)).otherwise(value)


def squares_of_rows(a: pa.Array, b: pa.Array) -> pa.Array:
    """Squared distances of two Arrow columns of vectors, row by row."""
    if len(a) == 0:
        return pa.array([], pa.float64())
    if pa.types.is_struct(a.type):
        x, y = Rows.of(a), Rows.of(b)
        if x.size != y.size:
            raise ValueError(f"feature vectors differ in length: {x.size} and {y.size}")
        every = np.arange(len(a))
        return pa.array(pair_squares(x, every, y, every))
    x, y = matrix(a), matrix(b)
    if x.shape[1] != y.shape[1]:
        raise ValueError(f"feature vectors differ in length: {x.shape[1]} and {y.shape[1]}")
    return pa.array(fold_squares(np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)))


@F.arrow_udf(T.DoubleType())
def _squared_distance_arrow(a: pa.Array, b: pa.Array) -> pa.Array:
    return squares_of_rows(a, b)


def dot_product(a: Column, b: Column, shared: bool = False) -> Column:
    """Dot product of two arrays of one length; with `shared` over the positions both have."""
    if shared:
        size = F.least(F.size(a), F.size(b))
        a, b = F.slice(a, 1, size), F.slice(b, 1, size)
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return _of_one_length(a, b, F.aggregate(products, F.lit(0.0), lambda total, x: total + x))


@dataclass(frozen=True)
class Distance:
    """A distance: `column` for given pairs, `block` for all rows of one matrix against another, and where vectors
    are sparse `sparse_block` for all compressed rows against others.

    `symmetric` says that swapping the sides changes no bit, which halves the work between blocks. `nearly(b)` may give a
    function of `a` that tells the same matrix roughly, and twice what it may be off at most; `of_rows` then measures pairs, row by
    row, with the bits of `block`.
    """

    name: str
    column: Callable[[Column, Column], Column]
    block: Callable[[np.ndarray, np.ndarray], np.ndarray]
    sparse_block: Callable[[Rows, Rows], np.ndarray] | None = None
    symmetric: bool = False
    nearly: Callable[[np.ndarray], Callable[[np.ndarray], tuple[np.ndarray, float]]] | None = None
    of_rows: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None


SQUARED_EUCLIDEAN = Distance(
    "squared_euclidean",
    _squared_distance_arrow,
    lambda a, b: fold_squares(a.T[:, :, None], b.T[:, None, :]),
)


def dimension(points: DataFrame) -> DataFrame:
    """The largest vector length, as one row."""
    return points.agg(F.max(vector_size(points)).alias("dimension"))
