"""Multivariate normal distributions: scoring tables and making them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vicinal.functions.distance import matrix
from vicinal.functions.stats import dim_stats

ROWS_PER_DRAW = 1024


@dataclass(frozen=True)
class Gaussian:
    mean: np.ndarray
    covariance: np.ndarray

    def __post_init__(self):
        mean = np.atleast_1d(np.asarray(self.mean, dtype=float))
        covariance = np.atleast_2d(np.asarray(self.covariance, dtype=float))
        if covariance.shape != (len(mean), len(mean)):
            raise ValueError(f"mean has {len(mean)} dimensions, covariance is {covariance.shape}")
        object.__setattr__(self, "mean", mean)
        object.__setattr__(self, "covariance", covariance)

    @classmethod
    def scalar(cls, mean: float, variance: float) -> Gaussian:
        return cls(np.array([mean]), np.array([[variance]]))

    @classmethod
    def standard(cls, dim: int) -> Gaussian:
        return cls(np.zeros(dim), np.eye(dim))

    @classmethod
    def fit(cls, points: DataFrame) -> Gaussian:
        """Mean and population covariance of a point table; only d and d*d numbers reach the driver."""
        means = {row["dim"]: row["mean"] for row in dim_stats(points).select("dim", "mean").toLocalIterator()}
        mean = np.array([means[i] for i in range(len(means))])
        dim = len(mean)

        def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total = 0, np.zeros((dim, dim))
            for batch in batches:
                if batch.num_rows:
                    gap = matrix(batch.column(0)) - mean
                    n, total = n + len(gap), total + gap.T @ gap
            if n:
                arrays = [pa.array(np.arange(dim * dim)), pa.array(total.ravel()), pa.array(np.full(dim * dim, n))]
                yield pa.RecordBatch.from_arrays(arrays, names=["at", "total", "n"])

        parts = points.select("features").mapInArrow(products, "at bigint, total double, n bigint")
        cells = parts.groupBy("at").agg((F.sum("total") / F.sum("n")).alias("v")).toPandas()
        return cls(mean, cells.sort_values("at")["v"].to_numpy().reshape(dim, dim))

    def density(self, features: Column | str) -> Column:
        """Probability density at each vector (or number) of a column; 0 or infinite where no double holds it."""
        return F.exp(self.log_density(features))

    def log_density(self, features: Column | str) -> Column:
        """Logarithm of the density, which is finite in any number of dimensions.

        The covariance's triangular factor, d * d numbers, goes to every task.
        """
        mean, factor = self.mean, np.linalg.cholesky(self.covariance)
        constant = -0.5 * len(mean) * np.log(2 * np.pi) - np.log(np.diag(factor)).sum()

        @F.arrow_udf(T.DoubleType())
        def log_pdf(column: pa.Array) -> pa.Array:
            if len(column) == 0:
                return pa.array([], pa.float64())
            if pa.types.is_floating(column.type) or pa.types.is_integer(column.type):
                x = column.to_numpy(zero_copy_only=False).astype(float)[:, None]
            else:
                x = matrix(column)
            even = np.linalg.solve(factor, (x - mean).T)
            return pa.array(constant - 0.5 * np.einsum("ji,ji->i", even, even))

        return log_pdf(features)

    def sample(self, spark: SparkSession, n: int, seed: int) -> DataFrame:
        """Draw n points with ids 0 to n-1. Rows depend on the seed and their id, not on partitions."""
        factor = np.linalg.cholesky(self.covariance)
        mean, dim = self.mean, len(self.mean)

        def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block in batch.column(0).to_pylist():
                    first = block * ROWS_PER_DRAW
                    rows = min(ROWS_PER_DRAW, n - first)
                    z = np.random.default_rng([seed, block]).standard_normal((ROWS_PER_DRAW, dim))[:rows]
                    x = z @ factor.T + mean
                    ends = pa.array(np.arange(rows + 1) * dim, pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.arange(first, first + rows)),
                            pa.array(np.zeros(rows)),
                            pa.ListArray.from_arrays(ends, pa.array(x.ravel())),
                        ],
                        names=["id", "label", "features"],
                    )

        blocks = -(-n // ROWS_PER_DRAW)
        return spark.range(blocks).mapInArrow(draw, "id bigint, label double, features array<double>")
