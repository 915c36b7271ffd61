"""Sparse vectors: `STRUCT<size, indices, values>` columns, and compressed rows of them in tasks.

Indices rise from 0 and stay below the size; what is not listed is zero. Distances, dot products and hash keys are those of
the same vectors written out in full, to the last bit, as adding zeros changes nothing and terms are added in the
order of the coordinates.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPARSE_TYPE = "struct<size:int,indices:array<int>,values:array<double>>"
#: Entries that a step works on at a time; bounds the temporary arrays of a task.
ENTRIES_AT_ONCE = 1 << 20


def is_sparse(points: DataFrame, column: str = "features") -> bool:
    return isinstance(points.schema[column].dataType, T.StructType)


def vector_size(points: DataFrame, column: str = "features") -> Column:
    """The dimension of each vector, null where it is null."""
    return F.col(f"{column}.size") if is_sparse(points, column) else F.size(column)


def vector_entries(points: DataFrame, column: str = "features") -> Column:
    """How many numbers each vector carries."""
    return F.size(f"{column}.indices") if is_sparse(points, column) else F.size(column)


def to_sparse(dense: Column) -> Column:
    """An array column as a sparse one: entries that are not zero."""
    pairs = F.filter(F.transform(dense, lambda x, i: F.struct(i.cast("int").alias("i"), x.cast("double").alias("x"))), lambda p: p["x"] != 0)
    made = F.struct(
        F.size(dense).alias("size"),
        F.transform(pairs, lambda p: p["i"]).alias("indices"),
        F.transform(pairs, lambda p: p["x"]).alias("values"),
    )
    return F.when(dense.isNotNull(), made)


def from_ml_vector(column: Column) -> Column:
    """A column of ML vectors, dense or sparse, as a sparse one; nothing is written out in full but dense vectors."""
    held = F.unwrap_udt(column)
    size = F.coalesce(held["size"], F.size(held["values"]))
    indices = F.coalesce(held["indices"], F.transform(held["values"], lambda x, i: i.cast("int")))
    return F.when(held.isNotNull(), F.struct(size.alias("size"), indices.alias("indices"), held["values"].alias("values")))


def sparse_dot(sparse: Column, dense: Column, shared: bool = False) -> Column:
    """Dot product of a sparse column with an array, as a native expression; with `shared` over the positions both have."""
    size = F.size(dense)
    term = F.zip_with(
        sparse["indices"], sparse["values"], lambda i, x: F.when(i < size, x.cast("double") * F.get(dense, i).cast("double")).otherwise(0.0)
    )
    total = F.aggregate(term, F.lit(0.0), lambda s, x: s + x)
    if shared:
        return total
    told = F.concat(F.lit("feature vectors differ in length: "), sparse["size"], F.lit(" and "), size)
    return F.when(sparse["size"] != size, F.raise_error(told)).otherwise(total)


@dataclass
class Rows:
    """Compressed rows: row r has the entries starts[r] to starts[r + 1]."""

    size: int
    starts: np.ndarray
    indices: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, column: pa.Array) -> Rows:
        """An Arrow struct column; refuses nulls, unequal sizes, unsorted or repeated indices, values that are not finite."""
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        if len(column) == 0:
            return cls(0, np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0))
        if column.null_count:
            raise ValueError("a feature vector is null")
        sizes, indices, values = (column.field(name) for name in ("size", "indices", "values"))
        if sizes.null_count or indices.null_count or values.null_count:
            raise ValueError("a feature vector is null")
        sizes = sizes.to_numpy(zero_copy_only=False)
        if sizes.min() != sizes.max():
            raise ValueError(f"feature vectors differ in length: {sizes.min()} and {sizes.max()}")
        counts = [np.diff(x.offsets.to_numpy()).astype(np.int64) for x in (indices, values)]
        if not np.array_equal(*counts):
            raise ValueError("a sparse vector has other numbers of indices and values")
        i, x = indices.flatten(), values.flatten()
        if i.null_count or x.null_count:
            raise ValueError("a feature vector holds a null")
        i, x = i.to_numpy(zero_copy_only=False).astype(np.int64), x.to_numpy(zero_copy_only=False).astype(np.float64)
        starts = np.append(0, np.cumsum(counts[0]))
        inside = np.ones(len(i), bool)
        inside[starts[:-1][counts[0] > 0]] = False
        if len(i) and (i.min() < 0 or i.max() >= sizes[0] or (np.diff(i)[inside[1:]] <= 0).any()):
            raise ValueError("indices of a sparse vector must rise and stay below its size")
        if not np.isfinite(x).all():
            raise ValueError("a feature vector holds a value that is not finite")
        return cls(int(sizes[0]), starts, i, x)

    def __len__(self) -> int:
        return len(self.starts) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.starts)

    def take(self, rows: np.ndarray) -> Rows:
        counts = self.counts[rows]
        at = runs(self.starts[:-1][rows], counts)
        return Rows(self.size, np.append(0, np.cumsum(counts)), self.indices[at], self.values[at])

    def squares(self) -> np.ndarray:
        """Squared norms, nearly."""
        return np.bincount(np.repeat(np.arange(len(self)), self.counts), self.values**2, len(self))


def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of every run, one run after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def fold_in_order(terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of runs of terms, each added one after the other from 0 as a loop would."""
    total = np.zeros(len(counts))
    order = np.argsort(-counts, kind="stable")
    begin = (np.cumsum(counts) - counts)[order]
    # The first `open_[t]` rows of that order have a term number t.
    open_ = np.searchsorted(-counts[order], -np.arange(1, counts.max(initial=0) + 1), side="right")
    for t, n in enumerate(open_.tolist()):
        total[order[:n]] += terms[begin[:n] + t]
    return total


def pair_squares(a: Rows, i: np.ndarray, b: Rows, j: np.ndarray) -> np.ndarray:
    """Squared distances of rows a[i] and b[j], term by term in the order of coordinates."""
    size = max(a.size, b.size, 1)
    out = np.zeros(len(i))
    work = np.cumsum(a.counts[i] + b.counts[j]) // ENTRIES_AT_ONCE
    for part in np.split(np.arange(len(i)), np.flatnonzero(np.diff(work)) + 1):
        if not len(part):
            continue
        x, y = a.take(i[part]), b.take(j[part])
        pair = np.concatenate([np.repeat(np.arange(len(part)), x.counts), np.repeat(np.arange(len(part)), y.counts)])
        place = pair * size + np.concatenate([x.indices, y.indices])
        # Of a coordinate both have, the entry of `a` comes first.
        order = np.argsort(place, kind="stable")
        place, value = place[order], np.concatenate([x.values, -y.values])[order]
        first = np.flatnonzero(np.append(True, place[1:] != place[:-1])[: len(place)])
        gap = np.add.reduceat(value, first) if len(first) else value
        out[part] = fold_in_order(gap * gap, np.bincount(place[first] // size, minlength=len(part)))
    return out


class Postings:
    """Rows by coordinate, for products of many rows with all of them."""

    #: A coordinate that more than this share of rows has is multiplied as a dense one.
    DENSE_SHARE = 0.25

    def __init__(self, rows: Rows):
        self.n = len(rows)
        row = np.repeat(np.arange(self.n), rows.counts)
        order = np.argsort(rows.indices, kind="stable")
        self.row, self.value = row[order], rows.values[order]
        self.coordinate, self.start, self.count = np.unique(rows.indices[order], return_index=True, return_counts=True)
        many = self.count > max(self.DENSE_SHARE * self.n, 8)
        self.dense_of = np.full(len(self.coordinate), -1)
        self.dense_of[many] = np.arange(many.sum())
        self.dense = np.zeros((int(many.sum()), self.n))
        at = runs(self.start[many], self.count[many])
        self.dense[np.repeat(np.arange(many.sum()), self.count[many]), self.row[at]] = self.value[at]

    def products(self, rows: Rows) -> np.ndarray:
        """Dot products of each of `rows` with each row here, nearly."""
        row = np.repeat(np.arange(len(rows)), rows.counts)
        at = np.searchsorted(self.coordinate, rows.indices)
        at[at == len(self.coordinate)] = 0
        met = (self.coordinate[at] == rows.indices) if len(self.coordinate) else np.zeros(len(at), bool)
        row, at, value = row[met], at[met], rows.values[met]
        kind = self.dense_of[at]
        common = kind >= 0
        left = np.zeros((len(rows), len(self.dense)))
        left[row[common], kind[common]] = value[common]
        out = left @ self.dense
        row, at, value = row[~common], at[~common], value[~common]
        work = np.cumsum(self.count[at]) // ENTRIES_AT_ONCE
        for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(work)) + 1):
            if len(part):
                count = self.count[at[part]]
                posting = runs(self.start[at[part]], count)
                cell = np.repeat(row[part], count) * self.n + self.row[posting]
                out += np.bincount(cell, np.repeat(value[part], count) * self.value[posting], out.size).reshape(out.shape)
        return out
