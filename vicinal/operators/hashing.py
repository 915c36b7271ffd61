"""Seeded p-stable hashing: floor((a.x / radius + b) / w), several components to a key."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vicinal.functions.distance import matrix
from vicinal.functions.sparse import Rows

# The bucket width, and the sizes of a family nobody tuned.
WIDTH = 4
DEFAULT_TABLES = 5
DEFAULT_KEY_LENGTH = 3

HASH_SCHEMA = "id bigint, table_id int, key array<int>"
#: Coefficients of projections, and projected values, that a task holds at a time.
COEFFICIENTS_AT_ONCE, VALUES_AT_ONCE = 4 << 20, 1 << 15
#: Projected values that leave a task, or come to it, together; long keys of many tables would make large batches.
VALUES_TOGETHER = 1 << 19
_STEP = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    """Random-looking bits of each 64-bit number."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(bits: np.ndarray) -> np.ndarray:
    """Numbers above 0 and up to 1."""
    return ((bits >> np.uint64(11)).astype(np.float64) + 1.0) / float(1 << 53)


@dataclass(frozen=True)
class HashFamily:
    """Random projections, drawn from the seed wherever they are needed, so none are shipped.

    A coefficient depends on (seed, generation, table, component, coordinate) alone: a shorter key is a prefix of a
    longer one, fewer tables are the first of more, and sparse vectors draw only the coordinates they have.
    """

    dim: int
    key_length: int = DEFAULT_KEY_LENGTH
    tables: int = DEFAULT_TABLES
    seed: int = 0
    generation: int = 0
    share_tables: bool = False

    def _streams(self, table: np.ndarray, component: np.ndarray) -> np.ndarray:
        """A 64-bit number for each (table, component)."""
        with np.errstate(over="ignore"):
            state = _mixed(np.uint64(self.seed % (1 << 64)) + np.uint64(_STEP)) + np.zeros(len(table), np.uint64)
            for part in (np.full(len(table), self.generation), table, component):
                state = _mixed(state + (part.astype(np.uint64) + np.uint64(1)) * np.uint64(_STEP))
        return state

    def coefficients(self, components: np.ndarray, coordinates: np.ndarray) -> np.ndarray:
        """N(0, 1) for each of `components` (numbered through all tables) and each coordinate, counted from 0."""
        streams = self._streams(components // self.key_length, components % self.key_length)
        with np.errstate(over="ignore"):
            at = (2 * coordinates.astype(np.uint64) + np.uint64(2)) * np.uint64(_STEP)
            one, two = (_uniform(_mixed(streams[:, None] + at + np.uint64(k) * np.uint64(_STEP))) for k in (0, 1))
        return np.sqrt(-2.0 * np.log(one)) * np.cos(2.0 * np.pi * two)

    def shifts(self, components: np.ndarray) -> np.ndarray:
        """U(0, w) for each of `components`."""
        with np.errstate(over="ignore"):
            streams = self._streams(components // self.key_length, components % self.key_length) + np.uint64(_STEP)
        return WIDTH * _uniform(_mixed(streams))

    def projections(self) -> tuple[np.ndarray, np.ndarray]:
        """Directions (tables, key_length, dim) ~ N(0, 1) and offsets (tables, key_length) ~ U(0, w), written out."""
        every = np.arange(self.tables * self.key_length)
        shape = (self.tables, self.key_length)
        return self.coefficients(every, np.arange(self.dim)).reshape(*shape, self.dim), self.shifts(every).reshape(shape)

    def update(self, key_length: int, tables: int) -> HashFamily:
        """A fresh family of another size."""
        return replace(self, key_length=key_length, tables=tables, generation=self.generation + 1)

    def project(self, x: np.ndarray | Rows) -> np.ndarray:
        """a.x of every row and component, terms added in the order of the coordinates: dense and sparse rows give
        the same bits, and rows the same whatever comes with them."""
        out = np.zeros((len(x), self.tables * self.key_length))
        if isinstance(x, Rows):
            self._project_sparse(x, out)
        elif len(x):
            self._project_dense(x, out)
        return out

    def _project_dense(self, x: np.ndarray, out: np.ndarray) -> None:
        width = max(1, COEFFICIENTS_AT_ONCE // max(self.dim, 1))
        for first in range(0, out.shape[1], width):
            components = np.arange(first, min(first + width, out.shape[1]))
            a = np.ascontiguousarray(self.coefficients(components, np.arange(self.dim)).T)
            step = max(1, VALUES_AT_ONCE // len(components))
            term = np.empty((step, len(components)))
            for at in range(0, len(x), step):
                part = np.ascontiguousarray(x[at : at + step, : self.dim].T)
                total, term_ = np.zeros((part.shape[1], len(components))), term[: part.shape[1]]
                for value, direction in zip(part, a, strict=True):
                    np.multiply(value[:, None], direction, out=term_)
                    total += term_
                out[at : at + step, components] = total

    def _project_sparse(self, x: Rows, out: np.ndarray) -> None:
        used = x.indices < self.dim
        counts = np.bincount(np.repeat(np.arange(len(x)), x.counts)[used], minlength=len(x))
        coordinates, place = np.unique(x.indices[used], return_inverse=True)
        values = x.values[used]
        width = max(1, COEFFICIENTS_AT_ONCE // max(len(coordinates), 1))
        order = np.argsort(-counts, kind="stable")
        begin = (np.cumsum(counts) - counts)[order]
        open_ = np.searchsorted(-counts[order], -np.arange(1, counts.max(initial=0) + 1), side="right").tolist()
        for first in range(0, out.shape[1], width):
            components = np.arange(first, min(first + width, out.shape[1]))
            a = np.ascontiguousarray(self.coefficients(components, coordinates).T)
            total = np.zeros((len(x), len(components)))
            # The t-th entry of every row that has one, t after t.
            for t, n in enumerate(open_):
                entry = begin[:n] + t
                total[:n] += values[entry, None] * a[place[entry]]
            out[order[:, None], components] = total


@dataclass(frozen=True)
class GivenFamily(HashFamily):
    """A family whose projections the caller states."""

    directions: tuple = ()
    offsets: tuple = ()

    @classmethod
    def of(cls, directions, offsets) -> GivenFamily:
        a = np.asarray(directions, dtype=float)
        return cls(a.shape[2], a.shape[1], a.shape[0], directions=tuple(a.ravel()), offsets=tuple(np.ravel(offsets)))

    def coefficients(self, components: np.ndarray, coordinates: np.ndarray) -> np.ndarray:
        return np.reshape(self.directions, (-1, self.dim))[np.ix_(components, coordinates)]

    def shifts(self, components: np.ndarray) -> np.ndarray:
        return np.asarray(self.offsets, dtype=float)[components]


def vectors_in(column: pa.Array, family: HashFamily, leading: bool = False) -> np.ndarray | Rows:
    """An Arrow column of vectors, checked against the family's dimension."""
    x = Rows.of(column) if pa.types.is_struct(column.type) else matrix(column)
    size = x.size if isinstance(x, Rows) else x.shape[1]
    if size < family.dim or (size > family.dim and not leading):
        raise ValueError(f"feature vectors have length {size}, hashing needs {family.dim}")
    return x


def key_values(projected: np.ndarray, shifts: np.ndarray, radius: float) -> np.ndarray:
    """Components of keys; those beyond 32 bits are set to the nearest that fits."""
    bounds = np.iinfo(np.int32)
    return np.clip(np.floor((projected / radius + shifts) / WIDTH), bounds.min, bounds.max).astype(np.int32)


def extended_hash(prefix: np.ndarray, component: np.ndarray) -> np.ndarray:
    """64-bit hashes of keys that are one component longer, from those of the keys."""
    with np.errstate(over="ignore"):
        return _mixed((prefix + np.uint64(_STEP)) ^ component.astype(np.int64).view(np.uint64))


def _key_batch(ids: np.ndarray, keys: np.ndarray, family: HashFamily) -> pa.RecordBatch:
    tables = np.zeros(family.tables) if family.share_tables else np.arange(family.tables)
    ends = pa.array(np.arange(len(ids) * family.tables + 1, dtype=np.int64) * family.key_length, pa.int32())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.repeat(ids, family.tables), pa.int64()),
            pa.array(np.tile(tables, len(ids)).astype(np.int32)),
            pa.ListArray.from_arrays(ends, pa.array(keys.ravel())),
        ],
        names=["id", "table_id", "key"],
    )


def slices(batches: Iterator[pa.RecordBatch], components: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows that their projected values stay bounded; none is empty."""
    rows = max(1, VALUES_TOGETHER // max(components, 1))
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _checked(radius: float) -> None:
    if not radius > 0:
        raise ValueError(f"radius must be positive, got {radius}")


def hash_points(points: DataFrame, family: HashFamily, radius: float, leading: bool = False) -> DataFrame:
    """One row per point and table: `id, table_id, key`. Runs inside the scan's partitions.

    Vectors, dense or sparse, must have the family's dimension; with `leading` they may be longer, and only their first
    positions are hashed. Keys beyond 32 bits are set to the nearest that fits, so very far
    buckets at a very small radius meet there.
    """
    _checked(radius)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shifts = family.shifts(np.arange(family.tables * family.key_length))
        for batch in slices(batches, family.tables * family.key_length):
            projected = family.project(vectors_in(batch.column(1), family, leading))
            yield _key_batch(batch.column(0).to_numpy(zero_copy_only=False), key_values(projected, shifts, radius), family)

    return points.select(F.col("id").cast("bigint"), "features").mapInArrow(hashes, HASH_SCHEMA)


def project_points(points: DataFrame, family: HashFamily) -> DataFrame:
    """The points with `projected`: a.x of all components, table after table, as little-endian doubles.

    Written once, it gives the keys of every radius (`hash_projected`), and of every shorter length.
    """
    schema = T.StructType([*points.schema.fields, T.StructField("projected", T.BinaryType())])
    at = points.columns.index("features")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, family.tables * family.key_length):
            values = family.project(vectors_in(batch.column(at), family)).astype("<f8", copy=False)
            stored = pa.array([row.tobytes() for row in values], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, stored], names=schema.names)

    return points.mapInArrow(run, schema)


def projected_rows(column: pa.Array, components: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), components)


def hash_projected(projected: DataFrame, family: HashFamily, radius: float) -> DataFrame:
    """The same rows as `hash_points` at any radius, from stored projections."""
    _checked(radius)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        components = family.tables * family.key_length
        shifts = family.shifts(np.arange(components))
        for batch in slices(batches, components):
            keys = key_values(projected_rows(batch.column(1), components), shifts, radius)
            yield _key_batch(batch.column(0).to_numpy(zero_copy_only=False), keys, family)

    return projected.select(F.col("id").cast("bigint"), "projected").mapInArrow(hashes, HASH_SCHEMA)
