"""Choosing hash parameters from the data."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.config import KnnConfig
from vicinal.operators.hashing import HashFamily, extended_hash, key_values, project_points, projected_rows
from vicinal.session import Scratch

#: How much longer than the first key the longest is that a search may come to.
LONGER = 8


@dataclass(frozen=True)
class HashParameters:
    key_length: int
    tables: int
    max_comparisons: int
    radius: float


def default_key_length(n: int, dim: int) -> int:
    per_dim = n // max(dim, 1)
    return max(math.ceil(math.log2(per_dim)) + 1, 1) if per_dim > 0 else 1


def default_tables(dim: int, factor: float = 1.0) -> int:
    return max(math.floor(math.log2(max(dim, 1)) ** 2 * factor), 1)


def default_max_comparisons(n: int, dim: int, tables: int, factor: float = 1.0) -> int:
    """0 where the formula has no value; 0 asks for complete lists instead of a number of comparisons."""
    spread = math.log2(n / (dim * 0.1)) if n and dim else -1.0
    return abs(math.ceil(tables * math.sqrt(factor) * math.sqrt(spread))) if spread >= 0 else 0


def choose_parameters(
    points: DataFrame, n: int, dim: int, config: KnnConfig, scratch: Scratch | None = None
) -> HashParameters:
    """Fill in what the configuration leaves open."""
    key_length, radius = config.key_length, config.radius
    if key_length <= 0:
        first = HashFamily(dim, default_key_length(n, dim), 1, config.seed)
        key_length, radius = best_key_length(points, first, radius, scratch)
    tables = config.tables if config.tables > 0 else default_tables(dim, config.factor)
    comparisons = config.max_comparisons
    if comparisons <= 0:
        comparisons = default_max_comparisons(n, dim, tables, config.factor)
    return HashParameters(key_length, tables, comparisons, radius)


def longest_key(start: int) -> int:
    """The longest key that a search which begins at `start` may come to."""
    return 2 * start + LONGER


def bucket_statistics(projected: DataFrame, family: HashFamily, radii: list[float], lengths: list[int]) -> dict:
    """One record about bucket sizes for every radius (by its place) and length, from one pass over stored projections.

    `mode` is the number of buckets of the commonest size; mean and deviation are over the sizes that
    occur, each counted once. Where no two points share a bucket there is no record.
    """
    pairs = [(i, length) for i in range(len(radii)) for length in lengths]

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        components = family.tables * family.key_length
        shifts = family.shifts(np.arange(components))
        wanted = {pair: at for at, pair in enumerate(pairs)}
        for batch in batches:
            if not batch.num_rows:
                continue
            values = projected_rows(batch.column(0), components)
            for i, radius in enumerate(radii):
                keys = key_values(values, shifts, radius)
                prefix = np.zeros(len(keys), np.uint64)
                for length in range(1, max(lengths) + 1):
                    prefix = extended_hash(prefix, keys[:, length - 1])
                    if (at := wanted.get((i, length))) is not None:
                        found, count = np.unique(prefix.view(np.int64), return_counts=True)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(found), at, np.int32)), pa.array(found), pa.array(count)], ["pair", "prefix", "n"]
                        )

    prefixes = projected.select("projected").mapInArrow(hashes, "pair int, prefix bigint, n bigint")
    sizes = prefixes.groupBy("pair", "prefix").agg(F.sum("n").alias("size")).where(F.col("size") > 1)
    histogram = sizes.groupBy("pair", "size").agg(F.count(F.lit(1)).alias("buckets"))
    told = histogram.groupBy("pair").agg(
        F.sum("buckets").alias("buckets"),
        F.max("buckets").alias("mode"),
        F.avg("size").alias("mean"),
        F.stddev_pop("size").alias("deviation"),
        F.max("size").alias("largest"),
    )
    # One row for each pair that was asked for.
    return {pairs[row["pair"]]: row.asDict() for row in told.collect()}


def _widest_radius(projected: DataFrame, family: HashFamily, radius: float) -> list[float]:
    """`radius` doubled up to the first at which every point has one key."""
    components = family.tables * family.key_length

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full(components, np.inf), np.full(components, -np.inf)
        for batch in batches:
            if batch.num_rows:
                values = projected_rows(batch.column(0), components)
                low, high = np.minimum(low, values.min(axis=0)), np.maximum(high, values.max(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(components)), pa.array(low), pa.array(high)], ["c", "low", "high"])

    found = projected.select("projected").mapInArrow(ranges, "c bigint, low double, high double")
    rows = found.groupBy("c").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("c").collect()
    low, high = np.array([r["low"] for r in rows]), np.array([r["high"] for r in rows])
    shifts = family.shifts(np.arange(components))
    radii = [radius]
    while np.isfinite(high).all() and not np.array_equal(*(key_values(v, shifts, radii[-1]) for v in (low, high))):
        radii.append(2 * radii[-1])
    return radii


def best_key_length(points: DataFrame, family: HashFamily, radius: float, scratch: Scratch | None = None) -> tuple[int, float]:
    """Search a key length and a radius at which buckets are neither all tiny nor one huge one.

    Points are projected once, for the longest key the search may come to; one pass over the projections then tells
    the bucket sizes of all radii and lengths, through which the search walks. It ends for every table: at the
    longest key, or at the radius where all points share one bucket.
    """
    start = family.key_length
    family = replace(family, key_length=longest_key(start), tables=1)
    scratch = scratch or Scratch(points.sparkSession)
    projected = scratch.save(project_points(points.select("id", "features"), family).select("projected"), "tuning")
    radii = _widest_radius(projected, family, radius)
    lengths = [length for length in range(1, family.key_length + 1) if length % 2 == start % 2 and length >= start // 2]
    seen = bucket_statistics(projected, family, radii, lengths)
    at, length = walk(seen, start, len(radii), family.key_length)
    return length, radii[at]


def walk(seen: dict, start: int, radii: int, longest: int) -> tuple[int, int]:
    """The place of the radius and the key length that a search over bucket statistics ends at.

    The radius grows while no bucket forms or keys are down to half their first length. Keys grow shorter while most
    buckets have the commonest size and none stands out, and longer otherwise, in one direction only.
    """
    at, length = 0, start
    went_up = went_down = False
    while True:
        here = seen.get((at, length))
        wider = not went_up and (here is None or length < start // 2)
        if not wider and here is None:
            return at, max(length - 2, 1)
        if not wider:
            alike = here["largest"] < here["mean"] + 3 * here["deviation"] or here["deviation"] == 0
            if here["buckets"] * 0.5 < here["mode"] and alike:
                length -= 2
                went_down = True
                if went_up:
                    return at, max(length, 1)
                # No key is left to shorten: the next look is at twice the radius.
                wider = length < 1
            elif went_down or length + 2 > longest:
                return at, length
            else:
                length += 2
                went_up = True
        if wider:
            if at + 1 == radii:
                return at, start
            at, length = at + 1, start


def with_parameters(config: KnnConfig, chosen: HashParameters) -> KnnConfig:
    return replace(
        config,
        key_length=chosen.key_length,
        tables=chosen.tables,
        max_comparisons=chosen.max_comparisons,
        radius=chosen.radius,
    )
