"""Nearest neighbours over pairs of ids the caller supplies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.functions.distance import SQUARED_EUCLIDEAN, Distance
from vicinal.operators.ends import with_ends
from vicinal.operators.topk import top_k
from vicinal.sources.points import found_or


def pair_distances(
    points: DataFrame,
    pairs: DataFrame,
    group_col: str | None = None,
    distance: Distance = SQUARED_EUCLIDEAN,
    first: str = "src",
    missing: str = "error",
    block_rows: int | None = None,
) -> DataFrame:
    """The distance of every pair (src, dst), with the group of dst if wanted.

    Vectors travel by blocks (`ends.with_ends`). `first` is the end results are kept for. A pair of an id without
    a point fails the job, or with `missing="drop"` is left out.
    """
    group = [] if group_col is None else [F.col(group_col).cast("int").alias("group_id")]
    sources, targets = points.select("id", "features"), points.select("id", "features", *group)
    measured = distance is SQUARED_EUCLIDEAN
    met = with_ends(pairs.select("src", "dst"), sources, targets, missing, measured, first, block_rows)
    if measured:
        return met.select("src", *([F.col("group_b").alias("group_id")] if group else []), "dst", "distance")
    a = found_or(missing, F.col("_a.features"), F.col("src"))
    b = found_or(missing, F.col("_b.features"), F.col("dst"))
    named = [F.col("_b.group_id").alias("group_id")] if group else []
    return met.select("src", *named, "dst", distance.column(a, b).alias("distance"))


def knn_from_pairs(
    points: DataFrame,
    pairs: DataFrame,
    k: int,
    group_col: str | None = None,
    distance: Distance = SQUARED_EUCLIDEAN,
    missing: str = "error",
) -> DataFrame:
    """Of the pairs given for each source, the k nearest (per group of the neighbour)."""
    return top_k(pair_distances(points, pairs, group_col, distance, missing=missing), k)


def pairs_viewed(pairs: DataFrame) -> DataFrame:
    """Effort counter of given pairs: one comparison for each pair of a source."""
    return pairs.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("viewed"))


def knn_connections(
    points: DataFrame,
    connections: DataFrame,
    k: int,
    keep_ties: bool = False,
    distance: Distance = SQUARED_EUCLIDEAN,
    missing: str = "error",
) -> DataFrame:
    """Along given connections (src, dst), the k nearest sources of each dst."""
    measured = pair_distances(points, connections, None, distance, first="dst", missing=missing)
    return top_k(measured, k, node="dst", keep_ties=keep_ties)
