"""Keeping, merging and reshaping the nearest neighbours of each node."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(
    edges: DataFrame, k: int, node: str = "src", keep_ties: bool = False, repeats: int | None = 1
) -> DataFrame:
    """The k nearest distinct neighbours of each node (and group), nearest first in `rank`.

    Repeats of an edge share a dense rank, so the limit is applied map-side before the shuffle and the
    repeats are dropped after it, inside the same partitioning. An edge may come with up to `repeats`
    distances that differ, if only in their last bits: the limit then leaves room for them, and the smallest
    counts. None says that any number may, which takes a shuffle more. With `keep_ties` every neighbour as
    near as the k-th is kept.
    """
    other = "dst" if node == "src" else "src"
    keys = [node, "group_id"] if "group_id" in edges.columns else [node]
    plain = edges.select("src", *keys[1:], "dst", "distance")
    nodes = Window.partitionBy(*keys)
    if repeats is None:
        plain = plain.groupBy("src", *keys[1:], "dst").agg(F.min("distance").alias("distance"))
    elif repeats > 1 and not keep_ties:
        near = F.dense_rank().over(nodes.orderBy("distance", other))
        best = F.row_number().over(Window.partitionBy(*keys, other).orderBy("distance"))
        plain = (
            plain.withColumn("_near", near)
            .where(F.col("_near") <= k * repeats)
            .withColumn("_best", best)
            .where(F.col("_best") == 1)
            .drop("_near", "_best")
        )
    if keep_ties:
        return plain.distinct().withColumn("rank", F.rank().over(nodes.orderBy("distance"))).where(F.col("rank") <= k)
    ranked = plain.withColumn("rank", F.dense_rank().over(nodes.orderBy("distance", other)))
    return ranked.where(F.col("rank") <= k).distinct()


def merge_graphs(graphs: list[DataFrame | None], k: int) -> DataFrame | None:
    """One graph with the k nearest neighbours any of the graphs knows; None stands for no graph."""
    known = [g for g in graphs if g is not None]
    if not known:
        return None
    grouped = ["group_id"] if "group_id" in known[0].columns else []
    columns = ["src", *grouped, "dst", "distance"]
    return top_k(reduce(DataFrame.unionByName, [g.select(*columns) for g in known]), k, repeats=len(known))


def merge_counters(counters: list[DataFrame | None]) -> DataFrame | None:
    """Sum effort counters (id, viewed) per id."""
    known = [c for c in counters if c is not None]
    if not known:
        return None
    return reduce(DataFrame.unionByName, known).groupBy("id").agg(F.sum("viewed").alias("viewed"))


def merge_lists(first: Column, second: Column, k: int | Column) -> Column:
    """Merge two neighbour arrays of STRUCT<distance, id>: distinct ids, nearest first, at most k."""
    near = F.array_sort(F.array_distinct(F.concat(first, second)))
    ids = F.transform(near, lambda x: x["id"])
    # Of an id's entries the first is the nearest.
    return F.slice(F.filter(near, lambda x, i: F.array_position(ids, x["id"]) == i + 1), 1, k)


def to_adjacency(edges: DataFrame) -> DataFrame:
    """One row per node (and group) with its neighbours as an array of STRUCT<distance, id>."""
    keys = ["src", "group_id"] if "group_id" in edges.columns else ["src"]
    pair = F.struct("distance", F.col("dst").alias("id"))
    return edges.groupBy(*keys).agg(F.array_sort(F.collect_set(pair)).alias("neighbors"))


def to_edges(adjacency: DataFrame) -> DataFrame:
    """Distinct edge rows of an adjacency table."""
    keys = ["src", "group_id"] if "group_id" in adjacency.columns else ["src"]
    each = adjacency.select(*keys, F.explode(F.array_distinct("neighbors")).alias("n"))
    return each.select(*keys, F.col("n.id").alias("dst"), F.col("n.distance").alias("distance"))
