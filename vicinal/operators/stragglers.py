"""Points the hashing rounds left without enough comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.functions.distance import SQUARED_EUCLIDEAN, Distance
from vicinal.operators.buckets import bucketize
from vicinal.operators.exact import knn_against


def reverse_lists(edges: DataFrame, stragglers: DataFrame) -> DataFrame:
    """For each straggler p an id list: p, the nodes whose lists hold p, and those lists.

    In a grouped graph only the list of p's own group can hold p, and only that list is taken.
    """
    group = ["group_id"] if "group_id" in edges.columns else []
    wanted = stragglers.select(F.col("id").alias("dst")).distinct()
    holders = edges.select("src", *group, "dst").join(wanted, "dst").withColumnRenamed("dst", "list_id")
    neighbors = holders.join(edges.select("src", *group, "dst"), ["src", *group])
    return (
        holders.select("list_id", F.explode(F.array("src", "list_id")).alias("id"))
        .unionByName(neighbors.select("list_id", F.col("dst").alias("id")))
        .distinct()
    )


def sized_reverse_lists(edges: DataFrame, stragglers: DataFrame) -> DataFrame:
    """The same with each list's size, as the bucket operators take it."""
    return bucketize(reverse_lists(edges, stragglers), by=["list_id"])


def straggler_exhaustive(
    points: DataFrame,
    stragglers: DataFrame,
    edges: DataFrame,
    k: int,
    group_col: str | None = None,
    distance: Distance = SQUARED_EUCLIDEAN,
    each_other: bool = False,
) -> DataFrame:
    """The k nearest of each straggler among all nodes of the graph, and with `each_other` among stragglers."""
    ids = edges.select(F.col("src").alias("id"))
    if each_other:
        ids = ids.unionByName(stragglers.select("id"))
    nodes = points.join(ids.distinct(), "id", "left_semi")
    sources = points.join(stragglers.select("id").distinct(), "id", "left_semi")
    return knn_against(sources, nodes, k, group_col, distance)
