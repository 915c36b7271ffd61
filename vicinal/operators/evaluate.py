"""Comparing an approximate graph with an exact one, and describing a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def restrict(edges: DataFrame, id_below: int | None) -> DataFrame:
    """Edges of nodes with a small id, for a quick look."""
    return edges if id_below is None else edges.where(F.col("src") < id_below)


def _side_by_side(exact: DataFrame, approx: DataFrame, id_below: int | None) -> DataFrame:
    """Edges of both graphs tagged with the graph they come from, placed by node."""
    tagged = [
        restrict(g, id_below).select("src", "dst", "distance", F.lit(e).alias("in_exact"), F.lit(1 - e).alias("in_approx"))
        for g, e in ((exact, 1), (approx, 0))
    ]
    return tagged[0].unionByName(tagged[1]).repartition("src")


def _overlap(both: DataFrame) -> DataFrame:
    """Per node the neighbours in each graph and in both; no shuffle beyond the one by node."""
    ids = both.groupBy("src", "dst").agg(F.max("in_exact").alias("e"), F.max("in_approx").alias("a"))
    return ids.groupBy("src").agg(
        F.sum("e").alias("exact_size"), F.sum("a").alias("approx_size"), F.sum(F.col("e") * F.col("a")).alias("hits")
    )


def recall(exact: DataFrame, approx: DataFrame, k: int, id_below: int | None = None) -> DataFrame:
    """Share of the k exact neighbours found, averaged over nodes both graphs have."""
    nodes = _overlap(_side_by_side(exact, approx, id_below))
    shared = (F.col("exact_size") > 0) & (F.col("approx_size") > 0)
    return nodes.agg(
        (F.avg(F.when(shared, F.col("hits"))) / F.lit(k)).alias("recall"),
        F.lit(k).alias("k"),
        F.count(F.when(shared, 1)).alias("nodes_compared"),
        F.count(F.when(F.col("approx_size") == 0, 1)).alias("nodes_missing"),
    )


def missed_edges(exact: DataFrame, approx: DataFrame, id_below: int | None = None) -> DataFrame:
    """Edges only one graph has, for shared nodes whose approximate list is not all in the exact one.

    Edges differ if id or distance differs. Each row carries the node's largest distance in both graphs.
    Everything happens inside the one placement by node.
    """
    node, pair = Window.partitionBy("src"), Window.partitionBy("src", "dst")
    edges = (
        _side_by_side(exact, approx, id_below)
        .groupBy("src", "dst", "distance")
        .agg(F.max("in_exact").alias("e"), F.max("in_approx").alias("a"))
        .withColumn("_e", F.max("e").over(pair))
        .withColumn("_a", F.max("a").over(pair))
        .withColumn("_first", F.row_number().over(pair.orderBy("distance")) == 1)
    )
    once = lambda flag: F.sum(F.when(F.col("_first"), flag).otherwise(0)).over(node)
    return (
        edges.withColumn("_exact", once(F.col("_e")))
        .withColumn("_approx", once(F.col("_a")))
        .withColumn("_hits", once(F.col("_e") * F.col("_a")))
        .withColumn("max_exact", F.max(F.when(F.col("e") == 1, F.col("distance"))).over(node))
        .withColumn("max_approx", F.max(F.when(F.col("a") == 1, F.col("distance"))).over(node))
        .where((F.col("_exact") > 0) & (F.col("_hits") < F.col("_approx")) & (F.col("e") != F.col("a")))
        .select(
            "src",
            F.when(F.col("e") == 1, "exact_only").otherwise("approx_only").alias("side"),
            "dst",
            "distance",
            "max_exact",
            "max_approx",
        )
    )


def missed_by_node(missed: DataFrame) -> DataFrame:
    """The missed-edge report with one row per node and edges as arrays of STRUCT<dst, distance>."""
    edge = F.struct("dst", "distance")
    pick = lambda side: F.array_sort(F.collect_list(F.when(F.col("side") == side, edge)))
    return missed.groupBy("src", "max_exact", "max_approx").agg(
        pick("exact_only").alias("exact_only"), pick("approx_only").alias("approx_only")
    )


def positional(
    exact: DataFrame, approx: DataFrame, k: int | None = None, decay: str = "step", id_below: int | None = None
) -> DataFrame:
    """Mean score of neighbours by their exact rank: full below k, decaying up to 2k, then nothing.

    k is the node's number of approximate neighbours if not given. The "step" decay keeps full marks up
    to rank 2k - 1; "linear" falls off evenly.
    """
    if decay not in ("step", "linear"):
        raise ValueError(f"decay must be 'step' or 'linear', got {decay!r}")
    node = Window.partitionBy("src")
    pairs = (
        _side_by_side(exact, approx, id_below)
        .groupBy("src", "dst")
        .agg(
            F.min(F.when(F.col("in_exact") == 1, F.col("distance"))).alias("distance"),
            F.max("in_exact").alias("e"),
            F.max("in_approx").alias("a"),
        )
        .withColumn("k", F.greatest(F.sum("a").over(node), F.lit(1)) if k is None else F.lit(k).cast("bigint"))
        .withColumn("place", F.row_number().over(node.orderBy(F.desc("e"), "distance", "dst")) - 1)
    )
    lost = F.expr("(place - k + 1) div k") if decay == "step" else (F.col("place") - F.col("k") + 1) / F.col("k")
    score = (
        F.when((F.col("e") == 0) | (F.col("a") == 0), 0.0)
        .when(F.col("place") < F.col("k"), 1.0)
        .when(F.col("place") < 2 * F.col("k"), 1.0 - lost)
        .otherwise(0.0)
    )
    nodes = pairs.groupBy("src").agg(
        (F.sum(score) / F.max("k")).alias("score"), F.max("e").alias("e"), F.max("a").alias("a")
    )
    shared = (F.col("e") == 1) & (F.col("a") == 1)
    return nodes.agg(
        F.avg(F.when(shared, F.col("score"))).alias("score"),
        F.count(F.when(shared, 1)).alias("nodes_compared"),
        F.count(F.when(F.col("a") == 0, 1)).alias("nodes_missing"),
    )


def degrees(edges: DataFrame) -> DataFrame:
    """Distinct edges per node."""
    return edges.groupBy("src").agg(F.countDistinct("dst").alias("edges"))


def degree_stats(edges: DataFrame) -> DataFrame:
    """Edges and nodes in all."""
    return degrees(edges).agg(
        F.coalesce(F.sum("edges"), F.lit(0)).alias("edges"),
        F.count(F.lit(1)).alias("nodes"),
        F.min("edges").alias("fewest"),
        F.max("edges").alias("most"),
    )
