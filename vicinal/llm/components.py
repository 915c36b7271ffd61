"""Connected components by contracting random neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.session import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """`node`, `root` for every node of `edges` (`a`, `b`; either way round, repeats allowed): equal roots, one component.

    Each round, every node moves to the neighbour (or itself) with the smallest hash of the round, and the
    edges follow. Nodes and edges shrink by a constant factor a round whatever the graph's shape; hubs are one
    aggregated row. The rounds' moves are chained at the end. Tables stay in Spark; the driver sees one count
    a round.
    """
    edges = scratch.save(edges.select("a", "b").where("a <> b").distinct(), "edges")
    moves = []
    while edges.limit(1).count():
        seed = F.lit(len(moves))
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b", seed).alias("h"), F.col("b"))).alias("n"))
        move = scratch.save(
            lowest.select(
                F.col("a").alias("node"),
                F.when(F.struct(F.xxhash64("a", seed).alias("h"), F.col("a").alias("b")) < F.col("n"), F.col("a"))
                .otherwise(F.col("n.b"))
                .alias("root"),
            ),
            "moves",
        )
        moves.append(move)
        edges = scratch.save(
            edges.join(move.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a")
            .join(move.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
            .where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
            .distinct(),
            "edges",
        )
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = moves[0]
    for move in moves[1:]:
        # A node that left no edge behind stays where it is.
        step = move.select(F.col("node").alias("root"), F.col("root").alias("_next"))
        roots = roots.join(step, "root", "left").select("node", F.coalesce("_next", "root").alias("root"))
    return scratch.save(roots, "roots")
