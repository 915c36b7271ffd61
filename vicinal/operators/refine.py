"""Better graphs from neighbours of neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.functions.distance import SQUARED_EUCLIDEAN, Distance
from vicinal.functions.sparse import vector_entries
from vicinal.operators.cells import SOURCE, TARGET, block_of, cell_edges
from vicinal.operators.topk import merge_graphs, top_k
from vicinal.session import Scratch, tasks_for
from vicinal.sources.points import kernel_columns

SOURCES_PER_CELL = 4096


def _paths(edges: DataFrame) -> DataFrame:
    first = edges.select(F.col("src"), F.col("dst").alias("_via"))
    second = edges.select(F.col("src").alias("_via"), F.col("dst"))
    return first.join(second, "_via").select("src", "dst").where(F.col("src") != F.col("dst"))


def refine_candidates(edges: DataFrame) -> DataFrame:
    """Distinct pairs (a, c), a <> c, with c a neighbour of a neighbour of a."""
    return _paths(edges).distinct()


def refine_work(edges: DataFrame) -> DataFrame:
    """Candidate pairs one refinement looks at, with and without repeats."""
    pairs = _paths(edges).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("_times"))
    return pairs.agg(
        F.coalesce(F.sum("_times"), F.lit(0)).alias("added"), F.count(F.lit(1)).alias("after_distinct")
    )


def refine(
    points: DataFrame,
    edges: DataFrame,
    k: int,
    group_col: str | None = None,
    rounds: int = 1,
    distance: Distance = SQUARED_EUCLIDEAN,
    block_rows: int | None = None,
) -> DataFrame:
    """Merge each node's list with the nearest of its neighbours' neighbours.

    The paths a -> b -> c meet in a cell for b: vectors go to b once for each edge, not once for each
    path, and only the k best of a cell leave it. A node b that many others point to has its sources
    spread over several cells. The graph is written before each round, since it is read several times.
    """
    scratch = Scratch(points.sparkSession)
    for done in range(rounds):
        edges = scratch.save(edges, f"refined{done}")
        edges = _refine_once(points, edges, k, group_col, distance, block_rows or SOURCES_PER_CELL)
    return edges


def _refine_once(points, edges, k, group_col, distance, most):
    spark = points.sparkSession
    links = edges.select("src", "dst").distinct()
    parts = F.ceil(F.count(F.lit(1)) / most).cast("int")
    indegree = links.groupBy(F.col("dst").alias("_via")).agg(parts.alias("_parts"))
    sources = (
        links.withColumnRenamed("dst", "_via")
        .join(indegree, "_via")
        .select(
            F.col("src").alias("id"),
            "_via",
            block_of(F.col("src"), F.col("_parts")).alias("_part"),
            F.lit(SOURCE).alias("side"),
        )
    )
    targets = (
        links.withColumnRenamed("src", "_via")
        .join(indegree, "_via")
        .select(
            F.col("dst").alias("id"),
            "_via",
            F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"),
            F.lit(TARGET).alias("side"),
        )
    )
    cells = (
        sources.unionByName(targets)
        .join(kernel_columns(points, group_col), "id")
        .withColumn("cell", F.concat_ws("/", "_via", "_part"))
        .withColumn("side", F.col("side").cast("tinyint"))
    )
    # A vector goes to its node's cell once for each edge, and to one for each part of a hub it is a target of.
    told = links.agg(F.count(F.lit(1))).first()
    size = points.agg(F.max(vector_entries(points))).first()[0] or 1
    width = max(
        int(spark.conf.get("spark.sql.shuffle.partitions")),
        tasks_for(spark, 16.0 * size * (told[0] or 0), 2.0 * size * k * (told[0] or 0)),
    )
    found = cell_edges(cells, k, distance, width)
    found = found if group_col else found.drop("group_id")
    if distance is not SQUARED_EUCLIDEAN:
        found = top_k(found, k, repeats=None).drop("rank")
    return merge_graphs([edges, found], k)
