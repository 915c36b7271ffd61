"""Exact graphs: every point against every other, or sources against targets."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.functions.distance import SQUARED_EUCLIDEAN, Distance
from vicinal.functions.sparse import is_sparse
from vicinal.operators.cells import (
    BOTH,
    LEFT,
    RIGHT,
    SOURCE,
    TARGET,
    block_of,
    block_rows_for,
    cell_edges,
    sparse_block_rows,
)
from vicinal.operators.strips import strip_edges
from vicinal.operators.topk import top_k
from vicinal.session import tasks_for
from vicinal.sources.points import PointStats, describe, kernel_columns


def knn_exact(
    points: DataFrame,
    k: int,
    group_col: str | None = None,
    subset: DataFrame | None = None,
    distance: Distance = SQUARED_EUCLIDEAN,
    block_rows: int | None = None,
    stats: PointStats | None = None,
) -> DataFrame:
    """The k nearest of every point, exactly; with `group_col`, k from each group of neighbours.

    `subset` (a table with an `id` column) restricts both ends. Points are cut into blocks by a hash of
    their id, and each pair of blocks is one cell, so no task sees more than two blocks. Sparse vectors under the squared
    distance go in strips (operators/strips.py).
    """
    if subset is not None:
        points, stats = points.join(subset.select("id").distinct(), "id", "left_semi"), None
    stats = stats or describe(points)
    spark = points.sparkSession
    if is_sparse(points) and distance is SQUARED_EUCLIDEAN and not (group_col or block_rows):
        return _finish(strip_edges(points, k, stats), k, None)
    if is_sparse(points):
        most = block_rows or sparse_block_rows(stats.total, stats.n)
    else:
        most = block_rows or block_rows_for(stats.entries, stats.entry_bytes)
    cores = spark.sparkContext.defaultParallelism
    blocks = max(math.ceil(stats.n / most), min(math.ceil(math.sqrt(2 * cores)), math.ceil(stats.n / 256)), 1)
    tasks = min(
        blocks * (blocks + 1) // 2,
        tasks_for(spark, float(blocks) * stats.entry_bytes * stats.total, 2.0 * stats.n * stats.n * stats.entries) * 4,
    )

    own = F.col("_own")
    partner = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_other")
    cells = (
        kernel_columns(points, group_col)
        .withColumn("_own", block_of(F.col("id"), F.lit(blocks)))
        .select("*", partner)
        .withColumn("_low", F.least(own, "_other").cast("long"))
        .withColumn("_high", F.greatest(own, "_other").cast("long"))
        .withColumn("cell", F.expr("_high * (_high + 1) div 2 + _low"))
        .withColumn(
            "side",
            F.when(own == F.col("_other"), BOTH).when(own < F.col("_other"), LEFT).otherwise(RIGHT).cast("tinyint"),
        )
    )
    edges = cell_edges(cells, k, distance, tasks, place=(F.col("cell") % tasks).cast("int"))
    return _finish(edges, k, group_col)


def knn_against(
    sources: DataFrame,
    targets: DataFrame,
    k: int,
    group_col: str | None = None,
    distance: Distance = SQUARED_EUCLIDEAN,
    block_rows: int | None = None,
) -> DataFrame:
    """The k nearest targets of every source, exactly; a point is never its own neighbour."""
    few, many = describe(sources), describe(targets)
    spark = sources.sparkSession
    entries = max(few.entries, many.entries)
    most = block_rows or block_rows_for(entries, many.entry_bytes)
    cores = spark.sparkContext.defaultParallelism
    source_blocks = max(math.ceil(few.n / most), 1)
    target_blocks = max(math.ceil(many.n / most), min(2 * cores, math.ceil(many.n / 256)), 1)
    rows = few.n * target_blocks + many.n * source_blocks
    tasks = min(
        source_blocks * target_blocks,
        tasks_for(spark, rows * float(many.entry_bytes) * entries, float(few.n) * many.n * entries) * 4,
    )

    def side(points, own_blocks, other_blocks, code, cell):
        return (
            kernel_columns(points, group_col)
            .withColumn("_own", block_of(F.col("id"), F.lit(own_blocks)).cast("long"))
            .select("*", F.explode(F.sequence(F.lit(0), F.lit(other_blocks - 1))).alias("_other"))
            .withColumn("cell", F.expr(cell))
            .withColumn("side", F.lit(code).cast("tinyint"))
        )

    cells = side(sources, source_blocks, target_blocks, SOURCE, f"_own * {target_blocks} + _other").unionByName(
        side(targets, target_blocks, source_blocks, TARGET, f"_other * {target_blocks} + _own")
    )
    edges = cell_edges(cells, k, distance, tasks, place=(F.col("cell") % tasks).cast("int"))
    return _finish(edges, k, group_col)


def _finish(edges: DataFrame, k: int, group_col: str | None) -> DataFrame:
    return top_k(edges if group_col else edges.drop("group_id"), k)
