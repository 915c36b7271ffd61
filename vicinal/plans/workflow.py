"""From a file of points to a stored graph, compared with a known one and refined."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession

from vicinal.config import KnnConfig
from vicinal.functions.distance import SQUARED_EUCLIDEAN, Distance
from vicinal.operators.evaluate import degree_stats, missed_edges, positional, recall
from vicinal.operators.refine import refine, refine_work
from vicinal.plans.graph import knn_graph
from vicinal.sources.edges import read_edges, write_edges
from vicinal.sources.points import read_points


def compare_graphs(exact: DataFrame, approx: DataFrame, k: int, id_below: int | None = None) -> dict:
    """Recall and positional score as numbers, and the missed edges as a table."""
    return {
        "recall": recall(exact, approx, k, id_below).first().asDict(),
        "positional": positional(exact, approx, id_below=id_below).first().asDict(),
        "missed": missed_edges(exact, approx, id_below),
    }


def run(
    spark: SparkSession,
    dataset: str | DataFrame,
    output: str,
    config: KnnConfig = KnnConfig(),
    compare: str | DataFrame | None = None,
    group_col: str | None = None,
    distance: Distance = SQUARED_EUCLIDEAN,
    format: str = "parquet",
    refine_rounds: int = 1,
) -> dict:
    """Build the graph of `dataset`, write it to a free path at `output`, and report on it.

    With `compare`, a stored exact graph, the result is scored against it; a hashed graph is then
    refined, written beside the first as `...refined0`, and scored again.
    """
    points = read_points(spark, dataset) if isinstance(dataset, str) else dataset
    read = (lambda path: read_edges(spark, path)) if format == "text" else spark.read.format(format).load
    start = time.time()
    built = knn_graph(points, config, group_col, distance)
    path = write_edges(built.edges, output, format)
    edges = read(path)
    report = {
        "path": path,
        "config": built.config,
        "steps": built.steps,
        "relative_cost": built.relative_cost,
        "degrees": degree_stats(edges).first().asDict(),
        "seconds": time.time() - start,
    }
    if compare is None:
        return report
    exact = read(compare) if isinstance(compare, str) else compare
    report["comparison"] = compare_graphs(exact, edges, config.k)
    report["refined"] = []
    if config.method == "lsh":
        graph = built.edges
        for turn in range(refine_rounds):
            work = refine_work(graph).first().asDict()
            start = time.time()
            graph = refine(points, graph, config.k, group_col, distance=distance)
            where = write_edges(graph, f"{path}refined{turn}", format)
            report["refined"].append(
                {
                    "path": where,
                    "seconds": time.time() - start,
                    "candidates": work,
                    "comparison": compare_graphs(exact, read(where), config.k),
                }
            )
    return report
