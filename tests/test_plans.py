"""What the plans must and must not contain, with broadcasts switched off as for large tables."""

import re

import pytest
from pyspark.sql import functions as F

from vicinal.operators.buckets import bucketize, knn_in_buckets
from vicinal.operators.evaluate import missed_edges, positional, recall
from vicinal.operators.exact import knn_against, knn_exact
from vicinal.operators.hashing import HashFamily, hash_points
from vicinal.operators.pairs import knn_connections, knn_from_pairs
from vicinal.operators.refine import refine
from vicinal.operators.retire import drop_completed
from vicinal.operators.topk import merge_graphs, top_k


@pytest.fixture(autouse=True)
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.fixture(scope="module")
def points(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "points.parquet")
    spark.range(100).select(
        "id", F.lit(0.0).alias("label"), F.array(F.rand(1), F.rand(2)).alias("features"), F.lit("x").alias("unused")
    ).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "graph.parquet")
    spark.range(100).selectExpr("id AS src", "(id + 1) % 100 AS dst", "0.5D AS distance").write.parquet(path)
    return spark.read.parquet(path)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return len(re.findall(r"Exchange ", plan_of(df)))


def test_no_plan_has_a_cross_join_or_a_broadcast(points, graph):
    buckets = bucketize(hash_points(points, HashFamily(2), 1.0))
    pairs = graph.select("src", "dst")
    plans = [
        knn_exact(points, 3),
        knn_against(points.where("id < 5"), points, 3),
        knn_in_buckets(points, buckets, 3),
        knn_from_pairs(points, pairs, 3),
        knn_connections(points, pairs, 3),
        refine(points, graph, 3),
        recall(graph, graph, 1),
        missed_edges(graph, graph),
        positional(graph, graph),
    ]
    for df in plans:
        assert not re.search("CartesianProduct|NestedLoop|BroadcastExchange", plan_of(df))


def test_exact_graph_shuffles_vectors_once_and_reads_two_columns(points):
    plan = plan_of(knn_exact(points, 3, block_rows=30))
    assert plan.count("Exchange ") == 2
    assert "ReadSchema: struct<id:bigint,features:array<double>>" in plan


def test_the_limit_is_applied_before_the_shuffle(graph):
    plan = plan_of(top_k(graph, 3))
    assert re.search(r"WindowGroupLimit.*Partial", plan) and re.search(r"WindowGroupLimit.*Final", plan)
    # Dropping repeats and merging two graphs reuse the placement of the limit.
    assert plan.count("Exchange ") == 1
    assert shuffles(merge_graphs([graph, graph], 3)) == 1


def test_results_are_kept_for_the_end_that_is_joined_first(points, graph):
    """The last join is by the other end, so a limit by node always has its own shuffle."""
    pairs = graph.select("src", "dst")
    for df, node in ((knn_from_pairs(points, pairs, 2), "src"), (knn_connections(points, pairs, 2), "dst")):
        assert re.search(rf"WindowGroupLimit \[{node}#\d+L\].*Partial", plan_of(df))


def test_evaluation_places_edges_by_node_once(graph):
    assert shuffles(missed_edges(graph, graph)) == 1
    assert shuffles(recall(graph, graph, 1)) == 2
    assert shuffles(positional(graph, graph)) == 2


def test_completed_points_leave_by_an_anti_join(points, graph):
    viewed = graph.select(F.col("src").alias("id"), F.lit(9).cast("bigint").alias("viewed"))
    assert "LeftAnti" in plan_of(drop_completed(points, graph, viewed, 1, 5))


def test_bucket_sizes_need_no_window(points):
    plan = plan_of(bucketize(hash_points(points, HashFamily(2), 1.0)))
    assert "Window" not in plan and "partial_count" in plan
