"""What used to depend on sizes, on both sides of each threshold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import brute, lists, neighbor_ids
from vicinal import Distance, KnnConfig, knn_graph
from vicinal.functions.distance import dot_product, squared_distance
from vicinal.functions.gaussian import Gaussian
from vicinal.functions.stats import kth_smallest, median_lower
from vicinal.operators import cells
from vicinal.operators.exact import knn_exact
from vicinal.operators.pairs import knn_from_pairs
from vicinal.operators.topk import merge_graphs, merge_lists, top_k
from vicinal.sources.points import lookup


@pytest.mark.parametrize("k", [1, 999, 1000, 1001, 1500])
def test_a_null_group_has_ranks(spark, k):
    rows = spark.createDataFrame([(None if i % 2 else 1, float(i)) for i in range(3000)], "g int, x double").repartition(3)
    got = {r["g"]: r["x"] for r in kth_smallest(rows, "g", "x", k).collect()}
    assert got == {None: 2.0 * k - 1, 1: 2.0 * k - 2}
    assert {r["g"]: r["x"] for r in median_lower(rows, "g", "x").collect()} == {None: 1499.0, 1: 1498.0}


@pytest.fixture(params=[0, 1 << 30])
def small_cell(request, monkeypatch):
    monkeypatch.setattr(cells, "SMALL_CELL", request.param)


@pytest.mark.parametrize("n", [20, 200])
def test_null_groups_are_a_group(spark, n, small_cell):
    draw = np.random.default_rng(n)
    x = draw.normal(0, 1, (n, 3))
    groups = [None if i % 5 == 0 else int(i % 2) for i in range(n)]
    rows = [(i, 0.0, [float(v) for v in x[i]], groups[i]) for i in range(n)]
    points = spark.createDataFrame(rows, "id bigint, label double, features array<double>, group_id int")
    found = knn_exact(points, 2, group_col="group_id").collect()
    for src in range(n):
        for group in (None, 0, 1):
            mine = [(r["distance"], r["dst"]) for r in found if r["src"] == src and r["group_id"] == group]
            want = sorted((float(((x[src] - x[j]) ** 2).sum()), j) for j in range(n) if j != src and groups[j] == group)[:2]
            assert [d for _, d in sorted(mine)] == [j for _, j in want]


@pytest.mark.parametrize("n", [20, 200])
def test_an_id_used_twice_is_no_neighbour_of_itself(make_points, n, small_cell):
    draw = np.random.default_rng(n)
    x = np.vstack([draw.normal(0, 1, (n, 3))] + [[0.0, 0.0, 0.0]] * 3)
    found = knn_exact(make_points(x, ids=[*range(n), 0, 0, 1]), 3).collect()
    assert all(r["src"] != r["dst"] for r in found)


def test_points_left_when_rounds_end_meet_each_other(make_points):
    vectors = [[0.0], [0.1], [0.2], [0.3], [1e6], [1e6 + 5000]]
    for rounds in (3, None):
        config = KnnConfig(k=1, seed=1, tables=1, key_length=1, radius=0.5, max_comparisons=2, max_rounds=rounds)
        found = neighbor_ids(knn_graph(make_points(vectors), config).edges)
        assert found[4] == [5] and found[5] == [4]


def test_copies_collapse_only_when_asked(make_points):
    draw = np.random.default_rng(3)
    x = np.round(draw.normal(0, 1, (80, 2)), 1)
    x[:30] = x[0]
    one = knn_graph(make_points(x), KnnConfig(k=3, method="brute")).edges
    two = knn_graph(make_points(x), KnnConfig(k=3, method="brute", collapse_copies=True)).edges
    assert lists(one) == lists(two) == brute(x, 3)


def test_a_neighbour_with_two_distances_counts_once(spark):
    near = [(1, 2, 0.5), (1, 3, 0.7)]
    other = [(1, 2, 0.5000000001), (1, 4, 0.9)]
    frames = [spark.createDataFrame(rows, "src bigint, dst bigint, distance double") for rows in (near, other)]
    got = [(r["dst"], r["distance"]) for r in merge_graphs(frames, 2).orderBy("rank").collect()]
    assert got == [(2, 0.5), (3, 0.7)]
    both = frames[0].unionByName(frames[1]).unionByName(frames[1].withColumn("distance", F.col("distance") + 1e-12))
    for node, repeats in (("src", 3), ("src", None)):
        assert [r["dst"] for r in top_k(both, 3, node, repeats=repeats).orderBy("rank").collect()] == [2, 3, 4]
    kind = "array<struct<distance:double,id:bigint>>"
    row = spark.createDataFrame([([(0.5, 2), (0.7, 3)], [(0.4999, 2), (0.9, 4)])], f"a {kind}, b {kind}")
    merged = row.select(merge_lists(F.col("a"), F.col("b"), 2).alias("m")).first()["m"]
    assert [(x["id"], x["distance"]) for x in merged] == [(2, 0.4999), (3, 0.7)]


def test_merging_graphs_takes_one_shuffle(spark):
    rows = [(i, j, float(j)) for i in range(20) for j in range(5)]
    graph = spark.createDataFrame(rows, "src bigint, dst bigint, distance double")
    plan = merge_graphs([graph, graph], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_custom_distances_that_round_by_shape_give_distinct_neighbours(make_points):
    draw = np.random.default_rng(4)
    x = draw.normal(0, 1, (90, 9))
    uneven = Distance(
        "manhattan",
        lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: F.abs(p - q)), F.lit(0.0), lambda s, v: s + v),
        lambda a, b: np.abs(a[:, None] - b[None]).sum(axis=2) * (1 + 1e-12 * len(b)),
    )
    config = KnnConfig(k=4, tables=6, key_length=1, radius=3.0, max_comparisons=1)
    edges = knn_graph(make_points(x), config, distance=uneven).edges
    assert edges.groupBy("src", "dst").count().where("count > 1").count() == 0


def test_vectors_of_unequal_length_are_refused(spark):
    row = spark.createDataFrame([([1.0, 2.0], [1.0])], "a array<double>, b array<double>")
    for f in (squared_distance, dot_product):
        with pytest.raises(Exception, match="differ in length"):
            row.select(f(F.col("a"), F.col("b"))).collect()


def test_unknown_ids_are_named_or_dropped(spark, line):
    pairs = spark.createDataFrame([(0, 1), (0, 77)], "src bigint, dst bigint")
    with pytest.raises(Exception, match="no point with id 77"):
        knn_from_pairs(line, pairs, 2).collect()
    assert knn_from_pairs(line, pairs, 2, missing="drop").count() == 1
    with pytest.raises(Exception, match="no point with id 77"):
        lookup(pairs, line, "dst").collect()
    assert lookup(pairs, line, "dst", missing="drop").count() == 1


def test_log_density_in_many_dimensions(spark):
    d = 800
    shape = Gaussian(np.zeros(d), np.eye(d) / d)
    row = spark.createDataFrame([([0.0] * d,)], "features array<double>")
    got = row.select(shape.log_density("features").alias("l"), shape.density("features").alias("p")).first()
    assert got["l"] == pytest.approx(-0.5 * d * np.log(2 * np.pi / d)) and got["p"] == np.inf
    assert Gaussian.standard(2000).mean.shape == (2000,)
