"""Cases worked out by hand."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import neighbor_ids
from vicinal.functions.distance import dimension, dot_product, squared_distance
from vicinal.functions.gaussian import Gaussian
from vicinal.functions.keys import key_concat, key_prefix
from vicinal.functions.stats import approx_median, kth_smallest, median_lower, select_rank
from vicinal.operators.buckets import bucket_histogram, bucket_viewed, bucketize, comparison_cost, knn_from_lists
from vicinal.operators.evaluate import degree_stats, missed_by_node, missed_edges, positional, recall
from vicinal.operators.exact import knn_exact
from vicinal.operators.hashing import GivenFamily, hash_points
from vicinal.operators.pairs import knn_connections, knn_from_pairs
from vicinal.operators.refine import refine, refine_candidates, refine_work
from vicinal.operators.stragglers import reverse_lists
from vicinal.operators.topk import merge_counters, merge_graphs, merge_lists, to_adjacency, to_edges, top_k

EXACT = {0: [1, 2], 1: [0, 2], 2: [1, 0], 3: [2, 4], 4: [3, 5], 5: [4, 3]}


@pytest.fixture(scope="module")
def edges(spark):
    def make(rows):
        return spark.createDataFrame([(s, d, float(x)) for s, d, x in rows], "src bigint, dst bigint, distance double")

    return make


@pytest.fixture(scope="module")
def exact(line):
    return knn_exact(line, 2).cache()


def test_exact_graph_of_the_line(exact):
    assert neighbor_ids(exact) == EXACT
    assert {r["distance"] for r in exact.where("src = 5").collect()} == {25.0, 81.0}


def test_grouped_graph_takes_k_from_each_group_of_neighbors(line):
    rows = knn_exact(line, 1, group_col="group_id").where("src = 0").collect()
    assert {(r["group_id"], r["dst"], r["distance"]) for r in rows} == {(0, 2, 9.0), (1, 1, 1.0)}


def test_more_neighbors_than_points(line):
    assert degree_stats(knn_exact(line, 10)).first().asDict() == {"edges": 30, "nodes": 6, "fewest": 5, "most": 5}


def test_subset(line, spark):
    ids = spark.createDataFrame([(0,), (3,), (5,), (5,)], "id bigint")
    assert neighbor_ids(knn_exact(line, 1, subset=ids)) == {0: [3], 3: [0], 5: [3]}


def test_recall_and_missed_edges(line, exact, edges):
    kept = [(r["src"], r["dst"], r["distance"]) for r in exact.collect() if (r["src"], r["dst"]) != (2, 0)]
    approx = edges([*kept, (2, 3, 9.0)])
    row = recall(exact, approx, 2).first()
    assert row["recall"] == pytest.approx(11 / 12) and (row["nodes_compared"], row["nodes_missing"]) == (6, 0)
    missed = missed_edges(exact, approx)
    found = {(r["src"], r["side"], r["dst"], r["distance"], r["max_exact"], r["max_approx"]) for r in missed.collect()}
    assert found == {(2, "exact_only", 0, 9.0, 9.0, 9.0), (2, "approx_only", 3, 9.0, 9.0, 9.0)}
    node = missed_by_node(missed).first()
    assert node["exact_only"] == [(0, 9.0)] and node["approx_only"] == [(3, 9.0)]


def test_recall_reports_nodes_left_out(exact):
    row = recall(exact, exact.where("src < 4"), 2).first()
    assert (row["recall"], row["nodes_compared"], row["nodes_missing"]) == (1.0, 4, 2)
    assert recall(exact, exact, 2, id_below=3).first()["nodes_compared"] == 3


def test_recall_of_disjoint_lists_is_zero(edges):
    assert recall(edges([(0, 1, 1)]), edges([(0, 2, 1)]), 1).first()["recall"] == 0.0


@pytest.mark.parametrize("ids, step, linear", [((1, 4), 0.5, 0.5), ((1, 3), 1.0, 0.75), ((8, 9), 0.0, 0.0)])
def test_positional(edges, ids, step, linear):
    exact = edges([(0, n, n) for n in (1, 2, 3, 4)])
    approx = edges([(0, n, n) for n in ids])
    assert positional(exact, approx).first()["score"] == step
    assert positional(exact, approx, decay="linear").first()["score"] == linear


def test_positional_counts_nodes(edges):
    exact = edges([(0, 1, 1), (1, 0, 1), (2, 0, 1)])
    row = positional(exact, edges([(0, 1, 1), (1, 2, 1), (7, 0, 1)])).first()
    assert row.asDict() == {"score": 0.5, "nodes_compared": 2, "nodes_missing": 1}


@pytest.mark.parametrize(
    "first, second, k, merged",
    [
        ([(1, 1.0), (2, 9.0)], [(2, 9.0), (3, 4.0)], 2, [(1, 1.0), (3, 4.0)]),
        ([(1, 1.0), (2, 9.0)], [(2, 9.0), (3, 4.0)], 3, [(1, 1.0), (3, 4.0), (2, 9.0)]),
        ([], [(3, 4.0)], 2, [(3, 4.0)]),
    ],
)
def test_merge(spark, edges, first, second, k, merged):
    kind = "a array<struct<distance: double, id: bigint>>, b array<struct<distance: double, id: bigint>>"
    pairs = [([(d, i) for i, d in first], [(d, i) for i, d in second])]
    row = spark.createDataFrame(pairs, kind).select(merge_lists(F.col("a"), F.col("b"), k).alias("m")).first()
    assert [(n["id"], n["distance"]) for n in row["m"]] == merged
    graphs = [edges([(0, i, d) for i, d in side]) for side in (first, second)]
    rows = merge_graphs(graphs, k).orderBy("rank").collect()
    assert [(r["dst"], r["distance"]) for r in rows] == merged


def test_merge_with_no_graph(exact):
    assert merge_graphs([None, None], 2) is None and merge_counters([None]) is None
    assert neighbor_ids(merge_graphs([None, exact], 2)) == EXACT
    assert neighbor_ids(merge_graphs([exact, exact], 2)) == EXACT


def test_ties_are_kept_on_demand(edges):
    graph = edges([(0, 1, 4), (0, 2, 4), (0, 3, 9)])
    assert {r["dst"] for r in top_k(graph, 1, keep_ties=True).collect()} == {1, 2}
    assert {r["dst"] for r in top_k(graph, 1).collect()} == {1}
    assert top_k(graph, 5, keep_ties=True).count() == 3


def test_adjacency_round_trip(exact):
    rows = to_adjacency(exact)
    assert {r["src"]: [n["id"] for n in r["neighbors"]] for r in rows.collect()} == EXACT
    assert neighbor_ids(to_edges(rows)) == EXACT


def test_refining_the_exact_graph_changes_nothing(line, exact):
    assert neighbor_ids(refine(line, exact, 2)) == EXACT


def test_refine_replaces_a_far_neighbor(line, exact, edges):
    kept = [(r["src"], r["dst"], r["distance"]) for r in exact.collect() if (r["src"], r["dst"]) != (0, 2)]
    rough = edges([*kept, (0, 3, 36.0)])
    assert {r["dst"] for r in refine_candidates(rough).where("src = 0").collect()} == {2, 4}
    # Only 0 -> 2 can be reached in two ways, by 1 and by 3.
    assert refine_work(rough).first().asDict() == {"added": 16, "after_distinct": 15}
    assert neighbor_ids(refine(line, rough, 2)) == EXACT
    assert neighbor_ids(refine(line, rough, 2, rounds=2)) == EXACT


def test_connections_serve_only_their_end(line, spark):
    given = spark.createDataFrame([(0, 2), (1, 2), (5, 2)], "src bigint, dst bigint")
    rows = knn_connections(line, given, 2).orderBy("rank").collect()
    assert [(r["dst"], r["src"], r["distance"]) for r in rows] == [(2, 1, 4.0), (2, 0, 9.0)]


def test_pairs(line, spark):
    given = spark.createDataFrame([(0, 5), (0, 4), (0, 4), (3, 0)], "src bigint, dst bigint")
    assert neighbor_ids(knn_from_pairs(line, given, 1)) == {0: [4], 3: [0]}


def test_lists(line, spark):
    given = spark.createDataFrame([(1, 0), (1, 3), (1, 3), (2, 3), (2, 5), (3, 4)], "list_id bigint, id bigint")
    assert neighbor_ids(knn_from_lists(line, given, 1)) == {0: [3], 3: [0], 5: [3]}


def test_reverse_lists(exact, spark):
    found = {}
    for row in reverse_lists(exact, spark.createDataFrame([(5,)], "id bigint")).collect():
        found.setdefault(row["list_id"], set()).add(row["id"])
    assert found == {5: {5, 4, 3}}


def test_hash_keys(spark):
    row = spark.createDataFrame([([3, -1, 4, 1],)], "key array<int>").select(
        key_prefix(F.col("key"), 2).alias("cut"), key_concat(key_prefix(F.col("key"), 2), F.slice("key", 3, 1)).alias("both")
    )
    assert row.first().asDict() == {"cut": [3, -1], "both": [3, -1, 4]}


def test_hash_formula(make_points):
    family = GivenFamily.of([[[1.0]]], [[1.0]])
    rows = hash_points(make_points([[3], [-3]]), family, 0.5).orderBy("id").collect()
    assert [r["key"] for r in rows] == [[1], [-2]]


def test_hash_ignores_positions_beyond_its_dimension(make_points):
    family = GivenFamily.of([[[1.0]]], [[1.0]])
    assert hash_points(make_points([[3, 99]]), family, 0.5, leading=True).first()["key"] == [1]
    with pytest.raises(Exception, match="hashing needs 1"):
        hash_points(make_points([[3, 99]]), family, 0.5).collect()
    with pytest.raises(Exception, match="hashing needs 2"):
        hash_points(make_points([[3]]), GivenFamily.of([[[1.0, 1.0]]], [[1.0]]), 0.5).collect()


def test_bucket_accounting(spark):
    members = [(0, [0], i) for i in (0, 1)] + [(0, [1], i) for i in (2, 3)] + [(0, [2], i) for i in (4, 5, 6, 7, 0)] + [(0, [9], 8)]
    buckets = bucketize(spark.createDataFrame(members, "table_id int, key array<int>, id bigint"))
    sizes = {r["size"]: r["buckets"] for r in bucket_histogram(buckets).collect()}
    assert sizes == {2: 2, 5: 1}
    cost = comparison_cost(bucket_histogram(buckets), 10).first()
    assert cost["comparisons"] == 12 and cost["relative_to_all_pairs"] == pytest.approx(12 / 45)
    assert comparison_cost(bucket_histogram(buckets), 10, extra=3).first()["comparisons"] == 15
    assert {r["id"]: r["viewed"] for r in bucket_viewed(buckets).collect()}[0] == 1 + 4


def test_vector_columns(spark):
    row = spark.createDataFrame([([1.0, 2.0], [3.0, 5.0])], "a array<double>, b array<double>").select(
        squared_distance(F.col("a"), F.col("b")).alias("d"), dot_product(F.col("a"), F.col("b")).alias("dot")
    )
    assert row.first().asDict() == {"d": 13.0, "dot": 13.0}


def test_dot_product_skips_what_the_other_lacks(spark):
    row = spark.createDataFrame([([1.0, 2.0, 9.0], [3.0, 5.0])], "a array<double>, b array<double>")
    assert row.select(dot_product(F.col("a"), F.col("b"), shared=True)).first()[0] == 13.0


def test_dimension(line):
    assert dimension(line).first()["dimension"] == 1


def test_gaussian_density(spark, make_points):
    at_zero = make_points([[0, 0]]).select(Gaussian.standard(2).density("features")).first()[0]
    assert at_zero == pytest.approx(1 / (2 * math.pi))
    full = Gaussian([1.0, -1.0], [[2.0, 0.5], [0.5, 1.0]])
    x = np.array([0.3, 0.7]) - full.mean
    expected = math.exp(-0.5 * x @ np.linalg.inv(full.covariance) @ x) / (2 * math.pi * math.sqrt(1.75))
    assert make_points([[0.3, 0.7]]).select(full.density("features")).first()[0] == pytest.approx(expected)
    number = spark.createDataFrame([(1.0,)], "x double").select(Gaussian.scalar(1.0, 4.0).density("x")).first()[0]
    assert number == pytest.approx(1 / math.sqrt(8 * math.pi))


def values(spark, groups):
    rows = [(g, x) for g, xs in enumerate(groups) for x in xs]
    return spark.createDataFrame(rows, "grp int, x bigint")


@pytest.mark.parametrize("k", [1, 2, 3, 4])
def test_kth_smallest_of_every_order(spark, k):
    rows = values(spark, list(itertools.permutations(range(1, 6))))
    assert {r["x"] for r in kth_smallest(rows, "grp", "x", k).collect()} == {k}
    assert {r["x"] for r in select_rank(rows, "grp", "x", F.lit(k)).collect()} == {k}


@pytest.mark.parametrize("n", [30, 100])
def test_kth_smallest_of_shuffles(spark, n):
    draw = random.Random(n)
    rows = values(spark, [draw.sample(range(1, n + 1), n) for _ in range(20)])
    k = draw.randint(1, n)
    for found in (kth_smallest(rows, "grp", "x", k), select_rank(rows, "grp", "x", F.lit(k))):
        assert [r["x"] for r in found.collect()] == [k] * 20


def test_kth_smallest_counts_repeats(spark):
    rows = values(spark, [[2, 2, 2, 2, 5]])
    for k, x in ((2, 2), (4, 2), (5, 5)):
        assert kth_smallest(rows, "grp", "x", k).first()["x"] == x
    assert kth_smallest(rows, "grp", "x", 6).count() == 0
    assert select_rank(rows, "grp", "x", F.lit(6)).count() == 0


def test_medians(spark):
    rows = values(spark, [range(1, 4), range(1, 5), range(1, 6)])
    assert {r["grp"]: r["x"] for r in median_lower(rows, "grp", "x").collect()} == {0: 2, 1: 2, 2: 3}
    assert {r["grp"]: r["x"] for r in median_lower(rows, "grp", "x", compat=True).collect()} == {0: 1, 1: 1, 2: 2}


def test_approximate_median_stays_in_the_middle(spark):
    draw = random.Random(5)
    small = values(spark, [draw.sample(range(1, 31), 30) for _ in range(200)])
    assert all(8 <= r["x"] - 1 <= 20 for r in approx_median(small, "grp", "x").collect())
    large = values(spark, [draw.sample(range(1, 101), 100) for _ in range(20)])
    assert all(30 <= r["x"] <= 70 for r in approx_median(large, "grp", "x").collect())
