"""The build as a log of touched points, and points that retire only with full lists."""

import pytest
from pyspark.sql import functions as F

from vicinal import KnnConfig, knn_graph
from vicinal.functions.gaussian import Gaussian
from vicinal.operators.buckets import bucket_viewed, bucketize, knn_in_buckets
from vicinal.operators.hashing import HashFamily, hash_points
from vicinal.operators.retire import completed_ids
from vicinal.operators.topk import merge_counters, merge_graphs
from vicinal.session import Scratch


@pytest.fixture(scope="module")
def points(spark):
    drawn = Gaussian.standard(3).sample(spark, 240, seed=4)
    # Group 5 has one member, group 6 two.
    group = F.when(F.col("id") == 7, 5).when(F.col("id").isin(8, 9), 6).otherwise(F.col("id") % 3).cast("int")
    return Scratch(spark).save(drawn.withColumn("group_id", group), "points")


def rows(frame):
    return sorted(map(tuple, frame.collect()))


def test_log_equals_whole_graphs_merged_each_round(spark, points):
    """The same rounds, with the whole graph and all counters rewritten and every point hashed anew."""
    config = KnnConfig(k=4, seed=2, tables=3, key_length=3, radius=0.1, max_comparisons=25, max_rounds=3)
    built = knn_graph(points, config)
    family, edges, viewed, remaining, radius = HashFamily(3, 3, 3, seed=2), None, None, points, 0.1
    scratch = Scratch(spark)
    lefts = []
    for _ in range(3):
        buckets = bucketize(hash_points(remaining, family, radius))
        if buckets.count():
            edges = scratch.save(merge_graphs([edges, knn_in_buckets(points, buckets, 4)], 4), "edges")
            viewed = scratch.save(merge_counters([viewed, bucket_viewed(buckets)]), "viewed")
            remaining = points.join(completed_ids(edges, viewed, 4, 25), "id", "left_anti")
        lefts.append(remaining.count())
        radius *= 2
    assert [s["left"] for s in built.steps if s["step"] == "round"] == lefts
    retired = points.join(remaining, "id", "left_anti").select(F.col("id").alias("src"))
    # Points that retired keep what they had, but for what stragglers add later.
    before = {(r.src, r.dst): r.distance for r in edges.join(retired, "src").collect()}
    after = {(r.src, r.dst): r.distance for r in built.edges.join(retired, "src").collect()}
    last = {}
    for (src, _), d in after.items():
        last[src] = max(d, last.get(src, 0.0))
    assert all(after.get(pair) == d or d >= last[pair[0]] for pair, d in before.items())


def test_rounds_write_less_as_points_retire(spark, points):
    built = knn_graph(points, KnnConfig(k=4, seed=2, tables=3, key_length=3, radius=0.4, max_comparisons=15, max_rounds=3))
    lefts = [s["left"] for s in built.steps if s["step"] == "round"]
    assert lefts[-1] < lefts[0] < 240
    members = [b.select("id").distinct().count() for b in built.buckets]
    assert all(m <= left for m, left in zip(members[1:], lefts))


def test_full_lists(points):
    given = dict(k=3, seed=2, tables=3, key_length=2, radius=0.2, max_comparisons=12)
    short = knn_graph(points, KnnConfig(**given), group_col="group_id")
    full = knn_graph(points, KnnConfig(**given, fill_lists=True), group_col="group_id")
    assert full.lists == short.lists == 240 * 5
    counts = {(r.src, r.group_id): r.n for r in full.edges.groupBy("src", "group_id").agg(F.count("*").alias("n")).collect()}
    size = {r.group_id: r.n for r in points.groupBy("group_id").agg(F.count("*").alias("n")).collect()}
    for r in points.collect():
        for g, n in size.items():
            assert counts.get((r.id, g), 0) == min(3, n - (r.group_id == g))
    # Lists of the two small groups can't have three.
    assert full.short_lists() == 240 * 2 < short.short_lists()


def test_nothing_is_short_without_groups(points):
    built = knn_graph(points, KnnConfig(k=4, seed=2, tables=3, key_length=3, fill_lists=True))
    assert built.lists == 240 and built.short_lists() == 0
