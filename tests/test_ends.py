"""Pairs with the rows of both ends: by blocks as by joins."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vicinal.functions.sparse import to_sparse
from vicinal.operators import ends
from vicinal.operators.buckets import bucketize, knn_from_lists, knn_in_buckets
from vicinal.operators.ends import with_ends
from vicinal.operators.pairs import knn_from_pairs, pair_distances
from vicinal.sources.points import lookup

POINTS = "id bigint, features array<float>, group_id int"


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=5)], i % 3) for i in range(60)]
    rows += [(7, [1.0, 2.0, 3.0, 4.0, 5.0], 1), (60, [0.0] * 5, None), (None, [9.0] * 5, 0), (61, [1.0], 0)]
    pairs = [(int(a), int(b), float(n)) for n, (a, b) in enumerate(rng.integers(0, 61, size=(900, 2)))]
    points = spark.createDataFrame(rows, POINTS)
    return points, spark.createDataFrame(pairs + pairs[:5] + [(7, 7, -1.0)], "src bigint, dst bigint, weight double")


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("block_rows", [None, 7])
@pytest.mark.parametrize("sparse", [False, True])
@pytest.mark.parametrize("measured", [False, True])
def test_blocks_as_joins(made, monkeypatch, block_rows, sparse, measured):
    points, pairs = made
    if sparse:
        points = points.withColumn("features", to_sparse(F.col("features")))
    monkeypatch.setattr(ends, "FEWEST_PAIRS", 20)
    told = [
        rows(with_ends(pairs, points.select("id", "features"), points, "error", measured, block_rows=block_rows, by_cells=by))
        for by in (True, False)
    ]
    assert told[0] == told[1] and len(told[0]) > 906


def test_missing_ends(made, spark):
    points, _ = made
    pairs = spark.createDataFrame([(1, 2), (1, 99), (None, 3), (4, None)], "src bigint, dst bigint")
    points = points.select("id", "features")
    for by in (True, False):
        assert with_ends(pairs, points, points, "drop", True, by_cells=by).count() == 1
        for wrong in pairs.collect()[1:]:
            with pytest.raises(Exception, match="no point with id" if None not in tuple(wrong) else ""):
                with_ends(spark.createDataFrame([wrong], pairs.schema), points, points, "error", True, by_cells=by).collect()


def test_vectors_do_not_travel_with_pairs(spark):
    """Many pairs of few points: nothing but narrow pairs and whole blocks is shuffled."""
    points = spark.range(500).select("id", F.transform(F.sequence(F.lit(1), F.lit(64)), lambda x: (F.col("id") + x).cast("float")).alias("features"))
    pairs = spark.range(60000).select((F.col("id") % 499).alias("src"), (F.col("id") % 483).alias("dst"))
    for df in (pair_distances(points, pairs), lookup(pairs, points, ("src", "dst"))):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "RepartitionByExpression" in plan and "LeftOuter" not in plan
    assert knn_from_pairs(points, pairs, 3).count() == 499 * 3


@pytest.mark.parametrize("group_col", [None, "group_id"])
def test_short_lists_as_pairs(made, spark, group_col):
    """Short lists become pairs of ids, long ones cells; repeated ids keep to cells."""
    rng = np.random.default_rng(4)
    wide = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.element_at("features", (i % 5 + 1).cast("int")) * (i + 1)).cast("array<float>")
    points = made[0].where("id < 60").dropDuplicates(["id"]).withColumn("features", wide)
    members = [(n, int(x)) for n in range(60) for x in rng.integers(0, 60, size=n % 6)] + [(60, i) for i in range(40)]
    lists = spark.createDataFrame(members, "list_id bigint, id bigint")
    sized = bucketize(lists, by=["list_id"], distinct=True)
    told = rows(knn_from_lists(points, lists, 3, group_col))
    assert told == rows(knn_in_buckets(points, sized, 3, group_col, ["list_id"])) and told
    twice = points.union(points.where("id < 20"))
    assert rows(knn_from_lists(twice, lists, 3, group_col)) == rows(knn_in_buckets(twice, sized, 3, group_col, ["list_id"]))


def test_vectors_do_not_travel_with_members(spark):
    points = spark.range(300).select("id", F.transform(F.sequence(F.lit(1), F.lit(64)), lambda x: (F.col("id") * x % 17).cast("float")).alias("features"))
    lists = spark.range(30000).select(F.expr("id div 4").alias("list_id"), (F.xxhash64("id") % 300).alias("id")).where("id >= 0")
    found = knn_from_lists(points, lists, 3)
    assert "RepartitionByExpression" in (plan := found._jdf.queryExecution().optimizedPlan().toString()) and "LeftOuter" not in plan
    assert rows(found) == rows(knn_in_buckets(points, bucketize(lists, by=["list_id"], distinct=True), 3, by=["list_id"]))


def test_sparse_blocks_follow_what_rows_carry():
    """A few long vectors among short ones do not make blocks, and with them copies, many."""
    from vicinal.operators.cells import block_rows_for, sparse_block_rows

    assert sparse_block_rows(40 * 600_000, 600_000) > 5 * block_rows_for(105, 12)
    assert sparse_block_rows(10**9, 1000) == 256 and sparse_block_rows(0, 0) == 256


def test_projections_leave_in_bounded_batches():
    """Whatever the rows of a batch, long keys of many tables do not make it large."""
    from vicinal.operators.hashing import VALUES_TOGETHER, slices

    batch = pa.record_batch({"id": pa.array(range(10_000))})
    parts = list(slices(iter([batch, batch.slice(0, 0), batch]), 36 * 12))
    assert sum(p.num_rows for p in parts) == 20_000 and all(0 < p.num_rows * 36 * 12 <= VALUES_TOGETHER for p in parts)
