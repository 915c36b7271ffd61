"""Sparse points give what the same points give written out in full."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from vicinal import Distance, KnnConfig, knn_graph
from vicinal.functions.distance import dimension, dot_product, squared_distance
from vicinal.functions.sparse import Postings, Rows, from_ml_vector, pair_squares, sparse_dot, to_sparse
from vicinal.operators import cells
from vicinal.operators.buckets import bucketize, knn_in_buckets
from vicinal.operators.exact import knn_against, knn_exact
from vicinal.operators.hashing import HashFamily, hash_points, hash_projected, project_points
from vicinal.operators.pairs import knn_from_pairs
from vicinal.operators.refine import refine
from vicinal.sources.points import describe, from_vectors

DIM = 40


@pytest.fixture(scope="module")
def both(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, DIM)) * (rng.random((300, DIM)) < 0.15)
    x[7], x[8], x[9] = 0, x[10], x[10]  # an empty vector, copies
    x[:, 3] += 1  # a coordinate that all have
    rows = [(int(3 * i - 50), 0.0, [float(v) for v in row], int(i % 7)) for i, row in enumerate(x)]
    dense = spark.createDataFrame(rows, "id bigint, label double, features array<double>, group_id int").cache()
    return dense, dense.withColumn("features", to_sparse(F.col("features")))


def rows(frame):
    return sorted(map(tuple, frame.collect()))


def test_sparse_column(both):
    dense, sparse = both
    for a, b in zip(dense.orderBy("id").collect(), sparse.orderBy("id").collect(), strict=True):
        full = np.zeros(DIM)
        full[b.features.indices] = b.features["values"]
        assert full.tolist() == a.features and 0 not in b.features["values"]
    assert describe(sparse).dim == describe(dense).dim == DIM and dimension(sparse).first()[0] == DIM


@pytest.mark.parametrize("group", [None, "group_id"])
@pytest.mark.parametrize("block_rows", [None, 50])
def test_exact_edges_are_the_same(both, group, block_rows):
    dense, sparse = both
    assert rows(knn_exact(sparse, 4, group, block_rows=block_rows)) == rows(knn_exact(dense, 4, group, block_rows=block_rows))


@pytest.mark.parametrize("small", [0, 1 << 14])
def test_both_ways_through_a_cell(both, monkeypatch, small):
    dense, sparse = both
    want = rows(knn_exact(dense, 3, "group_id"))
    monkeypatch.setattr(cells, "SMALL_CELL", small)
    assert rows(knn_exact(sparse, 3, "group_id")) == want == rows(knn_exact(dense, 3, "group_id"))


def test_other_operators(spark, both):
    dense, sparse = both
    pairs = dense.select(F.col("id").alias("src")).crossJoin(dense.where("id % 2 = 0").select(F.col("id").alias("dst")))
    assert rows(knn_from_pairs(sparse, pairs, 3)) == rows(knn_from_pairs(dense, pairs, 3))
    few = "id < 100"
    assert rows(knn_against(sparse.where(few), sparse, 3)) == rows(knn_against(dense.where(few), dense, 3))
    rough = knn_exact(dense, 2)
    assert rows(refine(sparse, rough, 2)) == rows(refine(dense, rough, 2))
    family = HashFamily(DIM, 2, 5, seed=3)
    buckets = bucketize(hash_points(sparse, family, 0.8))
    assert rows(buckets) == rows(bucketize(hash_points(dense, family, 0.8)))
    assert rows(knn_in_buckets(sparse, buckets, 3)) == rows(knn_in_buckets(dense, buckets, 3))


@pytest.mark.parametrize("copies", [False, True])
def test_adaptive_build(both, copies):
    dense, sparse = both
    config = KnnConfig(k=3, seed=5, tables=4, key_length=2, collapse_copies=copies)
    one, two = knn_graph(sparse, config), knn_graph(dense, config)
    assert rows(one.edges) == rows(two.edges) and one.steps == two.steps


def test_keys_of_stored_projections(both):
    dense, sparse = both
    family = HashFamily(DIM, 3, 4, seed=9)
    for radius in (0.05, 0.4, 3.2):
        want = rows(hash_points(dense, family, radius))
        assert rows(hash_points(sparse, family, radius)) == want
        assert rows(hash_projected(project_points(sparse, family), family, radius)) == want
    shorter = HashFamily(DIM, 2, 3, seed=9)
    prefixes = {(i, t, tuple(key[:2])) for i, t, key in rows(hash_points(dense, family, 0.4)) if t < 3}
    assert {(i, t, tuple(key)) for i, t, key in rows(hash_points(dense, shorter, 0.4))} == prefixes


def test_coefficients_are_normal():
    family = HashFamily(50_000, 2, 3, seed=4)
    a = family.coefficients(np.arange(6), np.arange(50_000))
    assert abs(a.mean()) < 0.01 and abs(a.std() - 1) < 0.01 and abs((a**4).mean() - 3) < 0.1
    assert np.abs(np.corrcoef(a) - np.eye(6)).max() < 0.02
    shifts = HashFamily(3, 50, 60, seed=4).shifts(np.arange(3000))
    assert 0 < shifts.min() and shifts.max() <= 4 and abs(shifts.mean() - 2) < 0.1
    assert not np.array_equal(family.update(2, 3).coefficients(np.arange(6), np.arange(9)), a[:, :9])


def test_dot_products(both):
    dense, sparse = both
    told = sparse.select("id", F.col("features").alias("s")).join(dense, "id")
    told = told.select(dot_product(F.col("features"), F.col("features")).alias("a"), sparse_dot(F.col("s"), F.col("features")).alias("b"))
    assert all(r.a == r.b for r in told.collect())
    shared = sparse.select(sparse_dot(F.col("features"), F.array(F.lit(2.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)), shared=True).alias("x"))
    want = dense.select((2 * F.col("features")[0] + F.col("features")[3]).alias("x"))
    assert np.allclose([r.x for r in shared.collect()], [r.x for r in want.collect()])
    with pytest.raises(Exception, match="differ in length"):
        sparse.select(sparse_dot(F.col("features"), F.array(F.lit(2.0)))).collect()


def test_a_million_dimensions(spark):
    """Rows of 50 numbers: nothing has room for a million."""
    rng = np.random.default_rng(1)
    made = []
    for i in range(1500):
        at = np.sort(rng.choice(1_000_000, 50, replace=False))
        if i % 3:  # near the one before
            at, value = last
            value = value + rng.normal(0, 0.01, 50)
        else:
            value = rng.standard_normal(50)
        last = at, value
        made.append((i, 0.0, (1_000_000, at.tolist(), value.tolist())))
    points = spark.createDataFrame(made, "id bigint, label double, features struct<size:int,indices:array<int>,values:array<double>>")
    exact = knn_exact(points, 2).collect()
    assert len(exact) == 3000 and all(r.src // 3 == r.dst // 3 for r in exact)
    hashed = knn_graph(points, KnnConfig(k=2, seed=1, tables=6, key_length=4)).edges.collect()
    assert {(r.src, r.dst) for r in hashed} & {(r.src, r.dst) for r in exact}


def test_own_distance(both):
    dense, sparse = both
    column = lambda a, b: squared_distance(a, b)
    block = lambda a, b: ((a[:, None, :] - b[None]) ** 2).sum(axis=2)
    sparse_block = lambda a, b: a.squares()[:, None] + b.squares() - 2 * Postings(b).products(a)
    own = Distance("own", column, block, sparse_block)
    near = {(r.src, r.rank): r.distance for r in knn_exact(dense, 3).collect()}
    got = {(r.src, r.rank): r.distance for r in knn_exact(sparse, 3, distance=own).collect()}
    assert near.keys() == got.keys() and all(abs(near[k] - got[k]) < 1e-9 for k in near)
    with pytest.raises(ValueError, match="sparse"):
        knn_exact(sparse, 3, distance=Distance("own", column, block))


@pytest.mark.parametrize(
    "bad, message",
    [
        ((3, [0, 3], [1.0, 1.0]), "rise"),
        ((3, [1, 0], [1.0, 1.0]), "rise"),
        ((3, [1, 1], [1.0, 1.0]), "rise"),
        ((3, [-1], [1.0]), "rise"),
        ((3, [0], [1.0, 2.0]), "numbers of indices"),
        ((3, [0], [float("nan")]), "not finite"),
        ((4, [0], [1.0]), "differ in length"),
        (None, "null"),
    ],
)
def test_bad_vectors_are_refused(spark, bad, message):
    frame = spark.createDataFrame(
        [(1, 0.0, (3, [0], [1.0])), (2, 0.0, bad)],
        "id bigint, label double, features struct<size:int,indices:array<int>,values:array<double>>",
    )
    with pytest.raises(Exception, match=message):
        knn_exact(frame, 1).collect()


def test_ml_vectors_stay_sparse(spark):
    frame = spark.createDataFrame([(1, Vectors.sparse(9, [2, 5], [1.0, 2.0])), (2, Vectors.dense(1, 0, 3)), (3, None)], ["id", "v"])
    got = {r.id: r.f for r in frame.select("id", from_ml_vector(F.col("v")).alias("f")).collect()}
    assert tuple(got[1]) == (9, [2, 5], [1.0, 2.0]) and tuple(got[2]) == (3, [0, 1, 2], [1.0, 0.0, 3.0]) and got[3] is None
    assert from_vectors(frame.where("id = 1"), features="v", sparse=True).first().features.size == 9


def test_pair_squares_in_pieces(monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((50, 30)) * (rng.random((50, 30)) < 0.3)
    i, j = np.nonzero(x)
    sparse = Rows(30, np.append(0, np.cumsum((x != 0).sum(axis=1))), j.astype(np.int64), x[i, j])
    a, b = rng.integers(0, 50, 400), rng.integers(0, 50, 400)
    whole = pair_squares(sparse, a, sparse, b)
    monkeypatch.setattr("vicinal.functions.sparse.ENTRIES_AT_ONCE", 40)
    assert np.array_equal(whole, pair_squares(sparse, a, sparse, b))
    assert np.allclose(Postings(sparse).products(sparse), x @ x.T)
    assert np.allclose(whole, ((x[a] - x[b]) ** 2).sum(axis=1))
