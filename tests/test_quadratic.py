"""Queries whose work grows with the square of the points: nothing is held or written beside what they need."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from vicinal.functions.sparse import Rows, pair_squares, to_sparse
from vicinal.operators import cells, retire, strips
from vicinal.operators.buckets import bucketize, knn_in_buckets
from vicinal.operators.exact import knn_exact
from vicinal.operators.retire import completed_ids
from vicinal.sources.points import describe


def test_manhattan_block_holds_little_beside_its_result():
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(512, 16)), rng.normal(size=(4096, 16))
    told = sum(np.abs(a[:, j, None] - b[None, :, j]) for j in range(16))
    tracemalloc.start()
    found = entry_points.MANHATTAN.block(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(found, told) and peak < 1.5 * found.nbytes


def test_full_lists_are_counted_without_a_written_graph(make_points):
    rng = np.random.default_rng(6)
    points = make_points(rng.normal(size=(80, 64)) / 8)
    edges, left = entry_points._remaining(points, by_count=False)
    assert not any("edges" in path.rsplit("vicinal-", 1)[-1] for path in left.inputFiles())
    by_node = {}
    for row in edges.collect():
        by_node.setdefault(row["src"], set()).add(row["dst"])
    assert {r["id"] for r in left.collect()} == {i for i in range(80) if len(by_node.get(i, ())) < 10}


def halves(n, m, dim, whole=False):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(n + m, dim))
    x[2], x[n + 1], x[n + 3] = x[1], x[1], x[n + 2]
    return pa.table(
        {
            "cell": np.zeros(n + m, np.int64),
            "side": np.repeat([cells.LEFT, cells.RIGHT], [n, m]).astype(np.int8),
            "id": rng.permutation(n + m),
            "group_id": np.zeros(n + m, np.int32),
            "features": pa.array(list(np.round(x) if whole else x)),
        }
    )


def rows_of(parts):
    return sorted(zip(*(np.concatenate(c).tolist() for c in zip(*parts))))


@pytest.mark.parametrize("n, m, whole", [(300, 200, False), (90, 400, True), (3, 7, False), (200, 4, True)])
def test_blocks_are_measured_once_for_both_sides(n, m, whole):
    table, seen = halves(n, m, 6, whole), []

    def block(a, b):
        seen.append(len(a) * len(b))
        return entry_points.MANHATTAN.block(a, b)

    told = entry_points.MANHATTAN
    both = rows_of(cells._compare_cells(table, 4, (told.block, None, None, False)))
    assert rows_of(cells._compare_cells(table, 4, (block, None, None, True))) == both
    assert sum(seen) == n * m
    assert rows_of(cells._compare_cells(table, 4, (told.block, told.nearly, told.of_rows, told.symmetric))) == both


@pytest.mark.parametrize("scale", [1.0, 1e-30, 1e-12, 1e12, 1e30])
def test_rough_manhattan_is_as_near_as_it_says(scale):
    rng = np.random.default_rng(9)
    a, b = rng.normal(size=(50, 40)) * scale, rng.normal(size=(70, 40)) * scale
    a[0], b[0] = 0, rng.normal(size=40) * scale * 1e-9
    d, off = entry_points.MANHATTAN.nearly(b)(a)
    exact = entry_points.MANHATTAN.block(a, b)
    assert (2 * np.abs(d - exact) <= off).all() and off < 1e-3 * exact.mean()
    i, j = np.divmod(np.arange(exact.size), len(b))
    assert np.array_equal(entry_points.MANHATTAN.of_rows(a[i], b[j]), exact.ravel())


@pytest.mark.parametrize("group_col", [None, "group_id"])
def test_long_lists_are_found_whole(spark, make_points, group_col):
    """Lists longer than their vectors come ranked from one task each, the same as those merged from cells."""
    rng = np.random.default_rng(10)
    x = np.round(rng.normal(size=(90, 3)), 1)
    x[5:9] = x[4]
    points = make_points(x, ids=rng.permutation(90) * 3 - 40, groups=rng.integers(0, 3, 90))
    ids = [r["id"] for r in points.collect()]
    rows = [(t, f"b{(i * (t + 1)) % 4}", i) for t in range(3) for i in ids[: 60 + 10 * t]] + [(0, "alone", ids[-1])]
    buckets = bucketize(spark.createDataFrame(rows + rows[:3], "table_id int, key string, id long"))
    want = knn_in_buckets(points, buckets, 25, group_col, block_rows=40)
    found = knn_in_buckets(points, buckets, 25, group_col)
    assert found.schema.simpleString() == want.schema.simpleString()
    assert "Window" not in found._jdf.queryExecution().toString() and sorted(found.collect()) == sorted(want.collect())
    twice = points.unionByName(points.limit(2))
    again = knn_in_buckets(twice, buckets, 25, group_col)
    assert sorted(again.collect()) == sorted(knn_in_buckets(twice, buckets, 25, group_col, block_rows=40).collect())
    fewer = points.where("id > 0")
    dropped = knn_in_buckets(fewer, buckets, 25, group_col, missing="drop")
    assert sorted(dropped.collect()) == sorted(knn_in_buckets(fewer, buckets, 25, group_col, block_rows=40, missing="drop").collect())
    with pytest.raises(Exception, match="no point with id"):
        knn_in_buckets(fewer, buckets, 25, group_col).count()


def test_neighbours_of_long_lists_are_counted_packed(spark, monkeypatch):
    rng = np.random.default_rng(11)
    far = [-(2**63), 2**63 - 1, 0, -1, 300, 70_000, 2**40]
    rows = [(s, g, d) for s in (1, 2, None) for g in (0, None) for d in [*far[: 3 + (s or 0)], *rng.integers(0, 40, 30).tolist()]]
    rows += [(1, 0, None), (1, 0, None), (3, 1, None), (4, 1, 7)]
    edges = spark.createDataFrame(rows * 2, "src long, group_id int, dst long").repartition(3)
    viewed = spark.createDataFrame([], "id long, viewed long")
    for graph, groups in ((edges, 2), (edges.drop("group_id"), 1)):
        for k in (1, 3, 15, 28):
            plain = sorted(str(r["id"]) for r in completed_ids(graph, viewed, k, 0, groups).collect())
            with monkeypatch.context() as m:
                m.setattr(retire, "LONG_LIST", 1)
                packed = completed_ids(graph, viewed, k, 0, groups)
                assert "Distinct" not in packed._jdf.queryExecution().logical().toString()
                assert sorted(str(r["id"]) for r in packed.collect()) == plain


@pytest.mark.parametrize("many, met", [(0.9, 60), (0.0, 1 << 20), (0.3, 1 << 20)])
def test_sparse_strips_give_the_graph_of_the_full_vectors(spark, many, met, monkeypatch):
    """Blocks of sources against groups of targets, where few or many coordinates are shared, with ties and empty vectors."""
    rng = np.random.default_rng(12)
    x = np.round(rng.normal(size=(120, 25)) * (rng.random((120, 25)) < rng.choice([0.05, 0.3], (120, 1))), 1)
    x[3:7], x[10:13] = x[3], 0
    ids = rng.permutation(120) * 11 - 500
    dense = spark.createDataFrame([(int(i), v) for i, v in zip(ids, x.tolist())], "id long, features array<double>")
    dense = dense.withColumn("label", F.lit(0.0)).repartition(3)
    sparse = dense.withColumn("features", to_sparse(F.col("features")))
    monkeypatch.setattr(strips, "MANY", many)
    monkeypatch.setattr(strips, "MET_AT_ONCE", met)
    monkeypatch.setattr(strips, "CHUNK_ENTRIES", 40)
    monkeypatch.setattr(strips, "SOURCE_BYTES", 2000)
    monkeypatch.setattr(strips, "TARGET_BYTES", 1500)
    for k in (1, 4, 200):
        found = knn_exact(sparse, k)
        assert sorted(found.collect()) == sorted(knn_exact(dense, k).collect())
    edges = strips.strip_edges(sparse, 4, describe(sparse))
    assert 4 * 120 < edges.count() < 120 * 119


def test_chunks_are_packed_without_loss():
    rng = np.random.default_rng(13)
    counts = rng.integers(0, 60, 400)
    rows = [np.sort(rng.choice(1 << 20, n, replace=False)) for n in counts]
    values = rng.integers(1, 50, counts.sum()).astype(float)
    values[::7] = rng.normal(size=len(values[::7])) * 1e300
    values[1] = -0.0
    x = Rows(1 << 20, np.append(0, np.cumsum(counts)), np.concatenate(rows).astype(np.int64), values)
    ids = rng.integers(-(2**62), 2**62, 400)
    batch = strips._packed(5, ids, x)
    got_ids, got = strips._unpacked({c: batch.column(c)[0] for c in batch.schema.names})
    assert np.array_equal(got_ids, ids) and got.size == x.size and got.values.tobytes() == x.values.tobytes()
    assert np.array_equal(got.starts, x.starts) and np.array_equal(got.indices, x.indices)
    assert batch.nbytes < 0.6 * 12 * len(values)


def test_few_pairs_are_measured_where_few_share_a_coordinate(monkeypatch):
    rng = np.random.default_rng(14)
    n, each = 3000, 5
    columns = np.sort(rng.integers(0, 200_000, (n, each)) + np.arange(each) * 200_000, axis=1)
    x = Rows(each * 200_000, np.arange(n + 1) * each, columns.ravel(), rng.integers(1, 50, n * each).astype(float))
    x, seen = x.take(np.argsort(x.squares())), []
    monkeypatch.setattr(strips, "pair_squares", lambda a, i, b, j: seen.append(len(i)) or pair_squares(a, i, b, j))
    monkeypatch.setattr(strips, "PAIRS_AT_ONCE", 1 << 15)
    strip = strips._Strip([(np.arange(n), x)], 5)
    for at in range(0, n, 100):
        strip.meet(np.arange(at, at + 100), x.take(np.arange(at, at + 100)))
    assert sum(len(b) for b in strip.edges()) == 5 * n and sum(seen) < 0.02 * n * n
