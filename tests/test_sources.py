import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from helpers import brute, neighbor_ids
from vicinal import KnnConfig
from vicinal.functions.gaussian import Gaussian
from vicinal.operators.exact import knn_exact
from vicinal.plans.workflow import run
from vicinal.session import Scratch, checkpoint_root, free_path
from vicinal.sources.edges import edges_between, edges_listed, read_edges, vertices_listed, vertices_with, write_edges
from vicinal.sources.points import assign_ids, describe, from_vectors, lookup, read_delimited, read_libsvm, read_points


def test_delimited_text_counts_ids_from_one(spark, tmp_path):
    path = tmp_path / "points.txt"
    path.write_text("1;0.0;2.5\n2;1.0;-3e2\n\n")
    rows = read_delimited(spark, str(path)).orderBy("id").collect()
    assert [(r["id"], r["label"], r["features"]) for r in rows] == [(0, 0.0, [0.0, 2.5]), (1, 0.0, [1.0, -300.0])]
    assert read_points(spark, str(path)).count() == 2


def test_libsvm_is_sparse_or_dense_and_numbered(spark, tmp_path):
    path = tmp_path / "points.libsvm"
    path.write_text("0 1:0.5 3:2.0\n1 2:1.0\n")
    rows = read_points(spark, str(path), dense=True).orderBy("id").collect()
    assert [(r["id"], r["label"], r["features"]) for r in rows] == [(0, 0.0, [0.5, 0.0, 2.0]), (1, 1.0, [0.0, 1.0, 0.0])]
    rows = read_points(spark, str(path)).orderBy("id").collect()
    assert [(r["id"], r["label"], tuple(r["features"])) for r in rows] == [(0, 0.0, (3, [0, 2], [0.5, 2.0])), (1, 1.0, (3, [1], [1.0]))]
    assert len(read_libsvm(spark, str(path), dim=5, dense=True).first()["features"]) == 5


def test_libsvm_ids_follow_files_and_lines(spark, tmp_path):
    """Spark reads larger files first; ids go by name and line all the same."""
    folder = tmp_path / "many.libsvm"
    folder.mkdir()
    labels = iter(range(1000))
    for name, count in (("a", 3), ("b", 200), ("c", 1), ("d", 50)):
        (folder / name).write_text("".join(f"{next(labels)} 1:1.0\n" for _ in range(count)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400")
    try:
        rows = read_libsvm(spark, str(folder), dim=2).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == 254 and all(r["id"] == r["label"] for r in rows)


def test_ml_vectors(spark):
    rows = spark.createDataFrame([(3, Vectors.sparse(3, [1], [2.0])), (4, Vectors.dense(1, 2, 3))], ["key", "v"])
    points = from_vectors(rows, id="key", features="v").orderBy("id").collect()
    assert [(r["id"], r["features"]) for r in points] == [(3, [0.0, 2.0, 0.0]), (4, [1.0, 2.0, 3.0])]


def test_edges_round_trip_and_never_overwrite(spark, line, tmp_path):
    edges = knn_exact(line, 2)
    path = str(tmp_path / "graph")
    assert write_edges(edges.unionByName(edges), path, "text") == path
    assert write_edges(edges, path, "text") == path + "-1"
    assert write_edges(edges, path) == path + "-2"
    assert free_path(spark, path) == path + "-3"
    lines = {r["value"] for r in spark.read.text(path).collect()}
    assert "(0,1,1.0)" in lines and len(lines) == 12
    for stored in (read_edges(spark, path), spark.read.parquet(path + "-2")):
        assert neighbor_ids(stored) == neighbor_ids(edges)


def test_grouped_edges_keep_their_group(spark, line, tmp_path):
    path = write_edges(knn_exact(line, 1, "group_id"), str(tmp_path / "grouped"))
    assert set(spark.read.parquet(path).columns) == {"src", "group_id", "dst", "distance"}


def test_lookups(spark, line):
    edges = knn_exact(line, 2)
    assert edges_between(edges, 3, 2).first()["distance"] == 9.0 and edges_between(edges, 0, 5).count() == 0
    pairs = spark.createDataFrame([(3, 2), (0, 5)], "src bigint, dst bigint")
    assert edges_listed(edges, pairs).count() == 1
    assert vertices_with(line, 4).first()["features"] == [10.0]
    assert vertices_listed(line, spark.createDataFrame([(4,), (77,)], "id bigint")).count() == 1
    assert {r["features"][0] for r in lookup(pairs, line, "dst").collect()} == {3.0, 15.0}


def test_ids_are_dense_and_in_order(spark):
    rows = spark.range(0, 1000, 1, 7).where("id % 3 <> 0").select(F.col("id").alias("was"))
    numbered = [(r["id"], r["was"]) for r in assign_ids(rows).orderBy("id").collect()]
    assert [n for n, _ in numbered] == list(range(len(numbered)))
    assert [w for _, w in numbered] == sorted(w for _, w in numbered)


def test_scratch_tables_lie_in_the_checkpoint_folder(spark):
    scratch = Scratch(spark)
    saved = scratch.save(spark.range(5), "five")
    assert saved.count() == 5 and checkpoint_root(spark).removeprefix("file:") in saved.inputFiles()[0]


def test_describe_an_empty_table(make_points):
    assert describe(make_points([])).n == 0


@pytest.mark.parametrize("format", ["text", "parquet"])
def test_workflow(spark, tmp_path, format):
    points = Gaussian.standard(4).sample(spark, 300, seed=2)
    source = str(tmp_path / "points.txt")
    line = F.concat_ws(";", F.col("id") + 1, F.array_join(F.col("features").cast("array<string>"), ";"))
    points.select(line.alias("value")).coalesce(1).write.text(source)
    exact = run(spark, source, str(tmp_path / "exact"), KnnConfig(k=4, method="brute"), format=format)
    assert exact["degrees"] == {"edges": 1200, "nodes": 300, "fewest": 4, "most": 4} and exact["relative_cost"] == 1.0
    report = run(spark, source, str(tmp_path / "exact"), KnnConfig(k=4, seed=3), compare=exact["path"], format=format)
    assert report["path"] == exact["path"] + "-1" and report["degrees"]["nodes"] == 300
    before, after = report["comparison"], report["refined"][0]["comparison"]
    assert report["refined"][0]["path"] == report["path"] + "refined0"
    assert before["recall"]["recall"] <= after["recall"]["recall"] <= 1.0
    assert before["positional"]["nodes_compared"] == 300
    assert after["missed"].where("side = 'exact_only'").count() == round((1 - after["recall"]["recall"]) * 1200)


def test_points_from_parquet(spark, tmp_path, line):
    path = str(tmp_path / "line.parquet")
    line.write.parquet(path)
    assert neighbor_ids(knn_exact(read_points(spark, path), 1)) == {
        src: [dst for _, dst in row] for (src, _), row in brute([[0], [1], [3], [6], [10], [15]], 1).items()
    }
