"""Every operator as a query over the given tables, with the SQL that should agree with it."""

from __future__ import annotations

import sys
from collections.abc import Callable
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from vicinal import Distance, KnnConfig, knn_graph  # noqa: E402
from vicinal.functions.distance import dimension, dot_product, squared_distance  # noqa: E402
from vicinal.functions.gaussian import Gaussian  # noqa: E402
from vicinal.functions.keys import key_concat, key_prefix  # noqa: E402
from vicinal.functions.sparse import is_sparse, sparse_dot, to_sparse, vector_size  # noqa: E402
from vicinal.functions.stats import (  # noqa: E402
    approx_median,
    deviation_summary,
    dim_stats,
    kth_smallest,
    median_lower,
)
from vicinal.operators.buckets import (  # noqa: E402
    bucket_histogram,
    bucket_viewed,
    bucketize,
    comparison_cost,
    knn_from_lists,
    knn_in_buckets,
    nearest_in_buckets,
    split_buckets,
)
from vicinal.operators.evaluate import (  # noqa: E402
    degree_stats,
    degrees,
    missed_by_node,
    missed_edges,
    positional,
    recall,
)
from vicinal.operators.exact import knn_exact  # noqa: E402
from vicinal.operators.hashing import (  # noqa: E402
    GivenFamily,
    HashFamily,
    hash_points,
    hash_projected,
    project_points,
)
from vicinal.operators.pairs import knn_connections, knn_from_pairs, pair_distances, pairs_viewed  # noqa: E402
from vicinal.operators.refine import refine, refine_candidates, refine_work  # noqa: E402
from vicinal.operators.retire import drop_completed  # noqa: E402
from vicinal.operators.stragglers import sized_reverse_lists, straggler_exhaustive  # noqa: E402
from vicinal.operators.topk import (  # noqa: E402
    merge_counters,
    merge_graphs,
    merge_lists,
    to_adjacency,
    to_edges,
)
from vicinal.operators.tuning import LONGER, best_key_length, default_key_length  # noqa: E402
from vicinal.session import Scratch, local_checkpoints  # noqa: E402
from vicinal.sources.edges import edges_listed, read_edges, vertices_listed, write_edges  # noqa: E402
from vicinal.sources.points import (  # noqa: E402
    assign_ids,
    describe,
    from_embeddings,
    lookup,
    read_delimited,
    read_libsvm,
)

try:
    import corpus_pipeline
    from vicinal.llm import queries as llm_queries
except ImportError:  # the package also works without these
    llm_queries = None

DIM = 64
FAMILY = HashFamily(DIM, key_length=2, tables=4, seed=7)
FINER = HashFamily(DIM, key_length=1, tables=2, seed=8)
RADIUS = 0.2
SPLIT_AT = 12
THIN = 0.1
BELOW = 100
#: Directions of whole numbers from -3 to 3, so that keys hardly depend on the order of adding.
GIVEN = GivenFamily.of(np.array([(7 * i + i * i // 5) % 7 - 3.0 for i in range(6 * DIM)]).reshape(2, 3, DIM), np.arange(6).reshape(2, 3) / 2)
ROUNDS = KnnConfig(k=5, seed=7, tables=4, key_length=2, radius=RADIUS / 2, max_comparisons=40, max_rounds=3)



def _manhattan_block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of absolute differences, dimension after dimension, in tiles that stay in a core's cache."""
    total = np.zeros((len(a), len(b)))
    bt, rows = np.ascontiguousarray(b.T), max(1, (1 << 14) // max(len(b), 1))
    for at in range(0, len(a), rows):
        part, out = a[at : at + rows], total[at : at + rows]
        gap = np.empty_like(out)
        for j in range(a.shape[1]):
            np.subtract(part[:, j, None], bt[j], out=gap)
            np.abs(gap, out=gap)
            out += gap
    return total


def _manhattan_nearly(b: np.ndarray):
    """The same roughly, in single precision where its range holds the values."""
    bt, most, norm = np.ascontiguousarray(b.T, np.float32), np.abs(b).max(initial=0), np.abs(b).sum(axis=1).max(initial=0)

    def measure(a: np.ndarray):
        if not 1e-20 < max(np.abs(a).max(initial=0), most) < 1e20 or a.shape[1] > 1 << 16:
            return _manhattan_block(a, b), 0.0
        total, narrow = np.zeros((len(a), len(b)), np.float32), a.astype(np.float32)
        rows = max(1, (1 << 15) // max(len(b), 1))
        for at in range(0, len(a), rows):
            out, sides = total[at : at + rows], np.ascontiguousarray(narrow[at : at + rows].T)
            gap = np.empty_like(out)
            for x, y in zip(sides[:, :, None], bt):
                np.subtract(x, y, out=gap)
                np.abs(gap, out=gap)
                np.add(out, gap, out=out)
        # Each of the values, gaps and sums is off by half an epsilon of what it adds to at most.
        return total, (a.shape[1] + 8) * float(np.finfo(np.float32).eps) * (np.abs(a).sum(axis=1).max() + norm)

    return measure


def _manhattan_of_rows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = np.zeros(len(a))
    for x, y in zip(np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)):
        total += np.abs(x - y)
    return total


MANHATTAN = Distance(
    "manhattan",
    lambda a, b: F.aggregate(
        F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x
    ),
    _manhattan_block,
    symmetric=True,
    nearly=_manhattan_nearly,
    of_rows=_manhattan_of_rows,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _points(spark: SparkSession, sf_dir: str, wide: bool = False) -> DataFrame:
    return from_embeddings(_table(spark, sf_dir, "embeddings"), wide)


def _thinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings without their small components, as sparse vectors."""
    points = _points(spark, sf_dir, wide=True)
    large = F.transform("features", lambda x: F.when(F.abs(x) >= THIN, x).otherwise(0.0))
    return points.withColumn("features", to_sparse(large))


def _baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as sparse vectors of the quantities they ordered, one dimension a part."""
    lines, orders = _table(spark, sf_dir, "lineitem"), _table(spark, sf_dir, "orders")
    dim = lines.agg(F.max("l_partkey")).first()[0] + 1
    bought = (
        lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
        .groupBy("o_custkey", "l_partkey")
        .agg(F.sum("l_quantity").cast("double").alias("x"))
    )
    entries = F.array_sort(F.collect_list(F.struct(F.col("l_partkey").cast("int").alias("i"), "x")))
    vector = F.struct(
        F.lit(dim).cast("int").alias("size"),
        F.transform("e", lambda p: p["i"]).alias("indices"),
        F.transform("e", lambda p: p["x"]).alias("values"),
    )
    held = bought.groupBy(F.col("o_custkey").cast("bigint").alias("id")).agg(entries.alias("e"))
    return held.select("id", F.lit(0.0).alias("label"), vector.alias("features"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and suppliers that were ordered together, as pairs of ids of vectors: every line counts."""
    lines, n = _table(spark, sf_dir, "lineitem"), _table(spark, sf_dir, "embeddings").count()
    return lines.select((F.col("l_partkey") % n).alias("src"), (F.col("l_suppkey") % n).alias("dst")).distinct()


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of each order, as a list of ids."""
    n = _table(spark, sf_dir, "embeddings").count()
    lines = _table(spark, sf_dir, "lineitem")
    return lines.select(F.col("l_orderkey").alias("list_id"), (F.col("l_partkey") % n).alias("id"))


def _buckets(points: DataFrame) -> DataFrame:
    return bucketize(hash_points(points, FAMILY, RADIUS))


def _edges(edges: DataFrame, *extra: str) -> DataFrame:
    group = ["group_id"] if "group_id" in edges.columns else []
    return edges.select("src", *group, "dst", F.round("distance", 6).alias("distance"), *extra)


def entry(spark: SparkSession) -> DataFrame:
    """The exact graph of the embeddings, ten neighbours each."""
    return _edges(knn_exact(_points(spark, "/root/testdata/sf0.001"), 10), "rank")


# ---------------------------------------------------------------- graphs


def _knn_exact(spark, sf_dir):
    return _edges(knn_exact(_points(spark, sf_dir), 10), "rank")


def _knn_subset(spark, sf_dir):
    good = _table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    return _edges(knn_exact(_points(spark, sf_dir), 5, subset=good), "rank")


def _knn_sparse(spark, sf_dir):
    return _edges(knn_exact(Scratch(spark).save(_baskets(spark, sf_dir), "baskets"), 5), "rank")


def _knn_grouped(spark, sf_dir):
    return _edges(knn_exact(_points(spark, sf_dir), 3, group_col="group_id"), "rank")


def _knn_manhattan(spark, sf_dir):
    return _edges(knn_exact(_points(spark, sf_dir), 5, distance=MANHATTAN), "rank")


def _knn_brute(spark, sf_dir):
    return _edges(knn_graph(_points(spark, sf_dir), KnnConfig(k=4, method="brute")).edges, "rank")


def _knn_from_pairs(spark, sf_dir):
    return _edges(knn_from_pairs(_points(spark, sf_dir), _pairs(spark, sf_dir), 5), "rank")


def _knn_from_pairs_grouped(spark, sf_dir):
    found = knn_from_pairs(_points(spark, sf_dir), _pairs(spark, sf_dir), 2, group_col="group_id")
    return _edges(found, "rank")


def _pairs_viewed(spark, sf_dir):
    return pairs_viewed(_pairs(spark, sf_dir))


def _knn_from_lists(spark, sf_dir):
    return _edges(knn_from_lists(_points(spark, sf_dir), _lists(spark, sf_dir), 5), "rank")


def _knn_from_lists_grouped(spark, sf_dir):
    return _edges(knn_from_lists(_points(spark, sf_dir), _lists(spark, sf_dir), 2, group_col="group_id"), "rank")


def _knn_connections(spark, sf_dir):
    return _edges(knn_connections(_points(spark, sf_dir), _pairs(spark, sf_dir), 5), "rank")


def _knn_connections_ties(spark, sf_dir):
    coarse = Distance(
        "coarse",
        lambda a, b: F.floor(4 * squared_distance(a, b)).cast("double"),
        lambda a, b: np.floor(4 * ((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2)),
    )
    found = knn_connections(_points(spark, sf_dir), _pairs(spark, sf_dir), 5, keep_ties=True, distance=coarse)
    return _edges(found, "rank")


def _merge_graphs(spark, sf_dir):
    points = _points(spark, sf_dir)
    one = knn_from_pairs(points, _pairs(spark, sf_dir), 5)
    two = knn_from_lists(points, _lists(spark, sf_dir), 5)
    return _edges(merge_graphs([one, None, two], 5), "rank")


def _merge_grouped(spark, sf_dir):
    points = _points(spark, sf_dir)
    one = knn_from_pairs(points, _pairs(spark, sf_dir), 2, group_col="group_id")
    two = knn_from_lists(points, _lists(spark, sf_dir), 2, group_col="group_id")
    return _edges(merge_graphs([one, two], 2), "rank")


def _merge_lists(spark, sf_dir):
    points = _points(spark, sf_dir)
    one = to_adjacency(knn_from_pairs(points, _pairs(spark, sf_dir), 5))
    two = to_adjacency(knn_from_lists(points, _lists(spark, sf_dir), 5)).withColumnRenamed("neighbors", "more")
    none = F.expr("array_except(coalesce(neighbors, more), coalesce(neighbors, more))")
    both = one.join(two, "src", "full")
    merged = merge_lists(F.coalesce("neighbors", none), F.coalesce("more", none), 5)
    return _edges(to_edges(both.select("src", merged.alias("neighbors"))))


def _merge_counters(spark, sf_dir):
    lists = bucketize(_lists(spark, sf_dir), by=["list_id"], distinct=True)
    return merge_counters([pairs_viewed(_pairs(spark, sf_dir)), bucket_viewed(lists)])


def _adjacency(spark, sf_dir):
    lists = to_adjacency(knn_exact(_points(spark, sf_dir), 6))
    return lists.select("src", F.array_join(F.transform("neighbors", lambda n: n["id"]), ",").alias("neighbors"))


def _refine(spark, sf_dir):
    points = _points(spark, sf_dir)
    return _edges(refine(points, knn_exact(points, 3), 3), "rank")


def _refine_candidates(spark, sf_dir):
    return refine_candidates(Scratch(spark).save(knn_exact(_points(spark, sf_dir), 3), "exact"))


def _refine_work(spark, sf_dir):
    points = _points(spark, sf_dir)
    return refine_work(Scratch(spark).save(knn_exact(points, 3), "exact"))


def _refine_grouped(spark, sf_dir):
    points = _points(spark, sf_dir)
    rough = knn_in_buckets(points, _buckets(points), 2, group_col="group_id")
    return _edges(refine(points, rough, 2, group_col="group_id"), "rank")


# ---------------------------------------------------------------- hashing


def _lsh_hash(spark, sf_dir):
    hashed = hash_points(_points(spark, sf_dir), FAMILY, RADIUS)
    return hashed.select("id", "table_id", F.array_join("key", ",").alias("key"))


def _lsh_given_projections(spark, sf_dir):
    """Projections of small whole numbers over all dimensions."""
    hashed = hash_points(_points(spark, sf_dir), GIVEN, 0.3)
    return hashed.select("id", "table_id", F.array_join("key", ",").alias("key"))


def _lsh_hash_sparse(spark, sf_dir):
    hashed = hash_points(_thinned(spark, sf_dir), FAMILY, RADIUS)
    return hashed.select("id", "table_id", F.array_join("key", ",").alias("key"))


def _lsh_stored(spark, sf_dir):
    """Keys of two radii from one table of projections."""
    projected = Scratch(spark).save(project_points(_points(spark, sf_dir), FAMILY), "projected")
    both = [hash_projected(projected, FAMILY, r).withColumn("radius", F.lit(r)) for r in (RADIUS, 2 * RADIUS)]
    return both[0].unionByName(both[1]).select("id", "table_id", F.array_join("key", ",").alias("key"), "radius")


def _lsh_key_ops(spark, sf_dir):
    hashed = hash_points(_points(spark, sf_dir), FAMILY, RADIUS)
    both = key_concat(key_prefix(F.col("key"), 1), F.col("key"))
    return hashed.select("id", "table_id", F.array_join(both, ",").alias("key"))


def _lsh_buckets(spark, sf_dir):
    buckets = _buckets(_points(spark, sf_dir))
    return buckets.select("table_id", F.array_join("key", ",").alias("key"), "id", "size")


def _lsh_shared_tables(spark, sf_dir):
    family = HashFamily(DIM, FAMILY.key_length, FAMILY.tables, FAMILY.seed, share_tables=True)
    buckets = bucketize(hash_points(_points(spark, sf_dir), family, RADIUS), distinct=True)
    return buckets.select(F.array_join("key", ",").alias("key"), "id", "size")


def _lsh_viewed(spark, sf_dir):
    return bucket_viewed(_buckets(_points(spark, sf_dir)))


def _lsh_histogram(spark, sf_dir):
    return bucket_histogram(_buckets(_points(spark, sf_dir)))


def _lsh_cost(spark, sf_dir):
    points = _points(spark, sf_dir)
    cost = comparison_cost(bucket_histogram(_buckets(points)), describe(points).n)
    return cost.select("comparisons", F.round("relative_to_all_pairs", 9).alias("relative_to_all_pairs"))


def _lsh_split(spark, sf_dir):
    points = _points(spark, sf_dir)
    parts = split_buckets(points, _buckets(points), FINER, RADIUS / 2.5, SPLIT_AT)
    return parts.select("table_id", F.array_join("key", ",").alias("key"), "id", "size")


def _lsh_candidates(spark, sf_dir):
    points = _points(spark, sf_dir)
    return _edges(nearest_in_buckets(points, _buckets(points), 5), "rank")


def _lsh_one_round(spark, sf_dir):
    points = _points(spark, sf_dir)
    return _edges(knn_in_buckets(points, _buckets(points), 5), "rank")


def _lsh_one_round_grouped(spark, sf_dir):
    points = _points(spark, sf_dir)
    return _edges(knn_in_buckets(points, _buckets(points), 2, group_col="group_id"), "rank")


def _lsh_parameters(spark, sf_dir):
    points = _points(spark, sf_dir)
    n = describe(points).n
    length, radius = best_key_length(points, HashFamily(DIM, default_key_length(n, DIM), 1, seed=7), 0.1)
    return points.agg(
        F.count(F.lit(1)).alias("points"), F.lit(length).alias("key_length"), F.lit(float(radius)).alias("radius")
    )


def _lsh_adaptive(spark, sf_dir):
    return _edges(knn_graph(_points(spark, sf_dir), KnnConfig(k=10, seed=7)).edges, "rank")


def _lsh_rounds(spark, sf_dir):
    """A whole build of three rounds at a doubling radius, the holders' pass and the exhaustive one."""
    return _edges(knn_graph(_points(spark, sf_dir), ROUNDS).edges, "rank")


def _lsh_rounds_viewed(spark, sf_dir):
    return knn_graph(_points(spark, sf_dir), ROUNDS).viewed


def _lsh_adaptive_grouped(spark, sf_dir):
    config = KnnConfig(k=2, seed=7, tables=6, key_length=2, fill_lists=True)
    return _edges(knn_graph(_points(spark, sf_dir), config, group_col="group_id").edges, "rank")


def _lsh_wide_radius(spark, sf_dir):
    """At a radius this wide all points share one bucket, so hashing gives the exact graph."""
    config = KnnConfig(k=6, seed=7, tables=2, key_length=1, radius=1e6)
    return _edges(knn_graph(_points(spark, sf_dir), config).edges, "rank")


def _remaining(points, by_count=True):
    """A graph of one hashing round and the points it leaves: those compared no more than the average,
    or those with fewer neighbours than an eighth of all points."""
    scratch = Scratch(points.sparkSession)
    buckets = scratch.save(_buckets(points), "buckets")
    viewed = bucket_viewed(buckets)
    k = 5 if by_count else points.count() // 8
    limit = int(viewed.agg(F.avg("viewed")).first()[0]) if by_count else 0
    edges = knn_in_buckets(points, buckets, k)
    if by_count:  # otherwise read once, and there a written table would be dealt out by node a second time
        edges = scratch.save(edges, "edges")
    return edges, drop_completed(points, edges, viewed, k, limit)


def _drop_completed(spark, sf_dir):
    return _remaining(_points(spark, sf_dir))[1].select("id")


def _drop_completed_lists(spark, sf_dir):
    return _remaining(_points(spark, sf_dir), by_count=False)[1].select("id")


def _straggler_reverse(spark, sf_dir):
    points = _points(spark, sf_dir)
    edges, left = _remaining(points)
    lists = sized_reverse_lists(edges, left)
    return _edges(knn_in_buckets(points, lists, 5, by=["list_id"]), "rank")


def _straggler_exhaustive(spark, sf_dir):
    points = _points(spark, sf_dir)
    edges, left = _remaining(points)
    return _edges(straggler_exhaustive(points, left, edges, 5), "rank")


# ---------------------------------------------------------------- evaluation


def _graphs(spark, sf_dir, exact_k=5):
    points = _points(spark, sf_dir)
    scratch = Scratch(spark)
    exact = scratch.save(knn_exact(points, exact_k), "exact")
    return exact, scratch.save(knn_in_buckets(points, _buckets(points), 5), "approximate")


def _rough_graph(spark, sf_dir):
    points = _points(spark, sf_dir)
    return knn_in_buckets(points, _buckets(points), 5)


def _recall(spark, sf_dir):
    row = recall(*_graphs(spark, sf_dir), 5)
    return row.select(F.round("recall", 9).alias("recall"), "k", "nodes_compared", "nodes_missing")


def _recall_below(spark, sf_dir):
    """The quick look at nodes with a small id."""
    row = recall(*_graphs(spark, sf_dir), 5, id_below=BELOW)
    return row.select(F.round("recall", 9).alias("recall"), "k", "nodes_compared", "nodes_missing")


def _missed_edges(spark, sf_dir):
    rounded = [F.round(c, 6).alias(c) for c in ("distance", "max_exact", "max_approx")]
    return missed_edges(*_graphs(spark, sf_dir)).select("src", "side", "dst", *rounded)


def _missed_by_node(spark, sf_dir):
    report = missed_by_node(missed_edges(*_graphs(spark, sf_dir)))
    ids = lambda c: F.array_join(F.transform(c, lambda e: e["dst"]), ",").alias(c)
    return report.select("src", ids("exact_only"), ids("approx_only"))


def _positional(spark, sf_dir):
    return positional(*_graphs(spark, sf_dir, 10)).select(F.round("score", 9).alias("score"), "nodes_compared", "nodes_missing")


def _positional_linear(spark, sf_dir):
    row = positional(*_graphs(spark, sf_dir, 10), k=5, decay="linear")
    return row.select(F.round("score", 9).alias("score"), "nodes_compared", "nodes_missing")


def _degrees(spark, sf_dir):
    return degrees(_rough_graph(spark, sf_dir))


def _degree_stats(spark, sf_dir):
    return degree_stats(_rough_graph(spark, sf_dir))


# ---------------------------------------------------------------- vectors and statistics


def _vector_ops(spark, sf_dir):
    points = _points(spark, sf_dir).select("id", "features")
    sides = lookup(_pairs(spark, sf_dir), points, ("src", "dst"))
    a, b = F.col("src_point.features"), F.col("dst_point.features")
    return sides.select(
        "src",
        "dst",
        F.round(squared_distance(a, b), 6).alias("distance"),
        F.round(dot_product(a, b), 6).alias("dot"),
    )


def _vector_ops_sparse(spark, sf_dir):
    thin = _thinned(spark, sf_dir).select("id", "features")
    told = pair_distances(thin, _pairs(spark, sf_dir))
    points = _points(spark, sf_dir).select("id", "features")
    sides = lookup(told, (thin, points), ("src", "dst"), missing="drop")
    thinned, full = F.col("src_point.features"), F.col("dst_point.features")
    few = F.slice(full, 1, 20)
    return sides.select(
        "src",
        "dst",
        F.round("distance", 6).alias("distance"),
        F.round(sparse_dot(thinned, full), 6).alias("dot"),
        F.round(sparse_dot(thinned, few, shared=True), 6).alias("shared"),
    )


def _dimension(spark, sf_dir):
    return dimension(_points(spark, sf_dir))


def _dim_stats(spark, sf_dir):
    stats = dim_stats(_points(spark, sf_dir))
    return stats.select("dim", *[F.round(c, 9).alias(c) for c in ("mean", "span", "deviation")])


def _deviation_summary(spark, sf_dir):
    row = deviation_summary(dim_stats(_points(spark, sf_dir)))
    return row.select(*[F.round(c, 9).alias(c) for c in row.columns])


def _gauss_pdf(spark, sf_dir):
    points = _points(spark, sf_dir)
    fitted = Gaussian.fit(points)
    diagonal = Gaussian(fitted.mean, np.diag(np.diag(fitted.covariance)))
    return points.select("id", F.round(F.log(diagonal.density("features")), 5).alias("log_density"))


def _gauss_pdf_scalar(spark, sf_dir):
    lines = _table(spark, sf_dir, "lineitem")
    at = lines.agg(F.avg("l_quantity").alias("m"), F.var_pop("l_quantity").alias("v")).first()
    density = Gaussian.scalar(at["m"], at["v"]).density("l_quantity")
    return lines.select("l_orderkey", "l_linenumber", F.round(density, 9).alias("density"))


def _gauss_sample(spark, sf_dir):
    points = _points(spark, sf_dir)
    drawn = Gaussian.fit(points).sample(spark, points.count(), seed=7)
    return drawn.select("id", F.size("features").alias("dim"), F.round(F.element_at("features", 1), 6).alias("first"))


def _kth_smallest(spark, sf_dir):
    return kth_smallest(_table(spark, sf_dir, "lineitem"), "l_suppkey", "l_extendedprice", 5)


def _kth_smallest_deep(spark, sf_dir):
    return kth_smallest(_table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice", 1200)


def _median_lower(spark, sf_dir):
    return median_lower(_table(spark, sf_dir, "lineitem"), "l_suppkey", "l_extendedprice")


def _median_compat(spark, sf_dir):
    return median_lower(_table(spark, sf_dir, "lineitem"), "l_suppkey", "l_extendedprice", compat=True)


def _approx_median(spark, sf_dir):
    return approx_median(_table(spark, sf_dir, "lineitem"), "l_suppkey", "l_extendedprice")


# ---------------------------------------------------------------- sources and sinks


def _point_summary(points: DataFrame) -> DataFrame:
    values = "features.values" if is_sparse(points) else "features"
    total = F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
    return points.select("id", vector_size(points).alias("dim"), F.round(total, 6).alias("total"))


def _text_points(spark, sf_dir):
    points = _points(spark, sf_dir, wide=True)
    path = Scratch(spark).new_path("points.txt")
    line = F.concat_ws(";", F.col("id") + 1, F.array_join(F.col("features").cast("array<string>"), ";"))
    points.select(line.alias("value")).write.text(path)
    return _point_summary(read_delimited(spark, path))


def _libsvm_points(spark, sf_dir):
    points = _points(spark, sf_dir, wide=True)
    path = Scratch(spark).new_path("points.libsvm")
    items = F.transform("features", lambda x, i: F.concat_ws(":", i + 1, x))
    points.select(F.concat_ws(" ", "label", F.array_join(items, " ")).alias("value")).write.text(path)
    read = read_libsvm(spark, path, DIM)
    return _point_summary(read).join(read.select("id", "label"), "id").select("label", "dim", "total")


def _text_roundtrip(spark, sf_dir):
    edges = knn_exact(_points(spark, sf_dir), 5)
    return _edges(read_edges(spark, write_edges(edges, Scratch(spark).new_path("edges"), "text")))


def _edge_lookup(spark, sf_dir):
    return _edges(edges_listed(knn_exact(_points(spark, sf_dir), 10), _pairs(spark, sf_dir)))


def _vertex_lookup(spark, sf_dir):
    toxic = _table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    return vertices_listed(_points(spark, sf_dir), toxic).select("id", "label", "group_id")


def _neighbor_labels(spark, sf_dir):
    points = _points(spark, sf_dir)
    edges = knn_exact(points, 5)
    return lookup(edges, points.select("id", "label"), "dst").select("src", "dst", "label")


def _assign_ids(spark, sf_dir):
    return assign_ids(_table(spark, sf_dir, "lineitem").select("l_orderkey")).select("id")


def _registered(name: str) -> Callable[[SparkSession, str], DataFrame]:
    query = globals()["_" + name]

    def run(spark, sf_dir):
        local_checkpoints(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One entry per operator; every one reads whole tables."""
    return {name: _registered(name) for name in QUERY_NAMES} | (
        llm_queries.queries() | {"pipeline": corpus_pipeline.run} if llm_queries else {}
    )


QUERY_NAMES = """
knn_exact knn_sparse knn_subset knn_grouped knn_manhattan knn_brute knn_from_pairs knn_from_pairs_grouped pairs_viewed
knn_from_lists knn_from_lists_grouped knn_connections knn_connections_ties merge_graphs merge_grouped
merge_lists merge_counters adjacency refine refine_candidates refine_work refine_grouped
lsh_hash lsh_hash_sparse lsh_stored lsh_given_projections lsh_key_ops lsh_buckets lsh_shared_tables lsh_viewed lsh_histogram lsh_cost
lsh_split lsh_candidates lsh_one_round lsh_one_round_grouped lsh_parameters lsh_rounds lsh_rounds_viewed lsh_adaptive
lsh_adaptive_grouped lsh_wide_radius drop_completed drop_completed_lists straggler_reverse
straggler_exhaustive recall recall_below missed_edges missed_by_node positional positional_linear degrees degree_stats
vector_ops vector_ops_sparse dimension dim_stats deviation_summary gauss_pdf gauss_pdf_scalar gauss_sample kth_smallest
kth_smallest_deep median_lower median_compat approx_median text_points libsvm_points text_roundtrip
edge_lookup vertex_lookup neighbor_labels assign_ids
""".split()


# ---------------------------------------------------------------- the same in SQL

POINTS = "p AS (SELECT vec_id AS id, embedding::DOUBLE[] AS f, label AS group_id FROM embeddings)"
VECTORS = "(SELECT count(*) FROM embeddings)"
PAIRS = f"pairs AS (SELECT DISTINCT l_partkey % {VECTORS} AS src, l_suppkey % {VECTORS} AS dst FROM lineitem)"
LISTS = f"lists AS (SELECT DISTINCT l_orderkey AS list_id, l_partkey % {VECTORS} AS id FROM lineitem)"
SIZED_LISTS = "sl AS (SELECT *, count(*) OVER (PARTITION BY list_id) AS size FROM lists)"
SQUARED = "power(list_distance(a.f, b.f), 2)"


def _distances(name: str, pairs: str, distance: str = SQUARED) -> str:
    """Distinct distances of the pairs (src, dst) a table or query gives."""
    return (
        f"{name} AS (SELECT q.src, b.group_id, q.dst, {distance} AS distance "
        f"FROM (SELECT DISTINCT src, dst FROM {pairs}) q JOIN p a ON a.id = q.src JOIN p b ON b.id = q.dst)"
    )


def _top(name: str, source: str, k: int, grouped: bool = False, node: str = "src") -> str:
    other = "dst" if node == "src" else "src"
    group, keys = (" group_id,", f"{node}, group_id") if grouped else ("", node)
    return (
        f"{name} AS (SELECT src,{group} dst, distance, rank FROM (SELECT *, row_number() OVER "
        f"(PARTITION BY {keys} ORDER BY distance, {other}) AS rank FROM {source}) WHERE rank <= {k})"
    )


def _exact(name: str, k: int, grouped: bool = False, distance: str = SQUARED) -> str:
    pairs = "(SELECT a.id AS src, b.id AS dst FROM p a JOIN p b ON a.id <> b.id)"
    return f"{_distances(name + '_d', pairs, distance)}, {_top(name, name + '_d', k, grouped)}"


def _show(name: str, grouped: bool = False, rank: bool = True) -> str:
    group, tail = " group_id," if grouped else "", ", rank" if rank else ""
    return f"SELECT src,{group} dst, round(distance, 6) AS distance{tail} FROM {name}"


def _with(*parts: str) -> str:
    *tables, final = parts
    return f"WITH {', '.join(tables)} {final}"


def _hash_sql(name: str, points: str, family: HashFamily, radius: float) -> str:
    """Keys under a family, its projections written out."""
    a, b = family.projections()
    tables = []
    for t in range(family.tables):
        parts = [
            f"floor((list_inner_product(f, [{', '.join(f'{x:.17e}' for x in a[t, j])}]::DOUBLE[]) / {radius:.17e} "
            f"+ {b[t, j]:.17e}) / 4)::INT"
            for j in range(family.key_length)
        ]
        tables.append(f"SELECT id, {t} AS table_id, [{', '.join(parts)}] AS key FROM {points}")
    return f"{name} AS ({' UNION ALL '.join(tables)})"


def _walk_sql(family: HashFamily) -> tuple[str, ...]:
    """The search for a key length over bucket statistics of every radius and length; `family` holds the longest key."""
    a, b = (x[0] for x in family.projections())
    values = ", ".join(f"list_inner_product(f, [{', '.join(f'{x:.17e}' for x in row)}]::DOUBLE[])" for row in a)
    return (
        f"shifts AS (SELECT [{', '.join(f'{x:.17e}' for x in b)}]::DOUBLE[] AS b)",
        f"q AS (SELECT [{values}]::DOUBLE[] AS v FROM p)",
        f"l0 AS (SELECT greatest(ceil(log2(count(*) // {DIM})) + 1, 1)::INT AS start FROM p)",
        "grid AS (SELECT i, i::INT AS pos, (0.1 * power(2, i))::DOUBLE AS r, (start % 2 + 2 * j)::INT AS len FROM l0, range(0, 9) t(i), "
        f"range(0, 21) u(j) WHERE start % 2 + 2 * j BETWEEN greatest(start // 2, 1) AND 2 * start + {LONGER})",
        "keyed AS (SELECT pos, len, list_transform(list_zip(v[1:len], b[1:len]), lambda x: floor((x[1] / r + x[2]) / 4)::INT) AS key "
        "FROM q, shifts, grid)",
        "sized AS (SELECT pos, len, count(*) AS size FROM keyed GROUP BY pos, len, key HAVING count(*) > 1)",
        "hist AS (SELECT pos, len, size, count(*) AS buckets FROM sized GROUP BY pos, len, size)",
        "seen AS (SELECT pos, len, sum(buckets) AS buckets, max(buckets) AS mode, avg(size) AS mean, stddev_pop(size) AS dev, "
        "max(size) AS largest FROM hist GROUP BY pos, len)",
        "step AS (SELECT w.*, start, buckets IS NULL AS empty, (NOT up AND (buckets IS NULL OR len < start // 2)) AS wider, "
        "coalesce(buckets * 0.5 < mode AND (largest < mean + 3 * dev OR dev = 0), false) AS alike "
        "FROM w LEFT JOIN seen USING (pos, len), l0 WHERE NOT done)",
    )


def _rounds_sql(config: KnnConfig, rounds: int) -> tuple[list[str], str, str]:
    """The build unrolled: rounds, the holders' pass, the exhaustive pass; the names of its edges and counters."""
    family = HashFamily(DIM, config.key_length, config.tables, config.seed)
    k, most = config.k, config.max_comparisons
    parts, edges, counts, left = [], None, None, "p"
    for t in range(rounds):
        parts.append(_hash_sql(f"h{t}", left, family, config.radius * 2**t))
        parts.append(
            f"b{t} AS MATERIALIZED (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY table_id, key) AS size FROM h{t}) WHERE size > 1)"
        )
        pairs = f"(SELECT x.id AS src, y.id AS dst FROM b{t} x JOIN b{t} y ON x.table_id = y.table_id AND x.key = y.key AND x.id <> y.id)"
        parts.append(_distances(f"d{t}", pairs))
        more = f"SELECT src, dst, distance FROM d{t}" + (f" UNION SELECT src, dst, distance FROM {edges}" if edges else "")
        parts += [f"u{t} AS ({more})", _top(f"e{t}", f"u{t}", k).replace(" AS (", " AS MATERIALIZED (", 1)]
        seen = f"SELECT id, size - 1 AS n FROM b{t}" + (f" UNION ALL SELECT id, viewed FROM {counts}" if counts else "")
        parts.append(f"v{t} AS MATERIALIZED (SELECT id, sum(n)::BIGINT AS viewed FROM ({seen}) GROUP BY id)")
        parts.append(f"p{t} AS MATERIALIZED (SELECT * FROM p WHERE id NOT IN (SELECT id FROM v{t} WHERE viewed > {most}))")
        edges, counts, left = f"e{t}", f"v{t}", f"p{t}"
    parts += [
        f"rev AS (SELECT r.dst AS list_id, r.src FROM {edges} r JOIN {left} st ON st.id = r.dst)",
        "rl AS (SELECT list_id, src AS id FROM rev UNION SELECT list_id, list_id FROM rev "
        f"UNION SELECT rev.list_id, r.dst FROM rev JOIN {edges} r ON r.src = rev.src)",
        _distances("hd", LIST_PAIRS.replace("lists", "rl")),
        f"hu AS (SELECT src, dst, distance FROM hd UNION SELECT src, dst, distance FROM {edges})",
        _top("he", "hu", k).replace(" AS (", " AS MATERIALIZED (", 1),
        f"hv AS (SELECT id, sum(n)::BIGINT AS viewed FROM (SELECT id, viewed AS n FROM {counts} UNION ALL "
        "SELECT id, count(*) OVER (PARTITION BY list_id) - 1 FROM rl) GROUP BY id)",
        f"hp AS MATERIALIZED (SELECT id FROM {left} WHERE id NOT IN (SELECT id FROM hv WHERE viewed > {most}))",
        _distances("xd", "(SELECT s.id AS src, t.id AS dst FROM hp s JOIN (SELECT src AS id FROM he UNION SELECT id FROM hp) t ON t.id <> s.id)"),
        "xu AS (SELECT src, dst, distance FROM xd UNION SELECT src, dst, distance FROM he)",
        _top("xe", "xu", k),
    ]
    return parts, "xe", "hv"


HASHED = _hash_sql("h", "p", FAMILY, RADIUS)
SIZED = (
    "bk AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY table_id, key) AS size FROM h) WHERE size > 1)"
)
TOGETHER = (
    "(SELECT x.id AS src, y.id AS dst FROM bk x JOIN bk y ON x.table_id = y.table_id AND x.key = y.key AND x.id <> y.id)"
)
ONE_ROUND = f"{_distances('rd', TOGETHER)}, {_top('r', 'rd', 5)}"
ONE_ROUND_GROUPED = f"{_distances('rd', TOGETHER)}, {_top('r', 'rd', 2, grouped=True)}"
LIST_PAIRS = "(SELECT x.id AS src, y.id AS dst FROM lists x JOIN lists y ON x.list_id = y.list_id AND x.id <> y.id)"
LEFT = (
    "vw AS (SELECT id, sum(size - 1) AS viewed FROM bk GROUP BY id), "
    "st AS (SELECT id FROM p WHERE id NOT IN (SELECT id FROM vw WHERE viewed > (SELECT floor(avg(viewed)) FROM vw)))"
)
REVERSE = (
    "rev AS (SELECT r.dst AS list_id, r.src FROM r JOIN st ON st.id = r.dst), "
    "rl AS (SELECT list_id, src AS id FROM rev UNION SELECT list_id, list_id FROM rev "
    "UNION SELECT rev.list_id, r.dst FROM rev JOIN r ON r.src = rev.src)"
)
OVERLAP = (
    "ov AS (SELECT r.src, count(*) AS approx_size, count(e.dst) AS hits, "
    "(r.src IN (SELECT src FROM e)) AS shared FROM r LEFT JOIN e ON e.src = r.src AND e.dst = r.dst GROUP BY r.src)"
)
# Distances computed in one engine agree bit by bit across its graphs, so rows are compared by id here.
MISSED = (
    "inc AS (SELECT src FROM ov WHERE shared AND hits < approx_size), "
    "m AS (SELECT e.src, 'exact_only' AS side, e.dst, e.distance FROM e JOIN inc USING (src) "
    "WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.src = e.src AND r.dst = e.dst) "
    "UNION ALL SELECT r.src, 'approx_only', r.dst, r.distance FROM r JOIN inc USING (src) "
    "WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.src = r.src AND e.dst = r.dst))"
)
MISSING = "(SELECT count(DISTINCT src) FROM e WHERE src NOT IN (SELECT src FROM r))"


def _positional_sql(decay: str) -> str:
    return _with(
        POINTS,
        HASHED,
        SIZED,
        ONE_ROUND,
        _exact("e", 10),
        "n AS (SELECT src, count(*) AS degree FROM r GROUP BY src)",
        "s AS (SELECT r.src, CASE WHEN e.rank IS NULL THEN 0.0 WHEN e.rank - 1 < k THEN 1.0 "
        f"WHEN e.rank - 1 < 2 * k THEN 1.0 - {decay} ELSE 0.0 END::DOUBLE / k AS score "
        "FROM (SELECT r.*, " + ("n.degree" if "//" in decay else "5") + " AS k FROM r JOIN n USING (src)) r "
        "LEFT JOIN e ON e.src = r.src AND e.dst = r.dst)",
        "SELECT round(avg(score), 9) AS score, count(*) AS nodes_compared, "
        f"{MISSING} AS nodes_missing FROM (SELECT src, sum(score) AS score FROM s GROUP BY src)",
    )


def _rank_sql(group: str, rank: str) -> str:
    return (
        f"SELECT {group}, l_extendedprice FROM (SELECT {group}, l_extendedprice, "
        f"row_number() OVER (PARTITION BY {group} ORDER BY l_extendedprice) AS rn, "
        f"count(*) OVER (PARTITION BY {group}) AS n FROM lineitem) WHERE rn = {rank}"
    )


def oracle_sql() -> dict[str, str]:
    """SQL for every query that has one."""
    return _core_sql() | (llm_queries.oracle_sql() if llm_queries else {})


def _core_sql() -> dict[str, str]:
    """SQL of the graph queries; adaptive loops and random draws have none."""
    key = "array_to_string(key, ',') AS key"
    shared = (
        "u AS (SELECT DISTINCT id, key FROM h), "
        "ub AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY key) AS size FROM u) WHERE size > 1)"
    )
    coarse = f"floor(4 * {SQUARED})::DOUBLE"
    manhattan = "list_sum(list_transform(list_zip(a.f, b.f), lambda t: abs(t[1] - t[2])))"
    round_tables = (POINTS, HASHED, SIZED, ONE_ROUND)
    pair_graph = f"{_distances('pd', 'pairs')}, {_top('pg', 'pd', 5)}"
    list_graph = f"{_distances('ld', LIST_PAIRS)}, {_top('lg', 'ld', 5)}"
    pair_groups = f"{_distances('pd', 'pairs')}, {_top('pg', 'pd', 2, True)}"
    list_groups = f"{_distances('ld', LIST_PAIRS)}, {_top('lg', 'ld', 2, True)}"
    both = "u AS (SELECT src, dst, distance FROM pg UNION SELECT src, dst, distance FROM lg)"
    both_groups = "u AS (SELECT src, group_id, dst, distance FROM pg UNION SELECT src, group_id, dst, distance FROM lg)"
    steps = "(SELECT e1.src, e2.dst FROM {0} e1 JOIN {0} e2 ON e1.dst = e2.src WHERE e1.src <> e2.dst)"
    split = (
        f"sm AS (SELECT table_id, key, id FROM bk WHERE size < {SPLIT_AT} UNION ALL "
        f"SELECT b.table_id * {FINER.tables} + g.table_id, list_concat(b.key, g.key), b.id "
        f"FROM bk b JOIN g ON g.id = b.id WHERE b.size >= {SPLIT_AT})"
    )
    dims = "x AS (SELECT id, unnest(f) AS x, generate_subscripts(f, 1) - 1 AS dim FROM p)"
    stats = "s AS (SELECT dim, avg(x) AS mean, max(x) - min(x) AS span, stddev_pop(x) AS deviation FROM x GROUP BY dim)"
    thin = f"z AS (SELECT id, list_transform(f, lambda x: CASE WHEN abs(x) >= {THIN} THEN x ELSE 0 END) AS f FROM p)"
    rounds, built, counted = _rounds_sql(ROUNDS, ROUNDS.max_rounds)
    summary = "SELECT {0}, len(f) AS dim, round(list_sum(f), 6) AS total FROM p"
    return {
        "knn_exact": _with(POINTS, _exact("e", 10), _show("e")),
        "knn_sparse": _with(
            "v AS (SELECT o_custkey AS id, l_partkey AS c, sum(l_quantity)::DOUBLE AS x FROM lineitem JOIN orders "
            "ON l_orderkey = o_orderkey GROUP BY o_custkey, l_partkey)",
            "n AS (SELECT id, sum(x * x) AS n2 FROM v GROUP BY id)",
            "d AS (SELECT a.id AS src, b.id AS dst, sum(a.x * b.x) AS dot FROM v a JOIN v b ON a.c = b.c AND a.id <> b.id GROUP BY a.id, b.id)",
            "e_d AS (SELECT a.id AS src, b.id AS dst, a.n2 + b.n2 - 2 * coalesce(dot, 0) AS distance FROM n a JOIN n b "
            "ON a.id <> b.id LEFT JOIN d ON d.src = a.id AND d.dst = b.id)",
            _top("e", "e_d", 5),
            _show("e"),
        ),
        "knn_subset": _with(
            POINTS.replace("FROM embeddings", "FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels WHERE quality = 1)"),
            _exact("e", 5),
            _show("e"),
        ),
        "knn_grouped": _with(POINTS, _exact("e", 3, True), _show("e", True)),
        "knn_manhattan": _with(POINTS, _exact("e", 5, distance=manhattan), _show("e")),
        "knn_brute": _with(POINTS, _exact("e", 4), _show("e")),
        "knn_from_pairs": _with(POINTS, PAIRS, pair_graph, _show("pg")),
        "knn_from_pairs_grouped": _with(POINTS, PAIRS, pair_groups, _show("pg", True)),
        "pairs_viewed": _with(PAIRS, "SELECT src AS id, count(*) AS viewed FROM pairs GROUP BY src"),
        "knn_from_lists": _with(POINTS, LISTS, list_graph, _show("lg")),
        "knn_from_lists_grouped": _with(POINTS, LISTS, list_groups, _show("lg", True)),
        "knn_connections": _with(
            POINTS, PAIRS, _distances("pd", "pairs"), _top("c", "pd", 5, node="dst"), _show("c")
        ),
        "knn_connections_ties": _with(
            POINTS,
            PAIRS,
            _distances("pd", "pairs", coarse),
            "c AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY dst ORDER BY distance) AS rank FROM pd) WHERE rank <= 5)",
            _show("c"),
        ),
        "merge_graphs": _with(POINTS, PAIRS, LISTS, pair_graph, list_graph, both, _top("m", "u", 5), _show("m")),
        "merge_grouped": _with(
            POINTS, PAIRS, LISTS, pair_groups, list_groups, both_groups, _top("m", "u", 2, True), _show("m", True)
        ),
        "merge_lists": _with(
            POINTS, PAIRS, LISTS, pair_graph, list_graph, both, _top("m", "u", 5), _show("m", rank=False)
        ),
        "merge_counters": _with(
            PAIRS,
            LISTS,
            SIZED_LISTS,
            "SELECT id, sum(viewed)::BIGINT AS viewed FROM (SELECT src AS id, 1 AS viewed FROM pairs UNION ALL "
            "SELECT id, size - 1 FROM sl WHERE size > 1) GROUP BY id",
        ),
        "adjacency": _with(
            POINTS, _exact("e", 6), "SELECT src, string_agg(dst::VARCHAR, ',' ORDER BY rank) AS neighbors FROM e GROUP BY src"
        ),
        "refine": _with(
            POINTS,
            _exact("e", 3),
            _distances("cd", steps.format("e")),
            "u AS (SELECT src, dst, distance FROM cd UNION SELECT src, dst, distance FROM e)",
            _top("m", "u", 3),
            _show("m"),
        ),
        "refine_candidates": _with(POINTS, _exact("e", 3), f"SELECT DISTINCT src, dst FROM {steps.format('e')}"),
        "refine_work": _with(
            POINTS,
            _exact("e", 3),
            f"SELECT count(*) AS added, count(DISTINCT (src, dst)) AS after_distinct FROM {steps.format('e')}",
        ),
        "refine_grouped": _with(
            POINTS,
            HASHED,
            SIZED,
            ONE_ROUND_GROUPED,
            _distances("cd", steps.format("r")),
            "u AS (SELECT src, group_id, dst, distance FROM cd UNION SELECT src, group_id, dst, distance FROM r)",
            _top("m", "u", 2, True),
            _show("m", True),
        ),
        "lsh_hash": _with(POINTS, HASHED, f"SELECT id, table_id, {key} FROM h"),
        "lsh_hash_sparse": _with(POINTS, thin, _hash_sql("h", "z", FAMILY, RADIUS), f"SELECT id, table_id, {key} FROM h"),
        "lsh_stored": _with(
            POINTS,
            HASHED,
            _hash_sql("g", "p", FAMILY, 2 * RADIUS),
            f"SELECT id, table_id, {key}, {RADIUS}::DOUBLE AS radius FROM h UNION ALL SELECT id, table_id, {key}, {2 * RADIUS}::DOUBLE FROM g",
        ),
        "lsh_parameters": "WITH RECURSIVE "
        + _with(
            POINTS,
            *_walk_sql(HashFamily(DIM, 48, 1, seed=7))[:-1],
            "w AS (SELECT 0 AS pos, start AS len, false AS up, false AS down, false AS done FROM l0 UNION ALL "
            "SELECT CASE WHEN wider OR (NOT empty AND alike AND NOT up AND len - 2 < 1) THEN pos + 1 ELSE pos END, "
            "CASE WHEN wider OR (NOT empty AND alike AND NOT up AND len - 2 < 1) THEN start WHEN empty THEN greatest(len - 2, 1) "
            "WHEN alike THEN greatest(len - 2, 1) "
            f"WHEN down OR len + 2 > 2 * start + {LONGER} THEN len ELSE len + 2 END, "
            f"up OR (NOT wider AND NOT empty AND NOT alike AND NOT down AND len + 2 <= 2 * start + {LONGER}), "
            "down OR (NOT wider AND NOT empty AND alike), "
            f"NOT wider AND (empty OR (alike AND up) OR (NOT alike AND (down OR len + 2 > 2 * start + {LONGER}))) FROM "
            + _walk_sql(FAMILY)[-1].removeprefix("step AS ")
            + ")",
            "SELECT (SELECT count(*) FROM p) AS points, len AS key_length, (0.1 * power(2, pos))::DOUBLE AS radius FROM w WHERE done",
        ).removeprefix("WITH "),
        "lsh_rounds": _with(POINTS, *rounds, _show(built)),
        "lsh_rounds_viewed": _with(POINTS, *rounds, f"SELECT id, viewed FROM {counted}"),
        "lsh_given_projections": _with(POINTS, _hash_sql("h", "p", GIVEN, 0.3), f"SELECT id, table_id, {key} FROM h"),
        "lsh_key_ops": _with(
            POINTS, HASHED, "SELECT id, table_id, array_to_string(list_concat(key[1:1], key), ',') AS key FROM h"
        ),
        "lsh_buckets": _with(POINTS, HASHED, SIZED, f"SELECT table_id, {key}, id, size FROM bk"),
        "lsh_shared_tables": _with(POINTS, HASHED, shared, f"SELECT {key}, id, size FROM ub"),
        "lsh_viewed": _with(POINTS, HASHED, SIZED, "SELECT id, sum(size - 1)::BIGINT AS viewed FROM bk GROUP BY id"),
        "lsh_histogram": _with(POINTS, HASHED, SIZED, "SELECT size, count(*) // size AS buckets FROM bk GROUP BY size"),
        "lsh_cost": _with(
            POINTS,
            HASHED,
            SIZED,
            "c AS (SELECT (sum(size - 1) // 2)::BIGINT AS c FROM bk), n AS (SELECT count(*) AS n FROM p)",
            "SELECT c AS comparisons, round(c / (n * (n - 1) / 2), 9) AS relative_to_all_pairs FROM c, n",
        ),
        "lsh_split": _with(
            POINTS,
            HASHED,
            SIZED,
            _hash_sql("g", "p", FINER, RADIUS / 2.5),
            split,
            f"SELECT table_id, {key}, id, size FROM "
            "(SELECT *, count(*) OVER (PARTITION BY table_id, key) AS size FROM sm) WHERE size > 1",
        ),
        "lsh_candidates": _with(
            POINTS, HASHED, SIZED, _distances("rd", TOGETHER), _top("c", "rd", 5, node="dst"), _show("c")
        ),
        "lsh_one_round": _with(*round_tables, _show("r")),
        "lsh_one_round_grouped": _with(POINTS, HASHED, SIZED, ONE_ROUND_GROUPED, _show("r", True)),
        "lsh_wide_radius": _with(POINTS, _exact("e", 6), _show("e")),
        "drop_completed": _with(POINTS, HASHED, SIZED, LEFT, "SELECT id FROM st"),
        "drop_completed_lists": _with(
            POINTS,
            HASHED,
            SIZED,
            f"f AS (SELECT src FROM (SELECT DISTINCT src, dst FROM {TOGETHER}) GROUP BY src "
            "HAVING count(*) >= (SELECT count(*) // 8 FROM p))",
            "SELECT id FROM p WHERE id NOT IN (SELECT src FROM f)",
        ),
        "straggler_reverse": _with(
            *round_tables,
            LEFT,
            REVERSE,
            _distances("sd", LIST_PAIRS.replace("lists", "rl")),
            _top("s", "sd", 5),
            _show("s"),
        ),
        "straggler_exhaustive": _with(
            *round_tables,
            LEFT,
            _distances("sd", "(SELECT st.id AS src, r.src AS dst FROM st JOIN r ON r.src <> st.id)"),
            _top("s", "sd", 5),
            _show("s"),
        ),
        "recall": _with(
            *round_tables,
            _exact("e", 5),
            OVERLAP,
            "SELECT round(avg(hits) / 5, 9) AS recall, 5 AS k, count(*) AS nodes_compared, "
            f"{MISSING} AS nodes_missing FROM ov WHERE shared",
        ),
        "recall_below": _with(
            *round_tables,
            _exact("e", 5),
            OVERLAP,
            "SELECT round(avg(hits) / 5, 9) AS recall, 5 AS k, count(*) AS nodes_compared, "
            f"(SELECT count(DISTINCT src) FROM e WHERE src < {BELOW} AND src NOT IN (SELECT src FROM r)) AS nodes_missing "
            f"FROM ov WHERE shared AND src < {BELOW}",
        ),
        "missed_edges": _with(
            *round_tables,
            _exact("e", 5),
            OVERLAP,
            MISSED,
            "SELECT src, side, dst, round(distance, 6) AS distance, "
            "round((SELECT max(distance) FROM e WHERE e.src = m.src), 6) AS max_exact, "
            "round((SELECT max(distance) FROM r WHERE r.src = m.src), 6) AS max_approx FROM m",
        ),
        "missed_by_node": _with(
            *round_tables,
            _exact("e", 5),
            OVERLAP,
            MISSED,
            "SELECT src, coalesce(string_agg(dst::VARCHAR, ',' ORDER BY dst) FILTER (side = 'exact_only'), '') AS exact_only, "
            "coalesce(string_agg(dst::VARCHAR, ',' ORDER BY dst) FILTER (side = 'approx_only'), '') AS approx_only "
            "FROM m GROUP BY src",
        ),
        "positional": _positional_sql("(e.rank - 1 - k + 1) // k"),
        "positional_linear": _positional_sql("(e.rank - 1 - k + 1) / k"),
        "degrees": _with(*round_tables, "SELECT src, count(*) AS edges FROM r GROUP BY src"),
        "degree_stats": _with(
            *round_tables,
            "SELECT sum(n)::BIGINT AS edges, count(*) AS nodes, min(n) AS fewest, max(n) AS most "
            "FROM (SELECT count(*) AS n FROM r GROUP BY src)",
        ),
        "vector_ops": _with(
            POINTS,
            PAIRS,
            f"SELECT src, dst, round({SQUARED}, 6) AS distance, round(list_inner_product(a.f, b.f), 6) AS dot "
            "FROM pairs JOIN p a ON a.id = src JOIN p b ON b.id = dst",
        ),
        "vector_ops_sparse": _with(
            POINTS,
            PAIRS,
            thin,
            f"SELECT src, dst, round({SQUARED}, 6) AS distance, round(list_inner_product(a.f, c.f), 6) AS dot, "
            "round(list_inner_product(a.f[1:20], c.f[1:20]), 6) AS shared "
            "FROM pairs JOIN z a ON a.id = src JOIN z b ON b.id = dst JOIN p c ON c.id = dst",
        ),
        "dimension": _with(POINTS, "SELECT max(len(f))::INT AS dimension FROM p"),
        "dim_stats": _with(
            POINTS,
            dims,
            stats,
            "SELECT dim::INT AS dim, round(mean, 9) AS mean, round(span, 9) AS span, round(deviation, 9) AS deviation FROM s",
        ),
        "deviation_summary": _with(
            POINTS,
            dims,
            stats,
            "SELECT round(max(deviation), 9) AS max_deviation, round(min(deviation), 9) AS min_deviation, "
            "round(avg(deviation), 9) AS mean_deviation FROM s",
        ),
        "gauss_pdf": _with(
            POINTS,
            dims,
            "g AS (SELECT dim, avg(x) AS m, var_pop(x) AS v FROM x GROUP BY dim)",
            "SELECT id, round(-0.5 * (count(*) * ln(2 * pi()) + sum(ln(v)) + sum((x - m) * (x - m) / v)), 5) AS log_density "
            "FROM x JOIN g USING (dim) GROUP BY id",
        ),
        "gauss_pdf_scalar": (
            "SELECT l_orderkey, l_linenumber, round(exp(-0.5 * (l_quantity - m) * (l_quantity - m) / v) / sqrt(2 * pi() * v), 9) "
            "AS density FROM lineitem, (SELECT avg(l_quantity) AS m, var_pop(l_quantity) AS v FROM lineitem)"
        ),
        "kth_smallest": _rank_sql("l_suppkey", "5"),
        "kth_smallest_deep": _rank_sql("l_returnflag", "1200"),
        "median_lower": _rank_sql("l_suppkey", "(n + 1) // 2"),
        "median_compat": _rank_sql("l_suppkey", "greatest((n - 1) // 2, 1)"),
        "text_points": _with(POINTS, summary.format("id")),
        "libsvm_points": _with(POINTS, summary.format("group_id::DOUBLE AS label")),
        "text_roundtrip": _with(POINTS, _exact("e", 5), _show("e", rank=False)),
        "edge_lookup": _with(
            POINTS, PAIRS, _exact("e", 10), _show("e", rank=False) + " WHERE (src, dst) IN (SELECT (src, dst) FROM pairs)"
        ),
        "vertex_lookup": "SELECT vec_id AS id, label::DOUBLE AS label, label AS group_id FROM embeddings "
        "WHERE vec_id IN (SELECT doc_id FROM labels WHERE toxic = 1)",
        "neighbor_labels": _with(
            POINTS, _exact("e", 5), "SELECT src, dst, p.group_id::DOUBLE AS label FROM e JOIN p ON p.id = e.dst"
        ),
        "assign_ids": "SELECT row_number() OVER () - 1 AS id FROM lineitem",
    }
