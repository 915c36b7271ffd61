"""Hash buckets and id lists: sizes, cost, splitting, and the nearest neighbours inside them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.functions.distance import SQUARED_EUCLIDEAN, Distance
from vicinal.functions.keys import key_concat
from vicinal.functions.sparse import is_sparse, vector_entries
from vicinal.operators.cells import FEWEST_ROWS, block_rows_column, cell_edges, repeats_of, split_into_cells, whole_lists
from vicinal.operators.ends import with_ends
from vicinal.operators.hashing import HashFamily, hash_points
from vicinal.operators.topk import top_k
from vicinal.session import Scratch, tasks_for
from vicinal.sources.points import found_or, join_kind, kernel_columns

BUCKET = ["table_id", "key"]
LONGEST_AS_PAIRS = 16
#: Vectors that a task may hold all at once, in bytes; the least share of all pairs that share a bucket for a task to look at
#: every pair; and bytes of an edge.
WHOLE_BYTES, WHOLE_SHARE, EDGE_BYTES = 128 << 20, 0.1, 24


def bucketize(
    members: DataFrame, by: list[str] = BUCKET, distinct: bool = False, scratch: Scratch | None = None
) -> DataFrame:
    """Members of buckets that hold at least two ids, with the bucket's `size`.

    Sizes are an aggregate joined back, not a window, so a bucket with most of the rows is counted
    map-side and its members stay spread. `distinct` first drops repeated members. The hash put before
    the key spares the join's sort from comparing arrays. Members are read twice, to count and to join: with
    `scratch` they are written first, so that what makes them runs once.
    """
    rows = members.select(*by, "id")
    if distinct:
        rows = rows.distinct()
    rows = rows.withColumn("_hash", F.xxhash64(*by))
    if scratch:
        rows = scratch.save(rows, "members")
    sizes = rows.groupBy("_hash", *by).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)
    return rows.join(sizes, ["_hash", *by]).drop("_hash")


def bucket_histogram(buckets: DataFrame) -> DataFrame:
    """How many buckets there are of each size; a bucket of n has n rows, so rows / n counts buckets."""
    return buckets.groupBy("size").agg(F.expr("count(*) div size").alias("buckets"))


def comparison_cost(histogram: DataFrame, n: int, extra: int = 0) -> DataFrame:
    """Comparisons the buckets imply, and their share of all pairs of n points."""
    pairs = n * (n - 1) / 2.0
    row = histogram.agg(F.coalesce(F.sum(F.expr("buckets * size * (size - 1) div 2")), F.lit(0)).alias("_c"))
    total = F.col("_c") + F.lit(extra)
    ratio = total / F.lit(pairs) if pairs else F.lit(None).cast("double")
    return row.select(total.cast("bigint").alias("comparisons"), ratio.alias("relative_to_all_pairs"))


def bucket_viewed(buckets: DataFrame) -> DataFrame:
    """Effort counter: each bucket (or list) an id is in adds the number of its other members."""
    return buckets.groupBy("id").agg(F.sum(F.col("size") - 1).alias("viewed"))


def split_buckets(
    points: DataFrame, buckets: DataFrame, family: HashFamily, radius: float, max_size: int
) -> DataFrame:
    """Re-hash members of buckets of `max_size` or more at `radius`; the new key is old then new.

    The new table number tells old and new table apart, so splits of different tables never meet.
    """
    small = buckets.where(F.col("size") < max_size).select(*BUCKET, "id")
    large = buckets.where(F.col("size") >= max_size).select(*BUCKET, "id")
    needed = points.join(large.select("id").distinct(), "id", "left_semi")
    fresh = hash_points(needed, family, radius).toDF("id", "_table", "_key")
    split = large.join(fresh, "id").select(
        (F.col("table_id") * family.tables + F.col("_table")).cast("int").alias("table_id"),
        key_concat(F.col("key"), F.col("_key")).alias("key"),
        "id",
    )
    return bucketize(small.unionByName(split))


def knn_in_buckets(
    points: DataFrame,
    buckets: DataFrame,
    k: int,
    group_col: str | None = None,
    by: list[str] = BUCKET,
    distance: Distance = SQUARED_EUCLIDEAN,
    block_rows: int | None = None,
    tasks: int | None = None,
    missing: str = "error",
) -> DataFrame:
    """The k nearest of each id among the ids it shares a bucket with, over all its buckets.

    `buckets` is what `bucketize` returns. A bucket beyond `block_rows` becomes several cells, one for
    each pair of its blocks; the outcome is the same and no task holds the bucket whole. Only members
    of buckets that survived get a vector. A member without a point fails the job, or with `missing="drop"`
    is left out.

    Lists of which each outweighs its vector in every task (`k` in the hundreds) are not merged from cells, which would send them
    several times over: where the points have room in a task and most pairs meet, a task finds the whole lists of its share.
    """
    spark = points.sparkSession
    if not (block_rows or tasks or is_sparse(points)) and distance is SQUARED_EUCLIDEAN:
        width = _width_for_whole(points, buckets, k)
        if width:
            name = F.concat_ws("|", *[F.col(c).cast("string") for c in by])
            held = buckets.select("id", name.alias("bucket")).groupBy("id").agg(F.collect_list("bucket").alias("buckets"))
            rows = held.join(kernel_columns(points, group_col), "id", join_kind(missing)).withColumn(
                "features", found_or(missing, F.col("features"), F.col("id"))
            )
            edges = whole_lists(rows, k, width)
            return edges if group_col else edges.drop("group_id")
    members = buckets.select(F.concat_ws("|", *[F.col(c).cast("string") for c in by]).alias("bucket"), "id", "size")
    vectors = members.join(kernel_columns(points, group_col), "id", join_kind(missing)).withColumn(
        "features", found_or(missing, F.col("features"), F.col("id"))
    )
    cells = split_into_cells(vectors, F.ceil(F.col("size") / (F.lit(block_rows) if block_rows else block_rows_column(vectors))))
    if not tasks:
        # Vectors of b blocks travel b times, so rows times blocks bound what is shuffled.
        blocks = F.greatest(F.lit(1.0), F.col("size") / (F.lit(block_rows) if block_rows else F.lit(FEWEST_ROWS)))
        told = buckets.agg(F.sum(blocks).alias("rows"), F.sum(F.col("size") - 1).alias("pairs")).first()
        size = points.agg(F.max(vector_entries(points))).first()[0] or 1
        tasks = tasks_for(spark, (told["rows"] or 0) * 8.0 * size, 2.0 * (told["pairs"] or 0) * size)
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), tasks)
    edges = cell_edges(cells, k, distance, width)
    return top_k(edges if group_col else edges.drop("group_id"), k, repeats=repeats_of(distance))


def _width_for_whole(points: DataFrame, buckets: DataFrame, k: int) -> int | None:
    """Over how many tasks to find whole lists, None where cells are the better way."""
    width = 2 * points.sparkSession.sparkContext.defaultParallelism
    if k * EDGE_BYTES < width * 8:
        return None
    told = points.agg(F.max(vector_entries(points)).alias("entries"), F.count(F.lit(1)).alias("n")).first()
    row = 8 * (told["entries"] or 1)
    if k * EDGE_BYTES < width * row or told["n"] * row > WHOLE_BYTES:
        return None
    pairs = buckets.agg(F.sum(F.col("size") - 1)).first()[0] or 0
    return width if pairs >= WHOLE_SHARE * told["n"] ** 2 and _unique_ids(points) else None


def knn_from_lists(
    points: DataFrame,
    lists: DataFrame,
    k: int,
    group_col: str | None = None,
    distance: Distance = SQUARED_EUCLIDEAN,
    block_rows: int | None = None,
    tasks: int | None = None,
    missing: str = "error",
) -> DataFrame:
    """The same over lists of ids (list_id, id); an id named twice in a list counts once.

    Vectors travel with the members of long lists. A short list becomes its few pairs, which are narrower than its
    vectors and meet these by blocks, with the same outcome where ids are unique.
    """
    sized = bucketize(lists, by=["list_id"], distinct=True)
    rest = (k, group_col, ["list_id"], distance, block_rows, tasks, missing)
    entries = points.agg(F.max(vector_entries(points))).first()[0] or 0
    most = min(entries // 4, LONGEST_AS_PAIRS)
    if distance is not SQUARED_EUCLIDEAN or most < 2 or not _unique_ids(points):
        return knn_in_buckets(points, sized, *rest)
    sized = Scratch(points.sparkSession).save(sized, "lists")
    met = with_ends(
        _pairs_of(sized.where(F.col("size") <= most)), *2 * [kernel_columns(points, group_col)], missing, measured=True, either_way=True
    )
    edge = lambda src, group, dst: F.struct(
        F.col(src).alias("src"), F.col(group).alias("group_id"), F.col(dst).alias("dst"), "distance"
    )
    edges = met.select(F.inline(F.array(edge("src", "group_b", "dst"), edge("dst", "group_a", "src"))))
    edges = edges if group_col else edges.drop("group_id")
    long = sized.where(F.col("size") > most)
    if not long.isEmpty():
        edges = edges.unionByName(knn_in_buckets(points, long, *rest).drop("rank"))
    return top_k(edges, k)


def _unique_ids(points: DataFrame) -> bool:
    return points.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).isEmpty()


def _pairs_of(members: DataFrame) -> DataFrame:
    """The pairs inside each list; for lists of bounded size."""
    # Structs, as a null id must stay and tell that it has no point.
    held = members.groupBy("list_id").agg(F.collect_list(F.struct("id")).alias("m"))
    with_later = F.transform(
        "m", lambda x, i: F.transform(F.slice("m", i + 2, F.size("m")), lambda y: F.struct(x["id"].alias("src"), y["id"].alias("dst")))
    )
    return held.select(F.inline(F.flatten(with_later)))


def nearest_in_buckets(
    points: DataFrame,
    buckets: DataFrame,
    k: int,
    distance: Distance = SQUARED_EUCLIDEAN,
    block_rows: int | None = None,
) -> DataFrame:
    """Connect all members of each bucket and keep the k nearest sources of each dst.

    The candidate pairs are those of a bucket with itself; they are formed and reduced inside the cells
    and never become rows.
    """
    found = knn_in_buckets(points, buckets, k, distance=distance, block_rows=block_rows)
    return found.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "distance", "rank")


def bucket_tasks(points: DataFrame, rows: int, comparisons: int, entries: int) -> int:
    """Shuffle width for the cells of buckets with that many member rows and comparisons."""
    return tasks_for(points.sparkSession, rows * 8.0 * entries, 2.0 * comparisons * entries)
