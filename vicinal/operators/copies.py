"""Many copies of one vector: build the graph over distinct vectors, then give every copy its list."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vicinal.operators.topk import top_k


def distinct_vectors(points: DataFrame, k: int, group_col: str | None) -> tuple[DataFrame, DataFrame]:
    """Representatives (the smallest id of each vector and group), and the first k + 1 ids of each.

    Of a set of copies only the k + 1 smallest ids can be in anyone's k nearest, as they tie in distance
    and ties go to the smaller id. The limit applies before the shuffle, so copies never gather.
    """
    same = ["features"] if group_col is None else ["features", group_col]
    hashed = points.withColumn("_hash", F.xxhash64("features"))
    rank = F.row_number().over(Window.partitionBy("_hash", *same).orderBy("id"))
    first = hashed.withColumn("_rank", rank).where(F.col("_rank") <= k + 1)
    rep = F.first("id").over(Window.partitionBy("_hash", *same).orderBy("_rank"))
    first = first.withColumn("rep", rep)
    return first.where(F.col("_rank") == 1).drop("_hash", "_rank", "rep"), first.select("rep", "id", *same[1:])


def copy_map(points: DataFrame, reps: DataFrame, group_col: str | None) -> DataFrame:
    """Every id with its representative."""
    same = ["_hash", "features"] if group_col is None else ["_hash", "features", group_col]
    hashed = points.withColumn("_hash", F.xxhash64("features"))
    named = reps.withColumn("_hash", F.xxhash64("features")).select(*same, F.col("id").alias("rep"))
    return hashed.join(named, same).select("id", "rep")


def expand_copies(edges: DataFrame, first: DataFrame, copies: DataFrame, k: int, group_col: str | None) -> DataFrame:
    """Turn a graph over representatives into the graph over all points."""
    keys = ["src"] if group_col is None else ["src", "group_id"]
    members = first.select(F.col("rep").alias("_rep"), F.col("id").alias("_member"))
    to_others = edges.select(*keys, F.col("dst").alias("_rep"), "distance").join(members, "_rep")
    group = [] if group_col is None else [F.col(group_col).cast("int").alias("group_id")]
    own = first.select(F.col("rep").alias("src"), *group, F.col("id").alias("dst"), F.lit(0.0).alias("distance"))
    lists = top_k(to_others.select(*keys, F.col("_member").alias("dst"), "distance").unionByName(own), k + 1)
    packed = lists.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("distance", "dst"))).alias("_list"))
    each = copies.join(packed.withColumnRenamed("src", "rep"), "rep").withColumn(
        "_list", F.slice(F.filter("_list", lambda n: n["dst"] != F.col("id")), 1, k)
    )
    rows = each.select(F.col("id").alias("src"), *keys[1:], F.posexplode("_list").alias("_at", "_n"))
    return rows.select(
        "src", *keys[1:], F.col("_n.dst").alias("dst"), F.col("_n.distance").alias("distance"), (F.col("_at") + 1).alias("rank")
    )
