"""Statistics of vector columns, and order statistics per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vicinal.session import Scratch

# Below this rank the head of each group is small enough to be ranked as it is. Either way gives the same rows.
SHALLOW = 1000


def dim_stats(points: DataFrame) -> DataFrame:
    """Mean, span and population deviation of every dimension."""
    each = points.select(F.posexplode("features").alias("dim", "x"))
    x = F.col("x").cast("double")
    return each.groupBy("dim").agg(
        F.avg(x).alias("mean"), (F.max(x) - F.min(x)).alias("span"), F.stddev_pop(x).alias("deviation")
    )


def deviation_summary(stats: DataFrame) -> DataFrame:
    """Largest, smallest and mean deviation over the dimensions."""
    return stats.agg(
        F.max("deviation").alias("max_deviation"),
        F.min("deviation").alias("min_deviation"),
        F.avg("deviation").alias("mean_deviation"),
    )


def kth_smallest(rows: DataFrame, group: str, value: str, k: int) -> DataFrame:
    """The k-th smallest value of each group, from 1, repeats counted; groups with fewer have no row.

    Null is a group; null values are left out.
    """
    if k < 1:
        raise ValueError(f"k must be at least 1, got {k}")
    if k >= SHALLOW:
        return select_rank(rows, group, value, F.lit(k))
    # The limit on the row number is applied map-side, so a task never sees a group whole.
    rank = F.row_number().over(Window.partitionBy(group).orderBy(value))
    ranked = rows.select(group, value).where(F.col(value).isNotNull()).withColumn("_rank", rank)
    return ranked.where(F.col("_rank") <= k).where(F.col("_rank") == k).select(group, value)


def median_lower(rows: DataFrame, group: str, value: str, compat: bool = False) -> DataFrame:
    """The lower median of each group, null being one. With `compat` the value at rank (n - 1) div 2, at least 1."""
    n = F.col("_n")
    rank = F.greatest(F.floor((n - 1) / 2), F.lit(1)) if compat else F.ceil(n / 2)
    return select_rank(rows, group, value, rank)


def approx_median(rows: DataFrame, group: str, value: str, accuracy: int = 10000) -> DataFrame:
    return rows.groupBy(group).agg(F.percentile_approx(value, 0.5, accuracy).alias(value))


def select_rank(rows: DataFrame, group: str, value: str, rank: Column) -> DataFrame:
    """The value at `rank` (a column over `_n`, the group's size) of each group, exactly.

    Values are counted map-side and range-partitioned by (group, value), so a group with most of the
    rows lies in many partitions, in order. Counts per group and partition then tell which partition
    holds the wanted rank, and only that one is ranked. The placed table is written, as its partition
    numbers are read twice.
    """
    spark = rows.sparkSession
    counted = (
        rows.select(F.col(group).alias("_g"), F.col(value).alias("_x"))
        .where(F.col("_x").isNotNull())
        .groupBy("_g", "_x")
        .agg(F.count(F.lit(1)).alias("_times"))
    )
    ordered = counted.repartitionByRange("_g", "_x")
    placed = Scratch(spark).save(ordered.withColumn("_part", F.spark_partition_id()), "placed")

    of_group = Window.partitionBy("_g")
    earlier = of_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    target = (
        placed.groupBy("_g", "_part")
        .agg(F.sum("_times").alias("_here"))
        .withColumn("_n", F.sum("_here").over(of_group))
        .withColumn("_left", rank.cast("bigint") - F.coalesce(F.sum("_here").over(earlier), F.lit(0)))
        .where((F.col("_left") >= 1) & (F.col("_left") <= F.col("_here")))
        .select("_g", "_part", "_left")
    )
    running = F.sum("_times").over(of_group.orderBy("_x"))
    target = target.select(F.col("_g").alias("_tg"), F.col("_part").alias("_tpart"), "_left")
    here = F.col("_g").eqNullSafe(F.col("_tg")) & (F.col("_part") == F.col("_tpart"))
    found = placed.join(target, here).withColumn("_upto", running)
    found = found.where((F.col("_upto") >= F.col("_left")) & (F.col("_upto") - F.col("_times") < F.col("_left")))
    return found.select(F.col("_g").alias(group), F.col("_x").alias(value))
