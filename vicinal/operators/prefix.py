"""Running totals over a whole table in order, without one task that sees it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vicinal.session import Scratch


def running_total(rows: DataFrame, order: list[Column | str], value: Column, name: str, scratch: Scratch) -> DataFrame:
    """`rows` with `name`: the sum of `value` over all rows before each one in `order`, 0 for the first.

    Rows are dealt out by ranges of `order`, which should not leave ties, and written; sums run inside ranges. One sum
    a range, as many as a shuffle is wide, goes through the driver to tell where each range begins. `rows` is read
    twice, to find the ranges and to deal rows out, so it should be a written table.
    """
    spark = rows.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.withColumn("_value", value).repartitionByRange(width, *order).withColumn("_range", F.spark_partition_id())
    placed = scratch.save(ranged, "ranges")
    sums = {r["_range"]: r["_sum"] for r in placed.groupBy("_range").agg(F.sum("_value").alias("_sum")).collect()}
    begins, total = [], 0
    for at in sorted(sums):
        begins.append((at, total))
        total += sums[at] or 0
    kind = placed.schema["_value"].dataType.simpleString()
    starts = spark.createDataFrame(begins, f"_range int, _begin {kind if kind == 'double' else 'bigint'}")
    before = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("_value").over(before), F.lit(0))
    return (
        placed.withColumn("_inside", inside)
        .join(F.broadcast(starts), "_range")
        .withColumn(name, F.col("_begin") + F.col("_inside"))
        .drop("_value", "_range", "_inside", "_begin")
    )
