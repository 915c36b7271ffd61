"""Edge tables: `src BIGINT, dst BIGINT, distance DOUBLE`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinal.session import free_path

EDGE_COLUMNS = ("src", "dst", "distance")


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """Read `(src,dst,distance)` lines."""
    fields = F.split(F.expr("substring(value, 2, length(value) - 2)"), ",")
    types = ("bigint", "bigint", "double")
    lines = spark.read.text(path).select(F.trim("value").alias("value")).where(F.col("value") != "")
    return lines.select(*[fields[i].cast(t).alias(c) for i, (c, t) in enumerate(zip(EDGE_COLUMNS, types))])


def write_edges(edges: DataFrame, path: str, format: str = "parquet", overwrite: bool = False) -> str:
    """Write distinct edges to `path`, or to `path-1`, ... if it is taken; returns where they went.

    `format="text"` gives `(src,dst,distance)` lines; other formats keep the neighbour's group, if any.
    """
    where = path if overwrite else free_path(edges.sparkSession, path)
    grouped = format != "text" and "group_id" in edges.columns
    rows = edges.select(*EDGE_COLUMNS, *(["group_id"] if grouped else [])).distinct()
    if format == "text":
        rows = rows.select(F.concat(F.lit("("), F.concat_ws(",", *EDGE_COLUMNS), F.lit(")")).alias("value"))
    rows.write.format(format).mode("overwrite" if overwrite else "errorifexists").save(where)
    return where


def edges_between(edges: DataFrame, src: int, dst: int) -> DataFrame:
    """The edges from one node to another."""
    return edges.where((F.col("src") == src) & (F.col("dst") == dst))


def edges_listed(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """The edges whose ends are a row (src, dst) of a table."""
    return edges.join(pairs.select("src", "dst"), ["src", "dst"], "left_semi")


def vertices_with(points: DataFrame, id: int) -> DataFrame:
    return points.where(F.col("id") == id)


def vertices_listed(points: DataFrame, ids: DataFrame) -> DataFrame:
    """The points whose id is in a table."""
    return points.join(ids.select("id"), "id", "left_semi")
