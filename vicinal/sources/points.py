"""Point tables: `id BIGINT, label DOUBLE, features ARRAY<DOUBLE>` and, if wanted, `group_id INT`.

Features may also be sparse, `STRUCT<size, indices, values>` (functions/sparse.py). Arrays may stay ARRAY<FLOAT>: they
are widened where they are used, and take half the room in a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinal.functions.sparse import from_ml_vector, is_sparse, vector_entries, vector_size
from vicinal.operators.prefix import running_total
from vicinal.session import Scratch


@dataclass(frozen=True)
class PointStats:
    """Points, their dimension, the most numbers one of them carries with the bytes of each, and all these numbers."""

    n: int
    dim: int
    entries: int
    entry_bytes: int
    total: int


def describe(points: DataFrame) -> PointStats:
    """Count points and find their dimension; null ids, null or unequal vectors are refused."""
    size = vector_size(points)
    row = points.agg(
        F.count(F.lit(1)).alias("n"),
        F.count("features").alias("present"),
        F.count("id").alias("named"),
        F.min(size).alias("low"),
        F.max(size).alias("high"),
        F.max(vector_entries(points)).alias("entries"),
        F.sum(vector_entries(points)).alias("total"),
    ).first()
    if row["present"] != row["n"] or row["named"] != row["n"]:
        raise ValueError("a point has a null id or a null vector")
    if row["low"] != row["high"]:
        raise ValueError(f"feature vectors differ in length: {row['low']} and {row['high']}")
    return PointStats(row["n"], row["high"] or 0, max(row["entries"] or 0, 1), 12 if is_sparse(points) else 8, row["total"] or 0)


def found_or(missing: str, column: Column, name: Column) -> Column:
    """`column` of an outer join: with "error" the job fails where it is null, naming the id."""
    if missing == "drop":
        return column
    return F.coalesce(column, F.raise_error(F.concat(F.lit("no point with id "), name.cast("string"))))


def join_kind(missing: str) -> str:
    if missing not in ("error", "drop"):
        raise ValueError(f"missing must be 'error' or 'drop', got {missing!r}")
    return "left" if missing == "error" else "inner"


def kernel_columns(points: DataFrame, group_col: str | None) -> DataFrame:
    group = F.lit(0) if group_col is None else F.col(group_col).cast("int")
    return points.select("id", group.alias("group_id"), "features")


def from_embeddings(embeddings: DataFrame, wide: bool = False) -> DataFrame:
    """Adapt a table of `vec_id, embedding, label`; the label is also the group."""
    features = F.col("embedding").cast("array<double>") if wide else F.col("embedding")
    return embeddings.select(
        F.col("vec_id").alias("id"),
        F.col("label").cast("double").alias("label"),
        features.alias("features"),
        F.col("label").cast("int").alias("group_id"),
    )


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """Read lines `id;x1;x2;...`; ids in the file start at 1, stored ids at 0."""
    fields = F.split("value", ";")
    return (
        spark.read.text(path)
        .where(F.trim("value") != "")
        .select(
            (F.element_at(fields, 1).cast("bigint") - 1).alias("id"),
            F.lit(0.0).alias("label"),
            F.slice(fields, 2, F.greatest(F.size(fields) - 1, F.lit(0))).cast("array<double>").alias("features"),
        )
    )


def from_vectors(
    rows: DataFrame, id: str = "id", features: str = "features", label: str | None = None, sparse: bool = False
) -> DataFrame:
    """Adapt a table with a column of ML vectors, dense or sparse; with `sparse` none is written out in full."""
    return rows.select(
        F.col(id).cast("bigint").alias("id"),
        (F.lit(0.0) if label is None else F.col(label).cast("double")).alias("label"),
        (from_ml_vector(F.col(features)) if sparse else vector_to_array(features)).alias("features"),
    )


def read_libsvm(spark: SparkSession, path: str, dim: int | None = None, dense: bool = False) -> DataFrame:
    """Read a libsvm file into points with ids 0, 1, ... in the order of its files and lines.

    Vectors stay sparse, as `STRUCT<size, indices, values>`, which all operators take; with `dense` they become arrays.
    """
    reader = spark.read.format("libsvm")
    if dim is not None:
        reader = reader.option("numFeatures", str(dim))
    rows = reader.load(path).select(
        "label",
        (vector_to_array("features") if dense else from_ml_vector(F.col("features"))).alias("features"),
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_offset"),
    )
    return assign_ids(rows, order=["_path", "_offset"]).select("id", "label", "features")


def read_points(spark: SparkSession, path: str, dense: bool = False) -> DataFrame:
    """Pick the reader by suffix: `.libsvm` (sparse unless `dense`), `.parquet`, or delimited text."""
    if path.endswith(".libsvm"):
        return read_libsvm(spark, path, dense=dense)
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    return read_delimited(spark, path)


def assign_ids(rows: DataFrame, name: str = "id", order: list[str] | None = None) -> DataFrame:
    """Number rows 0, 1, ... in their present order, without moving them.

    `order` names columns that are constant over runs of rows and sort those runs, such as file and
    offset; partitions are the runs if it is not given. Rows are written once with their position, so
    that counting runs and numbering rows see the same layout; counts of runs are summed by ranges of runs.
    """
    spark = rows.sparkSession
    runs = order or ["_part"]
    spot = F.monotonically_increasing_id()
    placed = rows.withColumn("_spot", spot).withColumn("_part", F.shiftright("_spot", 33))
    scratch = Scratch(spark)
    stored = scratch.save(placed, "numbered")
    counts = stored.groupBy(*runs).agg(F.count(F.lit(1)).alias("_rows"), F.min("_spot").alias("_first"))
    starts = running_total(scratch.save(counts, "runs"), runs, F.col("_rows"), "_start", scratch).drop("_rows")
    numbered = stored.join(starts, runs).withColumn(name, F.col("_start") + F.col("_spot") - F.col("_first"))
    return numbered.select(*rows.columns, name)


def lookup(
    ids: DataFrame,
    points: DataFrame | tuple[DataFrame, DataFrame],
    id_col: str | tuple[str, str] = "id",
    missing: str = "error",
) -> DataFrame:
    """Attach each id's point; a join, so neither side has to fit anywhere whole.

    With `id_col=("src", "dst")` the points of both ends come, as structs `src_point` and `dst_point`, and `points`
    may be two tables, one for each end; vectors then travel by blocks and not with every pair.
    An id without a point fails the job, or with `missing="drop"` is left out.
    """
    if isinstance(id_col, tuple):
        from vicinal.operators.ends import with_ends

        sources, targets = points if isinstance(points, tuple) else (points, points)
        found = with_ends(ids.withColumnsRenamed(dict(zip(id_col, ("src", "dst")))), sources, targets, missing)
        back = {"src": id_col[0], "dst": id_col[1], "_a": f"{id_col[0]}_point", "_b": f"{id_col[1]}_point"}
        return found.withColumnsRenamed(back)
    found = points.withColumnRenamed("id", id_col).withColumn("_found", F.lit(True))
    joined = ids.join(found, id_col, join_kind(missing))
    return joined.where(found_or(missing, F.col("_found"), F.col(id_col))).drop("_found")
