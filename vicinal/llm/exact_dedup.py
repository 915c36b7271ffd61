"""Exact deduplication by a distributed sort of the texts themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vicinal.llm.common import SPACES, only, shuffle_width, text_or_empty
from vicinal.session import Scratch

#: A group of copies gets a range of its own for about so many of its rows.
LEAST_SALTED = 64
#: Characters of a normalised text that ranges are split by; texts that share them are told apart by a hash.
SPLIT_BY = 32


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group documents whose texts are identical once white space is deleted.

    Returns one row per document: the id, `keep_id` (of the group's longest original text in code points,
    then the smallest id), `group_size`, `kept`, and `text_sha256` of the normalised text.

    The normalised texts are range-partitioned by splitters that Spark samples, sorted externally in whole, and
    equal neighbours are found by full comparison. A text with more than its share of rows is salted over
    several ranges; the ranges' heads, a few rows for each such text, are merged afterwards by digest.
    Which texts are salted changes no result.

    Nulls: a null text counts as empty; a null id sorts after all others. Rows that repeat an id and a text
    are all in the group and count in its size; all that bear `keep_id` are kept unless `keep_id` is null.
    Empty input gives no rows. Other columns are ignored.
    """
    spark = df.sparkSession
    scratch = Scratch(spark)
    work = only(df, _id=id_col, _text=text_col).select(
        F.col("_id"),
        F.regexp_replace(text_or_empty("_text"), SPACES, "").alias("_norm"),
        F.char_length(text_or_empty("_text")).alias("_points"),
    )

    copies = scratch.save(
        work.select(F.xxhash64("_norm").alias("_hash"), F.octet_length("_norm").alias("_bytes"))
        .groupBy("_hash")
        .agg(F.count("*").alias("_copies"), F.sum("_bytes").alias("_bytes")),
        "copies",
    )
    rows, size = copies.agg(F.coalesce(F.sum("_copies"), F.lit(0)), F.coalesce(F.sum("_bytes"), F.lit(0))).first()
    width = shuffle_width(spark, size)
    share = max(LEAST_SALTED, rows // (4 * width))
    # At most rows / share <= 4 * width texts can have so many copies.
    frequent = copies.where(F.col("_copies") > share).select(
        "_hash", F.ceil(F.col("_copies") / share).cast("long").alias("_salts")
    )

    salted = (
        work.withColumn("_hash", F.xxhash64("_norm"))
        .join(F.broadcast(frequent), "_hash", "left")
        .withColumn("_salt", F.coalesce(F.pmod(F.xxhash64("_id"), F.col("_salts")), F.lit(-1)))
        # Splitters are made from a beginning and a hash, so that no sample of whole texts goes to the driver.
        .withColumn("_begin", F.substring("_norm", 1, SPLIT_BY))
        .select("_begin", "_hash", "_salt", "_norm", "_points", "_id")
        .repartitionByRange(width, "_begin", "_hash", "_salt")
    )
    equal = Window.partitionBy("_begin", "_hash", "_salt", "_norm")
    ordered = equal.orderBy(F.desc("_points"), F.asc_nulls_last("_id"))
    ranges = scratch.save(
        salted.select(
            "_id",
            "_norm",
            "_points",
            "_salt",
            F.first("_id").over(ordered).alias("_best"),
            F.row_number().over(ordered).alias("_place"),
            F.count("*").over(equal).alias("_size"),
        ).select("_id", "_points", "_salt", "_best", "_place", "_size", F.unhex(F.sha2("_norm", 256)).alias("_digest")),
        "ranges",
    )

    heads = (
        ranges.where("_salt >= 0 AND _place = 1")
        .groupBy("_digest")
        .agg(
            F.min(F.struct(-F.col("_points"), F.col("_id").isNull(), F.col("_id"))).alias("_first"),
            F.sum("_size").alias("_total"),
        )
        .select("_digest", F.col("_first._id").alias("_merged"), "_total")
    )
    return ranges.join(F.broadcast(heads), "_digest", "left").select(
        F.col("_id").alias(id_col),
        F.when(F.col("_total").isNull(), F.col("_best")).otherwise(F.col("_merged")).alias("keep_id"),
        F.coalesce("_total", "_size").alias("group_size"),
        F.when(F.col("_total").isNull(), F.col("_best"))
        .otherwise(F.col("_merged"))
        .eqNullSafe(F.col("_id"))
        .alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )
