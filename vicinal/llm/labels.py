"""Bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.llm.common import only, remainder

#: Labelled documents that a classifier is fitted on at most, those with the smallest hash of their id.
SAMPLE_ROWS = 20_000


def labelled_sample(
    df: DataFrame, labels: DataFrame, label_col: str, fold: tuple[int, int], rows: int, id_col: str, text_col: str
) -> DataFrame:
    """`_text`, `_label` (0 or 1) and `_half` (0 or 1) of at most `rows` labelled documents outside a fold.

    `fold` is (modulus, remainder) of the crc32 of ids; documents in it are never looked at. Rows without a
    label are left out.
    """
    modulus, held_out = fold
    chosen = (
        only(labels, _id=id_col, _label=label_col)
        .where(F.col("_label").isNotNull() & F.col("_id").isNotNull() & (remainder("_id", modulus) != held_out))
        .groupBy("_id")
        .agg(F.max("_label").cast("int").alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(rows)
    )
    # The sample is bounded by `rows`, so it can be sent to every task that reads documents.
    return only(df, _id=id_col, _text=text_col).join(F.broadcast(chosen), "_id").select(
        "_text", "_label", F.pmod(F.xxhash64("_id", F.lit("half")), F.lit(2)).cast("int").alias("_half")
    )
