"""A training corpus from raw documents: five stages, each on all that the one before it kept."""

from __future__ import annotations

import sys
from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from vicinal.llm.byte_bpe import encode_decode, encoding_digest  # noqa: E402
from vicinal.llm.exact_dedup import exact_dedup  # noqa: E402
from vicinal.llm.mixing import mix  # noqa: E402
from vicinal.llm.simhash import simhash_groups  # noqa: E402
from vicinal.llm.toxicity import drop_toxic, fit_toxicity  # noqa: E402
from vicinal.session import Scratch, local_checkpoints  # noqa: E402


def _keep(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of `docs` whose `doc_id` is in `ids`; null is an id like any other here."""
    wanted = ids.select(F.col("doc_id").alias("_keep")).distinct()
    return docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["_keep"]), "left_semi")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go. The model is fitted on these documents' labels."""
    local_checkpoints(spark)
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return drop_toxic(docs, model)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose texts are equal but for white space, one stays."""
    local_checkpoints(spark)
    return _keep(docs, exact_dedup(docs).where("kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that SimHash links connect, the document with the smallest id stays."""
    local_checkpoints(spark)
    groups = simhash_groups(docs, words=4, bits=4)
    return _keep(docs, groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, 0 to 2 times."""
    local_checkpoints(spark)
    times = mix(docs).groupBy(F.col("doc_id").alias("_taken")).agg(F.max("epochs").alias("_epochs"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return (
        docs.join(times.where("_epochs > 0"), docs["doc_id"].eqNullSafe(times["_taken"]))
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_epochs"))))
        .select(*columns)
    )


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of what they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return encoding_digest(encode_decode(docs, path, public_tokenizers.PATTERN))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("exact dedup", exact),
    ("near dedup", near),
    ("mixing", mixing),
    ("encoding", encoding),
]

#: SQL can't express the toxicity score, SimHash groups or byte-pair encoding; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`; each one's rows are written as Parquet and read again by the next."""
    local_checkpoints(spark)
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.save(docs, name.replace(" ", "-"))
    return docs
