"""The operators as queries over the given tables, and SQL that should agree where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vicinal.llm.alignment import align_tokenizers
from vicinal.llm.byte_bpe import encode_decode, encoding_digest
from vicinal.llm.embedding_dedup import embedding_links
from vicinal.llm.exact_dedup import exact_dedup
from vicinal.llm.language import fit_languages, identify
from vicinal.llm.mixing import mix
from vicinal.llm.packing import pack_sequences
from vicinal.llm.quality import fit_quality, score_quality
from vicinal.llm.simhash import simhash_groups
from vicinal.llm.spelling import spelling_groups
from vicinal.llm.token_counts import token_counts
from vicinal.llm.token_files import read_digests, write_tokens
from vicinal.llm.toxicity import fit_toxicity, score_toxicity
from vicinal.session import Scratch, local_checkpoints

#: Where the vocabulary files lie; a parameter of the operators.
TOKENIZERS = public_tokenizers.path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return score_toxicity(documents, fit_toxicity(documents, _table(spark, sf_dir, "labels")))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark).new_path("tokens")
    write_tokens(_table(spark, sf_dir, "documents"), path, TOKENIZERS("byte_bpe_50k.json"), end_id=2)
    return read_digests(spark, path)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return score_quality(documents, fit_quality(documents, _table(spark, sf_dir, "labels")))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(_table(spark, sf_dir, "documents"), words=4, bits=4)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return encoding_digest(encode_decode(documents, TOKENIZERS("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), TOKENIZERS("piece_bpe_32k.model"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(_table(spark, sf_dir, "embeddings"), similarity=0.9)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return identify(documents, fit_languages(documents))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(_table(spark, sf_dir, "documents"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_sequences(_table(spark, sf_dir, "documents"), TOKENIZERS("byte_bpe_50k.json"), end_id=1, digest=True)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = TOKENIZERS("byte_bpe_50k.json"), TOKENIZERS("piece_bpe_32k.model")
    return align_tokenizers(_table(spark, sf_dir, "documents"), *paths, digest=True)


QUERIES = (
    op1_exact_dedup,
    op2_toxicity,
    op3_token_files,
    op4_quality,
    op5_simhash,
    op6_byte_bpe,
    op7_token_counts,
    op8_embedding_dedup,
    op9_mixing,
    op10_language,
    op11_spelling,
    op12_packing,
    op13_alignment,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def ready(query):
        def run(spark, sf_dir):
            local_checkpoints(spark)
            return query(spark, sf_dir)

        return run

    return {query.__name__: ready(query) for query in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[ \t-\r]', '', 'g') AS norm, length(coalesce(text, '')) AS points
           FROM documents)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM (SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY norm) AS group_size FROM n)
"""
    }
