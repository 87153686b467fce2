"""From raw documents to token ids: quality, near-duplicates, benchmark passages, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs, and each
sees all that its predecessor kept. Rows with nulls, empty or very long texts, and repeated rows pass through the
operators as their docstrings say; an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import bpe, decontaminate, order_minhash, quality_fm, secret_index
from tideline.llm.common import cut, free_name, table
from tideline.session import configure


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality_fm.keep_good(docs, quality_fm.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates, the document with the smallest doc_id stays."""
    return order_minhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark, and n_chars follows the text where that changed its length."""
    if "n_chars" not in docs.columns:
        return secret_index.redact(docs)
    before = free_name(docs, "_before")
    clean = secret_index.redact(docs.withColumn(before, F.length("text")))
    shown = F.when(F.length("text") != F.col(before), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", shown).drop(before)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and whether they decode to the text again."""
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    known = docs.select("doc_id", bpe.encode_checked(F.col("text"), path, pattern).alias("_coded")).select("doc_id", "_coded.*")
    return known.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", "decodes")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("tokens", tokens),
]

#: The classifier and the sketches can't be said in SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(configure(spark), sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
