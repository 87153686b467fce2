"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.session import cut, join_path, shared_dir

__all__ = ["cut", "free_name", "held_out", "learnable", "spans_digest", "spans_text", "staging_path", "table", "text_of"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """A whole text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def _fold(doc_id: str) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows kept for measuring: crc32 of the id as text, modulo 3, is 1. A null id is in no fold: false."""
    return F.coalesce(_fold(doc_id) == 1, F.lit(False))


def learnable(doc_id: str = "doc_id") -> Column:
    """Rows a model may learn from: a known id outside the held-out fold."""
    return F.coalesce(_fold(doc_id) != 1, F.lit(False))


def free_name(df: DataFrame, base: str) -> str:
    """A column name that the frame doesn't have, whatever its callers called theirs."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name = f"_{name}"
    return name


def staging_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder that the cluster names in spark.checkpoint.dir."""
    return join_path(shared_dir(spark), "tideline-stage", spark.sparkContext.applicationId, f"{what}-{uuid.uuid4().hex}")


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined in the given order."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def spans_digest(spans: Column) -> Column:
    return F.sha2(spans_text(spans), 256)
