"""Readers of the site table, subject snapshots and the context registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline import schemas
from tideline.functions import payload as pl
from tideline.functions.text import is_blank, text_or_empty
from tideline.functions.zones import zone_or_null


def site_defaults(sites: DataFrame, token_version: int = 1) -> DataFrame:
    """Fills the defaults of a site record and adds `zone`, the checked time zone."""
    return sites.withColumns(
        {
            "token_version": F.when(F.col("token_version") > 0, F.col("token_version")).otherwise(
                F.lit(token_version)
            ),
            "sample_rate": F.when(F.col("sample_rate") > 0, F.col("sample_rate")).otherwise(F.lit(1.0)),
            "schema_version": F.when(F.col("schema_version") > 0, F.col("schema_version")).otherwise(
                F.lit(1)
            ),
            "timezone": text_or_empty(F.col("timezone")),
        }
    ).withColumn("zone", zone_or_null(F.col("timezone")))


def valid_site(sites: DataFrame) -> DataFrame:
    """Adds `config_valid`: identity, domains, versions and rate are usable."""
    ok = (
        ~is_blank(F.col("site_code"))
        & ~is_blank(F.col("tenant_id"))
        & ~is_blank(F.col("site_id"))
        & ~is_blank(F.col("status"))
        & (F.size(F.coalesce("allowed_domains", F.array().cast("array<string>"))) > 0)
        & (F.col("token_version") > 0)
        & F.col("sample_rate").between(0.0, 1.0)
        & (F.col("schema_version") > 0)
    )
    return sites.withColumn("config_valid", F.coalesce(ok, F.lit(False)))


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    return valid_site(site_defaults(spark.read.schema(schemas.SITE).json(path)))


def read_snapshot_pages(spark: SparkSession, path: str) -> DataFrame:
    """Snapshot pages, one JSON document per file; the file is the page."""
    return spark.read.schema(schemas.SNAPSHOT_PAGE).option("multiLine", "true").json(path)


def snapshot_page_valid():
    """A page states customers, a revision and, with more to come, the next cursor."""
    return F.coalesce(
        (F.col("subject_type") == "customer")
        & (F.coalesce(F.col("source_revision"), F.lit("")) != "")
        & ~(F.coalesce(F.col("has_more"), F.lit(False)) & F.col("next_cursor").isNull()),
        F.lit(False),
    )


def check_snapshot(rows: DataFrame) -> DataFrame:
    """Adds `row_valid` and the parsed `source_updated_at` to snapshot rows."""
    at = F.col("source_updated_at")
    target = F.coalesce(F.col("merged_into_external_subject_id"), F.lit(""))
    ok = (
        at.rlike(pl.RFC3339)
        & (F.coalesce("tenant_id", F.lit("")) != "")
        & (F.coalesce("external_subject_id", F.lit("")) != "")
        & (F.coalesce("source_mutation_id", F.lit("")) != "")
        & F.col("lifecycle_status").isin("active", "inactive", "merged")
        & ((F.col("lifecycle_status") != "merged") | (target != ""))
    )
    return rows.withColumns(
        {
            "row_valid": F.coalesce(ok, F.lit(False)),
            "source_updated_at": F.when(at.rlike(pl.RFC3339), F.try_to_timestamp(at)),
        }
    )


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """A registry document as one row; contexts stay an array."""
    return spark.read.schema(schemas.REGISTRY).option("multiLine", "true").json(path)
