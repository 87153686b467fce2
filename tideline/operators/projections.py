"""Daily aggregates per subject, recomputed for touched keys only, and the ledger of their runs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline import schemas, vocab

GLOBAL_KEY = ["tenant_id", "external_subject_id", "local_date", "timezone_name"]
CONTEXT_KEY = ["tenant_id", "external_subject_id", "context_key", "context_version", "local_date", "timezone_name"]


def key_of(contextual: bool) -> list[str]:
    return CONTEXT_KEY if contextual else GLOBAL_KEY


def affected_keys(changed: DataFrame, contextual: bool = False) -> DataFrame:
    return changed.select(*key_of(contextual)).distinct()


def signals(facts: DataFrame, contextual: bool = False) -> DataFrame:
    """Facts that count: normalized rows of the signal events, registered ones for contexts."""
    rows = facts.where(
        (F.col("normalization_status") == "normalized") & F.col("event_name").isin(*vocab.SIGNAL_EVENTS)
    )
    return rows.where("context_resolution_status = 'registered'") if contextual else rows


def daily(facts: DataFrame, contextual: bool = False) -> DataFrame:
    """Signal counts and last association per key. One shuffle, with partial counts before it."""
    name = F.col("event_name")
    return signals(facts, contextual).groupBy(*key_of(contextual)).agg(
        F.count_if(name == "subject_impression").alias("impression_count"),
        F.count_if(name == "subject_viewed").alias("view_count"),
        F.count_if(name == "subject_selected").alias("selection_count"),
        F.count_if(name == "subject_associated").alias("association_count"),
        F.max(F.when(name == "subject_associated", F.col("event_time"))).alias("last_association_at"),
    )


def known_only(rows: DataFrame, subjects: DataFrame) -> DataFrame:
    """Keeps aggregates whose subject is in the dimension."""
    known = subjects.where("subject_type = 'customer'").select("tenant_id", "external_subject_id")
    return rows.join(known, ["tenant_id", "external_subject_id"], "left_semi")


def recompute(facts: DataFrame, affected: DataFrame, subjects: DataFrame, contextual: bool = False) -> DataFrame:
    """Full recount of the affected keys over all facts, however old the facts are."""
    key = key_of(contextual)
    return known_only(daily(facts.join(affected, key, "left_semi"), contextual), subjects)


def replace(stored: DataFrame, affected: DataFrame, fresh: DataFrame, contextual: bool = False) -> DataFrame:
    """Stored rows outside the affected keys plus the fresh ones; a key without signals is gone."""
    key = key_of(contextual)
    return stored.join(affected, key, "left_anti").unionByName(fresh)


def upsert(stored: DataFrame, prepared: DataFrame, contextual: bool = False) -> DataFrame:
    """Prepared absolute aggregates over the stored rows of the same key."""
    return replace(stored, prepared.select(*key_of(contextual)), prepared, contextual)


# --- run ledger ------------------------------------------------------------------------------

_CLOSED = ("completed", "failed", "skipped_locked")


def latest_runs(ledger: DataFrame) -> DataFrame:
    """Current state of every run of the append-only ledger; a closed state beats a running one, and of rows of one time the one
    that has written more."""
    done = [F.col(c) for c in ("rows_written", "rows_read", "affected_days") if c in ledger.columns]
    rank = F.struct(F.col("status") != "running", F.coalesce("completed_at", "started_at"), *done, F.col("status"))
    return (
        ledger.groupBy("run_id")
        .agg(F.max_by(F.struct(*ledger.columns), rank).alias("r"))
        .select("r.*")
    )


def last_completed(ledger: DataFrame) -> DataFrame:
    """Latest completed run per projection name and version."""
    return (
        latest_runs(ledger)
        .where("status = 'completed'")
        .groupBy("projection_name", "projection_version")
        .agg(F.max("completed_at").alias("computed_at"))
    )


def run_row(spark, **values) -> DataFrame:
    """One ledger row; a failure's text is cut to 1000 characters."""
    names = [f.split()[0] for f in schemas.RUN.split(",")]
    row = {n: values.get(n) for n in names}
    if row["last_error"]:
        row["last_error"] = row["last_error"][:1000]
    for name in ("affected_days", "rows_read", "rows_written"):
        row[name] = row[name] or 0
    return spark.createDataFrame([tuple(row[n] for n in names)], schemas.RUN)


def recovered(ledger: DataFrame, name: str, version: int, at: datetime) -> DataFrame:
    """Closing rows for runs that were still open when the next one started."""
    return (
        latest_runs(ledger)
        .where((F.col("status") == "running") & (F.col("projection_name") == name) & (F.col("projection_version") == version))
        .withColumns(
            {
                "status": F.lit("failed"),
                "completed_at": F.lit(at).cast("timestamp"),
                "last_error": F.lit("recovered_after_interruption"),
            }
        )
    )


def due(ledger: DataFrame, version: int, as_of: Column, every_seconds: int = vocab.RUN_EVERY_SECONDS) -> DataFrame:
    """Whether each projection should run: no completed run yet, or the last one is old enough."""
    names = ledger.sparkSession.createDataFrame(
        [(vocab.GLOBAL_PROJECTION,), (vocab.CONTEXT_PROJECTION,)], "projection_name string"
    )
    done = last_completed(ledger).where(F.col("projection_version") == version)
    age = F.unix_micros(as_of) - F.unix_micros("computed_at")
    return names.join(done, "projection_name", "left").select(
        "projection_name",
        "computed_at",
        (F.col("computed_at").isNull() | (age >= every_seconds * 1_000_000)).alias("due"),
    )
