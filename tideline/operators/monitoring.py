"""Operational numbers taken from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline import vocab
from tideline.operators import projections


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("events"))


def normalization_counts(facts: DataFrame) -> DataFrame:
    return facts.groupBy("normalization_status", "event_name").agg(F.count(F.lit(1)).alias("facts"))


def run_counts(ledger: DataFrame) -> DataFrame:
    """Runs by name and status with their total duration."""
    seconds = (F.unix_micros("completed_at") - F.unix_micros("started_at")) / 1e6
    return projections.latest_runs(ledger).groupBy("projection_name", "status").agg(
        F.count(F.lit(1)).alias("runs"), F.sum(seconds).alias("duration_seconds"),
        F.sum("rows_written").alias("rows_written"),
    )


def run_lag(ledger: DataFrame, as_of: Column, alert_seconds: int = 172800) -> DataFrame:
    """Age of each projection's last success, and whether it is too old."""
    lag = (F.unix_micros(as_of) - F.unix_micros("computed_at")) / 1e6
    return (
        projections.last_completed(ledger)
        .withColumn("lag_seconds", lag)
        .withColumn("stale", F.col("lag_seconds") > alert_seconds)
        .drop("computed_at")
    )


def histogram(df: DataFrame, value: str, keys: list[str] | None = None, bounds=vocab.HISTOGRAM_BOUNDS) -> DataFrame:
    """Cumulative counts per upper bound, in one pass with one counter per bound."""
    keys = keys or []
    measured = df.where(F.col(value) >= 0)
    counters = [F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    wide = measured.groupBy(*keys).agg(
        *counters, F.count(F.lit(1)).alias("total"), F.sum(value).alias("total_value")
    )
    pairs = F.array(
        *[F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("cumulative")) for i, b in enumerate(bounds)]
    )
    return wide.select(*keys, "total", "total_value", F.inline(pairs))


def latency_quantiles(log: DataFrame, at: str, value: str, minutes: int = 15, quantile: float = 0.95, accuracy: int = 10000) -> DataFrame:
    """Quantile of a value per tumbling window."""
    return log.groupBy(F.window(at, f"{minutes} minutes").alias("w")).agg(
        F.percentile_approx(value, quantile, accuracy).alias("quantile_value"),
        F.count(F.lit(1)).alias("requests"),
    ).select(F.col("w.start").alias("window_start"), "quantile_value", "requests")


def error_ratio(log: DataFrame, at: str, failed: Column, minutes: int = 15, alert: float = 0.01) -> DataFrame:
    return (
        log.groupBy(F.window(at, f"{minutes} minutes").alias("w"))
        .agg(F.count_if(failed).alias("errors"), F.count(F.lit(1)).alias("requests"))
        .select(
            F.col("w.start").alias("window_start"), "errors", "requests",
            (F.col("errors") / F.col("requests")).alias("ratio"),
        )
        .withColumn("alerting", F.col("ratio") > alert)
    )


def increase(log: DataFrame, at: str, counted: Column, minutes: int = 15) -> DataFrame:
    """How often something happened per tumbling window, only windows where it did."""
    return (
        log.where(counted)
        .groupBy(F.window(at, f"{minutes} minutes").alias("w"))
        .agg(F.count(F.lit(1)).alias("happened"))
        .select(F.col("w.start").alias("window_start"), "happened")
    )


def table_counts(events: DataFrame, subjects: DataFrame, facts: DataFrame, runs: DataFrame) -> DataFrame:
    """Events by source, subjects by status, facts and runs by status, as (what, label, rows)."""

    def by(df, what, column):
        return df.groupBy(F.col(column).alias("label")).agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(what).alias("what"), "label", "rows"
        )

    return (
        by(events, "events", "event_source")
        .unionByName(by(subjects, "subjects", "lifecycle_status"))
        .unionByName(by(facts, "facts", "normalization_status"))
        .unionByName(by(runs, "runs", "status"))
    )
