"""Integrity rules of the stored tables as counts of violations, and erasure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline import vocab

SUBJECT = ["tenant_id", "subject_type", "external_subject_id"]


def _row_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """All row rules of a table in one pass over it."""
    counts = df.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(n) for n, ok in rules.items()])
    return counts.unpivot([], list(rules), "rule", "violations")


def _unique(df: DataFrame, rule: str, keys: list[str], where: str = "true") -> DataFrame:
    repeated = df.where(where).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return repeated.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(rule).alias("rule"), "violations")


def _orphans(child: DataFrame, parent: DataFrame, rule: str, on: list[str], where: str = "true") -> DataFrame:
    missing = child.where(where).join(parent.select(*on), on, "left_anti")
    return missing.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(rule).alias("rule"), "violations")


def event_rules(events: DataFrame, items: DataFrame, orders: DataFrame) -> DataFrame:
    scope = ["tenant_id", "site_id"]
    return (
        _unique(events, "event_id_unique", ["event_id"])
        .unionByName(_unique(events, "logical_id_unique", [*scope, "logical_event_id"], "logical_event_id <> ''"))
        .unionByName(_unique(events, "idempotency_key_unique", [*scope, "idempotency_key"], "idempotency_key <> ''"))
        .unionByName(_orphans(items, events, "item_has_event", ["event_id"]))
        .unionByName(_orphans(orders, events, "order_has_event", ["event_id"]))
    )


def subject_rules(subjects: DataFrame) -> DataFrame:
    from tideline.operators import dimension

    merged = F.col("lifecycle_status") == "merged"
    target = F.col("merged_into_external_subject_id")
    rules = {
        "subject_is_customer": F.col("subject_type") == "customer",
        "subject_status_known": F.col("lifecycle_status").isin(*vocab.LIFECYCLE_STATUSES),
        "subject_merge_target": merged == target.isNotNull(),
        "subject_merge_distinct": target.isNull() | (target != F.col("external_subject_id")),
        "subject_order_pair": F.col("lifecycle_source_updated_at").isNull()
        == F.col("lifecycle_source_mutation_id").isNull(),
        "subject_identity": dimension.identity_valid(),
        "subject_lifecycle": dimension.lifecycle_valid(),
    }
    targets = subjects.where("merged_into_external_subject_id is not null").select(
        "tenant_id", "subject_type", F.col("merged_into_external_subject_id").alias("external_subject_id")
    )
    return (
        _row_rules(subjects, rules)
        .unionByName(_unique(subjects, "subject_unique", SUBJECT))
        .unionByName(_orphans(targets, subjects, "merge_target_exists", SUBJECT))
    )


def fact_rules(facts: DataFrame, events: DataFrame, subjects: DataFrame) -> DataFrame:
    rules = {
        "fact_ordinal": F.col("subject_ordinal") >= 0,
        "fact_source": F.col("event_source").isin(*vocab.SOURCES),
        "fact_normalization": F.col("normalization_status").isin(*vocab.NORMALIZATION_STATUSES),
        "fact_resolution": F.col("context_resolution_status").isin(*vocab.RESOLUTION_STATUSES),
        "fact_context_version": F.col("context_version").isNull() | (F.col("context_version") > 0),
    }
    key = ["tenant_id", "event_name", "idempotency_key", "subject_type", "external_subject_id", "relation"]
    return (
        _row_rules(facts, rules)
        .unionByName(_unique(facts, "fact_ordinal_unique", ["event_id", "subject_ordinal"]))
        .unionByName(_unique(facts, "fact_idempotency_unique", key, "idempotency_key <> ''"))
        .unionByName(_orphans(facts, events, "fact_has_event", ["event_id"]))
        .unionByName(_orphans(facts, subjects, "fact_has_subject", SUBJECT, "normalization_status = 'normalized'"))
    )


def daily_rules(daily: DataFrame, subjects: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    counts = ("impression_count", "view_count", "selection_count", "association_count")
    nonnegative = F.lit(True)
    for name in counts:
        nonnegative = nonnegative & (F.col(name) >= 0)
    customers = subjects.where("subject_type = 'customer'")
    return (
        _row_rules(daily, {f"{prefix}_counts": nonnegative})
        .unionByName(_unique(daily, f"{prefix}_unique", keys))
        .unionByName(_orphans(daily, customers, f"{prefix}_has_subject", ["tenant_id", "external_subject_id"]))
    )


def run_rules(runs: DataFrame) -> DataFrame:
    rules = {
        "run_version": F.col("projection_version") > 0,
        "run_status": F.col("status").isin(*vocab.RUN_STATUSES),
        "run_counts": (F.col("affected_days") >= 0) & (F.col("rows_read") >= 0) & (F.col("rows_written") >= 0),
        "run_completion": (F.col("status") == "running") == F.col("completed_at").isNull(),
    }
    return _row_rules(runs, rules).unionByName(
        _unique(runs, "one_open_run", ["projection_name", "projection_version"], "status = 'running'")
    )


def registry_rules(revisions: DataFrame, definitions: DataFrame, entries: DataFrame) -> DataFrame:
    rules = {
        "definition_version": F.col("context_version") > 0,
        "definition_family": F.col("context_family").isin(*vocab.CONTEXT_FAMILIES),
        "definition_parent": ~(
            F.col("parent_context_key").eqNullSafe(F.col("context_key"))
            & F.col("parent_context_version").eqNullSafe(F.col("context_version"))
        ),
    }
    key = ["context_key", "context_version"]
    return (
        _row_rules(definitions, rules)
        .unionByName(_row_rules(entries, {"entry_status": F.col("status").isin("active", "inactive")}))
        .unionByName(_unique(definitions, "definition_unique", key))
        .unionByName(_unique(revisions, "revision_unique", ["registry_revision"]))
        .unionByName(_unique(revisions, "one_active_revision", ["status"], "status = 'valid' and activated_at is not null"))
        .unionByName(_orphans(entries, definitions, "entry_has_definition", key))
    )


def erase_events(tables: dict[str, DataFrame], doomed: DataFrame) -> dict[str, DataFrame]:
    """Events go, and their items, orders and subject facts with them. doomed: event_id."""
    ids = doomed.select("event_id").distinct()
    return {
        name: df.join(ids, "event_id", "left_anti") if name in ("events", "items", "orders", "facts") else df
        for name, df in tables.items()
    }


def erase_subjects(tables: dict[str, DataFrame], doomed: DataFrame) -> dict[str, DataFrame]:
    """Subjects go, and their daily rows with them. doomed: tenant_id, external_subject_id."""
    key = ["tenant_id", "external_subject_id"]
    ids = doomed.select(*key).distinct()
    return {
        name: df.join(ids, key, "left_anti") if name in ("subjects", "global_daily", "context_daily") else df
        for name, df in tables.items()
    }
