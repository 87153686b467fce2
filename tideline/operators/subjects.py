"""Event-subject facts: explode, status cascade, context resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline import vocab
from tideline.functions import payload as pl
from tideline.functions.once import once
from tideline.functions.text import is_required_text, trimmed_text
from tideline.functions.zones import local_date

_SUBJECT = "struct<ord:int,is_object:boolean,subject_type:string,external_subject_id:string,relation:string>"


def _entries(subjects: Column) -> Column:
    raw = F.try_variant_get(subjects, "$", "array<variant>")
    # Elements are read in one pass, and texts trimmed behind it: lambdas are interpreted, and name things again for nothing.
    read = F.transform(raw, lambda x: pl.members(x, ("subject_type", "subject_id", "relation")))

    def text(value):
        return F.when(pl.is_string(value), F.try_variant_get(value, "$", "string")).otherwise(F.lit(""))

    texts = F.transform(
        read,
        lambda x: F.struct(
            x.isNotNull().alias("is_object"),
            text(x["subject_type"]).alias("subject_type"),
            text(x["subject_id"]).alias("external_subject_id"),
            text(x["relation"]).alias("relation"),
        ),
    )
    return F.transform(
        texts,
        lambda x, i: F.struct(
            i.alias("ord"),
            x["is_object"].alias("is_object"),
            *[trimmed_text(x[n]).alias(n) for n in ("subject_type", "external_subject_id", "relation")],
        ),
    ).cast(f"array<{_SUBJECT}>")


def _key(e: Column) -> Column:
    return F.when(
        e["is_object"], F.concat_ws("\x00", e["subject_type"], e["external_subject_id"], e["relation"])
    )


def _first_of_each() -> Column:
    """Entries in order; the first of each (type, id, relation) stays, non-objects all stay."""
    return F.filter(
        "_entries",
        lambda e: ~e["is_object"] | (F.array_position("_keys", _key(e)) == e["ord"] + 1),
    )


def _operation(value: Column):
    read = pl.members(value, ("operation_type", "operation_id"))
    kind, ident = pl.as_pure_text(read["operation_type"]), pl.as_pure_text(read["operation_id"])
    absent = pl.is_absent_or_null(value)
    valid = absent | (pl.is_object(value) & is_required_text(kind) & is_required_text(ident))
    return kind, ident, F.coalesce(valid, F.lit(False))


def _lifecycle(event_name: Column, value: Column):
    applies = event_name.isin(*vocab.LIFECYCLE_EVENTS)
    read = pl.members(value, ("source_updated_at", "source_mutation_id", "effective_at", "merged_into_subject_id"))
    updated = pl.as_time(read["source_updated_at"], pl.RFC3339_UTC)
    mutation = pl.as_pure_text(read["source_mutation_id"])
    effective = read["effective_at"]
    effective_at = pl.as_time(effective, pl.RFC3339_UTC)
    target = pl.as_pure_text(read["merged_into_subject_id"])
    target_ok = F.when(event_name == "subject_merged", is_required_text(target)).otherwise(target == "")
    complete = (
        pl.is_object(value)
        & updated.isNotNull()
        & is_required_text(mutation)
        & (effective.isNull() | effective_at.isNotNull())
        & target_ok
    )
    valid = F.when(applies, F.coalesce(complete, F.lit(False))).otherwise(pl.is_absent_or_null(value))
    used = applies & valid
    return {
        "lifecycle_valid": valid,
        "lifecycle_source_updated_at": F.when(used, updated),
        "lifecycle_source_mutation_id": F.when(used, mutation),
        "lifecycle_effective_at": F.when(used, effective_at),
        "merged_into_external_subject_id": F.when(used & (target != ""), target),
    }


def subject_rows(events: DataFrame) -> DataFrame:
    """One row per subject of an event. Needs tenant_id, site_id, timezone and zone of the site."""
    events = once(
        events,
        {
            "_read": pl.members(F.col("properties"), ("subjects", "operation", "lifecycle")),
            "_context": F.try_variant_get(
                "context", "$", "struct<context_key: variant, context_version: variant, claimed_context_family: variant>"
            ),
        },
    )
    subjects = F.col("_subjects")
    op_kind, op_id, op_ok = _operation(F.col("_read.operation"))
    life = _lifecycle(F.col("event_name"), F.col("_read.lifecycle"))
    key = pl.as_pure_text(F.col("_context.context_key"))
    kept = [
        c
        for c in (
            "stream_id", "event_id", "logical_event_id", "idempotency_key", "tenant_id", "site_id",
            "event_source", "event_name", "event_time", "received_at", "timezone", "zone",
        )
        if c in events.columns
    ]
    read = events.select(
        *kept,
        F.col("_read.subjects").alias("_subjects"),
        op_kind.alias("operation_type"),
        op_id.alias("operation_id"),
        op_ok.alias("_op_ok"),
        *[c.alias(n) for n, c in life.items()],
        key.alias("context_key"),
        pl.as_positive_int(F.col("_context.context_version")).alias("context_version"),
        pl.as_pure_text(F.col("_context.claimed_context_family")).alias("claimed_context_family"),
        local_date(F.col("event_time"), F.col("zone")).alias("_date"),
    )
    entries = F.when(pl.is_array(subjects), _entries(subjects)).when(
        subjects.isNotNull(), F.array(F.lit(None).cast(_SUBJECT))
    )
    # Taken once: a filter that the optimizer infers from exploding the entries names them again, as a join's condition even.
    keyed = once(once(read, {"_entries": entries}), {"_keys": F.transform("_entries", _key)})
    first = F.when(pl.is_array(subjects), _first_of_each()).otherwise(F.col("_entries"))
    listed = once(keyed, {"_entries": first}).drop("_keys", "_subjects")
    exploded = listed.select("*", F.explode("_entries").alias("s")).drop("_entries")
    s = F.col("s")
    ident, relation = s["external_subject_id"], s["relation"]
    invalid = F.lit("invalid_subject")
    bad_fields = (
        (s["subject_type"] == "")
        | (ident == "")
        | (F.char_length(ident) > vocab.MAX_TEXT)
        | (F.char_length(relation) > vocab.MAX_TEXT)
    )
    self_merge = (F.col("event_name") == "subject_merged") & F.coalesce(
        F.col("merged_into_external_subject_id") == ident, F.lit(False)
    )
    verdict = (
        F.when(s.isNull(), F.struct(invalid.alias("s"), F.lit("subjects_not_array").alias("r")))
        .when(~s["is_object"], F.struct(invalid.alias("s"), F.lit("subject_not_object").alias("r")))
        .when(bad_fields, F.struct(invalid.alias("s"), F.lit("invalid_subject_fields").alias("r")))
        .when(
            s["subject_type"] != "customer",
            F.struct(F.lit("unsupported_subject_type").alias("s"), F.lit("unsupported_subject_type").alias("r")),
        )
        .when(~F.col("_op_ok"), F.struct(invalid.alias("s"), F.lit("invalid_operation").alias("r")))
        .when(
            ~F.col("lifecycle_valid") | self_merge,
            F.struct(invalid.alias("s"), F.lit("invalid_lifecycle").alias("r")),
        )
        .when(
            F.col("zone").isNull(),
            F.struct(F.lit("timezone_unresolved").alias("s"), F.lit("timezone_unresolved").alias("r")),
        )
        .otherwise(F.struct(F.lit("normalized").alias("s"), F.lit(None).cast("string").alias("r")))
    )
    judged = exploded.withColumn("_v", verdict)
    identified = F.coalesce(s["is_object"], F.lit(False))
    empty_for_unidentified = (
        "operation_type", "operation_id", "context_key", "claimed_context_family",
    )
    null_for_unidentified = (
        "context_version", "lifecycle_source_updated_at", "lifecycle_source_mutation_id",
        "lifecycle_effective_at", "merged_into_external_subject_id",
    )
    initial = F.when(
        identified & (F.col("event_source") == "server") & (F.col("event_name") == "subject_associated"),
        F.lit("active"),
    ).otherwise(F.lit("unknown"))
    plain = [c for c in kept if c not in ("timezone", "zone")]
    return judged.select(
        *plain,
        F.coalesce(s["ord"], F.lit(0)).alias("subject_ordinal"),
        F.coalesce(s["subject_type"], F.lit("")).alias("subject_type"),
        F.coalesce(ident, F.lit("")).alias("external_subject_id"),
        F.coalesce(relation, F.lit("")).alias("relation"),
        *[F.when(identified, F.nullif(F.col(c), F.lit(""))).alias(c) for c in empty_for_unidentified],
        *[F.when(identified, F.col(c)).alias(c) for c in null_for_unidentified],
        F.when(identified, F.nullif(F.col("timezone"), F.lit(""))).alias("timezone_name"),
        F.when(F.col("_v.s") == "normalized", F.col("_date")).alias("local_date"),
        F.col("_v.s").alias("normalization_status"),
        F.col("_v.r").alias("normalization_reason"),
        initial.alias("initial_status"),
        F.lit("registry_disabled").alias("context_resolution_status"),
        F.lit(None).cast("string").alias("resolved_context_family"),
        F.lit(None).cast("string").alias("context_registry_revision"),
    )


def resolve_contexts(rows: DataFrame, definitions: DataFrame, revision: str | None) -> DataFrame:
    """Exact (key, version) lookup of normalized rows in the active revision.

    definitions: context_key, context_version, context_family, status of that revision. Without an
    active revision rows stay `registry_disabled`. A registry revision is one JSON document, but its
    join is left to the planner, which broadcasts it when it is small.
    """
    if revision is None:
        return rows
    known = definitions.select(
        F.col("context_key").alias("_key"),
        F.col("context_version").alias("_version"),
        F.col("context_family").alias("_family"),
        F.col("status").alias("_status"),
    )
    normalized = F.col("normalization_status") == "normalized"
    keyed = F.col("context_key").isNotNull() & F.col("context_version").isNotNull()
    on = (
        normalized
        & (F.col("context_key") == F.col("_key"))
        & (F.col("context_version") == F.col("_version"))
    )
    status = (
        F.when(~normalized, F.col("context_resolution_status"))
        .when(~keyed, F.lit("family_unresolved"))
        .when(F.col("_key").isNull(), F.lit("unregistered"))
        .when(F.col("_status") == "inactive", F.lit("inactive_context"))
        .otherwise(F.lit("registered"))
    )
    return (
        rows.join(known, on, "left")
        .withColumns(
            {
                "context_resolution_status": status,
                "resolved_context_family": F.coalesce(F.col("_family"), F.col("resolved_context_family")),
                "context_registry_revision": F.when(normalized, F.lit(revision)).otherwise(
                    F.col("context_registry_revision")
                ),
            }
        )
        .drop("_key", "_version", "_family", "_status")
    )


def with_row_id(rows: DataFrame) -> DataFrame:
    """Natural row id: event id and subject ordinal, in an order that sorts like the pair."""
    return rows.withColumn(
        "row_id", F.concat_ws("#", F.col("event_id"), F.lpad(F.col("subject_ordinal").cast("string"), 6, "0"))
    )
