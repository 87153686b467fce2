"""The subject dimension: identity, ordered lifecycle, merges, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline import vocab
from tideline.operators import ordered

KEY = ["tenant_id", "subject_type", "external_subject_id"]
_STATE = "struct<updated_at:timestamp,mutation_id:string,status:string,target:string,effective_at:timestamp,seen_at:timestamp>"


def creates_subject() -> Column:
    return F.col("normalization_status").isin("normalized", "timezone_unresolved")


def changes_lifecycle() -> Column:
    """Whether a fact is an ordered lifecycle change, which flag_ignored may refuse; never NULL."""
    return F.coalesce(creates_subject(), F.lit(False)) & F.col("lifecycle_source_updated_at").isNotNull()


def lifecycle_state(status: Column, target: Column, effective: Column, seen: Column) -> Column:
    """Change as one struct that orders by source time, then mutation id bytewise."""
    return F.struct(
        F.col("lifecycle_source_updated_at").alias("updated_at"),
        F.col("lifecycle_source_mutation_id").alias("mutation_id"),
        status.alias("status"),
        target.alias("target"),
        effective.alias("effective_at"),
        seen.alias("seen_at"),
    ).cast(_STATE)


def _status_of(event_name: Column) -> Column:
    pairs = [F.lit(x) for kv in vocab.LIFECYCLE_STATUS.items() for x in kv]
    return F.create_map(*pairs)[event_name]


def changes_from_events(rows: DataFrame) -> DataFrame:
    """Identity and lifecycle contributions of event-subject facts, merge targets included.

    Merge targets come into being with any merge, applied or ignored.
    """
    usable = rows.where(creates_subject())
    change = F.when(
        F.col("lifecycle_source_updated_at").isNotNull(),
        lifecycle_state(
            _status_of(F.col("event_name")),
            F.col("merged_into_external_subject_id"),
            F.col("lifecycle_effective_at"),
            F.col("received_at"),
        ),
    )
    place = [F.col(c) if c in rows.columns else F.lit("") for c in ("event_id", "subject_ordinal")]
    tie = F.concat(place[0], F.lit("/"), F.lpad(place[1].cast("string"), 9, "0")).alias("tie")
    own = usable.select(
        *KEY, (F.col("initial_status") == "active").alias("confirmed"),
        F.col("received_at").alias("seen_at"), tie, change.alias("change"),
    )
    targets = usable.where(F.col("merged_into_external_subject_id").isNotNull()).select(
        "tenant_id", "subject_type", F.col("merged_into_external_subject_id").alias("external_subject_id"),
        F.lit(False).alias("confirmed"), F.col("received_at").alias("seen_at"), tie,
        F.lit(None).cast(_STATE).alias("change"),
    )
    return own.unionByName(targets)


def changes_from_snapshot(snapshot: DataFrame) -> DataFrame:
    """Valid snapshot rows as contributions; a merged row also brings its target."""
    rows = snapshot.withColumn("subject_type", F.lit("customer"))
    own = rows.select(
        *KEY, F.lit(False).alias("confirmed"), F.col("source_updated_at").alias("seen_at"), F.lit("").alias("tie"),
        F.struct(
            F.col("source_updated_at").alias("updated_at"),
            F.col("source_mutation_id").alias("mutation_id"),
            F.col("lifecycle_status").alias("status"),
            F.when(F.col("lifecycle_status") == "merged", F.col("merged_into_external_subject_id")).alias("target"),
            F.lit(None).cast("timestamp").alias("effective_at"),
            F.col("source_updated_at").alias("seen_at"),
        ).cast(_STATE).alias("change"),
    )
    targets = rows.where(F.col("lifecycle_status") == "merged").select(
        "tenant_id", "subject_type", F.col("merged_into_external_subject_id").alias("external_subject_id"),
        F.lit(False).alias("confirmed"), F.col("source_updated_at").alias("seen_at"), F.lit("").alias("tie"),
        F.lit(None).cast(_STATE).alias("change"),
    )
    return own.unionByName(targets)


def changes_from_dimension(subjects: DataFrame) -> DataFrame:
    """The stored dimension as contributions, so that a rebuild is one fold."""
    ordered_change = F.when(
        F.col("lifecycle_source_updated_at").isNotNull(),
        lifecycle_state(
            F.col("lifecycle_status"), F.col("merged_into_external_subject_id"),
            F.col("lifecycle_effective_at"), F.col("status_updated_at"),
        ),
    )
    return subjects.select(
        *KEY, (F.col("lifecycle_status") == "active").alias("confirmed"),
        F.col("status_updated_at").alias("seen_at"), F.lit("").alias("tie"), ordered_change.alias("change"),
    )


def fold(changes: DataFrame) -> DataFrame:
    """One row per subject: the latest lifecycle change wins, else active once confirmed.

    Of changes with the same source time and mutation id the first that arrived counts, as a later one is ignored when it
    comes. Two partial aggregations: a subject with very many changes costs one row per change and task in the first
    shuffle, spread by change, and one per task in the second.
    """
    folded = (
        changes.groupBy(*KEY, F.col("change.updated_at").alias("_at"), F.col("change.mutation_id").alias("_id"))
        .agg(
            F.min(F.when(F.col("change").isNotNull(), F.struct("seen_at", "tie", "change"))).alias("_first"),
            F.bool_or("confirmed").alias("_confirmed"),
            F.min(F.when(F.col("confirmed"), F.col("seen_at"))).alias("_confirmed_at"),
            F.min("seen_at").alias("_first_seen"),
        )
        .groupBy(*KEY)
        .agg(
            F.max_by(F.col("_first.change"), F.when(F.col("_first").isNotNull(), F.struct("_at", "_id"))).alias("_c"),
            F.bool_or("_confirmed").alias("_confirmed"),
            F.min("_confirmed_at").alias("_confirmed_at"),
            F.min("_first_seen").alias("_first_seen"),
        )
    )
    c = F.col("_c")
    status = F.when(c.isNotNull(), c["status"]).when(F.col("_confirmed"), F.lit("active")).otherwise(F.lit("unknown"))
    changed_at = F.when(c.isNotNull(), c["seen_at"]).otherwise(
        F.coalesce(F.col("_confirmed_at"), F.col("_first_seen"))
    )
    return folded.select(
        *KEY,
        status.alias("lifecycle_status"),
        c["updated_at"].alias("lifecycle_source_updated_at"),
        c["mutation_id"].alias("lifecycle_source_mutation_id"),
        c["effective_at"].alias("lifecycle_effective_at"),
        c["target"].alias("merged_into_external_subject_id"),
        changed_at.alias("status_updated_at"),
    )


def merge(*parts: DataFrame) -> DataFrame:
    """Folds several dimensions, such as the stored one and those of new batches, into one."""
    changes = [changes_from_dimension(p) for p in parts]
    whole = changes[0]
    for part in changes[1:]:
        whole = whole.unionByName(part)
    return fold(whole)


def flag_ignored(rows: DataFrame, stored: DataFrame | None = None, bucket_seconds: int = 3600) -> DataFrame:
    """Marks lifecycle changes that were not newer than all earlier ones of their subject.

    The order of application is arrival; a subject's changes are compared with a running maximum
    that is carried from hour to hour, so one busy subject is spread over its hours.
    """
    mark = F.struct("lifecycle_source_updated_at", "lifecycle_source_mutation_id")
    applies = changes_lifecycle()
    value = F.when(applies, mark)
    bucket = ordered.time_bucket(F.col("received_at"), bucket_seconds)
    order = ["received_at", "event_id", "subject_ordinal"]
    seen = ordered.with_running_max(rows, KEY, order, bucket, value, "_seen")
    if stored is not None:
        known = stored.where("lifecycle_source_updated_at is not null").select(
            *KEY,
            F.struct("lifecycle_source_updated_at", "lifecycle_source_mutation_id").alias("_known"),
        )
        seen = seen.join(known, KEY, "left").withColumn("_seen", F.greatest("_seen", "_known")).drop("_known")
    ignored = F.coalesce(applies & (mark <= F.col("_seen")), F.lit(False))
    out = seen.withColumns(
        {
            "normalization_status": F.when(ignored, F.lit("lifecycle_ignored")).otherwise(
                F.col("normalization_status")
            ),
            "normalization_reason": F.when(ignored, F.lit("out_of_order_or_duplicate")).otherwise(
                F.col("normalization_reason")
            ),
        }
    )
    return out.select(*rows.columns)


SUBJECT_KEY = ["tenant_id", "event_name", "idempotency_key", "subject_type", "external_subject_id", "relation"]


def flag_idempotency(rows: DataFrame, stored_keys: DataFrame | None = None) -> DataFrame:
    """A repeat of (tenant, name, idempotency key, type, id, relation) is kept for audit with its key
    cleared. Runs after the lifecycle has been applied."""
    from tideline.operators.dedup import flag_repeats

    keyed = F.coalesce(F.col("idempotency_key"), F.lit("")) != ""
    order = F.struct("received_at", "event_id", "subject_ordinal")
    flagged = flag_repeats(rows, SUBJECT_KEY, order, "_again", keyed)
    if stored_keys is not None:
        asked = rows.where(keyed).select(*SUBJECT_KEY).distinct()
        known = stored_keys.select(*SUBJECT_KEY).join(asked, SUBJECT_KEY, "left_semi").distinct().withColumn("_known", F.lit(True))
        flagged = flagged.join(known, SUBJECT_KEY, "left").withColumn(
            "_again", F.col("_again") | F.coalesce(F.col("_known"), F.lit(False))
        )
    again = F.col("_again")
    out = flagged.withColumns(
        {
            "idempotency_key": F.when(~again, F.nullif(F.col("idempotency_key"), F.lit(""))),
            "normalization_status": F.when(again, F.lit("idempotency_conflict")).otherwise(F.col("normalization_status")),
            "normalization_reason": F.when(again, F.lit("tenant_idempotency_conflict")).otherwise(F.col("normalization_reason")),
        }
    )
    return out.select(*rows.columns)


def merge_targets(subjects: DataFrame) -> DataFrame:
    """Merged subjects with the state of the subject they point at; one hop."""
    target = subjects.select(
        F.col("tenant_id").alias("_t"), F.col("subject_type").alias("_y"),
        F.col("external_subject_id").alias("_x"), F.col("lifecycle_status").alias("target_status"),
    )
    merged = subjects.where("lifecycle_status = 'merged'")
    on = (
        (F.col("tenant_id") == F.col("_t"))
        & (F.col("subject_type") == F.col("_y"))
        & (F.col("merged_into_external_subject_id") == F.col("_x"))
    )
    return merged.join(target, on, "left").drop("_t", "_y", "_x")


def eligible(subjects: DataFrame) -> DataFrame:
    return subjects.where("lifecycle_status = 'active'")


def identity_valid() -> Column:
    return F.coalesce(
        (F.col("tenant_id") != "") & (F.col("external_subject_id") != "") & (F.col("subject_type") == "customer"),
        F.lit(False),
    )


def lifecycle_valid() -> Column:
    """Known status; a merge target exactly when merged, and never the subject itself."""
    merged = F.col("lifecycle_status") == "merged"
    target = F.col("merged_into_external_subject_id")
    return F.coalesce(
        F.col("lifecycle_status").isin(*vocab.LIFECYCLE_STATUSES)
        & (merged == target.isNotNull())
        & (target.isNull() | (target != F.col("external_subject_id"))),
        F.lit(False),
    )
