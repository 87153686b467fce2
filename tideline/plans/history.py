"""Resolves facts that no registry revision has seen, in the stored table.

Resolved rows move: they get a new updated_at, and facts lie in folders by the day of it, so projections find them as
changed. The job works on the folders that hold such rows. It first writes the resolved rows aside, then into a batch of
its own, then rewrites the folders without them, and notes the revision's step as done. A run that was cut off is taken up from
the rows written aside and leaves the same tables. Projections don't run meanwhile.
"""

from __future__ import annotations

from contextlib import ExitStack
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators import registry
from tideline.plans import projection
from tideline.plans.registry_store import RegistryStore
from tideline.plans.tables import Tables
from tideline.session import cut

FOLDERS = ["ingest_date", "event_date", "batch_id"]
STEPS = "revision string, step int, rows bigint, at timestamp"


def _steps(tables: Tables, revision: str) -> int:
    """Steps of this revision that are done."""
    rows = tables.read_or_none("context_resolution_steps")
    return 0 if rows is None else rows.where(F.col("revision") == revision).select("step").distinct().count()


def resolve(tables: Tables, at: datetime) -> int | None:
    """Resolves all open facts against the active revision; the number of them, None where another job is at the tables.

    Without an active revision, or without open facts, nothing is written.
    """
    definitions, revision = RegistryStore(tables).active()
    if revision is None or tables.read_or_none("facts") is None:
        return 0
    with ExitStack() as stack:
        for contextual in (False, True):
            if not stack.enter_context(tables.claim(projection.claim_name(contextual, 1))):
                return None
        return _resolve(tables, definitions, revision, at)


def _resolve(tables: Tables, definitions: DataFrame, revision: str, at: datetime) -> int:
    step = _steps(tables, revision) + 1
    name = f"history-{revision}-{step:06d}"
    aside = f"_history/{name}"
    if not tables.exists(f"{aside}/_SUCCESS"):
        facts = tables.read("facts")
        rows = facts.where("context_registry_revision is null")
        if rows.isEmpty():
            return 0
        _, published, _ = RegistryStore(tables).load()
        resolved = registry.resolve_history(rows, published, definitions, revision, at)
        resolved.withColumnsRenamed({c: f"was_{c}" for c in FOLDERS}).write.mode("overwrite").parquet(tables.path(aside))
    resolved = tables.read(aside)
    was = [f"was_{c}" for c in FOLDERS]
    tables.write_batch("facts", resolved.drop(*was), name, "event_time", ingested="updated_at")
    tables.write_batch("unregistered", registry.unregistered(resolved), name)
    folders = cut(resolved.select(*[F.col(f"was_{c}").alias(c) for c in FOLDERS]).distinct())
    _without(tables, folders, resolved.select("row_id", *[F.col(f"was_{c}").alias(c) for c in FOLDERS]))
    count = resolved.count()
    tables.append("context_resolution_steps", tables.spark.createDataFrame([(revision, step, count, at)], STEPS))
    tables.remove(aside)
    return count


def _without(tables: Tables, folders: DataFrame, gone: DataFrame) -> None:
    """Rewrites folders of facts without the rows that moved. The join prunes the scan to these folders."""
    left = cut(tables.read("facts").join(folders, FOLDERS, "left_semi").join(gone, ["row_id", *FOLDERS], "left_anti"))
    if not left.isEmpty():
        writer = left.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*FOLDERS)
        writer.parquet(tables.path("facts"))
    # a folder that keeps no row isn't overwritten
    for r in folders.join(left.select(*FOLDERS).distinct(), FOLDERS, "left_anti").toLocalIterator():
        tables.remove("facts", *[f"{c}={r[c]}" for c in FOLDERS])


def unregistered_contexts(tables: Tables) -> DataFrame | None:
    """Counters of contexts that no revision knows: each batch's own part, folded. A batch that is replayed replaces its part."""
    parts = tables.read_or_none("unregistered")
    if parts is None:
        return None
    known = F.when(F.col("claimed_context_family").isNotNull(), F.col("batch_id"))
    return parts.groupBy(*registry.KEY).agg(
        F.min_by("claimed_context_family", known).alias("claimed_context_family"),
        F.min_by("first_seen_at", "batch_id").alias("first_seen_at"),
        F.max("last_seen_at").alias("last_seen_at"),
        F.sum("event_count").alias("event_count"),
        F.lit("pending").alias("reconciliation_status"),
    )
