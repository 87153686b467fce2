"""Loading the subject dimension from a snapshot: page by page, resumable, once per revision."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline import schemas
from tideline.operators import dimension
from tideline.plans.tables import Tables
from tideline.session import join_path
from tideline.sources import dimensions

LEDGER = """
    run_id string, status string, cursor string, source_revision string, processed_count bigint,
    failed_count bigint, last_error string, at timestamp, step bigint
"""


class SnapshotExpired(RuntimeError):
    """The source moved to another revision while the load was running."""


class SnapshotInvalid(ValueError):
    """A page breaks the contract."""


def state(tables: Tables) -> dict | None:
    """Latest state of the latest run."""
    rows = tables.read_or_none("bootstrap_runs")
    if rows is None:
        return None
    last = rows.agg(F.max_by(F.struct(*rows.columns), F.struct("run_id", "step")).alias("r")).first()["r"]
    return None if last is None else last.asDict()


def _note(tables: Tables, previous: dict, **changes) -> dict:
    new = {**previous, **changes, "step": previous["step"] + 1}
    if new["last_error"]:
        new["last_error"] = new["last_error"][:1000]
    names = [f.split()[0] for f in LEDGER.split(",")]
    tables.append("bootstrap_runs", tables.spark.createDataFrame([tuple(new[n] for n in names)], LEDGER))
    return new


def begin_or_resume(tables: Tables, now: datetime, force: bool = False) -> dict | None:
    """The run to go on with; None when the last one is complete. Force starts a new one."""
    last = state(tables)
    if last is not None and not force:
        if last["status"] == "completed":
            return None
        if last["last_error"] == "snapshot_revision_expired":
            raise SnapshotExpired("the revision expired; start anew with force")
        return _note(tables, last, status="running", last_error=None, at=now)
    if last is not None and last["status"] == "running":
        _note(tables, last, status="failed", last_error="replaced_by_operator", at=now)
    fresh = dict(
        run_id=now.strftime("%Y%m%dT%H%M%S%f"), status="running", cursor=None, source_revision=None,
        processed_count=0, failed_count=0, last_error=None, at=now, step=0,
    )
    return _note(tables, fresh)


def run(tables: Tables, pages_dir: str, now: datetime, force: bool = False, pages_per_batch: int = 1000) -> dict | None:
    """Loads all pages not yet loaded by this run. Each page is a JSON file.

    A file stream keeps track of the pages: every micro-batch writes its subjects under its own
    batch id and then the ledger row; a crash in between repeats the batch with the same result.
    """
    current = begin_or_resume(tables, now, force)
    if current is None:
        return None
    spark = tables.spark
    pages = (
        spark.readStream.schema(schemas.SNAPSHOT_PAGE)
        .option("multiLine", "true")
        .option("maxFilesPerTrigger", str(pages_per_batch))
        .json(pages_dir)
    )
    holder = {"state": current}

    def apply(batch: DataFrame, batch_id: int) -> None:
        holder["state"] = _apply(tables, batch, batch_id, holder["state"], now)

    query = (
        pages.writeStream.foreachBatch(apply)
        .trigger(availableNow=True)
        .option("checkpointLocation", join_path(tables.base, "_bootstrap", current["run_id"]))
        .start()
    )
    try:
        query.awaitTermination()
    except Exception as error:
        expired = "SnapshotExpired" in str(error)
        cause = "snapshot_revision_expired" if expired else str(error)
        _note(tables, holder["state"], status="failed", last_error=cause, at=now)
        if expired:
            raise SnapshotExpired(cause) from error
        raise
    return _note(tables, holder["state"], status="completed", at=now)


def _apply(tables: Tables, pages: DataFrame, batch_id: int, current: dict, now: datetime) -> dict:
    summary = pages.agg(
        F.min("source_revision").alias("low"), F.max("source_revision").alias("high"),
        F.bool_and(dimensions.snapshot_page_valid()).alias("valid"), F.max("next_cursor").alias("cursor"),
        F.sum(F.size("subjects")).alias("rows"),
    ).first()
    known = current["source_revision"] or summary["low"]
    if not summary["valid"]:
        raise SnapshotInvalid("a page breaks the snapshot contract")
    if summary["low"] != known or summary["high"] != known:
        raise SnapshotExpired(f"expected revision {known}")
    rows = dimensions.check_snapshot(pages.select(F.inline("subjects")))
    if not rows.where("not row_valid").isEmpty():
        raise SnapshotInvalid("a snapshot row is invalid")
    batch = dimension.fold(dimension.changes_from_snapshot(rows))
    # Shared with the event batches, under ids of its own.
    tables.write_batch("subject_changes", batch, f"bootstrap-{current['run_id']}-{batch_id:09d}", keys=dimension.KEY)
    return _note(
        tables, current, cursor=summary["cursor"], source_revision=known,
        processed_count=current["processed_count"] + (summary["rows"] or 0), at=now,
    )
