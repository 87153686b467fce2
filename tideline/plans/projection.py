"""The projection job: changed facts -> affected keys -> recount -> replaced days -> checkpoint."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline import vocab
from tideline.operators import projections
from tideline.plans.tables import Tables
from tideline.session import cut
from tideline.sources import changes

TABLE = {False: "global_daily", True: "context_daily"}
NAME = {False: vocab.GLOBAL_PROJECTION, True: vocab.CONTEXT_PROJECTION}


def read_daily(tables: Tables, contextual: bool) -> DataFrame | None:
    """Daily rows; a day that became empty holds a single row without tenant, which is skipped."""
    rows = tables.read_or_none(TABLE[contextual])
    return None if rows is None else rows.where("tenant_id is not null")


def checkpoint(tables: Tables, name: str, version: int):
    rows = tables.read_or_none("projection_checkpoints")
    if rows is None:
        return None, None
    found = (
        rows.where((F.col("projection_name") == name) & (F.col("projection_version") == version))
        .agg(F.max(F.struct("last_updated_at", "last_id")).alias("c"))
        .first()["c"]
    )
    return (None, None) if found is None else (found["last_updated_at"], found["last_id"])


def claim_name(contextual: bool, version: int) -> str:
    return f"{NAME[contextual]}-{version}"


def run(tables: Tables, facts: DataFrame, subjects: DataFrame, contextual: bool, now: datetime, version: int = 1) -> dict:
    """One run over everything that changed since the checkpoint, whatever its age.

    The recount is absolute, so a run that is repeated after a crash writes the same rows; the
    checkpoint moves only after the data is in place. While another run holds the claim nothing is done but a note of that.
    """
    with tables.claim(claim_name(contextual, version)) as alone:
        if alone:
            return _run(tables, facts, subjects, contextual, now, version)
    skipped = dict(run_id=f"{NAME[contextual]}:{version}:{now.isoformat()}:skipped", status="skipped_locked", started_at=now, completed_at=now)
    named = dict(projection_name=NAME[contextual], projection_version=version)
    tables.append("projection_runs", projections.run_row(tables.spark, **skipped, **named))
    return dict(affected_days=0, rows_read=0, rows_written=0)


def _run(tables, facts, subjects, contextual, now, version) -> dict:
    spark, name = tables.spark, NAME[contextual]
    key = projections.key_of(contextual)
    ledger = tables.read_or_none("projection_runs")
    if ledger is not None:
        lost = projections.recovered(ledger, name, version, now)
        if not lost.isEmpty():
            tables.append("projection_runs", cut(lost))
    run_id = f"{name}:{version}:{now.isoformat()}"
    opened = dict(run_id=run_id, projection_name=name, projection_version=version, started_at=now)
    tables.append("projection_runs", projections.run_row(spark, status="running", **opened))
    try:
        counts = _advance(tables, facts, subjects, contextual, name, version, key)
    except Exception as error:
        failed = projections.run_row(spark, status="failed", completed_at=now, last_error=str(error), **opened)
        tables.append("projection_runs", failed)
        raise
    done = projections.run_row(spark, status="completed", completed_at=now, **counts, **opened)
    tables.append("projection_runs", done)
    return counts


def _advance(tables, facts, subjects, contextual, name, version, key) -> dict:
    spark = tables.spark
    changed = changes.changed_rows(facts, *checkpoint(tables, name, version), contextual)
    top = changed.agg(
        F.count(F.lit(1)).alias("n"), F.max(F.struct("updated_at", "row_id")).alias("c")
    ).first()
    if top["n"] == 0:
        return dict(affected_days=0, rows_read=0, rows_written=0)
    affected = cut(projections.affected_keys(changed, contextual))
    days = cut(affected.select("local_date").distinct())
    fresh = projections.recompute(_on_days(facts, days, "event_date", 1), affected, subjects, contextual)
    stored = read_daily(tables, contextual)
    if stored is not None:
        touched = _on_days(stored, days, "local_date", 0)
        on_days = touched.join(days, "local_date", "left_semi").select(*fresh.columns)
        fresh = projections.replace(on_days, affected, fresh, contextual)
    fresh = cut(fresh)
    emptied = days.join(fresh.select("local_date").distinct(), "local_date", "left_anti")
    blank = emptied.select(
        *[
            F.col(c) if c == "local_date" else F.lit(None).cast(fresh.schema[c].dataType).alias(c)
            for c in fresh.columns
        ]
    )
    (
        fresh.unionByName(blank)
        .hint("rebalance", "local_date")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("local_date")
        .parquet(tables.path(TABLE[contextual]))
    )
    written = fresh.join(affected, key, "left_semi").count()
    mark = spark.createDataFrame(
        [(name, version, top["c"]["updated_at"], top["c"]["row_id"])],
        "projection_name string, projection_version int, last_updated_at timestamp, last_id string",
    )
    tables.append("projection_checkpoints", mark)
    return dict(affected_days=affected.count(), rows_read=top["n"], rows_written=written)


def _on_days(rows: DataFrame, days: DataFrame, column: str, margin: int) -> DataFrame:
    """The rows on the touched days; the join prunes a table's day folders at run time.

    The table's day may be off the local date by the margin, because it is taken in UTC.
    """
    if column not in rows.columns:
        return rows
    near = F.explode(F.transform(F.sequence(F.lit(-margin), F.lit(margin)), lambda d: F.date_add("local_date", d)))
    return rows.join(days.select(near.alias(column)).distinct(), column, "left_semi")


def run_all(tables: Tables, facts: DataFrame, subjects: DataFrame, now: datetime, version: int = 1) -> list[dict]:
    """Global, then context; the first error stops the sequence."""
    return [run(tables, facts, subjects, contextual, now, version) for contextual in (False, True)]


def run_due(tables: Tables, facts: DataFrame, subjects: DataFrame, now: datetime, version: int = 1) -> list[str]:
    """Runs the projections that are due; returns their names."""
    ledger = tables.read_or_none("projection_runs")
    if ledger is None:
        names = [vocab.GLOBAL_PROJECTION, vocab.CONTEXT_PROJECTION]
    else:
        rows = projections.due(ledger, version, F.lit(now).cast("timestamp")).where("due").collect()
        names = [r["projection_name"] for r in rows]
    for contextual in (False, True):
        if NAME[contextual] in names:
            run(tables, facts, subjects, contextual, now, version)
    return sorted(names)
