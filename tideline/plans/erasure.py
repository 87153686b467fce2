"""Erases events, subjects and tenants from the stored tables, with everything that hangs on them.

With an event go its items, orders, facts and keys, with a subject its daily rows; daily counts stay as they are until their keys are
recounted. Marks hold no event and lapse by themselves. Only folders that hold such rows are rewritten. For every table
the job first writes aside which folders those are and what they keep, then overwrites them from there, so a run that was cut
off is taken up and leaves the same tables. Events go last, since they tell the rest. Projections and the history job don't run meanwhile.
A message that is delivered again after its event was erased is a new one.
"""

from __future__ import annotations

from contextlib import ExitStack
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators import dimension
from tideline.plans import keys, projection
from tideline.plans.tables import Tables
from tideline.session import join_path

#: Tables by the order in which they lose rows, with the columns that name a row's owner.
EVENT_TABLES = {name: ["event_date", "event_id"] for name in ("items", "orders", "facts")} | {keys.NAME: ["bucket", "event_id"]}
SUBJECT_TABLES = {name: ["tenant_id", "external_subject_id"] for name in projection.TABLE.values()}

LEDGER = "request string, table_name string, rows bigint, folders bigint, at timestamp"


def erase(tables: Tables, request: str, at: datetime, events: DataFrame | None = None, subjects: DataFrame | None = None, tenants: DataFrame | None = None) -> dict[str, int] | None:
    """Rows erased from each table; None where another job is at the tables.

    request names the erasure: one that was cut off goes on with what it found then, one that is done returns its counts and
    writes nothing. events: event_id. subjects: tenant_id, subject_type, external_subject_id. tenants: tenant_id, which stands for all of its
    events and subjects. Null ids name nothing; ids that aren't stored are passed over, repeated ones count once.
    """
    with ExitStack() as stack:
        for contextual in (False, True):
            if not stack.enter_context(tables.claim(projection.claim_name(contextual, 1))):
                return None
        ledger = tables.read_or_none("erasures")
        done = [] if ledger is None else ledger.where(F.col("request") == request).collect()
        if not done:
            done = _erase(tables, request, at, events, subjects, tenants)
        return {r["table_name"]: r["rows"] for r in done}


def _erase(tables: Tables, request: str, at: datetime, events, subjects, tenants) -> list:
    aside = join_path("_erasure", request)
    doomed = _kept_aside(tables, f"{aside}/events", lambda: _doomed(tables, "events", ["event_id"], events, tenants, ["event_date", "event_id"]))
    owned = _kept_aside(tables, f"{aside}/keys", lambda: _owned(tables, doomed))
    gone = _kept_aside(tables, f"{aside}/subjects", lambda: _doomed(tables, "subject_changes", dimension.KEY, subjects, tenants, ["bucket", *dimension.KEY]))
    people = None if gone is None else gone.where("subject_type = 'customer'").select("tenant_id", "external_subject_id").distinct()
    plan = [(name, owned if name == keys.NAME else doomed, on) for name, on in EVENT_TABLES.items()]
    plan += [("events", doomed, ["event_date", "event_id"])]
    plan += [(name, people, on) for name, on in SUBJECT_TABLES.items()]
    plan += [("subject_changes", gone, ["bucket", *dimension.KEY])]
    counts = [(request, name, *_remove(tables, f"{aside}/tables/{name}", name, rows, on), at) for name, rows, on in plan if rows is not None]
    noted = tables.spark.createDataFrame(counts, LEDGER)
    tables.write_batch("erasures", noted, request)
    tables.remove(aside)
    return noted.collect()


def _kept_aside(tables: Tables, path: str, rows) -> DataFrame | None:
    """Rows as a table written once. None for an empty one."""
    if not tables.exists(f"{path}/_SUCCESS"):
        found = rows()
        if found is None:
            return None
        found.write.mode("overwrite").parquet(tables.path(path))
    stored = tables.read(path)
    return None if stored.isEmpty() else stored


def _doomed(tables: Tables, name: str, key: list[str], rows: DataFrame | None, tenants: DataFrame | None, out: list[str]) -> DataFrame | None:
    """The stored rows that are named, or whose tenant is; of the stored columns only ids are read."""
    stored = tables.read_or_none(name)
    if stored is None:
        return None
    parts = [stored.join(asked.select(*on), on, "left_semi").select(*out) for asked, on in ((rows, key), (tenants, ["tenant_id"])) if asked is not None]
    return reduce(DataFrame.unionByName, parts).distinct() if parts else None


def _owned(tables: Tables, doomed: DataFrame | None) -> DataFrame | None:
    """(bucket, event_id) of the keys that doomed events and their facts own."""
    if doomed is None:
        return None
    on, facts = ["event_date", "event_id"], tables.read_or_none("facts")
    events = _near(tables.read("events"), doomed, on).join(doomed, on, "left_semi")
    if facts is None:
        rows = events.select("event_id", F.inline("unique_keys")).select("kind", "key", "event_id")
    else:
        rows = keys.owned(events, _near(facts, doomed, on).join(doomed, on, "left_semi"))
    return rows.select(tables.bucket(keys.KEY).alias("bucket"), "event_id").distinct()


def _near(stored: DataFrame, gone: DataFrame, on: list[str]) -> DataFrame:
    """The stored rows in folders of the days or buckets that occur: a partition filter of as many values."""
    if on[0] not in ("event_date", "bucket"):
        return stored
    return stored.where(F.col(on[0]).isin([r[0] for r in gone.select(on[0]).distinct().collect()]))


def _folders(tables: Tables, name: str) -> list[str]:
    """The partition columns of a table, outermost first, by the names of its first folders."""
    fs, path = tables._file(name)
    found = []
    while True:
        inner = [s for s in fs.listStatus(path) if s.isDirectory() and "=" in s.getPath().getName()]
        if not inner:
            return found
        found.append(inner[0].getPath().getName().partition("=")[0])
        path = inner[0].getPath()


def _remove(tables: Tables, aside: str, name: str, gone: DataFrame, on: list[str]) -> tuple[int, int]:
    """Rewrites the folders of a table that hold rows of gone; the numbers of rows and folders."""
    stored = tables.read_or_none(name)
    if not tables.exists(f"{aside}/kept/_SUCCESS"):
        if stored is None:
            return 0, 0
        folders = _folders(tables, name)
        near = _near(stored, gone, on)
        touched = near.join(gone, on, "left_semi").groupBy(*folders).agg(F.count(F.lit(1)).alias("_n"))
        touched.write.mode("overwrite").parquet(tables.path(f"{aside}/folders"))
        touched = tables.read(f"{aside}/folders").drop("_n")
        kept = near.join(touched, folders, "left_semi").join(gone, on, "left_anti")
        kept.write.mode("overwrite").parquet(tables.path(f"{aside}/kept"))
    touched, kept = tables.read(f"{aside}/folders"), tables.read(f"{aside}/kept")
    folders = [c for c in touched.columns if c != "_n"]
    total = touched.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("folders")).first()
    if total["rows"] == 0:
        return 0, 0
    if not kept.isEmpty():
        writer = kept.hint("rebalance", *folders).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*folders)
        writer.parquet(tables.path(name))
    # a folder that keeps no row isn't overwritten
    for r in touched.join(kept.select(*folders).distinct(), folders, "left_anti").toLocalIterator():
        tables.remove_folder(name, *[f"{c}={r[c]}" for c in folders])
    return total["rows"], total["folders"]
