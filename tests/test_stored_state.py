"""What stored tables hold between jobs: keys, the registry, resolved history, claims."""

from datetime import timedelta, timezone

import pytest
from pyspark.sql import functions as F
from test_jobs import T0, message, site_table

from tideline import schemas
from tideline.operators import dimension
from tideline.plans import erasure, history, keys, projection
from tideline.plans.registry_store import RegistryStore
from tideline.plans.tables import Tables
from tideline.sources import changes
from tideline.streaming import jobs


@pytest.fixture
def tables(spark, tmp_path):
    return Tables(spark, str(tmp_path / "tables"), buckets=4)


def batch(spark, tables, number, messages, registry=(None, None)):
    rows = spark.createDataFrame([tuple(m[c] for c in ("stream_id", "payload", "delivery_count")) for m in messages], jobs.MESSAGE)
    jobs.process_batch(tables, rows, number, site_table(spark), [], *registry)


def document(spark, version, revision, *contexts):
    rows = [(k, v, family, None, None, status) for k, v, family, status in contexts]
    return spark.createDataFrame([(1, version, revision, rows)], schemas.REGISTRY)


def stored(tables, name, *columns):
    return sorted(tuple(r) for r in tables.read(name).select(*columns).collect())


def plan(df):
    return df._jdf.queryExecution().toString()


def test_a_second_batch_asks_keys_and_no_history(spark, tables, monkeypatch):
    batch(spark, tables, 0, [message("e1", idempotency_key="k1"), message("e2")])
    assert {r["kind"] for r in tables.read(keys.NAME).collect()} == {"exact", "idempotency", keys.SUBJECT}
    read = []
    whole = Tables.read
    monkeypatch.setattr(Tables, "read", lambda self, name: read.append(name) or whole(self, name))
    batch(spark, tables, 1, [message("e3", received=T0 + timedelta(hours=30), idempotency_key="k1"), message("e4", subject="43")])
    assert set(read) <= {"marks", keys.NAME, "subject_changes"}
    monkeypatch.undo()
    # the tenant's key of the subject is taken, so e3 would repeat e1's fact; it is a conflict of the event's key already
    assert [e for (e,) in stored(tables, "events", "event_id")] == ["e1", "e2", "e4"]
    asked = spark.createDataFrame([("exact", "e1"), ("exact", "none")], "kind string, key string")
    found = keys.lookup(tables, asked)
    assert [tuple(r)[:3] for r in found.collect()] == [("exact", "e1", "e1")]
    scan = next(line for line in plan(found).splitlines() if "PartitionFilters" in line and "bucket" in line)
    assert "bucket" in scan.split("PartitionFilters:")[1].split("]")[0]
    assert keys.lookup(tables, asked, "b000000000000").count() == 0


def test_subject_keys_of_earlier_batches_count(spark, tables):
    batch(spark, tables, 0, [message("e1", idempotency_key="k1")])
    fact = tables.read("facts")
    asked = fact.select(F.lit(keys.SUBJECT).alias("kind"), keys.subject_key().alias("key"))
    again = dimension.flag_idempotency(fact, keys.owned_facts(fact, keys.lookup(tables, asked)))
    assert [(r.normalization_status, r.idempotency_key) for r in again.collect()] == [("idempotency_conflict", None)]
    assert [r.normalization_status for r in dimension.flag_idempotency(fact, fact.where("false").select(*dimension.SUBJECT_KEY)).collect()] == ["normalized"]


def test_change_scan_starts_at_the_checkpoints_day(spark, tables):
    days = [T0 + timedelta(days=d) for d in range(3)]
    for i, at in enumerate(days):
        batch(spark, tables, i, [message(f"e{i}", at=at)])
    found = changes.changed_rows(tables.read("facts"), days[1], "")
    assert "ingest_date" in plan(found).split("PartitionFilters: [")[1].split("]")[0]
    assert sorted(r.event_id for r in found.collect()) == ["e1", "e2"]
    assert sorted(r.event_id for r in changes.changed_rows(tables.read("facts"), days[1], "e1#000000").collect()) == ["e2"]


CHECKOUT = ("checkout", 1, "transaction", "active")


def test_registry_tables(spark, tables):
    store = RegistryStore(tables)
    assert store.active() == (None, None)
    assert store.refresh(None, T0) == "source_error"
    assert store.refresh(document(spark, 1, "rev-1", CHECKOUT), T0) == "loaded"
    assert store.refresh(document(spark, 2, "rev-2", CHECKOUT, CHECKOUT), T0) == "invalid"
    assert store.refresh(document(spark, 1, "rev-0", CHECKOUT), T0) == "rejected"
    assert store.active()[1] == "rev-1"
    states = {r["registry_revision"]: r["status"] for r in store.load()[0].collect()}
    assert states == {"rev-1": "valid", "rev-2": "invalid"}
    # the tables of a publication that was cut off are not looked at
    tables.replace("registry_definitions", store.load()[1].where("false"), 9)
    assert [r["context_key"] for r in store.active()[0].collect()] == ["checkout"]
    with tables.claim("registry"):
        assert store.refresh(document(spark, 3, "rev-3", CHECKOUT), T0) == "locked"
    assert store.refresh(document(spark, 3, "rev-3", ("checkout", 1, "transaction", "inactive")), T0 + timedelta(hours=1)) == "loaded"
    definitions, revision = store.active()
    assert revision == "rev-3" and [r["status"] for r in definitions.collect()] == ["inactive"]


def test_history_is_resolved_once_even_after_a_crash(spark, tables, monkeypatch):
    store, later = RegistryStore(tables), T0 + timedelta(days=2)
    other = {"context_key": "elsewhere", "context_version": 1}
    batch(spark, tables, 0, [message("e1"), message("e2", context=other)])
    assert history.resolve(tables, later) == 0
    store.refresh(document(spark, 1, "rev-1", CHECKOUT), T0)
    batch(spark, tables, 1, [message("e3", at=T0 + timedelta(days=1)), message("e4", context=other)], store.active())
    before = {r["event_id"]: r["context_resolution_status"] for r in tables.read("facts").collect()}
    assert before == {"e1": "registry_disabled", "e2": "registry_disabled", "e3": "registered", "e4": "unregistered"}

    done = history._without
    monkeypatch.setattr(history, "_without", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        history.resolve(tables, later)
    monkeypatch.setattr(history, "_without", done)
    assert history.resolve(tables, later + timedelta(days=1)) == 2
    assert history.resolve(tables, later + timedelta(days=1)) == 0

    found = stored(tables, "facts", "event_id", "context_resolution_status", "context_registry_revision", "updated_at")
    assert [(e, s, r) for e, s, r, _ in found] == [
        ("e1", "registered", "rev-1"), ("e2", "unregistered", "rev-1"), ("e3", "registered", "rev-1"), ("e4", "unregistered", "rev-1")
    ]
    moved = tables.read("facts").where("batch_id like 'history%'").select(F.to_date("updated_at").alias("d"), "ingest_date").distinct().collect()
    assert [(str(r.d), str(r.ingest_date)) for r in moved] == [(str(later.astimezone(timezone.utc).date()),) * 2]
    counters = {r["context_key"]: (r["event_count"], r["claimed_context_family"]) for r in history.unregistered_contexts(tables).collect()}
    assert counters == {"elsewhere": (2, None)}
    # a replayed batch replaces its own part of the counters
    batch(spark, tables, 1, [message("e3", at=T0 + timedelta(days=1)), message("e4", context=other)], store.active())
    assert history.unregistered_contexts(tables).first()["event_count"] == 2


def test_history_and_projections_keep_out_of_each_others_way(spark, tables):
    batch(spark, tables, 0, [message("e1")])
    RegistryStore(tables).refresh(document(spark, 1, "rev-1", CHECKOUT), T0)
    subjects = jobs.subjects(tables)
    with tables.claim(projection.claim_name(False, 1)) as first:
        assert first
        assert history.resolve(tables, T0) is None
        projection.run(tables, tables.read("facts"), subjects, False, T0 + timedelta(hours=1))
    skipped = tables.read("projection_runs").collect()
    assert [(r["status"], r["completed_at"] is not None) for r in skipped] == [("skipped_locked", True)]
    assert history.resolve(tables, T0 + timedelta(days=1)) == 1
    assert [c["rows_written"] for c in projection.run_all(tables, tables.read("facts"), subjects, T0 + timedelta(days=2))] == [1, 1]


def test_a_lapsed_claim_is_taken_over(tables):
    with tables.claim("x", timedelta(seconds=-1)) as lost:
        with tables.claim("x") as taken, tables.claim("x") as third:
            assert (lost, taken, third) == (True, True, False)
        with tables.claim("x") as free:
            assert free


def filled(spark, tables):
    """Three events of two subjects, projected."""
    batch(spark, tables, 0, [message("e1", idempotency_key="k1"), message("e2", subject="43", at=T0 + timedelta(days=1))])
    batch(spark, tables, 1, [message("e3", subject="43", at=T0 + timedelta(days=1), received=T0 + timedelta(days=2))])
    projection.run_all(tables, tables.read("facts"), jobs.subjects(tables), T0 + timedelta(days=3))


def rows_of(tables):
    names = {"events": "event_id", "facts": "event_id", "keys": "event_id", "subject_changes": "external_subject_id", "global_daily": "external_subject_id"}
    out = {}
    for name, column in names.items():
        found = tables.read_or_none(name)
        out[name] = set() if found is None else {r[0] for r in found.select(column).collect()}
    return out


@pytest.mark.parametrize("cut_off", [None, "facts", "global_daily"])
def test_erasure_takes_all_that_hangs_on_an_event(spark, tables, monkeypatch, cut_off):
    filled(spark, tables)
    ids = spark.createDataFrame([("e2",), ("e2",), ("none",), (None,)], "event_id string")
    people = tables.read("subject_changes").where("external_subject_id = '42'").select(*dimension.KEY)
    if cut_off:
        done = Tables.remove

        def lost(self, *parts):
            if parts[0] == cut_off:
                raise RuntimeError("lost")
            return done(self, *parts)

        monkeypatch.setattr(Tables, "remove", lost)
        with pytest.raises(RuntimeError):
            erasure.erase(tables, "r1", T0, ids, people)
        monkeypatch.setattr(Tables, "remove", done)
    counts = erasure.erase(tables, "r1", T0, ids, people)
    assert rows_of(tables) == {
        "events": {"e1", "e3"}, "facts": {"e1", "e3"}, "keys": {"e1", "e3"}, "subject_changes": {"43"}, "global_daily": {"43"}
    }
    assert (counts["events"], counts["facts"], counts["global_daily"], counts["subject_changes"]) == (1, 1, 1, 1)
    assert not tables.exists("_erasure/r1")
    before = stored(tables, "events", "event_id", "event_date", "batch_id")
    assert erasure.erase(tables, "r1", T0, ids, people) == counts
    assert stored(tables, "events", "event_id", "event_date", "batch_id") == before


def test_erasure_of_a_tenant_and_of_nothing(spark, tables):
    filled(spark, tables)
    tenant = tables.read("events").select("tenant_id").distinct()
    nobody = spark.createDataFrame([("x",), (None,)], "tenant_id string")
    assert sum(erasure.erase(tables, "r0", T0, tenants=nobody).values()) == 0
    assert erasure.erase(tables, "r1", T0) == {}
    with tables.claim(projection.claim_name(True, 1)):
        assert erasure.erase(tables, "r2", T0, tenants=tenant) is None
    counts = erasure.erase(tables, "r2", T0, tenants=tenant)
    assert (counts["events"], counts["facts"], counts["subject_changes"]) == (3, 3, 3)  # one subject is told of in both batches
    assert not any(rows_of(tables).values())
    # what was erased may come again
    batch(spark, tables, 2, [message("e1", idempotency_key="k1", received=T0 + timedelta(days=9))])
    assert rows_of(tables)["events"] == {"e1"}
