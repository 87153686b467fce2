"""Whole jobs over tables in a scratch folder: ingest stream, projections, bootstrap, the two together."""

import json
import os
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tideline import schemas, vocab
from tideline.operators import dimension, registry, suggestions
from tideline.plans import bootstrap, projection
from tideline.plans.tables import Tables
from tideline.sources import dimensions, envelope
from tideline.streaming import jobs

UTC = timezone.utc
T0 = datetime(2026, 8, 10, 1, tzinfo=UTC)


@pytest.fixture
def tables(spark, tmp_path):
    return Tables(spark, str(tmp_path / "tables"))


def site_table(spark):
    rows = [("site-1", "tenant-1", "s1", "active", True, ["shop.example.com"], 1, 1.0, 1, "America/Argentina/Buenos_Aires")]
    return dimensions.valid_site(dimensions.site_defaults(spark.createDataFrame(rows, schemas.SITE)))


def message(event_id, name="subject_associated", subject="42", at=T0, received=None, **more):
    body = {
        "event_id": event_id, "event_source": "server", "site_code": "site-1", "env": "production", "event_name": name, "event_version": 1,
        "event_time": at.isoformat().replace("+00:00", "Z"), "received_at": (received or at).isoformat().replace("+00:00", "Z"),
        "properties": {"subjects": [{"subject_type": "customer", "subject_id": subject}]},
        "context": {"context_key": "checkout", "context_version": 1},
    }
    body.update(more)
    return {"stream_id": f"{event_id}-{body['received_at']}", "payload": json.dumps(body), "delivery_count": 1}


def drop(folder, name, messages):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(m) for m in messages))


def definitions(spark):
    rows = [(1, 1, "rev-1", [("checkout", 1, "transaction", None, None, "active")])]
    return registry.entries(spark.createDataFrame(rows, schemas.REGISTRY))


def run_stream(spark, tables, folder):
    messages = jobs.read_messages(spark, str(folder))
    query = jobs.start(messages, tables, site_table(spark), [], definitions(spark), "rev-1", available_now=True)
    query.awaitTermination()


def test_every_message_becomes_an_event_or_a_dead_letter(spark):
    good, bad = json.loads(json.dumps(message("e1"))), {"stream_id": "x", "payload": "{"}
    rows = [(good["stream_id"], good["payload"], n) for n in (None, 1, 99)] + [(bad["stream_id"], bad["payload"], n) for n in (None, 1)] + [(None, None, None)]
    decoded = envelope.decode_messages(spark.createDataFrame(rows, jobs.MESSAGE))
    dead = envelope.dead_letters(decoded).count()
    alive = decoded.where(~envelope.is_dead()).count()
    assert (alive, dead) == (2, 4)


def test_the_first_of_two_equal_changes_counts(spark):
    def change(event_id, name, received):
        at = T0 - timedelta(days=1)
        return ("tenant-1", "customer", "7", event_id, 0, name, received, at, "m1", None, None, "unknown", "normalized")

    columns = "tenant_id string, subject_type string, external_subject_id string, event_id string, subject_ordinal int, event_name string, received_at timestamp, lifecycle_source_updated_at timestamp, lifecycle_source_mutation_id string, lifecycle_effective_at timestamp, merged_into_external_subject_id string, initial_status string, normalization_status string"
    rows = [change("b", "subject_deactivated", T0), change("a", "subject_reactivated", T0), change("0", "subject_deactivated", T0 + timedelta(seconds=1))]
    df = spark.createDataFrame(rows, columns)
    assert [r.lifecycle_status for r in dimension.fold(dimension.changes_from_events(df)).collect()] == ["active"]
    late = dimension.fold(dimension.changes_from_events(df.where("event_id = '0'")))
    first = dimension.fold(dimension.changes_from_events(df.where("event_id <> '0'")))
    assert [r.lifecycle_status for r in dimension.merge(late, first).collect()] == ["active"]


def test_stream_batches_replay_and_projection(spark, tables, tmp_path):
    folder = tmp_path / "in"
    changed = {"subjects": [{"subject_type": "customer", "subject_id": "43"}]}
    drop(folder, "1.json", [message("e1", idempotency_key="k1"), message("e1", received=T0 + timedelta(minutes=1)), {"stream_id": "x", "payload": "{", "delivery_count": 1}])
    run_stream(spark, tables, folder)
    drop(folder, "2.json", [
        message("e1", received=T0 + timedelta(hours=2), idempotency_key="k1"),
        message("e2", received=T0 + timedelta(hours=3), idempotency_key="k1"),
        message("e1", received=T0 + timedelta(hours=30), idempotency_key="k1"),
        message("e3", received=T0 + timedelta(hours=31), idempotency_key="k1", properties=changed),
        message("e4", received=T0 + timedelta(hours=32)),
    ])
    run_stream(spark, tables, folder)

    def stored():
        return {name: sorted(map(str, tables.read(name).select(*cols).collect())) for name, cols in (
            ("events", ["event_id"]), ("rejected", ["event_id", "reason"]), ("dead_letters", ["stream_id", "reason"]), ("facts", ["event_id", "normalization_status"]))}

    first = stored()
    assert [r.event_id for r in tables.read("events").orderBy("event_id").collect()] == ["e1", "e4"]
    reasons = sorted((r.event_id, r.reason) for r in tables.read("rejected").collect())
    # e1 again within a day, e2 by its key; a day later e1 is a known repeat and renews its keys, so e3 is a repeat too.
    assert reasons == [("e1", "duplicate_event"), ("e1", "duplicate_event"), ("e2", "duplicate_logical_event"), ("e3", "duplicate_logical_event")]
    assert tables.read("dead_letters").count() == 1

    # The second batch once more, as after a crash: the same tables.
    again = spark.read.schema(jobs.MESSAGE).json(str(folder / "2.json"))
    jobs.process_batch(tables, again, 1, site_table(spark), [], definitions(spark), "rev-1")
    assert stored() == first

    subjects = jobs.subjects(tables)
    assert [(r.external_subject_id, r.lifecycle_status) for r in subjects.collect()] == [("42", "active")]
    facts = tables.read("facts")
    now = T0 + timedelta(days=2)
    assert [c["rows_written"] for c in projection.run_all(tables, facts, subjects, now)] == [1, 1]
    env, rows = suggestions.suggest(
        suggestions.SuggestionQuery("tenant-1", context_key="checkout", context_version=1),
        projection.read_daily(tables, False), projection.read_daily(tables, True), subjects, definitions(spark),
        tables.read("projection_runs"), now,
    )
    assert env["source_level"] == "context" and not env["is_stale"]
    assert [(r.external_subject_id, r.association_count, r.source_level) for r in rows.collect()] == [("42", 2, "context")]


def fact(row_id, updated, at=T0, day="2026-08-09", subject="s", name="subject_associated", status="normalized"):
    return (
        "t", "customer", subject, datetime.strptime(day, "%Y-%m-%d").date(), "UTC", name, at, updated, row_id, status, "registered", "k", 1,
    )


FACT = (
    "tenant_id string, subject_type string, external_subject_id string, local_date date, timezone_name string, event_name string,"
    " event_time timestamp, updated_at timestamp, row_id string, normalization_status string, context_resolution_status string,"
    " context_key string, context_version int"
)


def known(spark, *ids):
    return spark.createDataFrame([("t", "customer", i, "active") for i in ids], "tenant_id string, subject_type string, external_subject_id string, lifecycle_status string")


def counts(tables):
    return {(r.external_subject_id, str(r.local_date)): r.association_count for r in projection.read_daily(tables, False).collect()}


def test_late_facts_are_recounted_not_added(spark, tables):
    rows = [fact("1", T0), fact("2", T0, subject="other", day="2026-08-01")]
    subjects = known(spark, "s", "other")

    def run(hours):
        return projection.run(tables, spark.createDataFrame(rows, FACT), subjects, False, T0 + timedelta(hours=hours))

    run(1)
    assert run(2) == dict(affected_days=0, rows_read=0, rows_written=0)
    rows.append(fact("3", T0 + timedelta(hours=3), at=T0 - timedelta(hours=48)))
    assert run(4) == dict(affected_days=1, rows_read=1, rows_written=1)
    assert counts(tables) == {("s", "2026-08-09"): 2, ("other", "2026-08-01"): 1}
    states = [r.status for r in tables.read("projection_runs").collect()]
    assert states.count("completed") == 3 and states.count("running") == 3
    # A day that loses its last signal disappears; the others stay.
    rows[:] = [fact("1", T0 + timedelta(hours=5), name="page_view"), fact("2", T0, subject="other", day="2026-08-01")]
    run(6)
    assert counts(tables) == {("other", "2026-08-01"): 1}


def test_failed_and_due_runs(spark, tables):
    subjects = known(spark, "s")
    facts = spark.createDataFrame([fact("1", T0)], FACT)
    broken = facts.withColumn("row_id", F.raise_error(F.lit("x" * 3000)))
    with pytest.raises(Exception):
        projection.run(tables, broken, subjects, False, T0)
    last = tables.read("projection_runs").where("status = 'failed'").first()
    assert len(last.last_error) == 1000
    assert projection.run_due(tables, facts, subjects, T0 + timedelta(hours=1)) == [vocab.CONTEXT_PROJECTION, vocab.GLOBAL_PROJECTION]
    assert projection.run_due(tables, facts, subjects, T0 + timedelta(hours=24)) == []
    assert len(projection.run_due(tables, facts, subjects, T0 + timedelta(hours=25))) == 2


def page(folder, name, revision, ids, cursor=None, status="active"):
    folder.mkdir(exist_ok=True)
    subjects = [
        {"tenant_id": "t", "external_subject_id": i, "lifecycle_status": status, "source_updated_at": "2026-08-01T00:00:00Z", "source_mutation_id": "m", "merged_into_external_subject_id": "x" if status == "merged" else None}
        for i in ids
    ]
    document = {"subject_type": "customer", "source_revision": revision, "next_cursor": cursor, "has_more": cursor is not None, "subjects": subjects}
    (folder / name).write_text(json.dumps(document))


def test_bootstrap_resumes_and_finishes_once(spark, tables, tmp_path):
    folder = tmp_path / "pages"
    page(folder, "1.json", "r1", ["1", "2"], "c1")
    page(folder, "2.json", "r1", ["3"], None, "merged")
    (folder / "3.json").write_text('{"subject_type":"account","source_revision":"r1","has_more":false,"subjects":[]}')
    for i, f in enumerate(sorted(folder.iterdir())):  # pages are taken by the time of their files
        os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
    with pytest.raises(Exception):
        bootstrap.run(tables, str(folder), T0, pages_per_batch=1)
    state = bootstrap.state(tables)
    assert state["status"] == "failed" and state["processed_count"] in (2, 3)
    # The broken page is repaired; the load goes on from where it stopped.
    page(folder, "3.json", "r1", ["4"])
    done = bootstrap.run(tables, str(folder), T0 + timedelta(minutes=1), pages_per_batch=1)
    assert (done["status"], done["processed_count"]) == ("completed", 4)
    assert bootstrap.run(tables, str(folder), T0 + timedelta(minutes=2)) is None
    found = {r.external_subject_id: r.lifecycle_status for r in jobs.subjects(tables).collect()}
    assert found == {"1": "active", "2": "active", "3": "merged", "4": "active", "x": "unknown"}


def test_bootstrap_of_an_expired_revision(spark, tables, tmp_path):
    folder = tmp_path / "pages"
    page(folder, "1.json", "r1", ["1"], "c1")
    bootstrap_now = T0
    page(folder, "2.json", "r2", ["2"])
    with pytest.raises(bootstrap.SnapshotExpired):
        bootstrap.run(tables, str(folder), bootstrap_now, pages_per_batch=1)
    with pytest.raises(bootstrap.SnapshotExpired):
        bootstrap.run(tables, str(folder), T0 + timedelta(minutes=1))
    anew = tmp_path / "anew"
    page(anew, "1.json", "r2", ["1", "2"])
    assert bootstrap.run(tables, str(anew), T0 + timedelta(minutes=2), force=True)["processed_count"] == 2


def test_forced_restart_closes_the_open_run(spark, tables):
    bootstrap.begin_or_resume(tables, T0)
    bootstrap.begin_or_resume(tables, T0 + timedelta(minutes=1), force=True)
    causes = [r.last_error for r in tables.read("bootstrap_runs").collect()]
    assert causes.count("replaced_by_operator") == 1


@pytest.mark.parametrize("key", ["event_id", "idempotency_key"])
def test_repeats_in_a_stream(spark, tmp_path, key):
    """Late rows stay, live marks block in either direction, rows without a key pass, payloads come through."""
    folder = tmp_path / "in"
    folder.mkdir()
    files = [
        [("a", T0), ("a", T0 + timedelta(hours=1)), ("b", T0 + timedelta(days=9)), ("", T0), ("", T0)],
        [("c", T0 - timedelta(days=30)), ("a", T0 + timedelta(hours=30)), ("b", T0 + timedelta(days=8, hours=23)), ("a", T0 - timedelta(hours=1))],
    ]
    for i, rows in enumerate(files):
        path = folder / f"{i}.json"
        path.write_text("\n".join(json.dumps({key: k, "received_at": t.isoformat(), "properties": '{"n": 1}'}) for k, t in rows))
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    events = spark.readStream.schema(f"{key} string, received_at timestamp, properties string").option("maxFilesPerTrigger", "1").json(str(folder))
    events = events.withColumn("properties", F.parse_json("properties"))
    kept = jobs.drop_repeats(events, key).withColumn("n", F.try_variant_get("properties", "$.n", "int")).drop("properties")
    name = f"kept_{key}"
    # states that can time out ask for another batch for ever, so a run over what is there must not make empty ones
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    query = kept.writeStream.format("memory").queryName(name).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "checkpoint")).start()
    query.awaitTermination()
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    got = sorted((r[key], r.received_at.replace(tzinfo=UTC), r.n) for r in spark.table(name).collect())
    expect = [("", T0), ("", T0), ("a", T0), ("a", T0 + timedelta(hours=30)), ("b", T0 + timedelta(days=9)), ("c", T0 - timedelta(days=30))]
    assert got == [(k, t, 1) for k, t in sorted(expect)]


def test_merged_dimension_equals_one_fold(spark):
    rows = [(f"s{i % 3}", T0 + timedelta(seconds=i * 7 % 5), f"m{i}", "active" if i % 2 else "inactive") for i in range(12)]
    df = spark.createDataFrame([("t", s, status, t, m, None) for s, t, m, status in rows],
                               "tenant_id string, external_subject_id string, lifecycle_status string, source_updated_at timestamp, source_mutation_id string, merged_into_external_subject_id string")
    whole = dimension.fold(dimension.changes_from_snapshot(df))
    halves = [dimension.fold(dimension.changes_from_snapshot(df.where(f"hash(source_mutation_id) % 2 {op} 0"))) for op in ("=", "<>")]
    assert sorted(map(str, whole.collect())) == sorted(map(str, dimension.merge(*halves).collect()))
