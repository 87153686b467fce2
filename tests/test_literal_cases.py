"""Literal cases: decoding, checks, items, subjects, lifecycle, registry, ranking."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tideline import schemas
from tideline.functions import net, payload as pl, zones
from tideline.operators import (
    client, dedup, dimension, items, projections, registry, subjects, suggestions, validation,
)
from tideline.sources import dimensions, envelope

UTC = timezone.utc
T0 = datetime(2026, 8, 10, 1, tzinfo=UTC)


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def jsons(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "j string").withColumn("v", F.try_parse_json("j"))


def event(spark, properties, name="subject_viewed", context="{}", tz="America/Argentina/Buenos_Aires", source="web", at=T0):
    df = spark.createDataFrame(
        [("e1", "", "", "t", "s", source, name, at, at, "sess", "u", tz, properties, context)],
        "event_id string, logical_event_id string, idempotency_key string, tenant_id string, site_id string, event_source string,"
        " event_name string, event_time timestamp, received_at timestamp, session_id string, user_id string, timezone string,"
        " properties string, context string",
    )
    parsed = df.withColumns({"properties": F.parse_json("properties"), "context": F.parse_json("context")})
    return zones.with_zone(parsed)


# --- decoding --------------------------------------------------------------------------------


def test_public_event_aliases_and_extras(spark):
    body = (
        '{"event_id":"1","event_type":"page_view","page_url":"https://x/y","timestamp":"2026-01-01T00:00:00Z","origin":"https://body",'
        '"metadata":{"source":"meta"},"properties":{"source":"sdk"},"raw":{"a":1},"items":[1],"consent":{"c":true},"app":"web"}'
    )
    df = spark.createDataFrame([(body,)], "body string")
    row = one(envelope.normalize_public(envelope.split_public(df)).select(
        "event_name", "url", F.to_json("properties").alias("p"), F.to_json("context").alias("c"), "event_time"))
    assert (row.event_name, row.url) == ("page_view", "https://x/y")
    assert row.p == '{"items":[1],"raw":{"a":1},"source":"sdk"}'
    assert row.c == '{"app":"web","consent":{"c":true}}'


def test_duplicate_json_keys_keep_the_last(spark):
    assert one(jsons(spark, '{"a":1,"a":2}').select(F.to_json("v").alias("t"))).t == '{"a":2}'


def test_message_without_payload_and_bad_json(spark):
    df = spark.createDataFrame(
        [("1", None, 1), ("2", "{bad", 1), ("3", "[]", 1), ("4", '{"event_id":"x"}', 5), ("5", '{"event_id":"x","sequence":1.5}', 1)],
        "stream_id string, payload string, delivery_count int",
    )
    dead = envelope.dead_letters(envelope.decode_messages(df)).orderBy("stream_id").collect()
    assert [(r.stream_id, r.reason) for r in dead] == [
        ("1", "invalid_stream_payload"), ("2", "invalid_stream_payload"), ("3", "invalid_stream_payload"),
        ("4", "stream_retry_exhausted"), ("5", "invalid_stream_payload"),
    ]


def server_request(spark, **changes):
    import json

    base = {
        "event_id": "e", "event_name": "subject_associated", "event_version": 1, "timestamp": "2026-08-10T00:00:00Z",
        "site_code": "s", "idempotency_key": "k", "properties": {"subjects": [{"subject_type": "customer", "subject_id": "1"}]},
    }
    base.update(changes)
    body = json.dumps({k: v for k, v in base.items() if v is not None})
    df = spark.createDataFrame([("r", body)], "request_id string, body string")
    return one(validation.accept_server_batches(envelope.decode_server(df)).select("strict_ok", "event_ok", "batch_ok"))


def test_server_event_rules(spark):
    assert server_request(spark).batch_ok
    subject = {"subject_type": "customer", "subject_id": "1"}
    life = {"source_updated_at": "2026-08-10T00:00:00Z", "source_mutation_id": "m"}
    bad = [
        {"event_name": "subject_renamed"},
        {"properties": {"subjects": [{**subject, "subject_type": "account"}]}},
        {"idempotency_key": None},
        {"timestamp": "2026-08-10T00:00:00-03:00"},
        {"properties": {"subjects": []}},
        {"properties": {"subjects": [subject], "lifecycle": life}},
        {"event_name": "subject_merged", "properties": {"subjects": [subject], "lifecycle": life}},
        {"event_name": "subject_deactivated", "properties": {"subjects": [subject], "lifecycle": {**life, "merged_into_subject_id": "2"}}},
        {"properties": {"subjects": [subject] * 101}},
        {"properties": {"subjects": [{**subject, "subject_id": "x" * 256}]}},
    ]
    for changes in bad:
        row = server_request(spark, **changes)
        assert row.strict_ok and not row.batch_ok, changes
    assert server_request(spark, event_name="subject_merged", properties={"subjects": [subject], "lifecycle": {**life, "merged_into_subject_id": "2"}}).batch_ok
    assert not server_request(spark, surprise=1).strict_ok
    assert not server_request(spark, properties={"subjects": [{**subject, "age": 3}]}).strict_ok


# --- payload safety --------------------------------------------------------------------------


def test_blocked_keys_and_depth(spark):
    cases = {
        '{"a":{"Password":1}}': "Password", '{"a":[{" cvv ":1}]}': " cvv ", '{"a":"password"}': "",
        '{"a":"x,\\"password\\":1"}': "", '{"passwords":1}': "", '{"\\u0074oken":1}': "token",
    }
    got = {r.j: r.k for r in jsons(spark, *cases).select("j", pl.blocked_key(F.to_json("v")).alias("k")).collect()}
    assert got == cases
    depths = {"{}": 1, '{"a":1}': 2, '{"a":{}}': 2, '{"a":{"b":[1,{"c":"x{[\\"y"}]}}': 5, '{"a":[true,null]}': 3, '{"a":"' + "[" * 99 + '"}': 2}
    got = {r.j: r.d for r in jsons(spark, *depths).select("j", pl.depth(F.to_json("v")).alias("d")).collect()}
    assert got == depths


def test_payload_limits(spark):
    deep = '{"a":' * 16 + "1" + "}" * 16
    fits = '{"a":' * 15 + "1" + "}" * 15
    long = '{"a":"' + "x" * 65529 + '"}'
    edge = '{"a":"' + "x" * 65528 + '"}'
    escaped = '{"a":"' + "<" * 11000 + '"}'
    rows = jsons(spark, deep, fits, long, edge, escaped).select(pl.limit_issue(F.to_json("v"), "p").alias("i")).collect()
    assert [r.i for r in rows] == ["p_depth", None, "p_size", None, "p_size"]


# --- sites -----------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "origin, allowed, expected",
    [
        ("http://127.0.0.1:5173", "127.0.0.1:5173", True), ("https://shop.example.com", "shop.example.com", True),
        ("https://www.shop.example.com", "shop.example.com", True), ("https://shop.example.com", "www.shop.example.com", True),
        ("http://127.0.0.1:5174", "127.0.0.1:5173", False), ("https://a.shop.example.com", "shop.example.com", False),
        ("shop.example.com", "https://SHOP.example.com.", True), ("shop.example.com/x", "shop.example.com", False), ("", "x", False),
        ("127.0.0.1:5173", "http://127.0.0.1:5173", True),
    ],
)
def test_origins(spark, origin, allowed, expected):
    df = spark.createDataFrame([(origin, [allowed])], "o string, a array<string>")
    assert one(df.select(net.allows_origin(F.col("a"), F.col("o")).alias("x"))).x is expected


def test_ip_hash(spark):
    import hashlib

    df = spark.createDataFrame(
        [(" 1.1.1.1 , 2.2.2.2", "3.3.3.3", "4.4.4.4:5"), ("", "3.3.3.3", "x"), (None, None, "[::1]:80"), (None, "", "")],
        "f string, r string, p string",
    )
    got = [r.h for r in df.select(net.ip_hash(F.col("f"), F.col("r"), F.col("p")).alias("h")).collect()]
    assert got == [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in ("1.1.1.1", "3.3.3.3", "::1", "")]


# --- items -----------------------------------------------------------------------------------


def test_item_row_coercions(spark):
    text = '{"item":{"item_id":100,"variant_id":"101","category_ids":["1",2],"position":3,"unit_price":"1200.50"}}'
    row = one(items.item_rows(event(spark, text, "item_viewed")))
    assert (row.item_id, row.variant_id, row.category_ids, row.position, str(row.unit_price)) == ("100", "101", ["1", "2"], 3, "1200.5000")


def test_checkout_lines_and_null_member_hides_header(spark):
    text = '{"sku":"h","items":[{"item_id":"a","quantity":2},"skip",{"item_id":"b","quantity":1,"sku":null}]}'
    rows = items.item_rows(event(spark, text, "checkout_started")).orderBy("item_id").collect()
    assert [(r.item_id, float(r.quantity), r.sku) for r in rows] == [("a", 2.0, "h"), ("b", 1.0, "")]


def test_item_completeness(spark):
    row = one(items.item_rows(event(spark, '{"item_id":"1","surface":"s","visible_ratio":0.5,"visible_time_ms":10}', "item_impression")))
    assert row.missing_fields == ["list_instance_id"] and row.incomplete_for_scoring
    assert row.metadata == '{"incomplete_for_scoring":true,"missing_fields":["list_instance_id"]}'
    row = one(items.item_rows(event(spark, '{"order_id":"o","items":[{"item_id":"1"}]}', "purchase_completed")))
    assert row.missing_fields == ["order_line_id"]
    assert items.item_rows(event(spark, '{"item_id":"1"}', "page_view")).count() == 0


def test_order_header(spark):
    row = one(items.order_rows(event(spark, '{"order":{"subtotal_amount":1000,"net_amount":"900"},"net_amount":1}', "purchase_completed")))
    assert (float(row.subtotal_amount), float(row.net_amount)) == (1000.0, 900.0)


# --- subjects --------------------------------------------------------------------------------


def test_subjects_repeat_and_local_date(spark):
    text = (
        '{"subjects":[{"subject_type":"customer","subject_id":"1","relation":"r"},{"subject_type":"customer","subject_id":" 1 ","relation":"r"},'
        '{"subject_type":"customer","subject_id":"2"}]}'
    )
    rows = subjects.subject_rows(event(spark, text)).orderBy("subject_ordinal").collect()
    assert [(r.subject_ordinal, str(r.local_date), r.normalization_status) for r in rows] == [
        (0, "2026-08-09", "normalized"), (2, "2026-08-09", "normalized")]


def test_subject_flaws(spark):
    rows = subjects.subject_rows(event(spark, '{"subjects":["text",{"subject_type":"account","subject_id":"1"}]}')).orderBy("subject_ordinal").collect()
    assert [r.normalization_status for r in rows] == ["invalid_subject", "unsupported_subject_type"]
    row = one(subjects.subject_rows(event(spark, '{"subjects":[{"subject_type":"customer","subject_id":"1"}]}', tz="")))
    assert (row.normalization_status, row.local_date) == ("timezone_unresolved", None)
    assert subjects.subject_rows(event(spark, "{}")).count() == 0


def merge_text(target):
    return (
        '{"subjects":[{"subject_type":"customer","subject_id":"1"}],"lifecycle":{"source_updated_at":"2026-08-10T00:00:00Z",'
        f'"source_mutation_id":"m1","merged_into_subject_id":"{target}"}}}}'
    )


def test_merge_into_itself(spark):
    assert one(subjects.subject_rows(event(spark, merge_text("2"), "subject_merged"))).normalization_status == "normalized"
    assert one(subjects.subject_rows(event(spark, merge_text("1"), "subject_merged"))).normalization_reason == "invalid_lifecycle"


def test_daylight_saving_dates(spark):
    df = spark.createDataFrame(
        [(datetime(2024, 3, 31, 0, 30, tzinfo=UTC),), (datetime(2024, 3, 31, 22, 30, tzinfo=UTC),), (datetime(2024, 10, 27, 22, 30, tzinfo=UTC),)],
        "t timestamp",
    )
    got = [str(r.d) for r in df.select(zones.local_date(F.col("t"), F.lit("Europe/Madrid")).alias("d")).collect()]
    assert got == ["2024-03-31", "2024-04-01", "2024-10-27"]


def test_lifecycle_sequence(spark):
    t = datetime(2026, 8, 1, tzinfo=UTC)
    steps = [
        ("subject_deactivated", t, "mutation-20", None), ("subject_reactivated", t - timedelta(seconds=1), "mutation-99", None),
        ("subject_reactivated", t, "mutation-21", None), ("subject_merged", t + timedelta(seconds=1), "mutation-01", "customer-target"),
    ]
    rows = spark.createDataFrame(
        [(f"e{i}", 0, "t", "customer", "c", n, t + timedelta(minutes=i), at, m, None, target, "unknown", "normalized", None)
         for i, (n, at, m, target) in enumerate(steps)],
        "event_id string, subject_ordinal int, tenant_id string, subject_type string, external_subject_id string, event_name string,"
        " received_at timestamp, lifecycle_source_updated_at timestamp, lifecycle_source_mutation_id string, lifecycle_effective_at timestamp,"
        " merged_into_external_subject_id string, initial_status string, normalization_status string, normalization_reason string",
    )
    flags = {r.event_id: r.normalization_status for r in dimension.flag_ignored(rows).collect()}
    assert flags == {"e0": "normalized", "e1": "lifecycle_ignored", "e2": "normalized", "e3": "normalized"}
    states = {r.external_subject_id: r for r in dimension.fold(dimension.changes_from_events(rows)).collect()}
    assert (states["c"].lifecycle_status, states["c"].lifecycle_source_mutation_id, states["c"].merged_into_external_subject_id) == (
        "merged", "mutation-01", "customer-target")
    assert states["customer-target"].lifecycle_status == "unknown"


# --- registry --------------------------------------------------------------------------------


def document(spark, contexts, version=1, revision="r1"):
    return spark.createDataFrame([(1, version, revision, contexts)], schemas.REGISTRY)


def test_registry_parents_and_cycles(spark):
    good = [("root", 1, "search", None, None, "active"), ("leaf", 1, "search", "root", 1, "inactive")]
    assert registry.violations(document(spark, good)).count() == 0
    ring = [("a", 1, "search", "b", 1, "active"), ("b", 1, "search", "a", 1, "active"), ("c", 1, "search", "a", 1, "active")]
    found = registry.violations(document(spark, ring)).collect()
    assert sorted((r.rule, r.context_key) for r in found) == [("cycle", "a"), ("cycle", "b")]


def test_registry_publication_rules(spark):
    base = [("a", 1, "search", None, None, "active")]
    tables, what = registry.refresh(document(spark, base, 2, "r2"), registry.empty_tables(spark), T0)
    assert what == "loaded"
    for contexts, version, revision in (
        (base, 1, "r1"),
        ([("a", 1, "support", None, None, "active")], 3, "r3"),
        ([("a", 1, "search", None, None, "inactive")], 2, "r2"),
        ([("z", 1, "search", None, None, "active"), ("a", 1, "search", "z", 1, "active")], 3, "r3"),
    ):
        after, what = registry.refresh(document(spark, contexts, version, revision), tables, T0)
        assert what == "rejected" and after is tables
    after, what = registry.refresh(document(spark, [("a", 0, "search", None, None, "active")], 4, "r4"), tables, T0)
    assert what == "invalid"
    assert one(registry.load_active(after[0])).registry_revision == "r2"
    assert registry.refresh(None, tables, T0)[1] == "source_error"
    later, what = registry.refresh(document(spark, [("a", 1, "search", None, None, "inactive")], 3, "r3"), tables, T0)
    assert what == "loaded" and one(registry.active_definitions(*later)).status == "inactive"


def test_resolution_statuses(spark):
    contexts = [("a", 1, "search", None, None, "active"), ("b", 1, "support", None, None, "inactive")]
    definitions = registry.entries(document(spark, contexts))
    text = '{"subjects":[{"subject_type":"customer","subject_id":"1"}]}'

    def status(context):
        rows = subjects.subject_rows(event(spark, text, context=context))
        row = one(subjects.resolve_contexts(rows, definitions, "r1"))
        return row.context_resolution_status, row.resolved_context_family

    assert status('{"context_key":"a","context_version":1.0}') == ("registered", "search")
    assert status('{"context_key":"b","context_version":1}') == ("inactive_context", "support")
    assert status('{"context_key":"c","context_version":1}') == ("unregistered", None)
    assert status('{"context_key":"a","context_version":"1"}') == ("family_unresolved", None)


# --- ranking and suggestions -----------------------------------------------------------------


AS_OF = datetime(2026, 8, 11, 12, tzinfo=UTC)


def daily_rows(spark, rows):
    return spark.createDataFrame(
        [(t, s, AS_OF.date(), "UTC", 0, 0, 0, n, AS_OF - timedelta(hours=1)) for t, s, n in rows],
        "tenant_id string, external_subject_id string, local_date date, timezone_name string, impression_count bigint, view_count bigint,"
        " selection_count bigint, association_count bigint, last_association_at timestamp",
    )


def subject_table(spark, ids):
    return spark.createDataFrame(
        [(t, "customer", s, status) for t, s, status in ids],
        "tenant_id string, subject_type string, external_subject_id string, lifecycle_status string",
    )


def runs(spark, hours):
    rows = [(f"r{n}", n, 1, "completed", AS_OF - timedelta(hours=h + 1), AS_OF - timedelta(hours=h), 0, 0, 0, None) for n, h in hours.items()]
    return spark.createDataFrame(rows, schemas.RUN)


def test_ranking_order_and_tenants(spark):
    daily = daily_rows(spark, [("tenant-a", "b", 5), ("tenant-a", "a", 5), ("tenant-a", "c", 8), ("tenant-b", "z", 99), ("tenant-a", "off", 50)])
    table = subject_table(spark, [("tenant-a", "a", "active"), ("tenant-a", "b", "active"), ("tenant-a", "c", "active"), ("tenant-b", "z", "active"), ("tenant-a", "off", "inactive")])
    assert [r.external_subject_id for r in suggestions.top_global(daily, table, "tenant-a", AS_OF).collect()] == ["c", "a", "b"]
    ranked = suggestions.rank_global(daily, table, AS_OF, limit=2).where("tenant_id = 'tenant-a'").orderBy("position").collect()
    assert [r.external_subject_id for r in ranked] == ["c", "a"]


def ask(spark, context_rows, global_rows, limit, hours, **options):
    daily = daily_rows(spark, [("t", s, n) for s, n in global_rows])
    contextual = daily_rows(spark, [("t", s, n) for s, n in context_rows]).withColumns({"context_key": F.lit("k"), "context_version": F.lit(1)})
    table = subject_table(spark, [("t", s, "active") for s in {s for s, _ in context_rows} | {s for s, _ in global_rows}])
    definitions = registry.entries(document(spark, [("k", 1, "search", None, None, "active")]))
    query = suggestions.SuggestionQuery("t", context_key=options.pop("key", "k"), context_version=options.pop("ver", 1), limit=limit)
    envelope_row, rows = suggestions.suggest(query, daily, contextual, table, definitions, runs(spark, hours), AS_OF, **options)
    return envelope_row, [(r.external_subject_id, r.source_level) for r in rows.collect()]


FRESH = {"subject_global": 2, "subject_context": 1}


def test_composed_levels(spark):
    env, rows = ask(spark, [("a", 3)], [("b", 9)], 1, FRESH)
    assert (env["source_level"], env["fallback_applied"], rows) == ("context", False, [("a", "context")])
    env, rows = ask(spark, [("a", 3)], [("a", 9), ("b", 5)], 2, FRESH)
    assert (env["source_level"], env["fallback_applied"], rows) == ("mixed", True, [("a", "context"), ("b", "global")])
    assert env["computed_at"] == (AS_OF - timedelta(hours=2)).replace(tzinfo=None)
    env, rows = ask(spark, [], [("b", 5)], 2, FRESH)
    assert (env["source_level"], env["fallback_applied"], rows) == ("global", True, [("b", "global")])
    env, rows = ask(spark, [], [("b", 5)], 2, FRESH, key=None, ver=None)
    assert "source_level" not in env and rows == [("b", "global")]


def test_staleness_and_availability(spark):
    old = {"subject_global": 49, "subject_context": 49}
    with pytest.raises(suggestions.ProjectionStale):
        ask(spark, [], [("b", 5)], 2, old)
    env, _ = ask(spark, [], [("b", 5)], 2, old, serve_stale=True)
    assert env["is_stale"]
    with pytest.raises(suggestions.ProjectionUnavailable):
        ask(spark, [("a", 1)], [("b", 5)], 2, {"subject_context": 1})
    with pytest.raises(suggestions.ProjectionUnavailable):
        ask(spark, [("a", 1)], [("b", 5)], 2, {"subject_global": 1})


def test_query_arguments():
    good = suggestions.SuggestionQuery.parse({"tenant_id": " t ", "subject_type": "customer", "limit": "5"})
    assert (good.tenant_id, good.limit) == ("t", 5)
    bad = [
        {"tenant_id": "", "subject_type": "customer"}, {"tenant_id": "t", "subject_type": "account"}, {"tenant_id": "t", "subject_type": "customer", "x": "1"},
        {"tenant_id": ["a", "b"], "subject_type": "customer"}, {"tenant_id": "t", "subject_type": "customer", "context_key": "k"},
        {"tenant_id": "t", "subject_type": "customer", "context_key": "k", "context_version": "0"}, {"tenant_id": "t", "subject_type": "customer", "limit": "101"},
        {"tenant_id": "t" * 256, "subject_type": "customer"}, {"tenant_id": "t", "subject_type": "customer", "limit": "x"},
    ]
    for parameters in bad:
        with pytest.raises(ValueError):
            suggestions.SuggestionQuery.parse(parameters)


# --- semantic keys, sessions -----------------------------------------------------------------


def test_semantic_repeat_in_window(spark):
    rule = [{"event_name": "page_view", "window_ms": 200, "fields": ["session_id", "tab_id", "path"]}]
    base = datetime(2026, 1, 1, tzinfo=UTC)
    rows = [("1", 0, "", "/a"), ("2", 199, "", "/a"), ("3", 200, "", "/a"), ("4", 150, "", "/b"), ("5", 150, "log", "/a")]
    df = spark.createDataFrame(
        [(i, base + timedelta(milliseconds=ms), "", log, "page_view", "t", "s", "sess", "tab", p) for i, ms, log, p in rows],
        "event_id string, event_time timestamp, idempotency_key string, logical_event_id string, event_name string, tenant_id string,"
        " site_id string, session_id string, tab_id string, path string",
    )
    keyed = dedup.with_semantic_key(df, rule)
    flagged = dedup.flag_repeats(keyed, ["semantic_key"], F.struct("event_time", "event_id"), applies=F.col("semantic_key").isNotNull())
    assert {r.event_id: r.repeat for r in flagged.collect()} == {"1": False, "2": True, "3": False, "4": False, "5": False}


def test_session_gap_is_inclusive(spark):
    base = datetime(2026, 1, 1, 23, 50, tzinfo=UTC)
    df = spark.createDataFrame([("u", 1, base), ("u", 2, base + timedelta(minutes=30)), ("u", 3, base + timedelta(minutes=60, seconds=1))], "user string, id int, t timestamp")
    got = client.sessionize(df, ["user"], "t", ["t", "id"]).orderBy("id").collect()
    assert [r.session_number for r in got] == [1, 1, 2]


def test_site_and_snapshot_checks(spark):
    sites = spark.createDataFrame([("c", "t", "s", "active", True, ["d"], 0, 0.0, 0, " UTC ")], schemas.SITE)
    row = one(dimensions.valid_site(dimensions.site_defaults(sites, token_version=3)))
    assert (row.token_version, row.sample_rate, row.schema_version, row.zone, row.config_valid) == (3, 1.0, 1, "UTC", True)
    rows = spark.createDataFrame(
        [("t", "1", "active", "2026-01-01T00:00:00Z", "m", None), ("t", "2", "merged", "2026-01-01T00:00:00Z", "m", None), ("t", "3", "unknown", "2026-01-01T00:00:00Z", "m", None)],
        schemas.SNAPSHOT,
    )
    assert [r.row_valid for r in dimensions.check_snapshot(rows).orderBy("external_subject_id").collect()] == [True, False, False]


def test_run_ledger(spark):
    opened = projections.run_row(spark, run_id="a", projection_name="subject_global", projection_version=1, status="running", started_at=T0)
    lost = projections.recovered(opened, "subject_global", 1, T0 + timedelta(hours=1))
    assert one(lost).last_error == "recovered_after_interruption"
    assert one(projections.latest_runs(opened.unionByName(lost))).status == "failed"
    failed = projections.run_row(spark, run_id="b", projection_name="x", projection_version=1, status="failed", started_at=T0, completed_at=T0, last_error="e" * 2000)
    assert len(one(failed).last_error) == 1000
    assert sorted(r.due for r in projections.due(opened, 1, F.lit(T0).cast("timestamp")).collect()) == [True, True]


def test_rows_of_one_time_leave_one_state_of_a_run(spark):
    row = {"run_id": "r", "projection_name": "p", "projection_version": 1, "status": "running", "started_at": T0}
    opened, going = projections.run_row(spark, **row), projections.run_row(spark, **row, rows_written=7)
    for ledger in (opened.union(going), going.union(opened)):
        assert one(projections.latest_runs(ledger.coalesce(1)))["rows_written"] == 7
