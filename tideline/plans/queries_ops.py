"""Queries over sinks, integrity, monitoring and the design-only aggregates."""

from __future__ import annotations

from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators import audit, designs, dimension, lookups, monitoring, projections
from tideline.plans import base, erasure as erasure_job, history, projection
from tideline.plans.catalog import query
from tideline.plans.queries_daily import LEDGER, _ledger
from tideline.plans.queries_dedup import _DECIDED, _process
from tideline.plans.queries_subjects import _DIMENSION, _dimension
from tideline.plans.registry_store import RegistryStore
from tideline.plans.tables import Tables
from tideline.session import cut, new_folder
from tideline.sources import adapters, envelope
from tideline.streaming import jobs


def _events(spark, sf_dir):
    """Raw events without payloads, as a stored-event stand-in for the lookups."""
    return adapters.raw_text(spark, sf_dir, repeats=False).drop("properties", "context")


_RAW = f"({base.RAW_ONCE})"


@query("H7", f"select event_id, event_time, event_name from {_RAW} order by event_time desc, event_id desc limit 50")
def recent_events(spark, sf_dir):
    """The fifty latest events."""
    return lookups.recent_events(_events(spark, sf_dir)).select("event_id", "event_time", "event_name")


@query("H9", f"select event_id, event_time from {_RAW} where session_id = 'sess-7-2024-01-03'")
def session_timeline(spark, sf_dir):
    """One session in order."""
    return lookups.session_timeline(_events(spark, sf_dir), "sess-7-2024-01-03").select("event_id", "event_time")


@query("H9", f"select event_id, event_name from {_RAW} where user_id = 'u-11'")
def user_history(spark, sf_dir):
    """One user's events, latest first."""
    return lookups.user_history(_events(spark, sf_dir), "u-11").select("event_id", "event_name")


@query(
    "H9",
    f"""select event_id, event_time from {_RAW} where event_name = 'page_view'
        and event_time >= timestamp '2024-01-10 00:00:00' and event_time < timestamp '2024-01-12 00:00:00'""",
)
def events_named(spark, sf_dir):
    """Events of one name in a time range."""
    start, end = datetime(2024, 1, 10, tzinfo=timezone.utc), datetime(2024, 1, 12, tzinfo=timezone.utc)
    return lookups.events_named(_events(spark, sf_dir), "page_view", start, end).select("event_id", "event_time")


@query(
    "I1 H8",
    _DECIDED
    + """
, ok as (select * from decided where outcome = 'inserted')
select 'events' as what, case when event_source = 'server' then 'server' else 'web' end as label, count(*) as rows from ok group by 2
union all select 'rejected', reason, count(*) from decided where reason is not null group by 2
""",
)
def ingested_tables(spark, sf_dir):
    """Rows of the event and rejection tables after one batch."""
    out = _process(spark, sf_dir)
    events = out.events.groupBy(F.col("event_source").alias("label")).agg(F.count(F.lit(1)).alias("rows"))
    rejected = out.rejected.groupBy(F.col("reason").alias("label")).agg(F.count(F.lit(1)).alias("rows"))
    return events.select(F.lit("events").alias("what"), "label", "rows").unionByName(
        rejected.select(F.lit("rejected").alias("what"), "label", "rows")
    )


@query(
    "J1 I1 I5 C9",
    _DECIDED
    + """
, ok as (select * from decided where outcome = 'inserted')
select 'events' as what, case when event_source = 'server' then 'server' else 'web' end as label, count(*) as rows from ok group by 2
union all select 'rejected', reason, count(*) from decided where reason is not null group by 2
""",
)
def streamed_tables(spark, sf_dir):
    """Rows of the stored tables after the stream's batch job has taken the messages of each half month."""
    raw = adapters.raw(spark, sf_dir)
    messages = cut(raw.select(
        "stream_id", envelope.to_message(raw).alias("payload"), F.lit(None).cast("int").alias("delivery_count"), "received_at"
    ))
    tables = Tables(spark, new_folder(spark))
    later = F.col("received_at") >= F.lit(datetime(2024, 1, 16, tzinfo=timezone.utc))
    for batch_id, part in enumerate((messages.where(~later), messages.where(later))):
        jobs.process_batch(tables, part.drop("received_at"), batch_id, base.sites(spark, sf_dir), [], base.definitions(spark), adapters.REVISION)
    events = tables.read("events").groupBy(F.col("event_source").alias("label")).agg(F.count(F.lit(1)).alias("rows"))
    rejected = tables.read("rejected").groupBy(F.col("reason").alias("label")).agg(F.count(F.lit(1)).alias("rows"))
    return events.select(F.lit("events").alias("what"), "label", "rows").unionByName(
        rejected.select(F.lit("rejected").alias("what"), "label", "rows")
    )


_LIFECYCLE = base.FACTS + "," + _DECIDED.strip().removeprefix("with") + """,
told as (
    select f.*, cast(split_part(f.context_key, '-', 2) as int) as c from facts f
    where exists (select 1 from decided d where d.turn = 0 and d.outcome = 'inserted' and d.n = f.n)
),
resolved as (
    select *, case when context_key is null then 'family_unresolved' when c = 3 then 'unregistered' when c = 2 then 'inactive_context'
                   else 'registered' end as status from told
)
select 'facts' as what, status as label, count(*) as n from resolved group by status
union all
select 'unregistered', context_key, count(*) from resolved where status = 'unregistered' group by context_key
union all
select 'associations', context_key, count(*) from resolved
where status = 'registered' and normalization_status = 'normalized' and event_name = 'subject_associated' group by context_key
union all
select 'refresh', unnest(['loaded', 'loaded', 'invalid', 'rejected', 'source_error']), 1
union all
select 'resolved again', '', 0
"""


@query("F3 F4 F5 F7 F8 F9 J1", _LIFECYCLE)
def registry_lifecycle(spark, sf_dir):
    """Half of the messages before any publication, half after one; documents that may not be published; the history resolved,
    projected, and resolved once more."""
    raw = adapters.raw(spark, sf_dir, repeats=False)
    messages = cut(raw.select(
        "stream_id", envelope.to_message(raw).alias("payload"), F.lit(None).cast("int").alias("delivery_count"), "received_at"
    ))
    sites, tables = base.sites(spark, sf_dir), Tables(spark, new_folder(spark))
    store, at = RegistryStore(tables), datetime(2024, 2, 1, tzinfo=timezone.utc)
    good = adapters.registry(spark)
    broken = good.withColumns({"registry_version": F.lit(2).cast("long"), "registry_revision": F.lit("rev-2"), "contexts": F.concat("contexts", "contexts")})
    older = good.withColumn("registry_revision", F.lit("rev-0"))
    later = F.col("received_at") >= F.lit(datetime(2024, 1, 16, tzinfo=timezone.utc))
    jobs.process_batch(tables, messages.where(~later).drop("received_at"), 0, sites, [], *store.active())
    said = [store.refresh(good, at)]
    jobs.process_batch(tables, messages.where(later).drop("received_at"), 1, sites, [], *store.active())
    said += [store.refresh(document, at) for document in (good, broken, older, None)]
    history.resolve(tables, at)
    projection.run_all(tables, tables.read("facts"), jobs.subjects(tables), at)
    again = history.resolve(tables, at)
    days = projection.read_daily(tables, True).groupBy("context_key").agg(F.sum("association_count").alias("n")).where("n > 0")
    parts = [
        tables.read("facts").groupBy(F.col("context_resolution_status").alias("label")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("facts").alias("what"), "label", "n"),
        history.unregistered_contexts(tables).select(F.lit("unregistered").alias("what"), F.col("context_key").alias("label"), F.col("event_count").alias("n")),
        days.select(F.lit("associations").alias("what"), F.col("context_key").alias("label"), "n"),
        spark.createDataFrame([("refresh", s, 1) for s in said] + [("resolved again", "", again)], "what string, label string, n long"),
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    "H8 K1",
    base.FACTS
    + base.sql(
        """
select 'events' as what, event_source as label, count(*) as rows from b group by 2
union all
select 'subjects', status, count(*) from (
    select case when bool_or(initial_status = 'active') then 'active' else 'unknown' end as status from facts
    where normalization_status in ('normalized', 'timezone_unresolved') group by tenant_id, external_subject_id) group by 2
union all
select 'facts', normalization_status, count(*) from facts group by 2
union all
select 'runs', status, count(*) from (<<ledger>>) group by 2
""",
        ledger=LEDGER,
    ),
)
def table_counts(spark, sf_dir):
    """Operational counts of events, subjects, facts and runs."""
    facts = cut(base.facts(spark, sf_dir))
    subjects = dimension.fold(dimension.changes_from_events(facts))
    return monitoring.table_counts(base.valid_raw(spark, sf_dir), subjects, facts, _ledger(spark, sf_dir))


@query(
    "K1",
    base.FACTS + "select normalization_status, event_name, count(*) as facts from facts group by normalization_status, event_name",
)
def normalization_counts(spark, sf_dir):
    """Facts by normalization and event name."""
    return monitoring.normalization_counts(base.facts(spark, sf_dir))


@query(
    "G7 K2",
    base.sql(
        """
select projection_name, status, count(*) as runs, sum((epoch_us(completed_at) - epoch_us(started_at)) / 1e6) as duration_seconds,
       cast(sum(rows_written) as bigint) as rows_written
from (<<ledger>>) group by projection_name, status
""",
        ledger=LEDGER,
    ),
)
def run_counts(spark, sf_dir):
    """Projection runs by name and state, from a ledger with an opening row per run."""
    ledger = _ledger(spark, sf_dir)
    opened = ledger.withColumns(
        {"status": F.lit("running"), "completed_at": F.lit(None).cast("timestamp"), "rows_written": F.lit(0).cast("bigint")}
    )
    return monitoring.run_counts(opened.unionByName(ledger))


@query(
    "G7 K2",
    base.sql(
        """
select projection_name, 1 as projection_version, (epoch_us(timestamp '2002-01-01 00:00:00') - epoch_us(max(completed_at))) / 1e6 as lag_seconds,
       (epoch_us(timestamp '2002-01-01 00:00:00') - epoch_us(max(completed_at))) / 1e6 > 172800 as stale
from (<<ledger>>) where status = 'completed' group by projection_name
""",
        ledger=LEDGER,
    ),
)
def run_lag(spark, sf_dir):
    """Age of each projection's last success."""
    return monitoring.run_lag(_ledger(spark, sf_dir), F.lit("2002-01-01 00:00:00").cast("timestamp"))


def _log(spark, sf_dir):
    events = adapters.read(spark, sf_dir, "events")
    return events.select("event_type", F.col("ts").cast("timestamp").alias("at"), "value", (F.col("event_type") == "error").alias("failed"))


@query(
    "K3",
    """
select event_type, le, count(*) filter (value <= le) as cumulative, count(*) as total
from events, (values (0.01::double), (0.025), (0.05), (0.1), (0.25), (0.3), (0.5), (1), (2.5), (5), (10), (30), (60), (300), (1800), (3600)) b(le)
where value >= 0 group by event_type, le
""",
)
def value_histogram(spark, sf_dir):
    """Cumulative histogram per event type."""
    return monitoring.histogram(_log(spark, sf_dir), "value", ["event_type"]).select("event_type", "le", "cumulative", "total")


_WINDOW = "time_bucket(interval '15 minutes', ts)"


@query(
    "K4",
    f"""
select {_WINDOW} as window_start, list_sort(list(value))[cast(ceil(count(*) * 0.95) as bigint)] as quantile_value, count(*) as requests
from events group by 1
""",
)
def latency_quantiles(spark, sf_dir):
    """95th percentile per quarter of an hour."""
    return monitoring.latency_quantiles(_log(spark, sf_dir), "at", "value")


@query(
    "K4",
    f"""
select {_WINDOW} as window_start, count(*) filter (event_type = 'error') as errors, count(*) as requests,
       count(*) filter (event_type = 'error') / count(*) as ratio, count(*) filter (event_type = 'error') / count(*) > 0.01 as alerting
from events group by 1
""",
)
def error_ratio(spark, sf_dir):
    """Share of failed requests per quarter of an hour."""
    return monitoring.error_ratio(_log(spark, sf_dir), "at", F.col("failed"))


@query("K4", f"select {_WINDOW} as window_start, count(*) as happened from events where event_type = 'error' group by 1")
def error_increase(spark, sf_dir):
    """Failures per quarter of an hour."""
    return monitoring.increase(_log(spark, sf_dir), "at", F.col("failed"))


@query(
    "I10 E9",
    _DIMENSION
    + """
, days as (
    select tenant_id, external_subject_id, local_date, timezone_name, count(*) as n from facts
    where normalization_status = 'normalized' and event_name <> 'page_view' group by all
)
select 'subject_is_customer' as rule, count(*) filter (subject_type <> 'customer') as violations from subjects
union all select 'subject_status_known', 0 union all select 'subject_merge_target', 0
union all select 'subject_merge_distinct', count(*) filter (merged_into_external_subject_id = external_subject_id) from subjects
union all select 'subject_order_pair', 0 union all select 'subject_identity', 0
union all select 'subject_lifecycle', count(*) filter (merged_into_external_subject_id = external_subject_id) from subjects
union all select 'subject_unique', 0 union all select 'merge_target_exists', 0
union all select 'daily_counts', 0 union all select 'daily_unique', 0 union all select 'daily_has_subject', 0
union all select 'fact_ordinal', 0 union all select 'fact_source', 0 union all select 'fact_normalization', 0
union all select 'fact_resolution', 0 union all select 'fact_context_version', 0
union all select 'fact_ordinal_unique', 0 union all select 'fact_idempotency_unique', 0
union all select 'fact_has_event', count(*) filter (n % 3 = 0) from facts
union all select 'fact_has_subject', 0
union all select 'run_version', 0 union all select 'run_status', 0 union all select 'run_counts', 0 union all select 'run_completion', 0
union all select 'one_open_run', count(*) from (select projection_name from (<<ledger>>) where status = 'running' group by 1 having count(*) > 1)
union all select 'event_id_unique', count(*) from (select event_id // 2 from events where event_id % 211 <> 0 group by 1 having count(*) > 1)
union all select 'logical_id_unique', 0
union all select 'idempotency_key_unique', 0
union all select 'item_has_event', (select count(*) from lineitem) union all select 'order_has_event', 0
""".replace("<<ledger>>", LEDGER),
)
def constraint_audit(spark, sf_dir):
    """Violations of every table rule, over tables with some rules broken on purpose."""
    facts = cut(base.facts(spark, sf_dir))
    subjects = cut(_dimension(spark, sf_dir, facts))
    events = base.valid_raw(spark, sf_dir).drop("properties", "context")
    # A third of the events go by another id, so their facts have none.
    events = events.withColumn("event_id", F.expr("if(sequence % 3 = 0, 'x' || event_id, event_id)"))
    # Half of the ids collide; the keys stay unique.
    clashing = events.withColumn("event_id", F.floor(F.col("sequence") / 2).cast("string"))
    lines = adapters.read(spark, sf_dir, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("event_id"))
    daily = projections.daily(facts)
    return (
        audit.subject_rules(subjects)
        .unionByName(audit.daily_rules(daily, subjects, projections.GLOBAL_KEY, "daily"))
        .unionByName(audit.fact_rules(facts, events, subjects))
        .unionByName(audit.run_rules(_ledger(spark, sf_dir)))
        .unionByName(audit.event_rules(clashing, lines, clashing.select("event_id")))
    )


@query(
    "I8",
    base.FACTS
    + """
, f as (select * from facts where n % 5 <> 0),
d as (select tenant_id, external_subject_id, local_date, timezone_name from facts
      where normalization_status = 'normalized' and event_name <> 'page_view'
        and external_subject_id not in (select external_subject_id from facts where relation = 'related') group by all)
select 'facts' as what, tenant_id, count(*) as rows from f group by tenant_id
union all select 'global_daily', tenant_id, count(*) from d group by tenant_id
""",
)
def erasure(spark, sf_dir):
    """Events and subjects removed with everything that hangs on them."""
    facts = cut(base.facts(spark, sf_dir))
    doomed = facts.where(F.substring("event_id", 5, 20).cast("bigint") % 5 == 0)
    tables = audit.erase_events({"facts": facts}, doomed)
    related = facts.where("relation = 'related'").select("external_subject_id").distinct()
    tenants = facts.select("tenant_id", "external_subject_id").join(related, "external_subject_id", "left_semi")
    tables |= audit.erase_subjects({"global_daily": projections.daily(facts)}, tenants)
    parts = [
        df.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("what"), "tenant_id", "rows")
        for name, df in tables.items()
    ]
    return parts[0].unionByName(parts[1])


_ERASED = base.FACTS + "," + _DECIDED.strip().removeprefix("with") + """,
ok as (select *, n % 5 = 0 or tenant_id = 'tenant-1' as gone from decided where turn = 0 and outcome = 'inserted'),
told as (select f.*, o.gone from facts f join ok o on o.n = f.n),
days as (
    select tenant_id, external_subject_id, local_date, timezone_name, sum(cast(event_name <> 'page_view' as integer)) as signals from told
    where normalization_status = 'normalized' group by all having signals > 0
),
sizes as (
    select 'events' as what, tenant_id, count(*) as stored, count(*) filter (gone) as erased from ok group by tenant_id
    union all select 'facts', tenant_id, count(*), count(*) filter (gone) from told group by tenant_id
    union all select 'global_daily', tenant_id, count(*), count(*) filter (tenant_id = 'tenant-1') from days group by tenant_id
)
select what, tenant_id as label, stored - erased as n from sizes where stored > erased
union all select 'erased', what, cast(sum(erased) as bigint) from sizes group by what
union all select 'without event', 'facts', 0
union all select 'without event', 'keys', 0
union all select 'known subjects', 'tenant-1', 0
"""


@query("I8", _ERASED)
def erased_tables(spark, sf_dir):
    """Every fifth event and a whole tenant erased from the stored tables, all read back; then the same request once more."""
    raw = adapters.raw(spark, sf_dir, repeats=False)
    messages = raw.select("stream_id", envelope.to_message(raw).alias("payload"), F.lit(None).cast("int").alias("delivery_count"))
    tables, at = Tables(spark, new_folder(spark)), datetime(2024, 2, 1, tzinfo=timezone.utc)
    jobs.process_batch(tables, messages, 0, base.sites(spark, sf_dir), [], base.definitions(spark), adapters.REVISION)
    projection.run(tables, tables.read("facts"), jobs.subjects(tables), False, at)
    fifth = raw.where("sequence % 5 = 0").select("event_id")
    tenant = spark.createDataFrame([("tenant-1",)], "tenant_id string")
    for _ in range(2):
        counts = erasure_job.erase(tables, "request-1", at, events=fifth, tenants=tenant)
    events, facts, daily = tables.read("events"), tables.read("facts"), projection.read_daily(tables, False)
    sizes = [
        df.groupBy(F.col("tenant_id").alias("label")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "label", "n")
        for name, df in (("events", events), ("facts", facts), ("global_daily", daily))
    ]
    lost = [
        df.join(events, "event_id", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("without event").alias("what"), F.lit(name).alias("label"), "n")
        for name, df in (("facts", facts), ("keys", tables.read("keys")))
    ]
    known = tables.read("subject_changes").where("tenant_id = 'tenant-1'").agg(F.count(F.lit(1)).alias("n"))
    told = [("erased", name, counts[name]) for name in ("events", "facts", "global_daily")]
    parts = [*sizes, *lost, known.select(F.lit("known subjects").alias("what"), F.lit("tenant-1").alias("label"), "n")]
    return reduce(DataFrame.unionByName, [*parts, spark.createDataFrame(told, "what string, label string, n long")])


# --- design-only aggregates -------------------------------------------------------------------

_SCORED = """
select 'site-' || cast(l.l_suppkey % 5 as string) as site_code, 'area-' || l.l_returnflag as app_area, 'feature-' || l.l_linestatus as feature,
       'component-' || cast(l.l_linenumber % 3 as string) as component_id, 'surface-' || cast(l.l_linenumber % 2 as string) as surface,
       'entry-' || cast(l.l_suppkey % 2 as string) as entry_point, p.p_type as item_type, cast(l.l_partkey as string) as item_id,
       case when l.l_quantity <= 30 then 'item_viewed' when l.l_quantity <= 45 then 'cart_item_added' else 'purchase_completed' end as event_name,
       l.l_shipdate as event_time
from {lineitem} l join {part} p on p.p_partkey = l.l_partkey
"""
_SCORES = base.sql(
    """
with scored as (<<scored>>),
scores as (
    select site_code, app_area, feature, component_id, surface, entry_point, item_type, item_id,
           cast(sum(case event_name when 'item_viewed' then 1 when 'cart_item_added' then 4 else 10 end) as bigint) as score,
           count(*) as event_count, max(event_time) as last_event_time
    from scored where event_time >= timestamp '1996-01-01 00:00:00' and event_time < timestamp '2000-01-01 00:00:00'
    group by all
)
""",
    scored=_SCORED.format(lineitem="lineitem", part="part"),
)


def _scores(spark, sf_dir):
    rows = adapters._as_instants(
        spark.sql(_SCORED, lineitem=adapters.read(spark, sf_dir, "lineitem"), part=adapters.read(spark, sf_dir, "part"))
    )
    context = list(designs.LEVELS[0][1])
    start, end = datetime(1996, 1, 1, tzinfo=timezone.utc), datetime(2000, 1, 1, tzinfo=timezone.utc)
    return designs.item_scores(rows, context, start, end)


@query("L1", _SCORES + "select *, 'context_items_v1' as algorithm_version from scores")
def item_scores(spark, sf_dir):
    """Weighted item scores per exact context."""
    return _scores(spark, sf_dir)


_LEVELED = (
    _SCORES
    + """
, leveled as (
    select site_code, app_area, feature, component_id, surface, entry_point, item_type, item_id, cast(sum(score) as bigint) as score,
           cast(sum(event_count) as bigint) as event_count, max(last_event_time) as last_event_time,
           case grouping_id(site_code, app_area, feature, component_id, surface, entry_point, item_type) when 0 then 0 when 2 then 1
                when 38 then 2 when 30 then 3 when 62 then 4 else 5 end as level_rank
    from scores group by grouping sets ((site_code, app_area, feature, component_id, surface, entry_point, item_type, item_id),
        (site_code, app_area, feature, component_id, surface, item_type, item_id), (site_code, feature, component_id, item_type, item_id),
        (site_code, app_area, item_type, item_id), (site_code, item_type, item_id), (site_code, item_id))
)
"""
)


@query("L2", _LEVELED + "select * from leveled")
def item_scores_by_level(spark, sf_dir):
    """Item scores rolled up to all fallback levels."""
    return designs.item_scores_by_level(_scores(spark, sf_dir)).drop("level")


@query(
    "L2",
    _LEVELED
    + """
, requests as (select distinct site_code, app_area, feature, component_id, surface, 'entry-9' as entry_point,
      case when surface = 'surface-0' then item_type else 'GADGET' end as item_type from scores
      union select distinct site_code, app_area, feature, component_id, surface, entry_point, item_type from scores),
found as (
    select r.*, l.item_id, l.score, l.last_event_time, l.level_rank from requests r join leveled l on
       l.site_code = r.site_code and (
       (level_rank = 0 and l.app_area = r.app_area and l.feature = r.feature and l.component_id = r.component_id and l.surface = r.surface and l.entry_point = r.entry_point and l.item_type = r.item_type)
    or (level_rank = 1 and l.app_area = r.app_area and l.feature = r.feature and l.component_id = r.component_id and l.surface = r.surface and l.item_type = r.item_type)
    or (level_rank = 2 and l.feature = r.feature and l.component_id = r.component_id and l.item_type = r.item_type)
    or (level_rank = 3 and l.app_area = r.app_area and l.item_type = r.item_type)
    or (level_rank = 4 and l.item_type = r.item_type) or level_rank = 5)
),
best as (select *, min(level_rank) over (partition by site_code, app_area, feature, component_id, surface, entry_point, item_type) as first from found),
ranked as (select *, row_number() over (partition by site_code, app_area, feature, component_id, surface, entry_point, item_type
           order by score desc, last_event_time desc, item_id) as position from best where level_rank = first)
select site_code, app_area, feature, component_id, surface, entry_point, item_type, item_id, score, position,
       case first when 0 then 'exact_context' when 1 then 'without_entry_point' when 5 then 'site_global' else 'other' end as level
from ranked where position <= 3
""",
)
def top_items_with_fallback(spark, sf_dir):
    """Best items of every requested context, from the first level that has any."""
    scores = cut(_scores(spark, sf_dir))
    columns = list(designs.LEVELS[0][1])
    exact = scores.select(*columns)
    gadget = F.when(F.col("surface") == "surface-0", F.col("item_type")).otherwise(F.lit("GADGET"))
    other = exact.withColumns({"entry_point": F.lit("entry-9"), "item_type": gadget})
    requests = exact.unionByName(other).distinct()
    top = designs.top_items_with_fallback(requests, designs.item_scores_by_level(scores), 3)
    return top.select(*columns, "item_id", "score", "position", "level")


