"""Inputs shared by the registered queries, on the Spark side and as SQL for the checks."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.once import once
from tideline.operators import registry, subjects, validation
from tideline.sources import adapters, dimensions

AS_OF = datetime(2024, 1, 31, tzinfo=timezone.utc)
AS_OF_SQL = "timestamp '2024-01-31 00:00:00'"


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dimensions.valid_site(dimensions.site_defaults(adapters.sites(spark, sf_dir)))


def valid_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw events that pass the field checks, on their site."""
    raw = adapters.raw(spark, sf_dir, repeats=False)
    # As a column of its own the verdict stays behind the shuffle that deals the events; as a filter it is pushed ahead of it, to
    # the one or two tasks that read the table.
    raw = once(raw, {"_fields_ok": validation.has_required_fields()}).where("_fields_ok").drop("_fields_ok")
    return validation.join_sites(raw, sites(spark, sf_dir)).withColumn(
        "event_source", validation.source("event_source")
    )


def definitions(spark: SparkSession) -> DataFrame:
    return registry.entries(adapters.registry(spark))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event-subject facts of all valid raw events, resolved against the registry."""
    rows = subjects.subject_rows(valid_raw(spark, sf_dir))
    resolved = subjects.resolve_contexts(rows, definitions(spark), adapters.REVISION)
    return subjects.with_row_id(resolved).withColumn("updated_at", F.col("received_at"))


def sql(template: str, **parts: str) -> str:
    """Fills <<name>> marks; SQL with JSON braces stays readable that way."""
    for name, text in parts.items():
        template = template.replace(f"<<{name}>>", text)
    return template


def _plain(template: str) -> str:
    tables = ("events", "nation", "region", "orders", "customer", "lineitem", "part")
    return template.format(**{t: t for t in tables})


RAW = _plain(adapters.RAW_EVENTS.replace("{repeats}", adapters.REPEATS))
RAW_ONCE = _plain(adapters.RAW_EVENTS.replace("{repeats}", ""))
SITES = _plain(adapters.SITES)
ORDER_EVENTS = _plain(adapters.ORDER_EVENTS)
LIFECYCLE = _plain(adapters.LIFECYCLE)
SNAPSHOT = _plain(adapters.SNAPSHOT)

# Facts straight from the events table: which subjects an event names, in which order.
FACTS = sql(
    """
with s as (select *, case when timezone in ('', 'Mars/Olympus') then null else timezone end as zone from (<<sites>>)),
b as (
    select e.*, cast(regexp_extract(e.props, '([0-9]+)', 1) as bigint) as k,
           case event_type when 'view' then 'subject_viewed' when 'click' then 'subject_selected'
                when 'purchase' then 'subject_associated' when 'signup' then 'subject_impression'
                else 'page_view' end as event_name,
           case when event_id % 4 = 0 then 'server' else 'web' end as event_source,
           ts + interval '1' second * (event_id * 37 % 900) as received_at,
           s.tenant_id, s.site_id, s.timezone, s.zone
    from events e join s on s.site_code = 'site-' || cast(e.user_id % 25 as string)
    where event_id % 211 <> 0
),
named as (
    select *, 0 as ordinal, 'customer' as subject_type, cast(user_id as string) as ext, 'primary' as relation, '' as flaw
    from b where event_id % 61 <> 0
    union all
    select *, 2, 'customer', cast(user_id + 5 as string), 'related', '' from b where event_id % 61 <> 0 and event_id % 7 = 0
    union all
    select *, 1 + 2 * cast(event_id % 7 = 0 as integer), '', '', '', 'subject_not_object'
    from b where event_id % 61 <> 0 and event_id % 41 = 0
    union all
    select *, 1 + 2 * cast(event_id % 7 = 0 as integer) + cast(event_id % 41 = 0 as integer), 'account', 'a1', '', ''
    from b where event_id % 61 <> 0 and event_id % 43 = 0
    union all
    select *, 0, '', '', '', 'subjects_not_array' from b where event_id % 61 = 0
),
judged as (
    select *, case when flaw <> '' then flaw
                   when subject_type <> 'customer' then 'unsupported_subject_type'
                   when event_id % 47 = 0 then 'invalid_operation'
                   when zone is null then 'timezone_unresolved' end as reason
    from named
),
facts as (
    select 'evt-' || cast(event_id as string) as event_id, event_id as n, ordinal as subject_ordinal,
           event_name, event_source, ts as event_time, received_at, tenant_id, site_id, subject_type,
           ext as external_subject_id, relation, reason as normalization_reason,
           case when reason is null then 'normalized'
                when reason in ('unsupported_subject_type', 'timezone_unresolved') then reason
                else 'invalid_subject' end as normalization_status,
           case when flaw = '' and timezone <> '' then timezone end as timezone_name,
           case when reason is null then
                cast((ts at time zone 'UTC') at time zone zone as date) end as local_date,
           case when flaw = '' and event_id % 59 <> 0 then 'ctx-' || cast(k % 4 as string) end as context_key,
           case when flaw = '' and event_id % 59 <> 0 then 1 end as context_version,
           case when flaw = '' and event_type = 'purchase' and event_id % 47 <> 0 then 'op-' || cast(event_id as string) end
               as operation_id,
           case when flaw = '' and event_source = 'server' and event_name = 'subject_associated' then 'active'
                else 'unknown' end as initial_status,
           case when reason is not null then 'registry_disabled'
                when event_id % 59 = 0 then 'family_unresolved'
                when k % 4 = 3 then 'unregistered'
                when k % 4 = 2 then 'inactive_context'
                else 'registered' end as context_resolution_status,
           case when reason is null and event_id % 59 <> 0 then
                case k % 4 when 0 then 'search' when 1 then 'selection' when 2 then 'support' end end
               as resolved_context_family
    from judged
)
""",
    sites=SITES,
)
