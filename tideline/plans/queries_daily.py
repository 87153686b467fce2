"""Queries over daily aggregates, their incremental upkeep, rankings and composed suggestions."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from tideline.operators import dedup, dimension, projections, subjects, suggestions, validation
from tideline.plans import base, projection
from tideline.plans.catalog import query
from tideline.plans.tables import Tables
from tideline.session import cut, new_folder
from tideline.sources import adapters, changes, envelope

CHANGED_SINCE = datetime(2024, 1, 25, tzinfo=timezone.utc)

_SUMS = """
       count(*) filter (event_name = 'subject_impression') as impression_count, count(*) filter (event_name = 'subject_viewed') as view_count,
       count(*) filter (event_name = 'subject_selected') as selection_count, count(*) filter (event_name = 'subject_associated') as association_count,
       max(event_time) filter (event_name = 'subject_associated') as last_association_at
"""
_SIGNAL = "normalization_status = 'normalized' and event_name <> 'page_view'"

_DAILY = (
    base.FACTS
    + f"""
, global_daily as (
    select tenant_id, external_subject_id, local_date, timezone_name, {_SUMS}
    from facts where {_SIGNAL} group by all
),
context_daily as (
    select tenant_id, external_subject_id, context_key, context_version, local_date, timezone_name, {_SUMS}
    from facts where {_SIGNAL} and context_resolution_status = 'registered' group by all
),
active as (
    select tenant_id, external_subject_id from facts where normalization_status in ('normalized', 'timezone_unresolved')
    group by all having bool_or(initial_status = 'active')
),
ranked_global as (
    select tenant_id, external_subject_id, sum(association_count) as association_count, max(last_association_at) as last_association_at,
           row_number() over (partition by tenant_id order by sum(association_count) desc, max(last_association_at) desc nulls last, external_subject_id) as position
    from global_daily semi join active using (tenant_id, external_subject_id)
    where local_date >= cast(({base.AS_OF_SQL} at time zone 'UTC') at time zone timezone_name as date) - 89 group by tenant_id, external_subject_id
    qualify position <= 10
),
ranked_context as (
    select tenant_id, context_key, context_version, external_subject_id, sum(association_count) as association_count, max(last_association_at) as last_association_at,
           row_number() over (partition by tenant_id, context_key, context_version
               order by sum(association_count) desc, max(last_association_at) desc nulls last, external_subject_id) as position
    from context_daily semi join active using (tenant_id, external_subject_id)
    where local_date >= cast(({base.AS_OF_SQL} at time zone 'UTC') at time zone timezone_name as date) - 29
    group by tenant_id, context_key, context_version, external_subject_id
    qualify position <= 10
)
"""
)


# What daily counts, the change scan and the dimension read of a fact.
_READ = (
    "tenant_id", "subject_type", "external_subject_id", "event_id", "subject_ordinal", "event_name", "event_time", "received_at",
    "updated_at", "row_id", "local_date", "timezone_name", "normalization_status", "context_key", "context_version",
    "context_resolution_status", "initial_status", "lifecycle_source_updated_at", "lifecycle_source_mutation_id",
    "lifecycle_effective_at", "merged_into_external_subject_id",
)


def _facts(spark, sf_dir):
    """Facts that are read more than once, written with the columns in use."""
    rows = base.facts(spark, sf_dir)
    return cut(rows.select(*[c for c in _READ if c in rows.columns]))


def _subjects(facts):
    return dimension.fold(dimension.changes_from_events(facts))


@query(
    "A2 B1 C1 D8 D13 G2 H1",
    _DAILY + "select tenant_id, position, external_subject_id, association_count, last_association_at from ranked_global",
)
def top_subjects_from_raw(spark, sf_dir):
    """Raw messages to ranking: decode, check, drop repeats, explode, count per day, rank per tenant."""
    raw = adapters.raw(spark, sf_dir)
    messages = raw.select("stream_id", envelope.to_message(raw).alias("payload"))
    decoded = envelope.decode_messages(messages).where("not malformed")
    # Decoded once; the search for first arrivals then reads three columns of it.
    valid = cut(decoded.where(validation.has_required_fields()))
    order = F.struct("received_at", "event_id", "stream_id")
    fresh = dedup.flag_repeats(valid, ["event_id"], order).where("not repeat")
    placed = validation.join_sites(fresh, base.sites(spark, sf_dir))
    rows = subjects.subject_rows(placed)
    facts = cut(rows.select(*[c for c in _READ if c in rows.columns]))
    daily = projections.daily(facts)
    ranked = suggestions.rank_global(daily, _subjects(facts), base.AS_OF)
    return ranked.select("tenant_id", "position", "external_subject_id", "association_count", "last_association_at")


@query("G2", _DAILY + "select * from global_daily")
def global_daily(spark, sf_dir):
    """Signal counts per tenant, subject and local day."""
    return projections.daily(base.facts(spark, sf_dir))


@query("G3", _DAILY + "select * from context_daily")
def context_daily(spark, sf_dir):
    """Signal counts per tenant, subject, context and local day."""
    return projections.daily(base.facts(spark, sf_dir), contextual=True)


@query(
    "A12 G1",
    base.FACTS
    + """
select distinct tenant_id, external_subject_id, local_date, timezone_name from facts
where normalization_status = 'normalized' and received_at > timestamp '2024-01-25 00:00:00'
""",
)
def affected_days(spark, sf_dir):
    """Keys touched since a checkpoint."""
    rows = changes.changed_rows(base.facts(spark, sf_dir), CHANGED_SINCE, "")
    return projections.affected_keys(rows)


@query(
    "A13 G1",
    base.FACTS
    + """
select distinct tenant_id, external_subject_id, context_key, context_version, local_date, timezone_name from facts
where normalization_status = 'normalized' and context_resolution_status = 'registered' and received_at > timestamp '2024-01-25 00:00:00'
""",
)
def affected_context_days(spark, sf_dir):
    """Context keys touched since a checkpoint."""
    rows = changes.changed_rows(base.facts(spark, sf_dir), CHANGED_SINCE, "", contextual=True)
    return projections.affected_keys(rows, contextual=True)


@query("G2 G4 J3", _DAILY + "select * from global_daily")
def incremental_daily(spark, sf_dir):
    """Daily rows kept up over two runs: the second recounts what changed, however late, and replaces it."""
    facts = _facts(spark, sf_dir)
    known = cut(_subjects(facts))
    # The first run saw what had arrived by then; old events of some subjects arrive only later.
    late = F.pmod(F.xxhash64("event_id"), F.lit(10)) == 0
    seen = facts.where((F.col("received_at") <= F.lit(CHANGED_SINCE)) & ~late)
    stored = projections.known_only(projections.daily(seen), known)
    changed = facts.where((F.col("received_at") > F.lit(CHANGED_SINCE)) | late)
    affected = cut(projections.affected_keys(changes.changed_rows(changed)))
    return projections.replace(stored, affected, projections.recompute(facts, affected, known))


@query("G6 G7 G9 G10", _DAILY + "select * from global_daily")
def projected_daily(spark, sf_dir):
    """Daily rows as the projection job leaves them after two runs, the second over what came since the checkpoint."""
    facts = _facts(spark, sf_dir)
    known = cut(_subjects(facts))
    tables = Tables(spark, new_folder(spark))
    projection.run(tables, facts.where(F.col("received_at") <= F.lit(CHANGED_SINCE)), known, False, CHANGED_SINCE)
    projection.run(tables, facts, known, False, CHANGED_SINCE + timedelta(hours=1))
    return projection.read_daily(tables, False).select(*projections.daily(facts).columns)


@query(
    "G5",
    _DAILY
    + """
select tenant_id, external_subject_id, local_date, timezone_name, impression_count, view_count, selection_count,
       case when local_date >= date '2024-01-20' then association_count + 100 else association_count end as association_count, last_association_at
from global_daily
""",
)
def daily_upsert(spark, sf_dir):
    """Prepared absolute aggregates over the stored ones."""
    stored = cut(projections.daily(base.facts(spark, sf_dir)))
    prepared = stored.where("local_date >= date '2024-01-20'").withColumn(
        "association_count", F.col("association_count") + 100
    )
    return projections.upsert(stored, prepared)


@query("H1 E8", _DAILY + "select tenant_id, position, external_subject_id, association_count, last_association_at from ranked_global")
def global_ranking(spark, sf_dir):
    """Top ten subjects of every tenant over ninety local days."""
    facts = _facts(spark, sf_dir)
    ranked = suggestions.rank_global(projections.daily(facts), _subjects(facts), base.AS_OF)
    return ranked.select("tenant_id", "position", "external_subject_id", "association_count", "last_association_at")


@query(
    "H1",
    _DAILY + "select external_subject_id, association_count, last_association_at from ranked_global where tenant_id = 'tenant-1'",
)
def tenant_ranking(spark, sf_dir):
    """Top ten subjects of one tenant, as a distributed top-k."""
    facts = _facts(spark, sf_dir)
    top = suggestions.top_global(projections.daily(facts), _subjects(facts), "tenant-1", base.AS_OF)
    return top.select("external_subject_id", "association_count", "last_association_at")


@query(
    "H2",
    _DAILY + "select tenant_id, context_key, position, external_subject_id, association_count, last_association_at from ranked_context",
)
def context_ranking(spark, sf_dir):
    """Top ten subjects of every tenant and active context over thirty local days."""
    facts = _facts(spark, sf_dir)
    ranked = suggestions.rank_context(
        projections.daily(facts, contextual=True), _subjects(facts), base.definitions(spark), base.AS_OF
    )
    return ranked.select("tenant_id", "context_key", "position", "external_subject_id", "association_count", "last_association_at")


def _requests(spark, sf_dir):
    """One request per tenant and context in use, known or not."""
    tenants = base.sites(spark, sf_dir).select("tenant_id").distinct()
    keys = F.explode(F.array(*[F.lit(f"ctx-{i}") for i in range(5)]))
    return tenants.select("tenant_id", keys.alias("context_key"), F.lit(1).alias("context_version"))


_REQUESTS = """
, requests as (select distinct tenant_id, 'ctx-' || cast(i as string) as context_key, 1 as context_version from s, range(5) r(i))
"""


@query(
    "H3",
    """
select distinct 'tenant-' || cast(n_regionkey as string) as tenant_id, 'ctx-' || cast(i as string) as context_key,
       case when i < 2 then 'registered' when i = 2 then 'inactive_context' else 'unregistered' end as resolution_status
from nation, range(5) r(i)
""",
)
def context_status(spark, sf_dir):
    """Resolution status of requested contexts."""
    rows = suggestions.context_status(_requests(spark, sf_dir), base.definitions(spark))
    return rows.select("tenant_id", "context_key", "resolution_status")


#: More than a tenant has subjects in some contexts, so that answers are filled up.
LIMIT = 50


def _composed(spark, sf_dir):
    facts = _facts(spark, sf_dir)
    known = cut(_subjects(facts))
    context_rows = suggestions.rank_context(
        projections.daily(facts, contextual=True), known, base.definitions(spark), base.AS_OF, limit=LIMIT
    )
    global_rows = suggestions.rank_global(projections.daily(facts), known, base.AS_OF, limit=LIMIT)
    requests = _requests(spark, sf_dir)
    return requests, suggestions.compose(requests, context_rows, global_rows, LIMIT)


_COMPOSED = (
    _DAILY.replace("position <= 10", f"position <= {LIMIT}")
    + _REQUESTS
    + """
, offered as (
    select r.*, c.external_subject_id, c.association_count, c.last_association_at, 0 as level, c.position
    from requests r join ranked_context c using (tenant_id, context_key, context_version)
    union all
    select r.*, g.external_subject_id, g.association_count, g.last_association_at, 1, g.position
    from requests r join ranked_global g on g.tenant_id = r.tenant_id
    where not exists (select 1 from ranked_context c where c.tenant_id = r.tenant_id and c.context_key = r.context_key
                        and c.external_subject_id = g.external_subject_id)
),
answers as (
    select *, row_number() over (partition by tenant_id, context_key, context_version order by level, position) as rank
    from offered qualify rank <= <<limit>>
)
""".replace("<<limit>>", str(LIMIT))
)


@query(
    "H4",
    _COMPOSED
    + """
select tenant_id, context_key, context_version, rank, external_subject_id, association_count, last_association_at,
       case level when 0 then 'context' else 'global' end as source_level from answers
""",
)
def composed_suggestions(spark, sf_dir):
    """Context results filled up with global ones, for every tenant and context."""
    return _composed(spark, sf_dir)[1]


def _ledger(spark, sf_dir):
    """Projection runs derived from orders: one run per order, open, failed or completed."""
    orders = adapters.read(spark, sf_dir, "orders")
    started = F.col("o_orderdate").cast("timestamp")
    minutes = F.make_interval(mins=(F.col("o_orderkey") % 600).cast("int"))
    closed = F.col("o_orderstatus") != "P"
    name = F.when(F.col("o_orderkey") % 3 == 0, F.lit("subject_context")).otherwise(F.lit("subject_global"))
    return orders.select(
        F.concat(F.lit("run-"), F.col("o_orderkey").cast("string")).alias("run_id"),
        name.alias("projection_name"), F.lit(1).alias("projection_version"),
        F.when(F.col("o_orderstatus") == "F", F.lit("completed")).when(F.col("o_orderstatus") == "O", F.lit("failed")).otherwise(F.lit("running")).alias("status"),
        started.alias("started_at"), F.when(closed, started + minutes).alias("completed_at"),
        (F.col("o_orderkey") % 31).alias("affected_days"), (F.col("o_orderkey") % 500).alias("rows_read"),
        (F.col("o_orderkey") % 100).alias("rows_written"), F.lit(None).cast("string").alias("last_error"),
    )


LEDGER = """
select 'run-' || cast(o_orderkey as string) as run_id, case when o_orderkey % 3 = 0 then 'subject_context' else 'subject_global' end as projection_name,
       case o_orderstatus when 'F' then 'completed' when 'O' then 'failed' else 'running' end as status, o_orderdate as started_at,
       case when o_orderstatus <> 'P' then o_orderdate + interval '1' minute * (o_orderkey % 600) end as completed_at,
       o_orderkey % 100 as rows_written
from orders
"""


@query(
    "H5",
    _COMPOSED
    + base.sql(
        """
, done as (select max(completed_at) filter (projection_name = 'subject_global') as g, max(completed_at) filter (projection_name = 'subject_context') + interval 152 days as c
           from (<<ledger>>) where status = 'completed'),
n as (select r.tenant_id, r.context_key, count(*) filter (level = 0) as own, count(*) filter (level = 1) as fill
      from requests r left join answers a using (tenant_id, context_key, context_version) group by all),
e as (
    select tenant_id, context_key, case when own > 0 and fill > 0 then 'mixed' when own > 0 then 'context' else 'global' end as source_level,
           case when own > 0 and fill > 0 then least(g, c) when own > 0 then c else g end as computed_at
    from n, done
)
select *, case when context_key in ('ctx-0', 'ctx-1') then 'registered' when context_key = 'ctx-2' then 'inactive_context' else 'unregistered' end as resolution_status,
       source_level <> 'context' as fallback_applied, computed_at < timestamp '2001-12-30 00:00:00' as is_stale,
       case when computed_at < timestamp '2001-12-30 00:00:00' then 'projection_stale' end as error
from e
""",
        ledger=LEDGER,
    ),
)
def suggestion_envelopes(spark, sf_dir):
    """Level, freshness and error of every composed answer."""
    requests, results = _composed(spark, sf_dir)
    statuses = suggestions.context_status(requests.select("context_key", "context_version").distinct(), base.definitions(spark))
    # The context runs go on for some months after the global ones have stopped, so answers from contexts alone are fresh.
    later = F.when(F.col("projection_name") == "subject_context", F.expr("interval 152 days")).otherwise(F.expr("interval 0 days"))
    ledger = _ledger(spark, sf_dir).withColumns({c: F.col(c) + later for c in ("started_at", "completed_at")})
    rows = suggestions.envelopes(requests, results, statuses, ledger, datetime(2002, 1, 1, tzinfo=timezone.utc))
    return rows.drop("context_version")


@query(
    "G8",
    base.sql(
        """
select projection_name, max(completed_at) as computed_at, epoch_us(timestamp '2001-12-31 12:00:00') - epoch_us(max(completed_at)) >= 86400000000 as due
from (<<ledger>>) where status = 'completed' group by projection_name
""",
        ledger=LEDGER,
    ),
)
def due_projections(spark, sf_dir):
    """Which projections should run."""
    at = F.lit("2001-12-31 12:00:00").cast("timestamp")
    return projections.due(_ledger(spark, sf_dir), 1, at)


@query(
    "L3",
    _DAILY
    + """
, days as (select tenant_id, local_date as d, sum(association_count) as a, sum(view_count) as v from global_daily group by all)
select tenant_id, p.period, p.value as period_value, cast(sum(a) as bigint) as association_count, cast(sum(v) as bigint) as view_count
from (select *, unnest([{'period': 'weekday', 'value': cast((isodow(d) - 1) as string)}, {'period': 'day_of_month', 'value': cast(day(d) as string)},
    {'period': 'week', 'value': strftime(date_trunc('week', d), '%Y-%m-%d')}, {'period': 'month', 'value': strftime(d, '%Y-%m')},
    {'period': 'quarter', 'value': cast(year(d) as string) || '-Q' || cast(quarter(d) as string)}, {'period': 'year', 'value': cast(year(d) as string)}]) as p
    from days)
group by tenant_id, p.period, p.value
""",
)
def period_roll_up(spark, sf_dir):
    """Daily rows rolled up to calendar periods."""
    from tideline.operators import designs

    return designs.roll_up(projections.daily(base.facts(spark, sf_dir)), ["tenant_id"])


@query(
    "L3",
    _DAILY
    + """
, days as (select tenant_id, local_date, sum(association_count) as a from global_daily group by all)
select tenant_id, local_date, cast(a as bigint) as association_count, cast(sum(a) over (partition by tenant_id order by local_date
       range between interval 6 days preceding and current row) as bigint) as moving_count from days
""",
)
def moving_week(spark, sf_dir):
    """Associations of the last seven local days per tenant."""
    from tideline.operators import designs

    return designs.moving_sum(projections.daily(base.facts(spark, sf_dir)), ["tenant_id"], 7)
