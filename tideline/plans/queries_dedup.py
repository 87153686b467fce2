"""Queries over the duplicate layers and the whole ingest path."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from tideline.operators import dedup, items, monitoring, validation
from tideline.plans import base, ingest
from tideline.plans.catalog import query
from tideline.session import cut
from tideline.sources import adapters

ORDER = ["received_at", "event_id", "stream_id"]


def _placed(spark, sf_dir):
    """Raw events with repeats on their site, narrow and without payloads."""
    raw = adapters.raw_text(spark, sf_dir).drop("properties", "context")
    return validation.join_sites(raw, base.sites(spark, sf_dir))


_PLACED = base.sql("(select r.*, s.tenant_id, s.site_id from (<<raw>>) r join (<<sites>>) s on s.site_code = r.site_code)", raw=base.RAW, sites=base.SITES)


def _repeats_sql(key: str, where: str) -> str:
    return f"""
select stream_id, {where} and row_number() over (partition by {key}, {where} order by received_at, event_id, stream_id) > 1 as repeat
from {_PLACED}
"""


@query("C1", _repeats_sql("event_id", "true"))
def exact_repeats(spark, sf_dir):
    """Repeats of an event id."""
    rows = adapters.raw_text(spark, sf_dir).select(*ORDER)
    keyed = rows.withColumn("_key", dedup.exact_key())
    return dedup.flag_repeats(keyed, ["_key"], F.struct(*ORDER)).select("stream_id", "repeat")


@query("C2", _repeats_sql("tenant_id, site_id, trim(idempotency_key)", "trim(idempotency_key) <> ''"))
def idempotency_repeats(spark, sf_dir):
    """Repeats of an idempotency key within a site; events without a key are never repeats."""
    rows = _placed(spark, sf_dir).withColumn("_key", dedup.scoped(F.col("idempotency_key")))
    narrow = rows.select(*ORDER, "_key", "idempotency_key")
    applies = F.trim("idempotency_key") != ""
    return dedup.flag_repeats(narrow, ["_key"], F.struct(*ORDER), applies=applies).select("stream_id", "repeat")


@query(
    "C3",
    _repeats_sql("tenant_id, site_id, logical_event_id", "(trim(idempotency_key) = '' and logical_event_id <> '')")
    + """
union all
select 'lay-' || cast(event_id as string) || '-0', event_type = 'error'
       and row_number() over (partition by user_id % 40, event_type = 'error' order by ts, 'lay-' || cast(event_id as string)) > 1
from events
""",
)
def logical_repeats(spark, sf_dir):
    """Repeats of a logical id, which only counts without an idempotency key."""
    layered = adapters.layered(spark, sf_dir).drop("properties", "context")
    both = _placed(spark, sf_dir).unionByName(validation.join_sites(layered, base.sites(spark, sf_dir)))
    rows = both.withColumn("_key", dedup.scoped(F.col("logical_event_id")))
    narrow = rows.select(*ORDER, "_key", "idempotency_key", "logical_event_id")
    applies = (F.trim("idempotency_key") == "") & (F.col("logical_event_id") != "")
    return dedup.flag_repeats(narrow, ["_key"], F.struct(*ORDER), applies=applies).select("stream_id", "repeat")


RULES = [
    {"event_name": "page_view", "window_ms": 21_600_000, "fields": ["session_id", "site_code"]},
    {"event_name": "subject_viewed", "window_ms": 3_600_000, "fields": ["tab_id", "path", "nothing"]},
]


@query(
    "C4 J5 M-hash",
    f"""
select stream_id, semantic_key, semantic_key is not null
       and row_number() over (partition by semantic_key order by received_at, event_id, stream_id) > 1 as repeat
from (
    select *, case when trim(idempotency_key) <> '' or logical_event_id <> '' then null
        when event_name = 'page_view' then sha256(concat_ws(chr(31), tenant_id, site_id, event_name, session_id, site_code))
             || ':' || cast(epoch_us(event_time) // 21600000000 as string)
        when event_name = 'subject_viewed' then sha256(concat_ws(chr(31), tenant_id, site_id, event_name, tab_id, path, ''))
             || ':' || cast(epoch_us(event_time) // 3600000000 as string) end as semantic_key
    from {_PLACED}
)
""",
)
def semantic_repeats(spark, sf_dir):
    """Repeats by semantic rule within a tumbling bucket of the event time."""
    rows = dedup.with_semantic_key(_placed(spark, sf_dir), RULES).select(*ORDER, "semantic_key")
    applies = F.col("semantic_key").isNotNull()
    return dedup.flag_repeats(rows, ["semantic_key"], F.struct(*ORDER), applies=applies).select(
        "stream_id", "semantic_key", "repeat"
    )


def _line_repeats(rows, name):
    events = items.with_lines(rows.where(F.col("event_name") == name))
    fields = items.key_fields(F.col("lines"), F.col("properties"))
    keyed = events.select(
        *ORDER, F.explode(dedup.item_keys(F.col("event_name"), fields, F.col("session_id"))).alias("_key")
    )
    flagged = dedup.flag_repeats(cut(keyed), ["_key"], F.struct(*ORDER))
    # One repeated line is enough to drop its event.
    return flagged.groupBy("event_id").agg(F.bool_or("repeat").alias("repeat"), F.count(F.lit(1)).alias("keys"))


_LINES = base.sql(
    """(select distinct e.event_id, e.received_at, e.stream_id, e.tenant_id, e.site_id, e.session_id, e.event_name,
        e.o_orderkey, e.o_custkey, trim(e.o_orderpriority) as surface, l.l_partkey, l.l_linenumber
        from (<<orders>>) e join lineitem l on l.l_orderkey = e.o_orderkey)""",
    orders=base.ORDER_EVENTS,
)


@query(
    "C5",
    f"""
with k as (select distinct event_id, received_at, stream_id, concat_ws(':', tenant_id, site_id, session_id, surface,
               'list-' || cast(o_custkey % 11 as string), cast(l_partkey as string), '') as key
           from {_LINES} where event_name = 'item_impression'),
r as (select event_id, row_number() over (partition by key order by received_at, event_id, stream_id) > 1 as again from k)
select event_id, bool_or(again) as repeat, count(*) as keys from r group by event_id
""",
)
def item_impression_repeats(spark, sf_dir):
    """Impressions of an item already seen in the same list, surface and session."""
    return _line_repeats(adapters.order_events(spark, sf_dir), "item_impression")


@query(
    "C6",
    f"""
with k as (select distinct event_id, received_at, stream_id, concat_ws(':', tenant_id, site_id, cast(o_orderkey as string),
               cast(l_linenumber as string)) as key from {_LINES} where event_name = 'purchase_completed'
           union all
           select 'lay-' || cast(event_id as string), ts, 'lay-' || cast(event_id as string) || '-0', 'layered o' || cast(user_id % 60 as string)
           from events where event_type = 'purchase'),
r as (select event_id, row_number() over (partition by key order by received_at, event_id, stream_id) > 1 as again from k)
select event_id, bool_or(again) as repeat, count(*) as keys from r group by event_id
""",
)
def purchase_line_repeats(spark, sf_dir):
    """Purchases with an order line that was reported before."""
    columns = [*ORDER, "event_name", "tenant_id", "site_id", "session_id", "properties"]
    layered = validation.join_sites(adapters.layered(spark, sf_dir), base.sites(spark, sf_dir))
    rows = adapters.order_events(spark, sf_dir).select(*columns).unionByName(layered.select(*columns))
    return _line_repeats(rows, "purchase_completed")


# Repeats share every key, so each row's fate follows from its kind: first, a minute later, a day later.
_DECIDED = base.sql(
    """
with d as (
    select r.*, s.tenant_id, s.site_id, cast(split_part(r.stream_id, '-', 2) as int) as turn, r.sequence as n,
        case when trim(event_name) = '' then 'invalid_payload'
             when n % 97 = 0 then 'blocked_key'
             when n % 101 = 0 or n % 1009 = 0 then 'payload_too_large' end as payload_reason,
        case when lower(trim(s.status)) <> 'active' then 'site_inactive'
             when not s.tracking_enabled then 'tracking_disabled'
             when event_source <> 'server' and s.token_version <> r.token_version then 'token_version_mismatch'
             when event_source <> 'server' and origin like '%evil%' then 'domain_not_allowed' end as site_reason
    from (select *, sequence as n from (<<raw>>)) r join (<<sites>>) s on s.site_code = r.site_code
),
decided as (
    select *, coalesce(payload_reason, site_reason, case when turn = 1 then 'duplicate_event'
                 when turn = 2 and n % 20 = 0 then 'idempotency_conflict' end) as reason,
           case when payload_reason is null and site_reason is null then
                case turn when 0 then 'inserted' when 2 then case when n % 20 = 0 then 'conflict' else 'duplicate_exact' end end end
               as outcome
    from d
)
""",
    raw=base.RAW,
    sites=base.SITES,
)


def _process(spark, sf_dir):
    raw = adapters.raw(spark, sf_dir)
    return ingest.process(raw, base.sites(spark, sf_dir), [], base.definitions(spark), adapters.REVISION)


@query("B13 C7 C8 C9 C10", _DECIDED + "select stream_id, reason, outcome from decided")
def event_decisions(spark, sf_dir):
    """Every raw event through all checks and the duplicate cascade: its reason and outcome."""
    return _process(spark, sf_dir).decided.select("stream_id", "reason", "outcome")


# In each hour the first impression that isn't refused stays, unless one of the hour before stayed: every second hour of a
# run of hours. A purchase stays a day after the last one that did; of a logical id the first stays, repeats within a day are
# dropped and later ones are conflicts; of a semantic key the first stays.
_LAYERED = """
with recursive e as (
    select *, 'lay-' || cast(event_id as string) || '-0' as stream_id, event_id % 211 = 0 as refused,
           cast(epoch_us(ts) // 3600000000 as bigint) as hour, cast(epoch_us(ts) // 21600000000 as bigint) as part
    from events
),
good as (select *, row_number() over (partition by user_id % 60 order by ts, 'lay-' || cast(event_id as string)) as rn
         from e where not refused and event_type = 'purchase'),
buys as (
    select stream_id, user_id % 60 as key, rn, ts as mark, true as stays from good where rn = 1
    union all
    select g.stream_id, w.key, g.rn, case when epoch_us(g.ts) - epoch_us(w.mark) >= 86400000000 then g.ts else w.mark end,
           epoch_us(g.ts) - epoch_us(w.mark) >= 86400000000
    from buys w join good g on g.user_id % 60 = w.key and g.rn = w.rn + 1
),
hours as (select distinct hour from e where not refused and event_type in ('signup', 'click')),
runs as (select hour, hour - row_number() over (order by hour) as run from hours),
stay as (select hour from (select hour, row_number() over (partition by run order by hour) as place from runs) where place % 2 = 1),
judged as (
    select e.stream_id, refused, event_type,
           case when event_type = 'purchase' then b.stays
                when event_type = 'view' then row_number() over (partition by refused, event_type, user_id % 7, part order by ts, e.stream_id) = 1
                when event_type = 'error' then row_number() over (partition by refused, event_type, user_id % 40 order by ts, e.stream_id) = 1
                else s.hour is not null and row_number() over (partition by refused, event_type in ('signup', 'click'), e.hour order by ts, e.stream_id) = 1
           end as stays,
           epoch_us(ts) - min(epoch_us(ts)) over (partition by refused, event_type, user_id % 40) < 86400000000 as fresh
    from e left join buys b on b.stream_id = e.stream_id left join stay s on s.hour = e.hour
)
select stream_id,
       case when refused then 'blocked_key' when stays then null when event_type <> 'error' then 'duplicate_semantic_event'
            when fresh then 'duplicate_logical_event' else 'idempotency_conflict' end as reason,
       case when refused then null when stays then 'inserted' when event_type = 'error' and not fresh then 'conflict' end as outcome,
       case when refused or stays or (event_type = 'error' and not fresh) then
                case event_type when 'error' then 'logical' when 'view' then 'semantic' else 'none' end
            else case event_type when 'error' then 'logical' when 'view' then 'semantic' when 'purchase' then 'purchase_line' else 'item_impression' end
       end as strategy
from judged
"""


@query("B13 C3 C4 C5 C6 C7 C8 C10", _LAYERED)
def layered_decisions(spark, sf_dir):
    """Events of all duplicate layers through the whole path, among them a chain of impressions over the whole time."""
    sites = base.sites(spark, sf_dir)
    decided = ingest.process(adapters.layered(spark, sf_dir), sites, RULES, base.definitions(spark), adapters.REVISION).decided
    return decided.select("stream_id", "reason", "outcome", F.col("dedup_strategy").alias("strategy"))


@query(
    "C12 K1",
    _DECIDED + "select coalesce(outcome, 'not_persisted') as outcome, count(*) as events from decided group by 1",
)
def persistence_outcomes(spark, sf_dir):
    """Counts of persistence outcomes."""
    decided = _process(spark, sf_dir).decided
    return monitoring.outcome_counts(decided.select(F.coalesce("outcome", F.lit("not_persisted")).alias("outcome")))


@query(
    "I5 B14",
    _DECIDED
    + """
select stream_id, event_id, tenant_id, reason, case when reason = 'domain_not_allowed' then 'suspicious' else 'warning' end as severity,
       case when reason = 'duplicate_event' then 'exact' when reason <> 'idempotency_conflict' then ''
            when n % 3 <> 2 then 'idempotency' else 'none' end as strategy,
       case when reason = 'blocked_key' then 'Password ' end as blocked_key,
       case when reason = 'payload_too_large' then case when n % 101 = 0 then 'properties_depth' else 'properties_size' end end as payload_issue,
       case when reason = 'idempotency_conflict' then 'event_id' end as conflict_field
from decided where reason is not null
""",
)
def rejected_events(spark, sf_dir):
    """Audit rows of rejected events with their minimal payload."""
    rows = _process(spark, sf_dir).rejected
    part = lambda name: F.get_json_object("raw_payload", f"$.{name}")
    return rows.select(
        "stream_id", "event_id", "tenant_id", "reason", "severity", part("dedup_strategy").alias("strategy"),
        part("blocked_key").alias("blocked_key"), part("payload_issue").alias("payload_issue"),
        part("conflict_field").alias("conflict_field"),
    )


@query(
    "C11",
    base.sql(
        """
select event_id, count(*) as copies, case when sequence % 20 = 0 then 2 else 1 end as fingerprints
from (<<raw>>) group by event_id, sequence
""",
        raw=base.RAW,
    ),
)
def event_fingerprints(spark, sf_dir):
    """How many different events hide behind one event id."""
    raw = adapters.raw(spark, sf_dir)
    placed = validation.join_sites(raw, base.sites(spark, sf_dir))
    hashed = placed.select("event_id", dedup.fingerprint(ingest.stored_context(None)).alias("fp"))
    return hashed.groupBy("event_id").agg(
        F.count(F.lit(1)).alias("copies"), F.count_distinct("fp").alias("fingerprints")
    )


@query(
    "C9 C10",
    base.sql(
        """
select stream_id,
       case when n % 4 = 0 then 'duplicate_exact' when n % 4 = 1 then 'conflict'
            when n % 4 = 2 then case when n % 3 = 0 then 'duplicate_logical' when n % 3 = 1 then 'duplicate_idempotency' else 'inserted' end
            else 'inserted' end as outcome,
       case when n % 4 in (0, 1) then 'event_id'
            when n % 4 = 2 and n % 3 = 0 then 'logical_event_id' when n % 4 = 2 and n % 3 = 1 then 'idempotency_key' end as existing_field
from (select *, sequence as n from (<<raw>>))
""",
        raw=base.RAW_ONCE,
    ),
)
def stored_conflicts(spark, sf_dir):
    """New events against the stored table: same, repeated under another id, changed, or new."""
    n = F.col("sequence")
    raw = adapters.raw(spark, sf_dir, repeats=False)
    placed = dedup.with_semantic_key(validation.join_sites(raw, base.sites(spark, sf_dir)), [])
    none = F.array().cast("array<string>")

    def keyed(df):
        context = ingest.stored_context(None)
        return df.withColumns({"fp": dedup.fingerprint(context), "keys": dedup.cascade_keys(none), "row": F.col("stream_id")})

    stored = keyed(placed).select("event_id", "fp", F.inline("keys")).where("unique").select("kind", "key", "event_id", "fp")
    other = F.concat(F.lit("new-"), F.col("event_id"))
    incoming = placed.withColumns(
        {
            "event_id": F.when(n % 4 >= 2, other).otherwise(F.col("event_id")),
            "properties": F.when(n % 4 == 1, F.parse_json(F.lit('{"other":1}'))).otherwise(F.col("properties")),
            "logical_event_id": F.when(n % 4 == 3, F.lit("")).otherwise(F.col("logical_event_id")),
            "idempotency_key": F.when(n % 4 == 3, F.lit("")).otherwise(F.col("idempotency_key")),
        }
    )
    return dedup.classify(keyed(incoming), stored).select("stream_id", "outcome", "existing_field")


@query(
    "C13",
    """
with recursive v as (
    select event_id, ts, 'k' || cast(user_id % 40 as string) as key,
           row_number() over (partition by user_id % 40 order by ts, event_id) as rn
    from events
),
walk as (
    select key, rn, event_id, ts as last_kept, true as kept from v where rn = 1
    union all
    select v.key, v.rn, v.event_id,
           case when epoch_us(v.ts) - epoch_us(w.last_kept) >= 1800000000 then v.ts else w.last_kept end,
           epoch_us(v.ts) - epoch_us(w.last_kept) >= 1800000000
    from walk w join v on v.key = w.key and v.rn = w.rn + 1
)
select event_id, kept from walk
""",
)
def page_view_debounce(spark, sf_dir):
    """Views that come too soon after the last kept one of their key (here half an hour)."""
    rows = adapters.read(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("k"), (F.col("user_id") % 40).cast("string")).alias("key"),
    )
    return dedup.debounce(rows, ["key"], "ts", timedelta(minutes=30), ["ts", "event_id"]).select("event_id", "kept")


@query(
    "C1 C8",
    """
with recursive k as (
    select event_id, user_id, ts, row_number() over (partition by user_id order by ts, event_id) as rn from events
),
walk as (
    select user_id, rn, event_id, ts as mark, true as kept from k where rn = 1
    union all
    select k.user_id, k.rn, k.event_id,
           case when epoch_us(k.ts) - epoch_us(w.mark) >= 604800000000 then k.ts else w.mark end,
           epoch_us(k.ts) - epoch_us(w.mark) >= 604800000000
    from walk w join k on k.user_id = w.user_id and k.rn = w.rn + 1
)
select event_id, kept from walk
""",
)
def expiring_keys(spark, sf_dir):
    """One event per user and week of key lifetime: a key counts until it expires, then anew."""
    events = adapters.read(spark, sf_dir, "events")
    at = F.col("ts").cast("timestamp")
    keys = F.array(
        F.struct(
            F.lit("exact").alias("kind"), F.col("user_id").cast("string").alias("key"),
            F.lit(1).alias("layer"), F.lit(False).alias("unique"),
        )
    ).cast(dedup.KEYS)
    rows = events.select(
        "event_id", F.struct(at.alias("at"), F.col("event_id").alias("id")).alias("arrival"), at.alias("at"),
        F.lit("").alias("fp"), keys.alias("keys"),
    )
    kept = cut(dedup.cascade(rows, timedelta(days=7))).select("event_id", F.lit(True).alias("kept"))
    return events.select("event_id").join(kept, "event_id", "left").fillna(False, ["kept"])
