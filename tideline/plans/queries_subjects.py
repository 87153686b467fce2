"""Queries over subject facts, the subject dimension and the context registry."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from tideline.operators import dimension, registry, subjects
from tideline.plans import base, ingest
from tideline.plans.catalog import query
from tideline.sources import adapters, dimensions


@query(
    "D8 D9 D10 D12 D13 D14 I4 M-date",
    base.FACTS
    + """
select event_id, subject_ordinal, event_name, subject_type, external_subject_id, relation, operation_id, context_key, context_version,
       timezone_name, local_date, normalization_status, normalization_reason, initial_status
from facts
""",
)
def subject_facts(spark, sf_dir):
    """Event-subject facts with their normalization."""
    rows = subjects.subject_rows(base.valid_raw(spark, sf_dir))
    return rows.select(
        "event_id", "subject_ordinal", "event_name", "subject_type", "external_subject_id", "relation", "operation_id",
        "context_key", "context_version", "timezone_name", "local_date", "normalization_status", "normalization_reason",
        "initial_status",
    )


@query(
    "D1 D2",
    base.sql(
        """
select r.event_id, s.tenant_id, s.site_id, s.timezone, case when event_source = 'server' then 'server' else 'web' end as event_source,
       '{"_snapshot":{"context_registry_revision":"rev-1","event_source":"' || case when event_source = 'server' then 'server' else 'web' end
       || '","timezone":"' || s.timezone || '"}' || case when r.context = '{}' then '' else
          ',"claimed_context_family":"search","context_key":"' || regexp_extract(r.context, 'ctx-[0-9]') || '","context_version":1' end || '}' as context
from (<<raw>>) r join (<<sites>>) s on s.site_code = r.site_code where trim(r.event_name) <> ''
""",
        raw=base.RAW_ONCE,
        sites=base.SITES,
    ),
)
def validated_events(spark, sf_dir):
    """Validated events with tenant, site and the context snapshot."""
    rows = base.valid_raw(spark, sf_dir).withColumn("context", ingest.stored_context(adapters.REVISION))
    return rows.select("event_id", "tenant_id", "site_id", "timezone", "event_source", F.to_json("context").alias("context"))


# Server events with a lifecycle object of every kind.
_LIFE = """
select 'lc-' || cast(c_custkey as string) as event_id, c_custkey as n,
       case c_custkey % 4 when 0 then 'subject_deactivated' when 1 then 'subject_reactivated' when 2 then 'subject_merged' else 'subject_viewed' end as event_name,
       '{{"subjects":[{{"subject_type":"customer","subject_id":"' || cast(c_custkey as string) || '"}}]'
       || case when c_custkey % 5 = 0 then '' else ',"lifecycle":{{"source_updated_at":"2024-01-05T10:00:00' || case when c_custkey % 7 = 0 then '+02:00' else '+00:00' end
            || '","source_mutation_id":"' || case when c_custkey % 11 = 0 then ' ' else 'm' end || '"'
            || case when c_custkey % 13 = 0 then ',"effective_at":"soon"' else '' end
            || case when c_custkey % 4 = 2 and c_custkey % 3 <> 0 then ',"merged_into_subject_id":"' || case when c_custkey % 17 = 0 then cast(c_custkey as string) else 't' end || '"' else '' end
            || '}}' end || '}}' as properties
from {customer}
"""


@query(
    "D11",
    base.sql(
        """
with v as (
    select *, case when n % 4 = 3 then n % 5 = 0
                   else n % 5 <> 0 and n % 7 <> 0 and n % 11 <> 0 and n % 13 <> 0 and (n % 4 <> 2 or n % 3 <> 0) end as parsed
    from (<<life>>)
),
w as (select *, parsed and not (n % 4 = 2 and n % 17 = 0) as good from v)
select event_id, case when good then 'normalized' else 'invalid_subject' end as normalization_status,
       case when not good then 'invalid_lifecycle' end as normalization_reason,
       case when parsed and n % 4 <> 3 then timestamp '2024-01-05 10:00:00' end as lifecycle_source_updated_at,
       case when parsed and n % 4 = 2 then case when n % 17 = 0 then cast(n as string) else 't' end end as merged_into_external_subject_id
from w
""",
        life=_LIFE.format(customer="customer"),
    ),
)
def lifecycle_facts(spark, sf_dir):
    """Lifecycle objects parsed and judged."""
    rows = spark.sql(_LIFE, customer=adapters.read(spark, sf_dir, "customer")).withColumns(
        {
            "properties": F.parse_json("properties"), "context": F.parse_json(F.lit("{}")),
            "event_time": F.lit("2024-01-05 10:00:00").cast("timestamp"), "timezone": F.lit("UTC"), "zone": F.lit("UTC"),
            "event_source": F.lit("server"), "tenant_id": F.lit("tenant-0"),
        }
    )
    return subjects.subject_rows(rows).select(
        "event_id", "normalization_status", "normalization_reason", "lifecycle_source_updated_at", "merged_into_external_subject_id"
    )


# --- dimension -------------------------------------------------------------------------------

_LC = base.LIFECYCLE


@query(
    "E2",
    base.sql(
        """
with t as (select *, row(source_updated_at, source_mutation_id) as mark from (<<lc>>))
select event_id, coalesce(mark <= max(mark) over (partition by tenant_id, external_subject_id order by received_at, event_id
       rows between unbounded preceding and 1 preceding), false) as ignored
from t
""",
        lc=_LC,
    ),
)
def lifecycle_order(spark, sf_dir):
    """Lifecycle changes that came too late or twice, by arrival."""
    rows = dimension.flag_ignored(adapters.lifecycle_rows(spark, sf_dir), bucket_seconds=30 * 86400)
    return rows.select("event_id", (F.col("normalization_status") == "lifecycle_ignored").alias("ignored"))


def _dimension(spark, sf_dir, facts=None):
    """Identities from events, ordered changes from orders, and a valid snapshot, folded at once."""
    seen = dimension.changes_from_events(base.facts(spark, sf_dir) if facts is None else facts)
    changes = dimension.changes_from_events(adapters.lifecycle_rows(spark, sf_dir))
    valid = dimensions.check_snapshot(adapters.snapshot(spark, sf_dir)).where("row_valid")
    return dimension.fold(seen.unionByName(changes).unionByName(dimension.changes_from_snapshot(valid)))


_DIMENSION = base.FACTS + base.sql(
    """
, snap as (
    select * from (<<snapshot>>)
    where source_updated_at <> 'yesterday' and (lifecycle_status <> 'merged' or merged_into_external_subject_id is not null)
),
changes as (
    select tenant_id, external_subject_id, source_updated_at, source_mutation_id, received_at as seen_at, event_id as tie,
           case event_name when 'subject_deactivated' then 'inactive' when 'subject_reactivated' then 'active' else 'merged' end as status,
           merge_target as target
    from (<<lc>>)
    union all
    select tenant_id, external_subject_id, timestamp '1998-06-01 00:00:00', source_mutation_id, timestamp '1998-06-01 00:00:00', '', lifecycle_status,
           case when lifecycle_status = 'merged' then merged_into_external_subject_id end from snap
),
ids as (
    select tenant_id, external_subject_id, initial_status = 'active' as confirmed from facts
    where normalization_status in ('normalized', 'timezone_unresolved')
    union all select tenant_id, external_subject_id, false from changes
    union all select tenant_id, target, false from changes where target is not null
),
latest as (
    select * from changes
    qualify row_number() over (partition by tenant_id, external_subject_id
        order by source_updated_at desc, source_mutation_id desc, seen_at, tie) = 1
),
subjects as (
    select i.tenant_id, 'customer' as subject_type, i.external_subject_id,
           coalesce(max(l.status), case when bool_or(i.confirmed) then 'active' else 'unknown' end) as lifecycle_status,
           max(l.source_mutation_id) as lifecycle_source_mutation_id, max(l.source_updated_at) as lifecycle_source_updated_at,
           max(l.target) as merged_into_external_subject_id
    from ids i left join latest l on l.tenant_id = i.tenant_id and l.external_subject_id = i.external_subject_id
    group by i.tenant_id, i.external_subject_id
)
""",
    lc=_LC,
    snapshot=base.SNAPSHOT,
)


@query(
    "E1 E2 E3 E4",
    _DIMENSION
    + """
select tenant_id, external_subject_id, lifecycle_status, lifecycle_source_mutation_id, lifecycle_source_updated_at,
       merged_into_external_subject_id from subjects
""",
)
def subject_dimension(spark, sf_dir):
    """The subject dimension from identities, ordered changes and a snapshot."""
    return _dimension(spark, sf_dir).select(
        "tenant_id", "external_subject_id", "lifecycle_status", "lifecycle_source_mutation_id",
        "lifecycle_source_updated_at", "merged_into_external_subject_id",
    )


@query(
    "E3",
    _DIMENSION
    + """
select s.tenant_id, s.external_subject_id, s.merged_into_external_subject_id, t.lifecycle_status as target_status
from subjects s left join subjects t on t.tenant_id = s.tenant_id and t.external_subject_id = s.merged_into_external_subject_id
where s.lifecycle_status = 'merged'
""",
)
def merge_targets(spark, sf_dir):
    """Merged subjects and the state of their target, one hop away."""
    rows = dimension.merge_targets(_dimension(spark, sf_dir))
    return rows.select("tenant_id", "external_subject_id", "merged_into_external_subject_id", "target_status")


@query(
    "E8 E9",
    _DIMENSION
    + """
select tenant_id, count(*) as subject_count, count(*) filter (lifecycle_status = 'active') as eligible,
       count(*) filter ((lifecycle_status = 'merged') = (merged_into_external_subject_id is not null)
           and merged_into_external_subject_id is distinct from external_subject_id) as valid
from subjects group by tenant_id
""",
)
def eligible_subjects(spark, sf_dir):
    """Eligible and valid subjects per tenant."""
    rows = _dimension(spark, sf_dir)
    return rows.groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("subject_count"),
        F.count_if(F.col("lifecycle_status") == "active").alias("eligible"),
        F.count_if(dimension.lifecycle_valid() & dimension.identity_valid()).alias("valid"),
    )




@query(
    "E7",
    base.FACTS
    + """
, k as (select *, case when n % 2 = 0 then 'day-' || cast(cast(event_time as date) as string) else '' end as ikey from facts),
r as (
    select *, ikey <> '' and row_number() over (partition by tenant_id, event_name, ikey, subject_type, external_subject_id, relation
          order by received_at, event_id, subject_ordinal) > 1 as again from k
)
select event_id, subject_ordinal, case when not again then nullif(ikey, '') end as idempotency_key,
       case when again then 'idempotency_conflict' else normalization_status end as normalization_status from r
""",
)
def subject_idempotency(spark, sf_dir):
    """Facts that repeat a subject's idempotency key, kept for audit."""
    n = F.substring("event_id", 5, 20).cast("bigint")
    day = F.concat(F.lit("day-"), F.to_date("event_time").cast("string"))
    rows = base.facts(spark, sf_dir).withColumn("idempotency_key", F.when(n % 2 == 0, day).otherwise(F.lit("")))
    return dimension.flag_idempotency(rows).select("event_id", "subject_ordinal", "idempotency_key", "normalization_status")


# --- registry --------------------------------------------------------------------------------

# Registry documents of a hundred definitions each, taken from the parts; flaws included.
_CONTEXTS = """
select 'rev-' || cast(p_partkey // 100 as string) as registry_revision, p_partkey as n,
       case when p_partkey % 211 = 0 then '' else 'ctx-' || cast(p_partkey % 100 as string) end as context_key, 1 as context_version,
       case when p_partkey % 97 = 1 then 'other' when p_size % 2 = 0 then 'search' else 'support' end as context_family,
       case when p_partkey % 100 = 0 then null when p_partkey % 89 = 3 then 'ctx-missing'
            when p_partkey % 300 = 7 then 'ctx-9' when p_partkey % 300 = 8 then 'ctx-7' when p_partkey % 300 = 9 then 'ctx-8'
            else 'ctx-' || cast((p_partkey % 100) // 2 as string) end as parent_context_key,
       case when p_partkey % 100 = 0 or p_partkey % 83 = 2 then null else 1 end as parent_context_version,
       case when p_size % 5 = 0 then 'inactive' else 'active' end as status
from {part}
"""
_CONTEXTS_SPARK = _CONTEXTS.replace("//", "div")
_CONTEXTS_SQL = _CONTEXTS.format(part="part")


def _registries(spark, sf_dir):
    rows = spark.sql(_CONTEXTS_SPARK, part=adapters.read(spark, sf_dir, "part"))
    context = F.struct(
        "context_key", "context_version", "context_family", "parent_context_key", "parent_context_version", "status"
    )
    documents = rows.groupBy("registry_revision").agg(
        F.sort_array(F.collect_list(F.struct("n", context.alias("c")))).alias("l"), F.min("n").alias("first")
    )
    return documents.select(
        F.lit(1).alias("schema_version"),
        (F.floor(F.col("first") / 100) % 4).cast("bigint").alias("registry_version"),
        "registry_revision",
        F.transform("l", lambda x: x["c"]).alias("contexts"),
    )


@query(
    "F1 A11",
    base.sql(
        """
with recursive c as (select * from (<<contexts>>)),
link as (select registry_revision as r, context_key as k, parent_context_key as p from c
         where parent_context_key is not null and parent_context_version is not null),
walk as (
    select r, k as origin, p as here, 1 as steps from link
    union all
    select w.r, w.origin, l.p, w.steps + 1 from walk w join link l on l.r = w.r and l.k = w.here where w.steps < 110 and w.here <> w.origin
)
select registry_revision, 'header' as rule, cast(null as string) as context_key from c
    group by registry_revision having min(n) // 100 % 4 = 0
union all
select registry_revision, 'definition', context_key from c where context_key = '' or context_family = 'other'
union all
select registry_revision, 'duplicate', context_key from c group by registry_revision, context_key having count(*) > 1
union all
select registry_revision, 'half_parent', context_key from c where (parent_context_key is null) <> (parent_context_version is null)
union all
select registry_revision, 'missing_parent', context_key from c
where parent_context_key is not null and parent_context_version is not null
  and not exists (select 1 from c p where p.registry_revision = c.registry_revision and p.context_key = c.parent_context_key)
union all
select distinct r, 'cycle', origin from walk where here = origin
""",
        contexts=_CONTEXTS_SQL,
    ),
)
def registry_violations(spark, sf_dir):
    """Broken rules of registry documents, cycles included."""
    return registry.violations(_registries(spark, sf_dir)).select("registry_revision", "rule", "context_key")


@query(
    "F2",
    base.sql(
        """
select registry_revision, sha256('{"schema_version":1,"registry_version":' || cast(min(n) // 100 % 4 as string) || ',"registry_revision":"' || registry_revision
       || '","contexts":[' || string_agg('{"context_key":"' || context_key || '","context_version":1,"context_family":"' || context_family
       || '","parent_context_key":' || coalesce('"' || parent_context_key || '"', 'null') || ',"parent_context_version":'
       || coalesce(cast(parent_context_version as string), 'null') || ',"status":"' || status || '"}', ',' order by n) || ']}') as payload_checksum
from (<<contexts>>) group by registry_revision
""",
        contexts=_CONTEXTS_SQL,
    ),
)
def registry_checksums(spark, sf_dir):
    """Checksums of registry documents."""
    return registry.checksum(_registries(spark, sf_dir)).select("registry_revision", "payload_checksum")


# A clean registry from regions and their nations, published in two revisions. A registry is one
# document, and these two tables are as small as one.
def _documents(spark, sf_dir):
    region, nation = adapters.read(spark, sf_dir, "region"), adapters.read(spark, sf_dir, "nation")

    def key(prefix, column):
        return F.concat(F.lit(prefix), F.col(column).cast("string"))

    def context(name, parent, status):
        return F.struct(
            name.alias("context_key"), F.lit(1).alias("context_version"), F.lit("navigation").alias("context_family"),
            parent.alias("parent_context_key"), F.when(parent.isNotNull(), F.lit(1)).alias("parent_context_version"),
            status.alias("status"),
        )

    def document(version):
        inactive = F.col("n_nationkey") % (version + 1) == 0
        tops = region.select(context(key("region-", "r_regionkey"), F.lit(None).cast("string"), F.lit("active")).alias("c"))
        leaves = nation.select(
            context(
                key("nation-", "n_nationkey"), key("region-", "n_regionkey"),
                F.when(inactive, F.lit("inactive")).otherwise(F.lit("active")),
            ).alias("c")
        )
        return tops.unionByName(leaves).groupBy().agg(F.sort_array(F.collect_list("c")).alias("contexts")).select(
            F.lit(1).alias("schema_version"), F.lit(version).cast("bigint").alias("registry_version"),
            F.lit(f"rev-{version}").alias("registry_revision"), "contexts",
        )

    return document(1), document(2)


@query(
    "F3 F5",
    """
select 'region-' || cast(r_regionkey as string) as context_key, 'active' as status, 'rev-2' as registry_revision from region
union all
select 'nation-' || cast(n_nationkey as string), case when n_nationkey % 3 = 0 then 'inactive' else 'active' end, 'rev-2' from nation
""",
)
def registry_publication(spark, sf_dir):
    """Two revisions published one after the other; the definitions of the active one."""
    first, second = _documents(spark, sf_dir)
    tables = registry.empty_tables(spark)
    for document, day in ((first, 1), (second, 2), (first, 3)):
        # The third load offers an older version again and is refused.
        tables, _ = registry.refresh(document, tables, datetime(2024, 1, day, tzinfo=timezone.utc))
    return registry.active_definitions(*tables).select("context_key", "status", "registry_revision")


@query(
    "F6",
    base.FACTS + "select event_id, subject_ordinal, context_resolution_status, resolved_context_family from facts",
)
def context_resolution(spark, sf_dir):
    """Facts resolved against the active revision."""
    return base.facts(spark, sf_dir).select(
        "event_id", "subject_ordinal", "context_resolution_status", "resolved_context_family"
    )


def _history(spark, sf_dir):
    """Facts of which only a quarter was resolved while they came in, resolved afterwards."""
    n = F.substring("event_id", 5, 20).cast("bigint")
    rows = subjects.subject_rows(base.valid_raw(spark, sf_dir)).withColumns(
        {"context_registry_revision": F.when(n % 4 == 0, F.lit("rev-0")), "updated_at": F.col("received_at")}
    )
    definitions = base.definitions(spark)
    published = definitions.select("context_key", "context_version", "context_family")
    return rows, registry.resolve_history(
        rows, published, definitions.select("context_key", "context_version", "status"), adapters.REVISION,
        datetime(2024, 2, 1, tzinfo=timezone.utc),
    )


_HISTORY = base.FACTS + """
, h as (
    select *, case when n % 4 = 0 then 'registry_disabled' when context_key is null then 'family_unresolved'
                   when context_key = 'ctx-3' then 'unregistered' when context_key = 'ctx-2' then 'inactive_context' else 'registered' end as new_status
    from facts
)
"""


@query(
    "F7",
    _HISTORY
    + """
select event_id, subject_ordinal, new_status as context_resolution_status, case when n % 4 = 0 then 'rev-0' else 'rev-1' end as context_registry_revision,
       case when n % 4 = 0 then received_at else timestamp '2024-02-01 00:00:00' end as updated_at,
       case when n % 4 <> 0 then case context_key when 'ctx-0' then 'search' when 'ctx-1' then 'selection' when 'ctx-2' then 'support' end end
           as resolved_context_family
from h
""",
)
def history_resolution(spark, sf_dir):
    """Resolution of facts no revision has seen yet."""
    return _history(spark, sf_dir)[1].select(
        "event_id", "subject_ordinal", "context_resolution_status", "context_registry_revision", "updated_at", "resolved_context_family"
    )


@query(
    "F8 K1",
    base.FACTS
    + """
select context_key, context_version, 'search' as claimed_context_family, min(event_time) as first_seen_at, max(event_time) as last_seen_at,
       count(*) as event_count, 'pending' as reconciliation_status
from facts where context_resolution_status = 'unregistered' group by context_key, context_version
""",
)
def unregistered_contexts(spark, sf_dir):
    """Counters of unregistered contexts, merged from two halves."""
    rows = base.facts(spark, sf_dir)
    early = F.col("event_time") < F.lit("2024-01-15").cast("timestamp")
    return registry.merge_unregistered(registry.unregistered(rows.where(early)), registry.unregistered(rows.where(~early)))


@query(
    "L4",
    _HISTORY
    + """
select 'registry_disabled' as old_status, new_status, count(*) as facts from h where n % 4 <> 0 group by new_status
""",
)
def context_reconciliation(spark, sf_dir):
    """Dry run of a history resolution over the unresolved facts."""
    from tideline.operators import designs

    rows, resolved = _history(spark, sf_dir)
    return designs.reconcile_contexts(rows, resolved, F.col("context_registry_revision").isNull())


@query(
    "L5",
    _DIMENSION
    + """
, raw_snap as (select * from (<<snapshot>>)),
j as (
    select coalesce(s.tenant_id, n.tenant_id) as tenant_id, coalesce(s.external_subject_id, n.external_subject_id) as external_subject_id,
           s.lifecycle_status as stored_status, n.lifecycle_status as source_status,
           s.merged_into_external_subject_id as st, n.merged_into_external_subject_id as nt
    from subjects s full join raw_snap n on n.tenant_id = s.tenant_id and n.external_subject_id = s.external_subject_id
)
select tenant_id, external_subject_id, stored_status, source_status,
       case when source_status is null then 'missing_in_source' when source_status = 'inactive' and stored_status <> 'inactive' then 'source_inactive'
            when source_status = 'merged' and stored_status <> 'merged' then 'source_merged'
            when stored_status is null or source_status <> stored_status or st is distinct from nt then 'conflicting_state' end as finding
from j where source_status is null or stored_status is null or source_status <> stored_status or st is distinct from nt
""".replace("<<snapshot>>", base.SNAPSHOT),
)
def subject_reconciliation(spark, sf_dir):
    """Differences between the dimension and the source snapshot."""
    from tideline.operators import designs

    return designs.reconcile_subjects(_dimension(spark, sf_dir), adapters.snapshot(spark, sf_dir))


