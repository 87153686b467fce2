"""Inputs of the pipeline derived from the driver's tables.

Each adapter is one SELECT that Spark and the checking engine both run, so both sides see the same
raw input and everything after it is computed independently. The remainders only vary the payloads
(a blocked key here, a deep payload there); every row of the tables is used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# --- site table: nation and region ------------------------------------------------------------

SITES = """
select 'site-' || cast(n.n_nationkey as string) as site_code,
       'tenant-' || cast(n.n_regionkey as string) as tenant_id,
       's' || cast(n.n_nationkey as string) as site_id,
       case when n.n_nationkey = 24 then 'inactive' else ' Active' end as status,
       n.n_nationkey <> 23 as tracking_enabled,
       'https://WWW.shop-' || cast(n.n_nationkey as string) || '.example.com.,alt-'
           || cast(n.n_nationkey as string) || '.example.org:8443' as domains,
       case when n.n_nationkey = 22 then 2 else 1 end as token_version,
       cast(case when n.n_nationkey = 19 then 0 else 0.5 end as double) as sample_rate,
       1 as schema_version,
       case when n.n_nationkey = 21 then 'Mars/Olympus'
            when n.n_nationkey = 20 then ''
            when r.r_regionkey = 0 then 'UTC'
            when r.r_regionkey = 1 then 'America/Argentina/Buenos_Aires'
            when r.r_regionkey = 2 then 'Asia/Kolkata'
            when r.r_regionkey = 3 then 'Europe/Madrid'
            else 'America/New_York' end as timezone
from {nation} n join {region} r on n.n_regionkey = r.r_regionkey
"""

# --- raw subject events: events ---------------------------------------------------------------

_K = "cast(regexp_extract(e.props, '([0-9]+)', 1) as bigint)"

RAW_EVENTS = f"""
select e.stream_id,
       'evt-' || cast(e.event_id as string) as event_id,
       case when e.event_id % 3 = 0 then 'log-' || cast(e.event_id as string) else '' end as logical_event_id,
       case when e.event_id % 3 <> 2 then ' idem-' || cast(e.event_id as string) else '' end as idempotency_key,
       'tab-' || cast(e.user_id % 3 as string) as tab_id,
       cast(e.event_id as bigint) as sequence,
       case when e.event_id % 5 = 0 and e.event_id > 0 then 'log-' || cast(e.event_id - 3 as string) else '' end
           as previous_logical_event_id,
       case when e.event_id % 4 = 0 then 'server' when e.event_id % 4 = 1 then '' else 'web' end as event_source,
       'site-' || cast(e.user_id % 25 as string) as site_code,
       'production' as env,
       1 as token_version,
       'jti-' || cast(e.user_id as string) as jwt_id,
       case when e.event_id % 211 = 0 then ' '
            when e.event_type = 'view' then 'subject_viewed'
            when e.event_type = 'click' then 'subject_selected'
            when e.event_type = 'purchase' then 'subject_associated'
            when e.event_type = 'signup' then 'subject_impression'
            else 'page_view' end as event_name,
       1 as event_version,
       e.ts as event_time,
       e.ts + interval '1' second * (e.delay + e.event_id * 37 % 900) as received_at,
       'anon-' || cast(e.user_id as string) as anonymous_id,
       'sess-' || cast(e.user_id as string) || '-' || cast(cast(e.ts as date) as string) as session_id,
       'u-' || cast(e.user_id as string) as user_id,
       case when e.event_id % 53 = 0 then 'https://evil.example.net'
            else 'https://shop-' || cast(e.user_id % 25 as string) || '.example.com' end as origin,
       'https://shop-' || cast(e.user_id % 25 as string) || '.example.com/p/' || cast({_K} % 10 as string) as url,
       '/p/' || cast({_K} % 10 as string) as path,
       '' as referrer,
       'agent' as user_agent,
       '' as ip_hash,
       'web-sdk' as sdk_name,
       '0.1.0' as sdk_version,
       '{{{{"subjects":' || case
            when e.event_id % 61 = 0 then '"none"'
            else '[{{{{"subject_type":"customer","subject_id":"' || cast(e.user_id as string)
                || '","relation":"primary"}}}}'
                || case when e.event_id % 7 = 0 then ',{{{{"subject_type":"customer","subject_id":" '
                       || cast(e.user_id as string) || '","relation":"primary"}}}}'
                       || ',{{{{"subject_type":"customer","subject_id":"' || cast(e.user_id + 5 as string)
                       || '","relation":"related"}}}}' else '' end
                || case when e.event_id % 41 = 0 then ',"oops"' else '' end
                || case when e.event_id % 43 = 0 then ',{{{{"subject_type":"account","subject_id":"a1"}}}}' else '' end
                || ']' end
           || case when e.event_id % 47 = 0 then ',"operation":"bad"'
                   when e.event_type = 'purchase' then ',"operation":{{{{"operation_type":"sale","operation_id":"op-'
                       || cast(e.event_id as string) || '"}}}}'
                   else '' end
           || case when e.event_id % 97 = 0 then ',"form":[{{{{"Password ":"x"}}}}]' else '' end
           || case when e.event_id % 101 = 0 then ',"deep":' || repeat('[', 16) || repeat(']', 16) else '' end
           || case when e.event_id % 1009 = 0 then ',"blob":"' || repeat('x', 66000) || '"' else '' end
           || ',"k":' || cast({_K} as string)
           || case when e.changed then ',"note":"changed"' else '' end
           || '}}}}' as properties,
       case when e.event_id % 59 = 0 then '{{{{}}}}'
            else '{{{{"context_key":"ctx-' || cast({_K} % 4 as string)
                || '","context_version":1,"claimed_context_family":"search"}}}}' end as context
from (
    select event_id, ts, user_id, event_type, props, cast(event_id as string) || '-0' as stream_id,
           0 as delay, false as changed
    from {{events}}
    {{repeats}}
) e
"""

# Repeats one minute later (every second one with another payload) and repeats a day later.
REPEATS = """
    union all
    select event_id, ts, user_id, event_type, props, cast(event_id as string) || '-1' as stream_id,
           60 as delay, event_id % 20 = 0 as changed
    from {events} where event_id % 10 = 0
    union all
    select event_id, ts, user_id, event_type, props, cast(event_id as string) || '-2' as stream_id,
           90000 as delay, event_id % 20 = 0 as changed
    from {events} where event_id % 10 = 0
"""

# Events for every duplicate layer. Impressions of one long session show the items of their hour and of the next one, so
# they hang together in a chain; purchases repeat order lines, errors logical ids, views the fields of a semantic rule.
LAYERED_EVENTS = """
select 'lay-' || cast(e.event_id as string) || '-0' as stream_id,
       'lay-' || cast(e.event_id as string) as event_id,
       case when e.event_type = 'error' then 'log-' || cast(e.user_id % 40 as string) else '' end as logical_event_id,
       '' as idempotency_key, '' as tab_id, cast(0 as bigint) as sequence, '' as previous_logical_event_id,
       'server' as event_source, 'site-1' as site_code, 'production' as env, 1 as token_version, 'jti' as jwt_id,
       case when e.event_type in ('signup', 'click') then 'item_impression' when e.event_type = 'purchase' then 'purchase_completed'
            when e.event_type = 'error' then 'app_error' else 'page_view' end as event_name,
       1 as event_version, e.ts as event_time, e.ts as received_at, 'anon' as anonymous_id,
       case when e.event_type = 'view' then 'sess-' || cast(e.user_id % 7 as string) else 'long' end as session_id,
       'u' as user_id, '' as origin, '' as url, '/' as path, '' as referrer, 'agent' as user_agent, '' as ip_hash,
       'sdk' as sdk_name, '1' as sdk_version,
       '{{"k":1' || case when e.event_id % 211 = 0 then ',"cvv":1' else '' end
           || case when e.event_type in ('signup', 'click') then ',"surface":"home","list_instance_id":"l","items":[{{"item_id":"h'
                       || cast(datediff(e.ts, timestamp '2024-01-01') * 24 + hour(e.ts) as string) || '"}},{{"item_id":"h'
                       || cast(datediff(e.ts, timestamp '2024-01-01') * 24 + hour(e.ts) + 1 as string) || '"}}]'
                   when e.event_type = 'purchase' then ',"order_id":"o' || cast(e.user_id % 60 as string) || '","item":{{"item_id":"i","order_line_id":"1"}}'
                   else '' end || '}}' as properties,
       '{{}}' as context
from {events} e
"""

# Context registry: three of the four keys in use, one of them inactive.
REGISTRY_CONTEXTS = (
    ("ctx-0", 1, "search", None, None, "active"),
    ("ctx-1", 1, "selection", "ctx-0", 1, "active"),
    ("ctx-2", 1, "support", "ctx-0", 1, "inactive"),
)
REVISION = "rev-1"

# --- purchases: orders and lineitem -----------------------------------------------------------

ORDER_EVENTS = """
select 'ord-' || cast(o.o_orderkey as string) as event_id,
       'ord-' || cast(o.o_orderkey as string) || '-0' as stream_id,
       case when o.o_orderstatus = 'F' then 'purchase_completed'
            when o.o_orderstatus = 'O' then 'checkout_started' else 'item_impression' end as event_name,
       'tenant-' || cast(c.c_nationkey % 5 as string) as tenant_id,
       's' || cast(c.c_nationkey as string) as site_id,
       'site-' || cast(c.c_nationkey as string) as site_code,
       o.o_orderdate as event_time,
       o.o_orderdate as received_at,
       'sess-' || cast(o.o_custkey as string) as session_id,
       'u-' || cast(o.o_custkey as string) as user_id,
       o.o_orderkey, o.o_custkey, o.o_totalprice, o.o_orderpriority
from {orders} o join {customer} c on o.o_custkey = c.c_custkey
"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a stored table that make one task of costly per-row work; a hundred thousand events are two million bytes.
SPREAD_BYTES = 1 << 20


def read_spread(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table ahead of costly per-row work, dealt to all cores and, where it is large, to tasks of about SPREAD_BYTES.

    A file is cut by bytes but read by row groups, so of its splits most may be empty and one hold all rows: the number of splits
    tells nothing. Only these narrow rows are shuffled.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    stored = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    tasks = max(spark.sparkContext.defaultParallelism, -(-stored // SPREAD_BYTES))
    return read(spark, sf_dir, name).repartition(tasks)


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(SITES, nation=read(spark, sf_dir, "nation"), region=read(spark, sf_dir, "region"))
    return rows.withColumn("allowed_domains", F.split("domains", ",")).drop("domains")


def _as_instants(df: DataFrame) -> DataFrame:
    """The tables hold zone-less UTC times; the pipeline works on instants."""
    return df.withColumns(
        {f.name: F.col(f.name).cast("timestamp") for f in df.schema if f.dataType.simpleString() == "timestamp_ntz"}
    )


def raw_text(spark: SparkSession, sf_dir: str, repeats: bool = True) -> DataFrame:
    """Raw events with JSON text payloads."""
    template = RAW_EVENTS.replace("{repeats}", REPEATS if repeats else "")
    return _as_instants(spark.sql(template, events=read_spread(spark, sf_dir, "events")))


def raw(spark: SparkSession, sf_dir: str, repeats: bool = True) -> DataFrame:
    """Raw events in the envelope's types."""
    return raw_text(spark, sf_dir, repeats).withColumns(
        {"properties": F.parse_json("properties"), "context": F.parse_json("context")}
    )


def layered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw events in which every duplicate layer decides."""
    rows = _as_instants(spark.sql(LAYERED_EVENTS, events=read_spread(spark, sf_dir, "events")))
    return rows.withColumns({"properties": F.parse_json("properties"), "context": F.parse_json("context")})


def registry(spark: SparkSession) -> DataFrame:
    from tideline import schemas

    contexts = [tuple(c) for c in REGISTRY_CONTEXTS]
    return spark.createDataFrame([(1, 1, REVISION, contexts)], schemas.REGISTRY)


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkout, purchase and impression events with their lines as an `items` array.

    Lines are gathered per order, which has a handful of them.
    """
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_quantity").alias("q"),
                    F.col("l_extendedprice").alias("e"), F.col("l_discount").alias("d"),
                    F.col("l_returnflag").alias("f"), F.col("l_suppkey").alias("s"),
                )
            )
        ).alias("lines")
    )
    heads = _as_instants(
        spark.sql(ORDER_EVENTS, orders=read_spread(spark, sf_dir, "orders"), customer=read(spark, sf_dir, "customer"))
    )
    items = F.transform(
        "lines",
        lambda x: F.to_variant_object(
            F.struct(
                x["p"].alias("item_id"),
                x["n"].cast("string").alias("order_line_id"),
                x["n"].alias("position"),
                x["q"].cast("string").alias("quantity"),
                x["e"].alias("gross_amount"),
                x["d"].alias("visible_ratio"),
                F.array(F.concat(F.lit("flag-"), x["f"]), (x["s"] % 7).cast("string")).alias("category_ids"),
            )
        ),
    )
    properties = F.to_variant_object(
        F.struct(
            items.alias("items"),
            F.col("o_orderkey").cast("string").alias("order_id"),
            F.lit("EUR").alias("currency"),
            F.concat(F.lit("list-"), (F.col("o_custkey") % 11).cast("string")).alias("list_instance_id"),
            F.concat(F.lit(" "), F.col("o_orderpriority")).alias("surface"),
            F.to_variant_object(
                F.struct(
                    F.col("o_totalprice").alias("gross_amount"),
                    F.col("o_totalprice").cast("string").alias("net_amount"),
                )
            ).alias("order"),
        )
    )
    return heads.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(
        "event_id", "stream_id", "event_name", "tenant_id", "site_id", "site_code", "event_time",
        "received_at", "session_id", "user_id", "o_orderkey", properties.alias("properties"),
    )


# --- subject changes: customer and orders -----------------------------------------------------

LIFECYCLE = """
select 'mut-' || cast(o.o_orderkey as string) as event_id,
       'tenant-' || cast(c.c_nationkey % 5 as string) as tenant_id,
       cast(o.o_custkey as string) as external_subject_id,
       case when o.o_orderstatus = 'F' then 'subject_deactivated'
            when o.o_orderstatus = 'O' then 'subject_reactivated' else 'subject_merged' end as event_name,
       o.o_orderdate as source_updated_at,
       lpad(cast(o.o_orderkey % 100 as string), 3, '0') as source_mutation_id,
       case when o.o_orderstatus = 'P' then 'target-' || cast(o.o_custkey % 50 as string) end as merge_target,
       o.o_orderdate + interval '1' second * (o.o_orderkey * 7919 % 40000000) as received_at
from {orders} o join {customer} c on o.o_custkey = c.c_custkey
union all
select 'tie-' || cast(o.o_orderkey as string), 'tenant-' || cast(c.c_nationkey % 5 as string), cast(o.o_custkey as string),
       case when o.o_orderstatus = 'F' then 'subject_reactivated' else 'subject_deactivated' end,
       o.o_orderdate, lpad(cast(o.o_orderkey % 100 as string), 3, '0'), cast(null as string),
       o.o_orderdate + interval '1' second * (o.o_orderkey * 7919 % 40000000 + o.o_orderkey % 3 - 1)
from {orders} o join {customer} c on o.o_custkey = c.c_custkey
where o.o_orderkey % 4 = 1
"""


def lifecycle_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event-subject facts of ordered lifecycle changes, one per order, and for some another of the same source time and
    mutation that arrives earlier, at once or later."""
    rows = _as_instants(
        spark.sql(LIFECYCLE, orders=read(spark, sf_dir, "orders"), customer=read(spark, sf_dir, "customer"))
    )
    return rows.select(
        "event_id", F.lit(0).alias("subject_ordinal"), "tenant_id", F.lit("customer").alias("subject_type"),
        "external_subject_id", "event_name", "received_at",
        F.col("source_updated_at").alias("lifecycle_source_updated_at"),
        F.col("source_mutation_id").alias("lifecycle_source_mutation_id"),
        F.lit(None).cast("timestamp").alias("lifecycle_effective_at"),
        F.col("merge_target").alias("merged_into_external_subject_id"),
        F.lit("unknown").alias("initial_status"),
        F.lit("normalized").alias("normalization_status"),
        F.lit(None).cast("string").alias("normalization_reason"),
    )


SNAPSHOT = """
select 'tenant-' || cast(c.c_nationkey % 5 as string) as tenant_id,
       cast(c.c_custkey as string) as external_subject_id,
       case when c.c_acctbal < 0 then 'inactive' when c.c_custkey % 17 = 0 then 'merged' else 'active' end
           as lifecycle_status,
       case when c.c_custkey % 97 = 0 then 'yesterday' else '1998-06-01T00:00:00Z' end as source_updated_at,
       '050' as source_mutation_id,
       case when c.c_custkey % 17 = 0 and c.c_custkey % 34 <> 0 then 'target-x' end as merged_into_external_subject_id
from {customer} c
"""


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SNAPSHOT, customer=read(spark, sf_dir, "customer"))
