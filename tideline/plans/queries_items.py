"""Queries over item lines, order headers, client ids and sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.operators import client, items, lookups
from tideline.plans import base
from tideline.plans.catalog import query
from tideline.sources import adapters

_ITEMS = base.sql(
    """(
select e.event_id, e.event_name, e.tenant_id, e.site_id, e.event_time, e.session_id, e.user_id,
       cast(l.l_partkey as string) as item_id, cast(l.l_linenumber as string) as order_line_id,
       cast(e.o_orderkey as string) as order_id, e.o_orderpriority as surface,
       'list-' || cast(e.o_custkey % 11 as string) as list_instance_id,
       l.l_linenumber as position, l.l_quantity as quantity, l.l_extendedprice as gross_amount,
       l.l_discount as visible_ratio, 'flag-' || l.l_returnflag || ',' || cast(l.l_suppkey % 7 as string) as category_ids
from (<<orders>>) e join lineitem l on l.l_orderkey = e.o_orderkey
)""",
    orders=base.ORDER_EVENTS,
)


@query(
    "D3 D4 D5 D6 M-coercion",
    f"""
select event_id, event_name, item_id, order_id, order_line_id, surface, list_instance_id, position,
       cast(quantity as double) as quantity, cast(gross_amount as double) as gross_amount, cast(visible_ratio as double) as visible_ratio,
       category_ids, 'EUR' as currency,
       case when event_name = 'item_impression' then 'visible_time_ms' else '' end as missing_fields,
       event_name = 'item_impression' as incomplete_for_scoring
from {_ITEMS}
""",
)
def item_lines(spark, sf_dir):
    """One row per item line with its coerced members and completeness."""
    rows = items.item_rows(adapters.order_events(spark, sf_dir))
    return rows.select(
        "event_id", "event_name", "item_id", "order_id", "order_line_id", "surface", "list_instance_id", "position",
        "quantity", "gross_amount", "visible_ratio", F.array_join("category_ids", ",").alias("category_ids"),
        "currency", F.array_join("missing_fields", ",").alias("missing_fields"), "incomplete_for_scoring",
    )


# Single items in `item`, at the top level, and headers hidden by a null member of the line.
_SINGLE = """
select 'one-' || cast(l_orderkey as string) || '-' || cast(l_linenumber as string) || '-' || cast(l_partkey as string) as event_id,
       case when l_linenumber % 7 = 0 then 'page_view' when l_returnflag = 'A' then 'item_viewed' when l_returnflag = 'N' then 'cart_item_added'
            else 'item_image_zoomed' end as event_name,
       case when l_linenumber % 3 = 0 then '{{"item_id":"' || cast(l_partkey as string) || '","surface":"top","unit_price":" 12.50 ","position":true}}'
            when l_linenumber % 3 = 1 then '{{"surface":"head","page":3,"sku":"head","item":{{"item_id":' || cast(l_partkey as string)
                 || '.0,"surface":null,"sku":" s ","unit_price":"abc","position":2.9,"category_ids":" a, ,b "}}}}'
            else '{{"items":[],"surface":"x","metadata":{{"z":1}},"item_id":"' || case when l_linenumber % 2 = 0 then ' ' else 'i' end || '"}}' end as properties
from {lineitem}
"""


@query(
    "D3 D4 M-coercion",
    base.sql(
        """
select event_id, event_name, case when n % 3 = 0 or n % 3 = 1 then pk else 'i' end as item_id,
       case when n % 3 = 0 then 'top' when n % 3 = 1 then '' else 'x' end as surface,
       case when n % 3 = 1 then 's' else '' end as sku,
       case when n % 3 = 0 then cast(12.5 as double) end as unit_price, case when n % 3 = 1 then 2 end as position,
       case when n % 3 = 1 then 3 end as page, case when n % 3 = 1 then 'a,b' else '' end as category_ids,
       case when n % 3 = 2 then '{"z":1}' else '{}' end as metadata
from (select *, cast(split_part(event_id, '-', 3) as int) as n, split_part(event_id, '-', 4) as pk from (<<single>>))
where event_name <> 'page_view' and (n % 3 <> 2 or n % 2 <> 0)
""",
        single=_SINGLE.format(lineitem="lineitem"),
    ),
)
def single_items(spark, sf_dir):
    """Items given as one object or at the top level, and null members that hide the header's."""
    rows = spark.sql(_SINGLE, lineitem=adapters.read_spread(spark, sf_dir, "lineitem"))
    found = items.item_rows(rows.withColumn("properties", F.parse_json("properties")))
    return found.select(
        "event_id", "event_name", "item_id", "surface", "sku", "unit_price", "position", "page",
        F.array_join("category_ids", ",").alias("category_ids"), "metadata",
    )


@query(
    "D7 I3",
    base.sql(
        """
select event_id, event_name, cast(o_orderkey as string) as order_id, 'EUR' as currency, o_totalprice as gross_amount,
       o_totalprice as net_amount, cast(null as string) as cart_id
from (<<orders>>) e where event_name in ('checkout_started', 'purchase_completed')
  and exists (select 1 from lineitem l where l.l_orderkey = e.o_orderkey)
""",
        orders=base.ORDER_EVENTS,
    ),
)
def order_headers(spark, sf_dir):
    """One header per checkout or purchase; members of `order` go over the event's."""
    rows = items.stored(items.order_rows(adapters.order_events(spark, sf_dir)))
    return rows.select("event_id", "event_name", "order_id", "currency", "gross_amount", "net_amount", "cart_id")


def _items(spark, sf_dir, members=None):
    return items.item_rows(adapters.order_events(spark, sf_dir), members)


@query(
    "H9 M-array",
    f"""
select tenant_id, category, count(*) as line_count, sum(cast(gross_amount as double)) as gross
from (select *, unnest(['flag-A', 'flag-R', '3']) as category from {_ITEMS})
where list_contains(string_split(category_ids, ','), category) group by tenant_id, category
""",
)
def category_lines(spark, sf_dir):
    """Lines by category containment."""
    rows = lookups.by_category(_items(spark, sf_dir, ["category_ids", "gross_amount"]), ["flag-A", "flag-R", "3"])
    # Amounts are summed as decimals, so their order doesn't matter.
    return rows.groupBy("tenant_id", "category").agg(F.count(F.lit(1)).alias("line_count"), F.sum("gross_amount").cast("double").alias("gross"))


@query("H9", f"select event_id, item_id, order_line_id from {_ITEMS} where tenant_id = 'tenant-1' and site_id = 's6' and item_id = '7'")
def item_history(spark, sf_dir):
    """An item's lines over time on one site."""
    return lookups.item_history(_items(spark, sf_dir, ["item_id", "order_line_id"]), "tenant-1", "s6", "7").select("event_id", "item_id", "order_line_id")


@query(
    "H9",
    f"select event_id, item_id, order_line_id from {_ITEMS} where tenant_id = 'tenant-2' and site_id = 's7' and surface = '1-URGENT'",
)
def surface_lines(spark, sf_dir):
    """A surface's lines over time on one site."""
    rows = lookups.surface_items(_items(spark, sf_dir, ["item_id", "order_line_id", "surface"]), "tenant-2", "s7", "1-URGENT")
    return rows.select("event_id", "item_id", "order_line_id")


@query(
    "H9",
    f"select event_id, item_id, order_line_id from {_ITEMS} where order_id = '7' and tenant_id = (select max(tenant_id) from {_ITEMS} where order_id = '7')",
)
def order_line_lookup(spark, sf_dir):
    """The lines of one order."""
    rows = _items(spark, sf_dir, ["item_id", "order_id", "order_line_id"]).where(F.col("order_id") == "7")
    return rows.select("event_id", "item_id", "order_line_id")


@query(
    "H9",
    """
select l_suppkey % 5 as run, count(*) as line_count from lineitem group by 1 having l_suppkey % 5 = 3
""",
)
def ranking_run_lines(spark, sf_dir):
    """Lines shown by one ranking run."""
    lines = adapters.read(spark, sf_dir, "lineitem")
    shown = lines.select(F.concat(F.lit("run-"), (F.col("l_suppkey") % 5).cast("string")).alias("ranking_run_id"), (F.col("l_suppkey") % 5).alias("run"))
    return lookups.ranking_run(shown, "run-3").groupBy("run").agg(F.count(F.lit(1)).alias("line_count"))


# --- client-side ids and sequences ------------------------------------------------------------

_TRACKED = """
select event_id, user_id, 'sess ' || cast(user_id as string) as session_id, 'tab/' || cast(user_id % 3 as string) as tab_id,
       event_id as sequence, '/p é/' || cast(user_id % 4 as string) as path,
       case event_id % 4 when 0 then 'page_view' when 1 then 'checkout_started' when 2 then 'form_completed' else 'item_viewed' end as event_name,
       case event_id % 4 when 0 then '{{"navigation_id":"nav:1"}}'
            when 1 then case when event_id % 3 = 0 then '{{"checkout_id":"  ","cart_id":"c&1"}}' when event_id % 3 = 1 then '{{"order_draft_id":"d"}}' else '{{}}' end
            when 2 then case when event_id % 3 = 0 then '{{"form_id":"f(1)"}}' when event_id % 3 = 1 then '{{"step_id":"s*!"}}' else '{{"form_id":3}}' end
            else '{{}}' end as properties
from {events}
"""


@query(
    "D15 D16 M-url",
    base.sql(
        """
with t as (select *, 'sess%20' || cast(user_id as string) as es, 'tab%2F' || cast(user_id % 3 as string) as et from (<<tracked>>)),
l as (
    select *, case when event_name = 'page_view' then 'page_view:' || es || ':' || et || ':nav%3A1:%2Fp%20%C3%A9%2F' || cast(user_id % 4 as string)
        when event_name = 'checkout_started' and event_id % 3 = 0 then 'checkout_started:' || es || ':c%261'
        when event_name = 'checkout_started' and event_id % 3 = 1 then 'checkout_started:' || es || ':d'
        when event_name = 'form_completed' and event_id % 3 = 0 then 'form_completed:' || es || ':' || et || ':f(1):'
        when event_name = 'form_completed' and event_id % 3 = 1 then 'form_completed:' || es || ':' || et || '::s*!'
        else event_name || ':' || es || ':' || et || ':' || cast(event_id as string) end as logical_event_id
    from t
)
select event_id, logical_event_id, event_name || ':' || es || ':' || et || ':'
       || replace(replace(logical_event_id, '%', '%25'), ':', '%3A') as idempotency_key
from l
""",
        tracked=_TRACKED.format(events="events"),
    ),
)
def logical_ids(spark, sf_dir):
    """Logical event ids and idempotency keys as browsers derive them."""
    rows = spark.sql(_TRACKED, events=adapters.read_spread(spark, sf_dir, "events")).withColumn("properties", F.parse_json("properties"))
    named = rows.withColumn("logical_event_id", client.logical_id())
    return named.select(
        "event_id", "logical_event_id", client.idempotency_id(F.col("logical_event_id")).alias("idempotency_key")
    )


@query(
    "D17",
    """
select event_id, cast(sum(case when prev is null or epoch_us(ts) - epoch_us(prev) > 1800000000 then 1 else 0 end)
       over (partition by user_id order by ts, event_id) as bigint) as session_number
from (select *, lag(ts) over (partition by user_id order by ts, event_id) as prev from events)
""",
)
def sessions(spark, sf_dir):
    """Session numbers per user by a pause of more than thirty minutes."""
    rows = adapters.read(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    return client.sessionize(rows, ["user_id"], "ts", ["ts", "event_id"]).select("event_id", "session_number")


@query(
    "D18",
    """
with t as (
    select event_id, user_id % 50 as tab, event_id // 2 as sequence, ts as received_at, 'log-' || cast(event_id as string) as logical_event_id,
           case when event_id % 9 = 0 then 'log-x' else '' end as named
    from events
),
w as (select *, lag(sequence) over o as ps, lag(logical_event_id) over o as pl from t window o as (partition by tab order by sequence, received_at, event_id))
select event_id, coalesce(sequence - ps > 1, false) as seq_gap, coalesce(sequence = ps, false) as seq_repeat,
       coalesce(named <> '' and named <> pl, false) as chain_broken
from w
""",
)
def tab_sequences(spark, sf_dir):
    """Gaps, repeats and broken chains in the numbering of a tab."""
    n = F.col("event_id")
    rows = adapters.read(spark, sf_dir, "events").select(
        "event_id", (F.col("user_id") % 50).alias("tab"), F.floor(n / 2).alias("sequence"),
        F.col("ts").cast("timestamp").alias("received_at"),
        F.concat(F.lit("log-"), n.cast("string")).alias("logical_event_id"),
        F.when(n % 9 == 0, F.lit("log-x")).otherwise(F.lit("")).alias("previous_logical_event_id"),
    )
    return client.check_sequence(rows, ["tab"], width=100).select("event_id", "seq_gap", "seq_repeat", "chain_broken")


