"""Queries over decoding and validation: sources A, checks B."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions import net, payload as pl
from tideline.operators import client, validation
from tideline.plans import base
from tideline.plans.catalog import query
from tideline.sources import adapters, dimensions, envelope

# Stream messages as JSON text, built alike on both sides; some are cut short or mistyped.
_MESSAGES = """
select cast(event_id as string) as stream_id,
       case when event_id % 13 = 0 then substr(payload, 1, length(payload) - 1)
            when event_id % 37 = 0 then null else payload end as payload,
       cast(event_id % 8 as int) as delivery_count,
       event_id as n
from (
    select event_id, '{{"event_id":' || case when event_id % 29 = 0 then '7' else '"m-' || cast(event_id as string) || '"' end
        || ',"site_code":"site-' || cast(user_id % 25 as string) || '","env":"production"'
        || ',"event_source":"' || case when event_id % 3 = 0 then ' Server ' else '' end || '"'
        || ',"event_version":' || cast(event_id % 3 as string)
        || ',"event_name":"' || event_type || '"'
        || ',"event_time":"2024-01-02T03:04:05.678+01:00"'
        || case when event_id % 2 = 0 then ',"user_id":"u' || cast(user_id as string) || '"' else ',"user_id":null' end
        || ',"properties":{{"b":1.0,"a":"' || event_type || '"}},"extra":1}}' as payload
    from {events}
)
"""
_MESSAGES_SQL = _MESSAGES.format(events="events")


def _messages(spark, sf_dir):
    return spark.sql(_MESSAGES, events=adapters.read_spread(spark, sf_dir, "events"))


@query(
    "A1 A2",
    base.sql(
        """
select stream_id, delivery_count, 'm-' || stream_id as event_id,
       case when n % 3 = 0 then 'server' else 'web' end as event_source,
       case when n % 3 = 0 then 1 else n % 3 end as event_version,
       timestamp '2024-01-02 02:04:05.678' as event_time,
       e.event_type as event_name, 0 as sequence, '' as session_id,
       case when n % 2 = 0 then 'u' || cast(e.user_id as string) end as user_id,
       '{"a":"' || e.event_type || '","b":1}' as properties
from (<<messages>>) m join events e on e.event_id = m.n
where n % 13 <> 0 and n % 37 <> 0 and n % 29 <> 0
""",
        messages=_MESSAGES_SQL,
    ),
)
def message_decode(spark, sf_dir):
    """Stream messages decoded to typed rows."""
    rows = envelope.decode_messages(_messages(spark, sf_dir)).where("not malformed")
    return rows.select(
        "stream_id", "delivery_count", "event_id", "event_source", "event_version", "event_time",
        "event_name", "sequence", "session_id", "user_id", F.to_json("properties").alias("properties"),
    )


@query(
    "I7 J2",
    base.sql(
        """
select stream_id, case when delivery_count >= 5 then 'stream_retry_exhausted' else 'invalid_stream_payload' end as reason,
       'warning' as severity, delivery_count, strlen(coalesce(payload, '')) as payload_bytes,
       sha256(coalesce(payload, '')) as payload_sha256,
       case when payload is null or n % 13 = 0 or n % 29 = 0 then '' else 'm-' || stream_id end as event_id,
       case when payload is null or n % 13 = 0 then '' else 'production' end as env
from (<<messages>>)
where delivery_count >= 5 or n % 13 = 0 or payload is null or n % 29 = 0
""",
        messages=_MESSAGES_SQL,
    ),
)
def dead_letters(spark, sf_dir):
    """Messages that never become events: undecodable, or delivered too often."""
    rows = envelope.dead_letters(envelope.decode_messages(_messages(spark, sf_dir)))
    return rows.drop("site_code")


# Public request bodies: a third are batches of two, the others single events.
_REQUESTS = """
select cast(event_id as string) as request_id, event_id as n, event_type, value,
       case when event_id % 17 = 0 then '{{}}' when event_id % 19 = 0 then '{{"events":{{}}}}'
            when event_id % 3 = 0 then '{{"events":[' || one || ',' || replace(one, '"p-', '"q-') || ']}}'
            else one end as body
from (
    select event_id, event_type, value, '{{"event_id":"p-' || cast(event_id as string) || '"'
        || case when event_id % 2 = 0 then ',"event_type":"' || event_type || '"' else ',"event_name":" ' || event_type || ' "' end
        || case when event_id % 5 = 0 then ',"url":" ","page_url":"https://a.example.com/x"' else ',"url":"https://b.example.com/y"' end
        || ',"event_version":2,"metadata":{{"source":"meta","m":1}},"properties":{{"source":"sdk"}}'
        || ',"raw":{{"r":true}},"items":[1,2],"consent":"yes","app":"web"'
        || case when event_id % 7 = 0 then ',"tenant_id":"t9","status":"active","context":{{"site":{{"tenant_id":"t1","x":1}}}}' else '' end
        || ',"unknown":5}}' as one
    from {events}
)
"""
_REQUESTS_SQL = _REQUESTS.format(events="events")


@query(
    "A3 A4",
    base.sql(
        """
select request_id, event_index, n % 17 = 0 or n % 19 = 0 as invalid_request,
       case when n % 17 <> 0 and n % 19 <> 0 then
            case when event_index = 1 then 'q-' else 'p-' end || request_id else '' end as event_id,
       case when n % 17 <> 0 and n % 19 <> 0 then event_type else '' end as event_name,
       case when n % 17 = 0 or n % 19 = 0 then '' when n % 5 = 0 then 'https://a.example.com/x' else 'https://b.example.com/y' end as url,
       case when n % 17 <> 0 and n % 19 <> 0 then 2 else 0 end as event_version,
       case when n % 17 <> 0 and n % 19 <> 0 then '{"items":[1,2],"m":1,"raw":{"r":true},"source":"sdk"}' else '{}' end as properties,
       case when n % 17 = 0 or n % 19 = 0 then '{}'
            when n % 7 = 0 then '{"app":"web","consent":"yes","site":{"status":"active","tenant_id":"t1","x":1}}'
            else '{"app":"web","consent":"yes"}' end as context
from (select *, unnest(case when n % 17 = 0 or n % 19 = 0 then [null] when n % 3 = 0 then [0, 1] else [0] end) as event_index
      from (<<requests>>))
""",
        requests=_REQUESTS_SQL,
    ),
)
def public_events(spark, sf_dir):
    """Public request bodies split into events, with aliases, merges and routed extra members."""
    requests = spark.sql(_REQUESTS, events=adapters.read_spread(spark, sf_dir, "events")).select("request_id", "body")
    rows = envelope.normalize_public(envelope.split_public(requests).drop("body"))
    return rows.select(
        "request_id", "event_index", "invalid_request", "event_id", "event_name", "url", "event_version",
        F.to_json("properties").alias("properties"), F.to_json("context").alias("context"),
    )


_IP = "'10.0.' || cast(user_id % 256 as string) || '.' || cast(event_id % 256 as string)"


@query(
    "A5 A6",
    f"""
select 'evt-' || cast(event_id as string) as event_id, 'site-' || cast(user_id % 25 as string) as site_code, 'web' as event_source,
       case when event_id % 2 = 0 then 'https://header.example.com'
            when event_id % 53 = 0 then 'https://evil.example.net'
            else 'https://shop-' || cast(user_id % 25 as string) || '.example.com' end as origin,
       'agent/' || event_type as user_agent,
       case when event_id % 4 = 0 then sha256({_IP}) when event_id % 4 = 1 then sha256('192.168.0.' || cast(event_id % 256 as string))
            when event_id % 4 = 2 then sha256('172.16.0.' || cast(event_id % 256 as string)) else '' end as ip_hash
from events
""",
)
def web_enrichment(spark, sf_dir):
    """Public events stamped with the request's claims, headers and hashed address."""
    raw = adapters.raw(spark, sf_dir, repeats=False)
    n = F.split("stream_id", "-")[0].cast("bigint")
    user = F.substring("user_id", 3, 20).cast("bigint")
    last = (n % 256).cast("string")
    events = adapters.read(spark, sf_dir, "events").select(F.col("event_id").alias("_n"), "event_type")
    requests = raw.join(events, n == F.col("_n")).withColumns(
        {
            "claim_site_code": F.col("site_code"), "claim_env": F.lit("production"),
            "claim_token_version": F.lit(1), "claim_jwt_id": F.col("jwt_id"),
            "header_origin": F.when(n % 2 == 0, F.lit(" https://header.example.com ")).otherwise(F.lit("")),
            "header_user_agent": F.concat(F.lit("agent/"), F.col("event_type")),
            "forwarded_for": F.when(
                n % 4 == 0,
                F.concat(F.lit(" 10.0."), (user % 256).cast("string"), F.lit("."), last, F.lit(", 9.9.9.9")),
            ),
            "real_ip": F.when(n % 4 == 1, F.concat(F.lit("192.168.0."), last)),
            "peer": F.when(n % 4 == 2, F.concat(F.lit("172.16.0."), last, F.lit(":4711"))).otherwise(F.lit("")),
        }
    )
    return envelope.enrich_web(requests).select(
        "event_id", "site_code", "event_source", "origin", "user_agent", "ip_hash"
    )


# Server requests: every flaw of the strict decode and of the event rules occurs.
_SERVER = """
select cast(event_id as string) as request_id, event_id as n, user_id, event_type,
       case when event_id % 3 = 0 then '{{"events":[' || one || ',' || replace(one, '"sv-', '"sw-') || ']'
                || case when event_id % 31 = 0 then ',"more":1' else '' end || '}}'
            else one end as body
from (
    select event_id, user_id, event_type,
        '{{"event_id":"sv-' || cast(event_id as string) || '","event_version":1,"site_code":"site-1"'
        || ',"event_name":"' || case when event_type = 'error' then 'subject_renamed'
              when event_type = 'purchase' then 'subject_associated' when event_type = 'signup' then 'subject_merged'
              when event_type = 'view' then 'subject_viewed' else 'subject_deactivated' end || '"'
        || ',"timestamp":"2024-01-02T03:04:05' || case when event_id % 11 = 0 then '-03:00' else 'Z' end || '"'
        || case when event_id % 13 = 0 then '' else ',"idempotency_key":"ik-' || cast(event_id as string) || '"' end
        || case when event_id % 17 = 0 then ',"surprise":true' else '' end
        || ',"properties":{{"subjects":['
        || case when event_id % 19 = 0 then '' else '{{"subject_type":"' || case when event_id % 23 = 0 then 'account' else 'customer' end
              || '","subject_id":"' || cast(user_id as string) || '"'
              || case when event_id % 29 = 0 then ',"age":3' else '' end || '}},'
              || '{{"subject_type":"customer","subject_id":"z"}},{{"subject_type":"customer","subject_id":"z","relation":""}}' end
        || ']'
        || case when event_type in ('signup', 'click') then ',"lifecycle":{{"source_updated_at":"2024-01-01T00:00:00Z","source_mutation_id":"m1"'
              || case when event_type = 'signup' and event_id % 2 = 0 then ',"merged_into_subject_id":"t"' else '' end || '}}' else '' end
        || case when event_id % 7 = 0 then ',"operation":{{"operation_type":"sale","operation_id":"'
              || case when event_id % 14 = 0 then '' else 'o1' end || '"}}' else '' end
        || '}},"context":{{"c":1}}}}' as one
    from {events}
)
"""
_SERVER_SQL = _SERVER.format(events="events")
_SERVER_JUDGED = base.sql(
    """
with j as (
    select *, n % 17 <> 0 and (n % 19 = 0 or n % 29 <> 0) and not (n % 3 = 0 and n % 31 = 0) as strict_ok,
           event_type <> 'error' and n % 11 <> 0 and (n % 13 <> 0 or event_type = 'view')
           and n % 19 <> 0 and n % 23 <> 0 and (event_type <> 'signup' or n % 2 = 0)
           and n % 14 <> 0 as rules_ok
    from (<<server>>)
)
""",
    server=_SERVER_SQL,
)


def _server(spark, sf_dir):
    requests = spark.sql(_SERVER, events=adapters.read_spread(spark, sf_dir, "events")).select("request_id", "body")
    return validation.accept_server_batches(envelope.decode_server(requests))


@query(
    "A14 B3 B4",
    _SERVER_JUDGED
    + """
select request_id, event_index, case when event_index = 1 then 'sw-' else 'sv-' end || request_id as event_id,
       strict_ok, strict_ok and rules_ok as event_ok, strict_ok and rules_ok as batch_ok
from (select *, unnest(case when n % 3 = 0 then [0, 1] else [0] end) as event_index from j)
""",
)
def server_events(spark, sf_dir):
    """Strict server payloads: decode verdict, event rules and whole-batch rejection."""
    return _server(spark, sf_dir).select("request_id", "event_index", "event_id", "strict_ok", "event_ok", "batch_ok")


@query(
    "A7 A8",
    _SERVER_JUDGED
    + """
select request_id || '/' || cast(event_index as string) as row_key, 'server' as event_source, 'production' as env, 'server' as sdk_name,
       case when n % 13 = 0 then '' else 'ik-' || request_id end as idempotency_key,
       '{' || case when event_type in ('signup', 'click') then '"lifecycle":{'
                || case when event_type = 'signup' then '"merged_into_subject_id":"t",' else '' end
                || '"source_mutation_id":"m1","source_updated_at":"2024-01-01T00:00:00Z"},' else '' end
           || case when n % 7 = 0 then '"operation":{"operation_id":"o1","operation_type":"sale"},' else '' end
           || '"subjects":[{"relation":"","subject_id":"' || cast(user_id as string) || '","subject_type":"customer"}'
           || ',{"relation":"","subject_id":"z","subject_type":"customer"}]}' as properties
from (select *, unnest(case when n % 3 = 0 then [0, 1] else [0] end) as event_index from j)
where strict_ok and rules_ok
""",
)
def server_raw_events(spark, sf_dir):
    """Accepted server events as raw envelope rows, subjects made unique."""
    rows = _server(spark, sf_dir).where("batch_ok").withColumn("received_at", F.col("event_time"))
    kept = rows.withColumn("row_key", F.concat_ws("/", "request_id", "event_index"))
    raw = envelope.server_to_raw(kept.withColumn("event_id", F.col("row_key")))
    return raw.select(
        F.col("event_id").alias("row_key"), "event_source", "env", "sdk_name", "idempotency_key",
        F.to_json("properties").alias("properties"),
    )


@query(
    "I6",
    base.sql(
        """
select event_id, sha256('{"event_id":"' || event_id || '","logical_event_id":"' || logical_event_id || '","idempotency_key":"'
       || idempotency_key || '","event_name":"' || event_name || '","event_time":"' || strftime(event_time, '%Y-%m-%dT%H:%M:%S.%f')
       || 'Z","path":"' || path || '"}') as message_sha256
from (<<raw>>)
""",
        raw=base.RAW_ONCE,
    ),
)
def published_messages(spark, sf_dir):
    """Raw events as the JSON text that is published, hashed."""
    raw = adapters.raw_text(spark, sf_dir, repeats=False).select(
        "event_id", "logical_event_id", "idempotency_key", "event_name", "event_time", "path"
    )
    return raw.select("event_id", F.sha2(envelope.to_message(raw), 256).alias("message_sha256"))


@query(
    "A9 B8 B12",
    base.sql(
        """
select site_code, tenant_id, token_version, case when sample_rate > 0 then sample_rate else 1.0 end as sample_rate,
       true as config_valid, case when timezone not in ('', 'Mars/Olympus') then timezone end as zone
from (<<sites>>)
""",
        sites=base.SITES,
    ),
)
def site_table(spark, sf_dir):
    """Site records with defaults, their validity and the checked time zone."""
    return base.sites(spark, sf_dir).select("site_code", "tenant_id", "token_version", "sample_rate", "config_valid", "zone")


@query(
    "A10",
    base.sql(
        """
select tenant_id, external_subject_id, lifecycle_status,
       case when source_updated_at = 'yesterday' then null else timestamp '1998-06-01 00:00:00' end as source_updated_at,
       source_updated_at <> 'yesterday' and (lifecycle_status <> 'merged' or merged_into_external_subject_id is not null) as row_valid
from (<<snapshot>>)
""",
        snapshot=base.SNAPSHOT,
    ),
)
def snapshot_rows(spark, sf_dir):
    """Snapshot rows of the source system with their validity."""
    rows = dimensions.check_snapshot(adapters.snapshot(spark, sf_dir))
    return rows.select("tenant_id", "external_subject_id", "lifecycle_status", "source_updated_at", "row_valid")


# --- checks ----------------------------------------------------------------------------------

_FLAWED = """
select *, case when n % 31 = 0 then '  ' else session_id end as s2, case when n % 62 = 0 then '' else anonymous_id end as a2,
       case when n % 37 = 0 then 0 else token_version end as t2, case when n % 23 = 0 then 'mobile' else event_source end as src
from (select *, sequence as n from (<<raw>>))
"""


def _flawed(spark, sf_dir):
    n = F.col("sequence")
    return adapters.raw(spark, sf_dir, repeats=False).withColumns(
        {
            "anonymous_id": F.when(n % 62 == 0, F.lit("")).otherwise(F.col("anonymous_id")),
            "session_id": F.when(n % 31 == 0, F.lit("  ")).otherwise(F.col("session_id")),
            "token_version": F.when(n % 37 == 0, F.lit(0)).otherwise(F.col("token_version")),
            "event_source": F.when(n % 23 == 0, F.lit("mobile")).otherwise(F.col("event_source")),
        }
    )


@query(
    "B1 B11",
    base.sql(
        """
select event_id, case when n % 23 = 0 then null when src = '' then 'web' else src end as source,
       n % 23 <> 0 and trim(event_name) <> '' and (src = 'server' or (t2 > 0 and (trim(s2) <> '' or trim(a2) <> ''))) as fields_ok
from (<<flawed>>)
""",
        flawed=base.sql(_FLAWED, raw=base.RAW_ONCE),
    ),
)
def required_fields(spark, sf_dir):
    """Required fields by source."""
    rows = _flawed(spark, sf_dir)
    return rows.select(
        "event_id", validation.source(F.col("event_source")).alias("source"),
        validation.has_required_fields().alias("fields_ok"),
    )


@query(
    "B2 B4 G11",
    base.sql(
        """
select batch_id, count(*) filter (ok) as accepted, count(*) filter (not ok) as rejected, count(*) between 1 and 50 as size_ok
from (select 'b-' || cast(case when n % 5 = 0 then floor(n / 400) * 10 else floor(n / 40) end as bigint) as batch_id,
             trim(event_name) <> '' and t2 > 0 and (trim(s2) <> '' or trim(a2) <> '') as ok
      from (<<flawed>>))
group by batch_id
""",
        flawed=base.sql(_FLAWED, raw=base.RAW_ONCE),
    ),
)
def batch_counts(spark, sf_dir):
    """Accepted and rejected events per request batch, and the batch size rule."""
    n = F.col("sequence")
    batch = F.when(n % 5 == 0, F.floor(n / 400) * 10).otherwise(F.floor(n / 40)).cast("bigint")
    rows = _flawed(spark, sf_dir).withColumns(
        {"batch_id": F.concat(F.lit("b-"), batch.cast("string")), "ingest_ok": validation.ingest_ok()}
    )
    return validation.batch_counts(rows)


@query(
    "B5 B6 B7 M-json",
    base.sql(
        """
select event_id, coalesce(nullif(regexp_extract(properties, '"(Password )"\\s*:', 1), ''), '') as blocked_key,
       case when sequence % 101 = 0 then 'properties_depth' when strlen(properties) > 65536 then 'properties_size' end as payload_issue
from (<<raw>>)
""",
        raw=base.RAW_ONCE,
    ),
)
def payload_safety(spark, sf_dir):
    """Blocked keys and payload limits."""
    rows = validation.check_payload(adapters.raw(spark, sf_dir, repeats=False))
    return rows.select("event_id", "blocked_key", "payload_issue")


@query(
    "B6 B7",
    base.sql(
        """
select event_id, greatest(case when sequence % 61 = 0 then 2 else 4 end, case when sequence % 97 = 0 then 4 else 0 end,
       case when sequence % 47 <> 0 and event_name = 'subject_associated' then 3 else 0 end,
       case when sequence % 101 = 0 then 17 else 0 end) as depth,
       strlen(replace(properties, '"k":' || cast(k as string), '"k":' || cast(k as string))) as size
from (select *, cast(regexp_extract(properties, '"k":([0-9]+)', 1) as bigint) as k from (<<raw>>))
""",
        raw=base.RAW_ONCE,
    ),
)
def payload_depth(spark, sf_dir):
    """Exact depth and encoded size of every payload."""
    text = F.to_json("properties")
    rows = adapters.raw(spark, sf_dir, repeats=False)
    return rows.select("event_id", pl.depth(text).alias("depth"), pl.encoded_size(text).alias("size"))


@query(
    "B9 B14",
    base.sql(
        """
select event_id, reason, case when reason = 'domain_not_allowed' then 'suspicious' when reason is not null then 'warning' end as severity
from (
    select event_id, case when s.site_code is null then 'site_unresolved' when lower(trim(s.status)) <> 'active' then 'site_inactive'
                when not s.tracking_enabled then 'tracking_disabled'
                when r.event_source <> 'server' and s.token_version <> r.token_version then 'token_version_mismatch'
                when r.event_source <> 'server' and r.origin like '%evil%' then 'domain_not_allowed' end as reason
    from (select * replace (case when sequence % 71 = 0 then 'site-x' else site_code end as site_code) from (<<raw>>)) r
    left join (<<sites>>) s on s.site_code = r.site_code
)
""",
        raw=base.RAW_ONCE,
        sites=base.SITES,
    ),
)
def site_eligibility(spark, sf_dir):
    """Site rules with their reasons and severities."""
    raw = adapters.raw(spark, sf_dir, repeats=False).withColumn(
        "site_code", F.when(F.col("sequence") % 71 == 0, F.lit("site-x")).otherwise(F.col("site_code"))
    )
    rows = validation.join_sites(raw, base.sites(spark, sf_dir)).withColumn("reason", validation.site_reason())
    severity = F.when(F.col("reason").isNotNull(), validation.severity(F.col("reason")))
    return rows.select("event_id", "reason", severity.alias("severity"))


@query(
    "B10 M-url",
    """
select page_id, host, host in ('thther.example.org', 'tionble.example.com', 'ththhe.example.com', 'blog.tionsh.example.net') as allowed
from (select page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www\\.', '') as host from pages)
""",
)
def origin_hosts(spark, sf_dir):
    """Hosts of page URLs against an allow list."""
    allowed = F.array(
        *[F.lit(d) for d in ("thther.example.org", "https://www.tionble.example.com", "WWW.ththhe.example.com.", "blog.tionsh.example.net")]
    )
    pages = adapters.read(spark, sf_dir, "pages")
    return pages.select(
        "page_id", net.origin_host(F.col("url")).alias("host"), net.allows_origin(allowed, F.col("url")).alias("allowed")
    )


_FORM = """
select event_id, '{{"form_id":"f' || cast(user_id as string) || '","step_id":' || case when event_id % 3 = 0 then '4' else '"s"' end
    || ',"value":9,"n":' || cast(event_id as string) || ',"flag":true,"note":"free"'
    || ',"valid_fields":["a","b c","Email",5],"invalid_fields":' || case when event_id % 2 = 0 then '"x"' else '["z.z"]' end
    || ',"field_errors":{{"a":"required","b":7,"phone":"bad","b d":"e"}}}}' as body
from {events}
"""


@query(
    "B15",
    """
select event_id, '{"field_errors":{"a":"required"},"form_id":"f' || cast(user_id as string) || '","invalid_fields":'
    || case when event_id % 2 = 0 then '[]' else '["z.z"]' end || ',"n":' || cast(event_id as string)
    || case when event_id % 3 = 0 then ',"step_id":4' else ',"step_id":"s"' end || ',"valid_fields":["a"]}' as sanitized
from events
""",
)
def form_sanitizing(spark, sf_dir):
    """Form payloads reduced to their safe members."""
    rows = spark.sql(_FORM, events=adapters.read_spread(spark, sf_dir, "events"))
    return rows.select("event_id", F.to_json(validation.sanitize_form(F.parse_json("body"))).alias("sanitized"))


@query(
    "B16",
    base.sql(
        """
select event_id, row_number() over (partition by site_code, floor(epoch(received_at) / 86400) order by received_at, event_id) <= 5 as site_admitted,
       row_number() over (partition by user_id, floor(epoch(received_at) / 86400) order by received_at, event_id) <= 2 as user_admitted
from (<<raw>>)
""",
        raw=base.RAW_ONCE,
    ),
)
def quota_audit(spark, sf_dir):
    """Fixed-window quotas per site and per client."""
    rows = adapters.raw_text(spark, sf_dir, repeats=False).select("event_id", "site_code", "user_id", "received_at")
    order = ["received_at", "event_id"]
    by_site = client.quota(rows, "site_code", "received_at", 86400, 5, order, "site_admitted")
    return client.quota(by_site, "user_id", "received_at", 86400, 2, order, "user_admitted").select(
        "event_id", "site_admitted", "user_admitted"
    )


@query(
    "B17",
    """
select event_id, event_id % 5 <> 0 and event_id % 7 <> 0 and event_id % 11 <> 0 and event_id % 9 <> 1 as claims_ok
from events
""",
)
def claim_checks(spark, sf_dir):
    """Tracking claims against the time of arrival."""
    n, at = F.col("event_id"), F.col("ts").cast("timestamp")
    rows = adapters.read(spark, sf_dir, "events").withColumns(
        {
            "claim_site_code": F.lit("site-1"), "claim_env": F.when(n % 5 == 0, F.lit(" ")).otherwise(F.lit("production")),
            "claim_jwt_id": F.lit("j"), "claim_issuer": F.when(n % 7 != 0, F.lit("iss")), "claim_audience": F.lit("aud"),
            "claim_token_version": F.when(n % 11 == 0, F.lit(0)).otherwise(F.lit(1)),
            "claim_not_before": at,
            "claim_expires_at": F.when(n % 9 == 1, at).otherwise(at + F.expr("interval 1 hour")),
        }
    )
    return rows.select("event_id", validation.claims_valid(at).alias("claims_ok"))

