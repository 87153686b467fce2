"""Checks that need one event and the site table: required fields, payload safety, eligibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline import vocab
from tideline.functions import net, payload as pl
from tideline.functions.once import once
from tideline.functions.text import is_blank, is_required_text, text_or_empty
from tideline.session import cut


def source(value: Column | str) -> Column:
    """Canonical source: blank is web, anything outside web/server NULL."""
    text = F.lower(text_or_empty(value))
    return F.when(text == "", F.lit("web")).when(text.isin(*vocab.SOURCES), text)


def has_required_fields() -> Column:
    """Identity, site, environment, name, version and time; web also needs its browser fields."""
    base = (
        ~is_blank(F.col("event_id"))
        & ~is_blank(F.col("site_code"))
        & ~is_blank(F.col("env"))
        & ~is_blank(F.col("event_name"))
        & (F.col("event_version") > 0)
        & F.col("event_time").isNotNull()
    )
    kind = source("event_source")
    return F.coalesce(base & ((kind == "server") | ((kind == "web") & web_fields())), F.lit(False))


def web_fields() -> Column:
    return (
        (F.col("token_version") > 0)
        & ~is_blank(F.col("jwt_id"))
        & ~(is_blank(F.col("anonymous_id")) & is_blank(F.col("session_id")))
        & ~is_blank(F.col("origin"))
        & ~is_blank(F.col("url"))
        & ~is_blank(F.col("path"))
    )


def ingest_ok() -> Column:
    """The same list at the door, where every event counts as web."""
    return F.coalesce(
        ~is_blank(F.col("event_id"))
        & ~is_blank(F.col("site_code"))
        & ~is_blank(F.col("env"))
        & ~is_blank(F.col("event_name"))
        & (F.col("event_version") > 0)
        & F.col("event_time").isNotNull()
        & web_fields(),
        F.lit(False),
    )


def batch_counts(events: DataFrame, batch: str = "batch_id", limit: int = vocab.MAX_BATCH_EVENTS) -> DataFrame:
    """Accepted and rejected events per batch, and whether the batch size is allowed."""
    return events.groupBy(batch).agg(
        F.count_if(F.col("ingest_ok")).alias("accepted"),
        F.count_if(~F.col("ingest_ok")).alias("rejected"),
        F.count(F.lit(1)).between(1, limit).alias("size_ok"),
    )


def check_payload(events: DataFrame) -> DataFrame:
    """Adds `blocked_key` ('' when none) and `payload_issue`; properties are read before context."""
    texts = once(events, {"_p": F.to_json("properties"), "_c": F.to_json("context")})
    properties, context = F.col("_p"), F.col("_c")
    key = F.coalesce(
        F.nullif(pl.blocked_key(properties), F.lit("")),
        F.nullif(pl.blocked_key(context), F.lit("")),
        F.lit(""),
    )
    issue = F.coalesce(pl.limit_issue(properties, "properties"), pl.limit_issue(context, "context"))
    return once(texts, {"blocked_key": key, "payload_issue": issue}).drop("_p", "_c")


def payload_reason() -> Column:
    """First failing check that needs nothing but the event."""
    return (
        F.when(~F.col("fields_ok"), F.lit("invalid_payload"))
        .when(F.col("blocked_key") != "", F.lit("blocked_key"))
        .when(F.col("payload_issue").isNotNull(), F.lit("payload_too_large"))
    )


def join_sites(events: DataFrame, sites: DataFrame) -> DataFrame:
    """Left join on the site record. The site table's size decides the join: AQE broadcasts it
    when it is below the session's threshold and shuffles otherwise."""
    site = sites.select(
        F.col("site_code").alias("_code"),
        F.col("tenant_id"),
        F.col("site_id"),
        F.col("timezone"),
        F.col("zone"),
        F.struct(
            "status", "tracking_enabled", "config_valid",
            F.col("token_version").alias("site_token"),
            F.transform("allowed_domains", net.domain).alias("hosts"),
        ).alias("_site"),
    )
    return events.join(site, text_or_empty("site_code") == text_or_empty(site["_code"]), "left").drop("_code")


def site_reason() -> Column:
    """First failing site rule; NULL for an eligible event. Needs join_sites."""
    web = source("event_source") == "web"
    return (
        F.when(F.col("_site").isNull(), F.lit("site_unresolved"))
        .when(~F.col("_site.config_valid"), F.lit("site_unresolved"))
        .when(F.lower(text_or_empty(F.col("_site.status"))) != "active", F.lit("site_inactive"))
        .when(~F.coalesce(F.col("_site.tracking_enabled"), F.lit(False)), F.lit("tracking_disabled"))
        .when(web & (F.col("_site.site_token") != F.col("token_version")), F.lit("token_version_mismatch"))
        .when(
            web & ~net.allows_host(F.col("_site.hosts"), net.origin_host("origin")),
            F.lit("domain_not_allowed"),
        )
    )


def severity(reason: Column) -> Column:
    return F.when(reason == "domain_not_allowed", F.lit("suspicious")).otherwise(F.lit("warning"))


def claims_valid(now: Column) -> Column:
    """Claim columns are complete and `now` lies in [not_before, expires_at)."""
    ok = (
        ~is_blank(F.col("claim_site_code"))
        & ~is_blank(F.col("claim_env"))
        & ~is_blank(F.col("claim_jwt_id"))
        & ~is_blank(F.col("claim_issuer"))
        & ~is_blank(F.col("claim_audience"))
        & (F.col("claim_token_version") > 0)
        & (F.col("claim_not_before") < F.col("claim_expires_at"))
        & (F.col("claim_not_before") <= now)
        & (now < F.col("claim_expires_at"))
    )
    return F.coalesce(ok, F.lit(False))


def _optional_text_ok(value: Column) -> Column:
    return F.char_length(F.coalesce(value, F.lit(""))) <= vocab.MAX_TEXT


def server_event_ok() -> Column:
    """Rules of a server event decoded by sources.envelope.decode_server."""
    name = F.col("event_name")
    lifecycle_event = name.isin(*vocab.LIFECYCLE_EVENTS)
    operation, lifecycle = F.col("operation"), F.col("lifecycle")

    def op(path):
        return F.try_variant_get(operation, path, "string")

    def life(path):
        return F.try_variant_get(lifecycle, path, "string")

    def utc(path, required):
        text = life(path)
        absent = F.lit(False) if required else text.isNull()
        return absent | F.coalesce(text.rlike(pl.RFC3339_UTC), F.lit(False))

    subjects_ok = F.size("subjects").between(1, vocab.MAX_SUBJECTS) & F.forall(
        "subjects",
        lambda s: (s["subject_type"] == "customer")
        & is_required_text(s["subject_id"])
        & _optional_text_ok(s["relation"]),
    )
    operation_ok = operation.isNull() | (
        is_required_text(op("$.operation_type")) & is_required_text(op("$.operation_id"))
    )
    keyed = ~(lifecycle_event | (name == "subject_associated")) | is_required_text(F.col("idempotency_key"))
    target = life("$.merged_into_subject_id")
    lifecycle_ok = F.when(
        lifecycle_event,
        lifecycle.isNotNull()
        & utc("$.source_updated_at", True)
        & is_required_text(life("$.source_mutation_id"))
        & utc("$.effective_at", False)
        & F.when(name == "subject_merged", is_required_text(target)).otherwise(is_blank(target)),
    ).otherwise(lifecycle.isNull())
    ok = (
        ~is_blank(F.col("event_id"))
        & ~is_blank(F.col("site_code"))
        & (F.col("event_version") == 1)
        & F.col("event_time").isNotNull()
        & F.col("time_is_utc")
        & name.isin(*vocab.SUBJECT_EVENTS)
        & subjects_ok
        & operation_ok
        & keyed
        & lifecycle_ok
    )
    return F.coalesce(ok, F.lit(False))


def accept_server_batches(events: DataFrame, request_id: str = "request_id", limit: int = vocab.MAX_BATCH_EVENTS) -> DataFrame:
    """Adds event_ok and batch_ok: one bad event, a strict-decode failure or a wrong batch size
    rejects the whole request. Rows are decoded once; the verdicts read two columns of the cut."""
    checked = cut(once(events, {"event_ok": F.col("strict_ok") & server_event_ok()}))
    verdict = checked.groupBy(F.col(request_id).alias("_request")).agg(
        (F.bool_and("event_ok") & (F.count(F.lit(1)) <= limit)).alias("batch_ok")
    )
    return checked.join(verdict, F.col(request_id) == F.col("_request")).drop("_request")


def sanitize_form(properties: Column) -> Column:
    """Form payload with only the safe members left, as VARIANT."""
    members = properties.try_cast("map<string,variant>")
    empty_list = F.array().cast("array<string>")

    def safe_name(name):
        return name.rlike(vocab.FIELD_NAME_PATTERN) & ~F.lower(name).isin(*vocab.FORM_BLOCKED_KEYS)

    def names(value):
        texts = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda x: F.when(pl.is_string(x), F.try_variant_get(x, "$", "string")))
        return F.to_variant_object(F.coalesce(F.filter(texts, lambda n: F.coalesce(safe_name(n), F.lit(False))), empty_list))

    def errors(value):
        codes = F.map_filter(
            value.try_cast("map<string,variant>"), lambda k, v: safe_name(k) & pl.is_string(v)
        )
        return F.to_variant_object(F.coalesce(codes, F.create_map().cast("map<string,variant>")))

    kept = F.map_filter(
        members,
        lambda k, v: ~k.isin(*vocab.FORM_BLOCKED_KEYS)
        & (
            k.isin("valid_fields", "invalid_fields", "field_errors")
            | (k.isin("form_id", "step_id") & pl.is_string(v))
            | pl.is_number(v)
        ),
    )
    cleaned = F.transform_values(
        kept,
        lambda k, v: F.when(k.isin("valid_fields", "invalid_fields"), names(v))
        .when(k == "field_errors", errors(v))
        .otherwise(v),
    )
    return F.to_variant_object(F.coalesce(cleaned, F.create_map().cast("map<string,variant>")))
