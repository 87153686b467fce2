"""Ids and sequences that browsers derive while tracking, recomputed over stored events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline import vocab
from tideline.functions import payload as pl
from tideline.functions.text import is_blank
from tideline.operators import ordered


def encoded(value: Column) -> Column:
    """Text as a URI component."""
    out = F.url_encode(F.coalesce(value, F.lit("")))
    for code, char in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def stable_id(*parts: Column) -> Column:
    """Encoded parts joined by colons; empty parts keep their place."""
    return F.concat_ws(":", *[encoded(p) for p in parts])


def _text(name: str) -> Column:
    value = pl.member(F.col("properties"), f"$.{name}")
    return F.when(pl.is_string(value), F.try_variant_get(value, "$", "string"))


def logical_id() -> Column:
    """Logical event id by event name: navigation, checkout, form step, else the tab sequence."""
    name, session, tab = F.col("event_name"), F.col("session_id"), F.col("tab_id")
    identity = F.coalesce(
        *[F.when(~is_blank(_text(n)), _text(n)) for n in ("checkout_id", "cart_id", "order_draft_id")]
    )
    form, step = _text("form_id"), _text("step_id")
    has_form = (F.coalesce(form, F.lit("")) != "") | (F.coalesce(step, F.lit("")) != "")
    return (
        F.when(name == "page_view", stable_id(F.lit("page_view"), session, tab, _text("navigation_id"), F.col("path")))
        .when((name == "checkout_started") & identity.isNotNull(), stable_id(name, session, identity))
        .when(name.isin(*vocab.FORM_EVENTS) & has_form, stable_id(name, session, tab, form, step))
        .otherwise(stable_id(name, session, tab, F.col("sequence").cast("string")))
    )


def idempotency_id(logical: Column) -> Column:
    return F.when(
        F.coalesce(logical, F.lit("")) != "",
        stable_id(F.col("event_name"), F.col("session_id"), F.col("tab_id"), logical),
    )


def sessionize(df: DataFrame, key: list[str], at: str, order: list[str], gap_seconds: int = vocab.SESSION_GAP_SECONDS, bucket_seconds: int = 86400) -> DataFrame:
    """Adds session_number (1..n per key); a session ends when the pause exceeds the gap."""
    bucket = ordered.time_bucket(F.col(at), bucket_seconds)
    previous = ordered.with_previous(df.withColumn("_us", F.unix_micros(at)), key, order, bucket, "_us", "_prev")
    starts = F.col("_prev").isNull() | (F.col("_us") - F.col("_prev") > gap_seconds * 1_000_000)
    numbered = ordered.with_running_count(previous, key, order, bucket, starts, "session_number")
    return numbered.drop("_us", "_prev")


def check_sequence(df: DataFrame, key: list[str], width: int = 10000) -> DataFrame:
    """Adds seq_gap, seq_repeat and chain_broken to events ordered by sequence within a tab."""
    order = ["sequence", "received_at", "event_id"]
    bucket = F.floor(F.col("sequence") / F.lit(width)).cast("bigint")
    packed = df.withColumn("_self", F.struct("sequence", "logical_event_id"))
    lagged = ordered.with_previous(packed, key, order, bucket, "_self", "_prev")
    previous = F.col("_prev")
    named = F.coalesce(F.col("previous_logical_event_id"), F.lit(""))
    return lagged.select(
        *df.columns,
        F.coalesce(F.col("sequence") - previous["sequence"] > 1, F.lit(False)).alias("seq_gap"),
        F.coalesce(F.col("sequence") == previous["sequence"], F.lit(False)).alias("seq_repeat"),
        F.coalesce(
            (named != "") & (named != F.coalesce(previous["logical_event_id"], F.lit(""))) & previous.isNotNull(),
            F.lit(False),
        ).alias("chain_broken"),
    )


def quota(df: DataFrame, key: str, at: str, window_seconds: int, limit: int, order: list[str], name: str = "admitted") -> DataFrame:
    """Adds whether a request is within its key's quota for its fixed window.

    The running number of a request is counted second by second, so a busy window of one key is
    spread over its seconds.
    """
    windowed = df.withColumn("_window", F.floor(F.unix_micros(at) / F.lit(window_seconds * 1_000_000)))
    second = ordered.time_bucket(F.col(at), max(window_seconds // 60, 1))
    counted = ordered.with_running_count(windowed, [key, "_window"], order, second, F.lit(True), "_n")
    return counted.withColumn(name, F.col("_n") <= limit).drop("_window", "_n")
