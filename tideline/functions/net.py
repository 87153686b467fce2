"""Hosts, origins and addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tideline.functions.text import text_or_empty, trimmed


def _authority(value: Column) -> Column:
    """Host and port of an absolute or scheme-relative URL, without user info; NULL otherwise."""
    found = F.regexp_extract(value, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)", 1)
    return F.nullif(found, F.lit(""))


def _bare(host: Column) -> Column:
    lowered = F.lower(trimmed(host))
    return F.regexp_replace(F.regexp_replace(lowered, r"\.$", ""), r"^www\.", "")


def domain(value: Column) -> Column:
    """Allow-list entry as host[:port], lower case, without scheme, www. and one trailing dot."""
    text = text_or_empty(value)
    return _bare(F.coalesce(_authority(text), text))


def origin_host(value: Column | str) -> Column:
    """Host[:port] of an origin; a bare host counts when it has neither scheme nor slash."""
    text = text_or_empty(value)
    bare = F.when(~text.contains("/") & ~text.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:(?![0-9]+$)"), text)
    return F.coalesce(_bare(F.coalesce(_authority(text), bare)), F.lit(""))


def allows_host(hosts: Column, host: Column) -> Column:
    """Host among allow-list entries that went through domain()."""
    return (host != "") & F.coalesce(F.array_contains(hosts, host), F.lit(False))


def allows_origin(allowed: Column, origin: Column) -> Column:
    return allows_host(F.transform(allowed, domain), origin_host(origin))


def ip_hash(forwarded_for: Column, real_ip: Column, peer: Column) -> Column:
    """Hex SHA-256 of the client address: first forwarded hop, else real ip, else peer host."""
    forwarded = F.when(
        F.coalesce(forwarded_for, F.lit("")) != "", F.split(forwarded_for, ",").getItem(0)
    )
    real = F.when(F.coalesce(real_ip, F.lit("")) != "", real_ip)
    host = F.regexp_replace(peer, r"^\[?([^\]]*?)\]?:\d+$", "$1")
    address = text_or_empty(F.coalesce(forwarded, real, host))
    return F.when(address == "", F.lit("")).otherwise(F.sha2(address, 256))
