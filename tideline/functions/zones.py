"""Time zones: conversions throw on unknown names, so names are checked against a list first."""

from __future__ import annotations

from functools import lru_cache
from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.text import text_or_empty


@lru_cache(maxsize=1)
def _names() -> tuple[str, ...]:
    return tuple(sorted(z for z in available_timezones() if z not in ("localtime", "Factory")))


def zone_or_null(name: Column) -> Column:
    """The zone name when it is a known IANA zone, else NULL."""
    text = text_or_empty(name)
    return F.when(text.isin(*_names()), text)


def local_date(at: Column, zone: Column) -> Column:
    """Calendar date of an instant in a zone that went through zone_or_null."""
    safe = F.coalesce(zone, F.lit("UTC"))
    return F.when(zone.isNotNull(), F.to_date(F.from_utc_timestamp(at, safe)))


def with_zone(df: DataFrame, column: str = "timezone", name: str = "zone") -> DataFrame:
    return df.withColumn(name, zone_or_null(F.col(column)))
