"""The reads users make of the fact tables: filters and order, nothing hidden behind them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recent_events(events: DataFrame, limit: int = 50) -> DataFrame:
    return events.orderBy(F.col("event_time").desc(), F.col("event_id").desc()).limit(limit)


def session_timeline(events: DataFrame, session_id: str) -> DataFrame:
    return events.where(F.col("session_id") == session_id).orderBy("sequence", "event_time", "event_id")


def user_history(events: DataFrame, user_id: str) -> DataFrame:
    return events.where(F.col("user_id") == user_id).orderBy(F.col("event_time").desc(), "event_id")


def events_named(events: DataFrame, name: str, start: datetime, end: datetime) -> DataFrame:
    in_range = (F.col("event_time") >= F.lit(start)) & (F.col("event_time") < F.lit(end))
    return events.where((F.col("event_name") == name) & in_range)


def item_history(items: DataFrame, tenant_id: str, site_id: str, item_id: str) -> DataFrame:
    mine = (F.col("tenant_id") == tenant_id) & (F.col("site_id") == site_id) & (F.col("item_id") == item_id)
    return items.where(mine).orderBy(F.col("event_time").desc(), "event_id")


def surface_items(items: DataFrame, tenant_id: str, site_id: str, surface: str) -> DataFrame:
    mine = (F.col("tenant_id") == tenant_id) & (F.col("site_id") == site_id) & (F.col("surface") == surface)
    return items.where(mine).orderBy(F.col("event_time").desc(), "event_id")


def order_lines(items: DataFrame, tenant_id: str, site_id: str, order_id: str) -> DataFrame:
    mine = (F.col("tenant_id") == tenant_id) & (F.col("site_id") == site_id) & (F.col("order_id") == order_id)
    return items.where(mine).orderBy("order_line_id")


def ranking_run(items: DataFrame, ranking_run_id: str) -> DataFrame:
    return items.where(F.col("ranking_run_id") == ranking_run_id)


def in_category(items: DataFrame, category: str) -> DataFrame:
    return items.where(F.array_contains("category_ids", category))


def by_category(items: DataFrame, categories: list[str]) -> DataFrame:
    """Lines once for each of the categories they are in, as `category`, in one pass."""
    wanted = F.array(*[F.lit(c) for c in categories])
    return items.withColumn("category", F.explode(F.array_intersect("category_ids", wanted)))
