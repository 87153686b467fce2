"""Aggregates that exist as design documents only: contextual item scores, fallback levels, roll-ups
over periods and two reconciliations."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.session import cut

# Example weights of the design.
EVENT_WEIGHTS = {"item_viewed": 1, "cart_item_added": 4, "purchase_completed": 10}
# Context columns by level, from the whole context down to the site.
LEVELS = (
    ("exact_context", ("site_code", "app_area", "feature", "component_id", "surface", "entry_point", "item_type")),
    ("without_entry_point", ("site_code", "app_area", "feature", "component_id", "surface", "item_type")),
    ("feature_component", ("site_code", "feature", "component_id", "item_type")),
    ("app_area_item_type", ("site_code", "app_area", "item_type")),
    ("site_item_type", ("site_code", "item_type")),
    ("site_global", ("site_code",)),
)


def item_scores(items: DataFrame, context: list[str], start: datetime, end: datetime, weights=None, version: str = "context_items_v1") -> DataFrame:
    """Weighted event score per context and item within [start, end)."""
    weights = weights or EVENT_WEIGHTS
    weight = F.lit(0)
    for name, value in weights.items():
        weight = F.when(F.col("event_name") == name, F.lit(value)).otherwise(weight)
    rows = items.where((F.col("event_time") >= F.lit(start)) & (F.col("event_time") < F.lit(end)) & F.col("event_name").isin(*weights))
    return rows.groupBy(*context, "item_id").agg(
        F.sum(weight).alias("score"),
        F.count(F.lit(1)).alias("event_count"),
        F.max("event_time").alias("last_event_time"),
    ).withColumn("algorithm_version", F.lit(version))


def item_scores_by_level(scores: DataFrame, levels=LEVELS) -> DataFrame:
    """Scores of exact contexts rolled up to every fallback level, each from the coarsest level before it that has its columns.

    `level_rank` 0 is the exact context. Columns outside a level are NULL. Rows are never multiplied by the levels, so a task
    holds the groups of one level only.
    """
    columns = list(levels[0][1])
    built: list[DataFrame] = []
    for _, names in levels:
        fitting = [p for p, (_, before) in enumerate(levels[: len(built)]) if set(names) <= set(before)]
        finer = built[min(fitting, key=lambda p: len(levels[p][1]))] if fitting else scores
        built.append(
            cut(
                finer.groupBy(*names, "item_id").agg(
                    F.sum("score").alias("score"),
                    F.sum("event_count").alias("event_count"),
                    F.max("last_event_time").alias("last_event_time"),
                )
            )
        )
    types = scores.schema
    parts = [
        df.select(
            *[F.col(c) if c in names else F.lit(None).cast(types[c].dataType).alias(c) for c in columns],
            "item_id", "score", "event_count", "last_event_time", F.lit(rank).alias("level_rank"), F.lit(level).alias("level"),
        )
        for rank, ((level, names), df) in enumerate(zip(levels, built))
    ]
    return reduce(DataFrame.unionByName, parts)


def top_items_with_fallback(requests: DataFrame, leveled: DataFrame, limit: int, levels=LEVELS) -> DataFrame:
    """Per request (the exact context columns) the best items of the first level that has any.

    Items are ranked once per level and context, so a request meets at most `limit` rows per level. The ranks are cut: every
    level's join and the choice of the level read them.
    """
    columns = list(levels[0][1])
    order = [F.col("score").desc(), F.col("last_event_time").desc(), F.col("item_id").asc()]
    ranks = Window.partitionBy("level_rank", *columns).orderBy(*order)
    best = cut(leveled.withColumn("position", F.row_number().over(ranks)).where(F.col("position") <= limit))
    values = ["item_id", "score", "event_count", "last_event_time", "position", "level_rank", "level"]
    found = None
    for position, (_, names) in enumerate(levels):
        rows = best.where(F.col("level_rank") == position).select(*names, *values)
        part = requests.join(rows, list(names)).select(*columns, *values)
        found = part if found is None else found.unionByName(part)
    first = found.groupBy(*columns).agg(F.min("level_rank").alias("_level"))
    return (
        found.join(first, columns)
        .where(F.col("level_rank") == F.col("_level"))
        .drop("level_rank", "_level")
    )


PERIODS = ("weekday", "day_of_month", "week", "month", "quarter", "year")


def roll_up(daily: DataFrame, keys: list[str]) -> DataFrame:
    """Daily rows rolled up to calendar periods: (keys, period, period_value, counts)."""
    day = F.col("local_date")
    values = {
        "weekday": F.weekday(day).cast("string"),
        "day_of_month": F.dayofmonth(day).cast("string"),
        "week": F.date_format(F.date_trunc("week", day), "yyyy-MM-dd"),
        "month": F.date_format(day, "yyyy-MM"),
        "quarter": F.concat(F.year(day).cast("string"), F.lit("-Q"), F.quarter(day).cast("string")),
        "year": F.year(day).cast("string"),
    }
    periods = F.array(*[F.struct(F.lit(p).alias("period"), values[p].alias("period_value")) for p in PERIODS])
    # Daily rows are summed per day first, so the six-fold copy is made of days, not of rows.
    per_day = daily.groupBy(*keys, "local_date").agg(
        F.sum("association_count").alias("association_count"), F.sum("view_count").alias("view_count")
    )
    return (
        per_day.select(*keys, "association_count", "view_count", F.inline(periods))
        .groupBy(*keys, "period", "period_value")
        .agg(F.sum("association_count").alias("association_count"), F.sum("view_count").alias("view_count"))
    )


def moving_sum(daily: DataFrame, keys: list[str], days: int) -> DataFrame:
    """Associations of the last `days` local days, per key and day with any row. A key has at most
    one row per calendar day here."""
    per_day = daily.groupBy(*keys, "local_date").agg(F.sum("association_count").alias("association_count"))
    window = Window.partitionBy(*keys).orderBy(F.unix_date("local_date")).rangeBetween(-(days - 1), 0)
    return per_day.withColumn("moving_count", F.sum("association_count").over(window))


def reconcile_contexts(rows: DataFrame, resolved: DataFrame, where: Column | None = None) -> DataFrame:
    """Dry run of a history resolution: how many facts would change, by old and new status."""
    key = ["event_id", "subject_ordinal"]
    new = resolved.select(*key, F.col("context_resolution_status").alias("new_status"))
    old = rows.where(where) if where is not None else rows
    return (
        old.select(*key, F.col("context_resolution_status").alias("old_status"))
        .join(new, key)
        .groupBy("old_status", "new_status")
        .agg(F.count(F.lit(1)).alias("facts"))
    )


def reconcile_subjects(subjects: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Differences between the dimension and a source snapshot, one row per differing subject."""
    key = ["tenant_id", "external_subject_id"]
    mine = subjects.where("subject_type = 'customer'").select(
        *key, F.col("lifecycle_status").alias("stored_status"), F.col("merged_into_external_subject_id").alias("_t")
    )
    theirs = snapshot.select(
        *key, F.col("lifecycle_status").alias("source_status"), F.col("merged_into_external_subject_id").alias("_st")
    )
    finding = (
        F.when(F.col("source_status").isNull(), F.lit("missing_in_source"))
        .when((F.col("source_status") == "inactive") & (F.col("stored_status") != "inactive"), F.lit("source_inactive"))
        .when((F.col("source_status") == "merged") & (F.col("stored_status") != "merged"), F.lit("source_merged"))
        .when(
            F.col("stored_status").isNull()
            | (F.col("source_status") != F.col("stored_status"))
            | ~F.col("_t").eqNullSafe(F.col("_st")),
            F.lit("conflicting_state"),
        )
    )
    return (
        mine.join(theirs, key, "full_outer")
        .withColumn("finding", finding)
        .where("finding is not null")
        .select(*key, "stored_status", "source_status", "finding")
    )
