"""Top subjects per tenant over a rolling window of local days, by context with global fill-up."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline import vocab
from tideline.operators import projections


def in_window(as_of: datetime, days: int) -> Column:
    """Local days from `days` - 1 before today, where today is the row's own calendar date.

    The first bound is a plain date, so it prunes partitions; the second is exact.
    """
    loose = (as_of - timedelta(days=days + 1)).date()
    today = F.to_date(F.from_utc_timestamp(F.lit(as_of), F.col("timezone_name")))
    return (F.col("local_date") >= F.lit(loose)) & (
        F.col("local_date") >= F.date_sub(today, F.lit(days - 1))
    )


def _order() -> list[Column]:
    return [
        F.col("association_count").desc(),
        F.col("last_association_at").desc_nulls_last(),
        F.col("external_subject_id").asc(),
    ]


def totals(rows: DataFrame, subjects: DataFrame, keys: list[str]) -> DataFrame:
    """Association totals per key of subjects that are active."""
    sums = rows.groupBy(*keys).agg(
        F.sum("association_count").alias("association_count"),
        F.max("last_association_at").alias("last_association_at"),
    )
    active = subjects.where("lifecycle_status = 'active' and subject_type = 'customer'").select(
        "tenant_id", "external_subject_id"
    )
    return sums.join(active, ["tenant_id", "external_subject_id"], "left_semi")


def rank_global(daily: DataFrame, subjects: DataFrame, as_of: datetime, days: int = vocab.GLOBAL_WINDOW_DAYS, limit: int = vocab.DEFAULT_LIMIT) -> DataFrame:
    """Top rows of every tenant. The rank filter is pushed below the shuffle as a group limit, so a
    task sends at most `limit` rows per tenant."""
    sums = totals(daily.where(in_window(as_of, days)), subjects, ["tenant_id", "external_subject_id"])
    position = F.row_number().over(Window.partitionBy("tenant_id").orderBy(*_order()))
    return sums.withColumn("position", position).where(F.col("position") <= limit)


def rank_context(daily: DataFrame, subjects: DataFrame, active_definitions: DataFrame, as_of: datetime, days: int = vocab.CONTEXT_WINDOW_DAYS, limit: int = vocab.DEFAULT_LIMIT) -> DataFrame:
    """Top rows of every tenant and context that is active in the active revision."""
    keys = ["tenant_id", "context_key", "context_version"]
    current = active_definitions.where("status = 'active'").select("context_key", "context_version")
    rows = daily.where(in_window(as_of, days)).join(current, ["context_key", "context_version"], "left_semi")
    sums = totals(rows, subjects, [*keys, "external_subject_id"])
    position = F.row_number().over(Window.partitionBy(*keys).orderBy(*_order()))
    return sums.withColumn("position", position).where(F.col("position") <= limit)


def top_global(daily: DataFrame, subjects: DataFrame, tenant: str, as_of: datetime, days: int = vocab.GLOBAL_WINDOW_DAYS, limit: int = vocab.DEFAULT_LIMIT) -> DataFrame:
    """Top rows of one tenant: a filtered aggregate and a distributed top-k."""
    rows = daily.where((F.col("tenant_id") == tenant) & in_window(as_of, days))
    return totals(rows, subjects, ["tenant_id", "external_subject_id"]).orderBy(*_order()).limit(limit)


def context_status(requests: DataFrame, active_definitions: DataFrame) -> DataFrame:
    """Resolution status of requested (context_key, context_version) pairs."""
    known = active_definitions.select("context_key", "context_version", F.col("status").alias("_s"))
    status = (
        F.when(F.col("_s").isNull(), F.lit("unregistered"))
        .when(F.col("_s") == "inactive", F.lit("inactive_context"))
        .otherwise(F.lit("registered"))
    )
    return (
        requests.join(known, ["context_key", "context_version"], "left")
        .withColumn("resolution_status", status)
        .drop("_s")
    )


def compose(requests: DataFrame, context_rows: DataFrame, global_rows: DataFrame, limit: int = vocab.DEFAULT_LIMIT) -> DataFrame:
    """Results per request (tenant_id, context_key, context_version): its context rows first, then
    the tenant's global rows not yet present, up to `limit`. Inputs are already top-`limit` lists."""
    key = ["tenant_id", "context_key", "context_version"]
    columns = [*key, "external_subject_id", "association_count", "last_association_at", "position"]
    own = requests.select(*key).join(context_rows, key).select(*columns).withColumn("level", F.lit(0))
    fill = requests.select(*key).join(global_rows, "tenant_id").select(*columns).withColumn("level", F.lit(1))
    best = (
        own.unionByName(fill)
        .groupBy(*key, "external_subject_id")
        .agg(F.min(F.struct("level", "position", "association_count", "last_association_at")).alias("b"))
        .select(*key, "external_subject_id", "b.*")
    )
    order = Window.partitionBy(*key).orderBy("level", "position")
    return (
        best.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= limit)
        .withColumn("source_level", F.when(F.col("level") == 0, F.lit("context")).otherwise(F.lit("global")))
        .select(*key, "rank", "external_subject_id", "association_count", "last_association_at", "source_level")
    )


def envelopes(requests: DataFrame, results: DataFrame, statuses: DataFrame, ledger: DataFrame, as_of: datetime, version: int = 1, stale_after_seconds: int = vocab.STALE_AFTER_SECONDS, serve_stale: bool = False) -> DataFrame:
    """Level, freshness and error of every request's answer.

    A completed global run is always required, a context run only when context rows are served. The
    answer is as old as the older run it took rows from.
    """
    key = ["tenant_id", "context_key", "context_version"]
    counts = results.groupBy(*key).agg(
        F.count_if(F.col("source_level") == "context").alias("context_rows"),
        F.count_if(F.col("source_level") == "global").alias("global_rows"),
    )
    done = projections.last_completed(ledger).where(F.col("projection_version") == version)

    def run_time(name: str) -> Column:
        return done.where(F.col("projection_name") == name).select("computed_at").scalar()

    joined = (
        requests.select(*key)
        .withColumns({"_global": run_time(vocab.GLOBAL_PROJECTION), "_context": run_time(vocab.CONTEXT_PROJECTION)})
        .join(statuses.select("context_key", "context_version", "resolution_status"), ["context_key", "context_version"], "left")
        .join(counts, key, "left")
        .fillna(0, ["context_rows", "global_rows"])
    )
    has_context, has_fill = F.col("context_rows") > 0, F.col("global_rows") > 0
    level = F.when(has_context & has_fill, F.lit("mixed")).when(has_context, F.lit("context")).otherwise(F.lit("global"))
    computed = (
        F.when(has_context & has_fill, F.least("_context", "_global"))
        .when(has_context, F.col("_context"))
        .otherwise(F.col("_global"))
    )
    missing = F.col("_global").isNull() | (has_context & F.col("_context").isNull())
    age = F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros("computed_at")
    return (
        joined.withColumns({"source_level": level, "computed_at": computed, "_missing": missing})
        .withColumn("is_stale", F.coalesce(age > stale_after_seconds * 1_000_000, F.lit(False)))
        .withColumn(
            "error",
            F.when(F.col("_missing"), F.lit("projection_unavailable")).when(
                F.col("is_stale") & F.lit(not serve_stale), F.lit("projection_stale")
            ),
        )
        .select(
            *key, "resolution_status", "source_level",
            (F.col("source_level") != "context").alias("fallback_applied"),
            "computed_at", "is_stale", "error",
        )
    )


class ProjectionUnavailable(RuntimeError):
    """No completed run of a projection the answer needs."""


class ProjectionStale(RuntimeError):
    """The answer is older than allowed."""


@dataclass(frozen=True)
class SuggestionQuery:
    """Checked arguments of one suggestion request."""

    tenant_id: str
    subject_type: str = "customer"
    context_key: str | None = None
    context_version: int | None = None
    limit: int = vocab.DEFAULT_LIMIT

    def __post_init__(self):
        tenant = self.tenant_id.strip()
        key = (self.context_key or "").strip() or None
        object.__setattr__(self, "tenant_id", tenant)
        object.__setattr__(self, "context_key", key)
        ok = (
            0 < len(tenant.encode()) <= vocab.MAX_TEXT
            and self.subject_type == "customer"
            and (key is None) == (self.context_version is None)
            and (key is None or len(key.encode()) <= vocab.MAX_TEXT)
            and (self.context_version is None or self.context_version >= 1)
            and 1 <= self.limit <= vocab.MAX_LIMIT
        )
        if not ok:
            raise ValueError("invalid_query")

    @classmethod
    def parse(cls, parameters: dict[str, list[str] | str]) -> "SuggestionQuery":
        """From text parameters: known names only, one value each, whole numbers."""
        allowed = {"tenant_id", "subject_type", "context_key", "context_version", "limit"}
        values = {}
        for name, value in parameters.items():
            one = [value] if isinstance(value, str) else list(value)
            if name not in allowed or len(one) != 1:
                raise ValueError("invalid_query")
            values[name] = one[0]
        try:
            version = int(values["context_version"]) if values.get("context_version") else None
            limit = int(values["limit"]) if values.get("limit") else vocab.DEFAULT_LIMIT
        except ValueError:
            raise ValueError("invalid_query") from None
        return cls(
            values.get("tenant_id", ""), values.get("subject_type", ""),
            values.get("context_key"), version, limit,
        )


def suggest(query: SuggestionQuery, global_daily: DataFrame, context_daily: DataFrame, subjects: DataFrame, definitions: DataFrame, ledger: DataFrame, as_of: datetime, version: int = 1, global_days: int = vocab.GLOBAL_WINDOW_DAYS, context_days: int = vocab.CONTEXT_WINDOW_DAYS, serve_stale: bool = False) -> tuple[dict, DataFrame]:
    """Answer to one request: its envelope (one small row) and the result rows."""
    spark = subjects.sparkSession
    request = spark.createDataFrame(
        [(query.tenant_id, query.context_key or "", query.context_version or 0)],
        "tenant_id string, context_key string, context_version int",
    )

    def tenant_rows(df):
        return df.where(F.col("tenant_id") == query.tenant_id)

    context_rows = rank_context(
        tenant_rows(context_daily).where(
            (F.col("context_key") == (query.context_key or "")) & (F.col("context_version") == (query.context_version or 0))
        ),
        subjects, definitions, as_of, context_days, query.limit,
    )
    global_rows = rank_global(tenant_rows(global_daily), subjects, as_of, global_days, query.limit)
    results = compose(request, context_rows, global_rows, query.limit).drop("context_key", "context_version")
    keyed = results.withColumns(
        {"context_key": F.lit(query.context_key or ""), "context_version": F.lit(query.context_version or 0)}
    )
    envelope = envelopes(
        request, keyed, context_status(request, definitions), ledger, as_of, version, serve_stale=serve_stale
    ).first().asDict()
    if envelope["error"] == "projection_unavailable":
        raise ProjectionUnavailable(envelope["error"])
    if envelope["error"] == "projection_stale":
        raise ProjectionStale(envelope["error"])
    if query.context_key is None:
        for name in ("context_key", "context_version", "resolution_status", "source_level", "fallback_applied"):
            envelope.pop(name)
    envelope.update(subject_type="customer", global_days=global_days, context_days=context_days, projection_version=version)
    envelope.pop("error")
    return envelope, results.orderBy("rank")
