"""Times the headline queries and the published volume runs; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from datetime import datetime, timezone

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from tideline.operators import dimension  # noqa: E402
from tideline.plans import projection  # noqa: E402
from tideline.plans.catalog import load_all  # noqa: E402
from tideline.plans.tables import Tables  # noqa: E402
from tideline.session import drop_cuts, local_session  # noqa: E402

HEADLINE = (
    "top_subjects_from_raw", "event_decisions", "message_decode", "payload_safety", "site_eligibility", "exact_repeats",
    "semantic_repeats", "purchase_line_repeats", "page_view_debounce", "item_lines", "order_headers", "subject_facts",
    "subject_dimension", "lifecycle_order", "context_resolution", "global_daily", "context_daily", "incremental_daily",
    "global_ranking", "context_ranking", "composed_suggestions", "sessions", "quota_audit", "value_histogram", "item_scores_by_level",
)


def consume(df) -> None:
    """Computes every row and column without shipping them."""
    df.write.format("noop").mode("overwrite").save()


def volume_projection(spark, base: str) -> float:
    """The published volume: 500k associations of 100k subjects in 20 tenants, both projections."""
    now = datetime.now(timezone.utc).replace(microsecond=0)
    n = F.col("id")
    subject = (n % 100_000).alias("s")
    facts = spark.range(500_000).select(
        F.concat(F.lit("tenant-"), ((n % 100_000) % 20).cast("string")).alias("tenant_id"), F.lit("customer").alias("subject_type"),
        subject.cast("string").alias("external_subject_id"), F.current_date().alias("local_date"), F.lit("UTC").alias("timezone_name"),
        F.lit("subject_associated").alias("event_name"), F.lit(now).cast("timestamp").alias("event_time"),
        F.lit(now).cast("timestamp").alias("updated_at"), F.lpad(n.cast("string"), 9, "0").alias("row_id"),
        F.lit("normalized").alias("normalization_status"), F.lit("registered").alias("context_resolution_status"),
        F.lit("ctx").alias("context_key"), F.lit(1).alias("context_version"),
    )
    facts.write.parquet(f"{base}/facts")
    subjects = spark.range(100_000).select(
        F.concat(F.lit("tenant-"), (n % 20).cast("string")).alias("tenant_id"), F.lit("customer").alias("subject_type"), n.cast("string").alias("external_subject_id")
    )
    subjects.write.parquet(f"{base}/subjects")
    tables = Tables(spark, f"{base}/tables")
    started = time.time()
    projection.run_all(tables, spark.read.parquet(f"{base}/facts"), spark.read.parquet(f"{base}/subjects"), now)
    elapsed = time.time() - started
    total = projection.read_daily(tables, False).agg(F.count(F.lit(1)), F.sum("association_count"), F.count_distinct("tenant_id")).first()
    assert tuple(total) == (100_000, 500_000, 20), total
    return elapsed


def volume_bootstrap(spark, base: str) -> float:
    """The published volume: 100k snapshot subjects into the dimension."""
    n = F.col("id")
    rows = spark.range(100_000).select(
        F.concat(F.lit("tenant-"), (n % 20).cast("string")).alias("tenant_id"), n.cast("string").alias("external_subject_id"),
        F.lit("active").alias("lifecycle_status"), F.lit(datetime(2026, 1, 1, tzinfo=timezone.utc)).cast("timestamp").alias("source_updated_at"),
        F.lit("m").alias("source_mutation_id"), F.lit(None).cast("string").alias("merged_into_external_subject_id"),
    )
    rows.write.parquet(f"{base}/snapshot")
    started = time.time()
    snapshot = spark.read.parquet(f"{base}/snapshot")
    Tables(spark, f"{base}/boot").write_batch("subject_changes", dimension.fold(dimension.changes_from_snapshot(snapshot)), "0")
    return time.time() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, partitions=int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("OFF")
    catalog = load_all()
    consume(catalog["sessions"].run(spark, sf_dir))  # starts the JVM's compilers
    times = {}
    for name in HEADLINE:
        started = time.time()
        consume(catalog[name].run(spark, sf_dir))
        times[name] = round(time.time() - started, 3)
        print(f"{name} {times[name]}", file=sys.stderr)
    base = tempfile.mkdtemp(prefix="run-tideline-")
    volume = {
        "projection_100k_subjects_500k_events": round(volume_projection(spark, f"{base}/p"), 3),
        "bootstrap_100k_subjects": round(volume_bootstrap(spark, f"{base}/b"), 3),
    }
    drop_cuts(spark)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "volume_runs": volume,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
