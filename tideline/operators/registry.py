"""The context registry: validation, publication, resolution of old facts, unregistered counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline import schemas, vocab
from tideline.session import cut

KEY = ["context_key", "context_version"]


def entries(registry: DataFrame) -> DataFrame:
    """Registry documents to one row per definition, with the header fields."""
    return registry.select(
        "schema_version", "registry_version", "registry_revision", F.explode("contexts").alias("c")
    ).select("schema_version", "registry_version", "registry_revision", "c.*")


def violations(registry: DataFrame) -> DataFrame:
    """Rows (registry_revision, rule, context_key, context_version) for every broken rule."""
    header = registry.where(
        ~F.coalesce(
            (F.col("schema_version") == 1)
            & (F.col("registry_version") >= 1)
            & (F.col("registry_revision") != "")
            & (F.size("contexts") > 0),
            F.lit(False),
        )
    ).select(
        "registry_revision", F.lit("header").alias("rule"),
        F.lit(None).cast("string").alias("context_key"), F.lit(None).cast("int").alias("context_version"),
    )
    rows = entries(registry)

    def broken(rule, found):
        return found.select("registry_revision", F.lit(rule).alias("rule"), *KEY)

    bad = rows.where(
        ~F.coalesce(
            (F.col("context_key") != "")
            & (F.col("context_version") >= 1)
            & F.col("context_family").isin(*vocab.CONTEXT_FAMILIES)
            & F.col("status").isin("active", "inactive"),
            F.lit(False),
        )
    )
    repeated = rows.groupBy("registry_revision", *KEY).count().where("count > 1")
    half = rows.where(F.col("parent_context_key").isNull() != F.col("parent_context_version").isNull())
    child = rows.where("parent_context_key is not null and parent_context_version is not null")
    parents = rows.select(
        F.col("registry_revision").alias("_r"), F.col("context_key").alias("_k"), F.col("context_version").alias("_v")
    ).distinct()
    on = (
        (F.col("registry_revision") == F.col("_r"))
        & (F.col("parent_context_key") == F.col("_k"))
        & (F.col("parent_context_version") == F.col("_v"))
    )
    orphan = child.join(parents, on, "left_anti")
    return (
        header.unionByName(broken("definition", bad))
        .unionByName(broken("duplicate", repeated))
        .unionByName(broken("half_parent", half))
        .unionByName(broken("missing_parent", orphan))
        .unionByName(broken("cycle", cycles(rows)))
    )


def cycles(rows: DataFrame) -> DataFrame:
    """Definitions that reach themselves through their parents.

    Pointer doubling: each pass replaces a definition's ancestor by that ancestor's ancestor, so a
    chain of n links ends after log2(n) joins; what still has an ancestor then lies on or below a
    cycle, and the definitions that are such an ancestor lie on it.
    """
    node = F.struct("registry_revision", *KEY)
    parent = F.struct(
        F.col("registry_revision"),
        F.col("parent_context_key").alias("context_key"),
        F.col("parent_context_version").alias("context_version"),
    )
    links = rows.where("parent_context_key is not null and parent_context_version is not null").select(
        node.alias("node"), parent.alias("up")
    ).dropDuplicates(["node"])
    count = links.count()
    jump = links
    for _ in range(max(count, 1).bit_length()):
        above = jump.select(F.col("node").alias("_n"), F.col("up").alias("_u"))
        jump = cut(jump.join(above, F.col("up") == F.col("_n")).select("node", F.col("_u").alias("up")))
        if jump.isEmpty():
            break
    on_cycle = jump.select("up").distinct()
    return on_cycle.select("up.*").select("registry_revision", *KEY)


def checksum(registry: DataFrame) -> DataFrame:
    """Adds `payload_checksum`: hex SHA-256 of the document in fixed member order, nulls written."""
    options = {"ignoreNullFields": "false"}
    document = F.to_json(
        F.struct("schema_version", "registry_version", "registry_revision", "contexts"), options
    )
    return registry.withColumn("payload_checksum", F.sha2(document, 256))


class RegistryRejected(ValueError):
    """A revision that may not be published; the active one stays."""


def publish(
    registry: DataFrame,
    revisions: DataFrame,
    definitions: DataFrame,
    entries_table: DataFrame,
    at,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Checks a valid document against the published tables and returns their new contents.

    revisions: registry_version, registry_revision, schema_version, payload_checksum, status,
    activated_at; definitions: context_key, context_version, context_family, parent_*;
    entries_table: registry_revision, context_key, context_version, status.
    """
    new = checksum(registry).select(
        "schema_version", "registry_version", "registry_revision", "payload_checksum"
    )
    rows = entries(registry)
    active = revisions.where("status = 'valid' and activated_at is not null")
    others = active.join(new.select("registry_revision"), "registry_revision", "left_anti")
    checks = {
        "the registry version must grow": new.where(F.col("registry_version") <= others.select(F.max("registry_version")).scalar()),
        "revision reused with another checksum": new.join(
            revisions.select(F.col("payload_checksum").alias("_c"), F.col("registry_revision").alias("_r")),
            (F.col("registry_revision") == F.col("_r")) & (F.col("payload_checksum") != F.col("_c")),
        ),
        "published family changed": rows.join(
            definitions.select(*KEY, F.col("context_family").alias("_f")), KEY
        ).where("context_family <> _f"),
        "published parent changed": rows.join(
            definitions.select(
                *KEY, F.col("parent_context_key").alias("_pk"), F.col("parent_context_version").alias("_pv")
            ),
            KEY,
        ).where("not (parent_context_key <=> _pk) or not (parent_context_version <=> _pv)"),
    }
    for reason, found in checks.items():
        if not found.isEmpty():
            raise RegistryRejected(reason)
    stamp = F.lit(at).cast("timestamp")
    kept = revisions.join(new.select("registry_revision"), "registry_revision", "left_anti").withColumn(
        "activated_at", F.lit(None).cast("timestamp")
    )
    earlier = revisions.select("registry_revision", F.col("activated_at").alias("_was"))
    published = (
        new.join(earlier, "registry_revision", "left")
        .withColumn("status", F.lit("valid"))
        .withColumn("activated_at", F.coalesce(F.col("_was"), stamp))
        .drop("_was")
    )
    fresh = rows.join(definitions.select(*KEY), KEY, "left_anti").select(
        *KEY, "context_family", "parent_context_key", "parent_context_version"
    )
    own = rows.select("registry_revision", *KEY, "status")
    others = entries_table.join(own.drop("status"), ["registry_revision", *KEY], "left_anti")
    return (
        kept.unionByName(published.select(*kept.columns)),
        definitions.unionByName(fresh.select(*definitions.columns)),
        others.select(*own.columns).unionByName(own),
    )


def record_invalid(registry: DataFrame, revisions: DataFrame) -> DataFrame:
    """Appends a revision with a usable header as invalid, unless the revision is known."""
    new = checksum(registry).where(
        "schema_version = 1 and registry_version >= 1 and registry_revision <> ''"
    ).select("schema_version", "registry_version", "registry_revision", "payload_checksum")
    unknown = new.join(revisions.select("registry_revision"), "registry_revision", "left_anti")
    row = unknown.withColumn("status", F.lit("invalid")).withColumn(
        "activated_at", F.lit(None).cast("timestamp")
    )
    return revisions.unionByName(row.select(*revisions.columns))


def load_active(revisions: DataFrame) -> DataFrame:
    """The latest activated valid revision, or no row."""
    return (
        revisions.where("status = 'valid' and activated_at is not null")
        .groupBy()
        .agg(F.max_by(F.struct(*revisions.columns), F.struct("activated_at", "registry_version")).alias("r"))
        .where("r is not null")
        .select("r.*")
    )


def active_definitions(revisions: DataFrame, definitions: DataFrame, entries_table: DataFrame) -> DataFrame:
    """Definitions of the active revision with their status in it."""
    return (
        entries_table.join(load_active(revisions).select("registry_revision"), "registry_revision")
        .join(definitions, KEY)
        .select("registry_revision", *KEY, "context_family", "status")
    )


def resolve_history(rows: DataFrame, definitions: DataFrame, active: DataFrame, revision: str, at) -> DataFrame:
    """Resolves facts that no revision has seen yet, whatever their normalization.

    Family comes from any published definition, the status from its entry in this revision.
    Resolved rows get a new updated_at, so the projections pick them up; the rest is unchanged.
    """
    known = definitions.select(*KEY, F.col("context_family").alias("_family")).join(
        active.select(*KEY, F.col("status").alias("_status")), KEY, "left"
    )
    open_row = F.col("context_registry_revision").isNull()
    joined = rows.join(
        known.select(F.col("context_key").alias("_k"), F.col("context_version").alias("_v"), "_family", "_status"),
        (F.col("context_key") == F.col("_k")) & (F.col("context_version") == F.col("_v")),
        "left",
    )
    status = (
        F.when(F.col("context_key").isNull() | F.col("context_version").isNull(), F.lit("family_unresolved"))
        .when(F.col("_status").isNull(), F.lit("unregistered"))
        .when(F.col("_status") == "inactive", F.lit("inactive_context"))
        .otherwise(F.lit("registered"))
    )
    return joined.withColumns(
        {
            "context_resolution_status": F.when(open_row, status).otherwise(F.col("context_resolution_status")),
            "resolved_context_family": F.when(open_row, F.col("_family")).otherwise(F.col("resolved_context_family")),
            "updated_at": F.when(open_row, F.lit(at).cast("timestamp")).otherwise(F.col("updated_at")),
            "context_registry_revision": F.coalesce("context_registry_revision", F.lit(revision)),
        }
    ).select(*rows.columns)


def unregistered(rows: DataFrame) -> DataFrame:
    """Counter rows of the unregistered contexts among the given facts."""
    return (
        rows.where("context_resolution_status = 'unregistered' and context_key is not null and context_version is not null")
        .groupBy(*KEY)
        .agg(
            F.max("claimed_context_family").alias("claimed_context_family"),
            F.min("event_time").alias("first_seen_at"),
            F.max("event_time").alias("last_seen_at"),
            F.count(F.lit(1)).alias("event_count"),
        )
        .withColumn("reconciliation_status", F.lit("pending"))
    )


def merge_unregistered(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Adds new counters to the stored ones; the first sight and a known family stay."""
    tagged = stored.withColumn("_rank", F.lit(0)).unionByName(new.withColumn("_rank", F.lit(1)))
    return tagged.groupBy(*KEY).agg(
        F.min_by(
            "claimed_context_family", F.when(F.col("claimed_context_family").isNotNull(), F.col("_rank"))
        ).alias("claimed_context_family"),
        F.min_by("first_seen_at", "_rank").alias("first_seen_at"),
        F.max("last_seen_at").alias("last_seen_at"),
        F.sum("event_count").alias("event_count"),
        F.max_by("reconciliation_status", "_rank").alias("reconciliation_status"),
    )


def empty_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Revisions, definitions and entries before the first publication."""
    return (
        spark.createDataFrame([], schemas.REVISIONS),
        spark.createDataFrame([], schemas.DEFINITIONS),
        spark.createDataFrame([], schemas.ENTRIES),
    )


def refresh(registry: DataFrame | None, tables: tuple, at) -> tuple[tuple, str]:
    """One load of the registry source against the published tables.

    Returns the tables and what happened: loaded, invalid, rejected or source_error. Whatever goes
    wrong, the active revision stays as it was.
    """
    revisions, definitions, entries_table = tables
    if registry is None:
        return tables, "source_error"
    if not violations(registry).isEmpty():
        return (record_invalid(registry, revisions), definitions, entries_table), "invalid"
    try:
        return publish(registry, revisions, definitions, entries_table, at), "loaded"
    except RegistryRejected:
        return tables, "rejected"
