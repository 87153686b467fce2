"""Registered queries: a Spark function per operator and, where SQL can say it, the checking SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.session import configure


@dataclass(frozen=True)
class Query:
    name: str
    covers: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def presented(df: DataFrame) -> DataFrame:
    """Plain result types: zone-less timestamps and doubles, so any reader compares them alike."""
    plain = {}
    for field in df.schema.fields:
        kind = field.dataType.simpleString()
        if kind == "timestamp":
            plain[field.name] = F.col(field.name).cast("timestamp_ntz")
        elif kind.startswith("decimal"):
            plain[field.name] = F.col(field.name).cast("double")
    return df.withColumns(plain) if plain else df


def query(covers: str, sql: str | None = None, name: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under its name."""

    def register(fn):
        key = name or fn.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return presented(fn(configure(spark), sf_dir))

        run.__name__ = key
        run.__doc__ = fn.__doc__
        if key in REGISTRY:
            raise ValueError(f"query {key} is registered twice")
        REGISTRY[key] = Query(key, covers, run, sql)
        return fn

    return register


def load_all() -> dict[str, Query]:
    from tideline.plans import (  # noqa: F401
        queries_daily,
        queries_decode,
        queries_dedup,
        queries_items,
        queries_ops,
        queries_subjects,
    )

    return REGISTRY
