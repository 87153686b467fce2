"""Costly expressions evaluated once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds or replaces columns whose expressions must not be copied into later steps.

    The values pass through a one-row generator. Filters and projections behind it read columns;
    without it the optimizer copies a parsed payload into every place that names one of its members. The values are made in a
    projection below the generator: inside one, an expression with a lambda would have all of them interpreted.
    """
    kept = [c for c in df.columns if c not in columns]
    made = df.select(*kept, *[c.alias(f"_once_{n}") for n, c in columns.items()])
    values = F.struct(*[F.col(f"_once_{n}").alias(n) for n in columns])
    return made.select(*kept, F.inline(F.array(values)))
