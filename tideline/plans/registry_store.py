"""The published context registry as tables: jobs refresh it, micro-batches look it up.

Revisions, definitions and entries are written as one generation, the revisions last; a reader takes the generation of the newest
revisions, so it sees a whole publication or the one before.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame

from tideline import schemas
from tideline.operators import registry
from tideline.plans.tables import Tables
from tideline.session import cut

NAMES = ("registry_revisions", "registry_definitions", "registry_entries")
SCHEMAS = (schemas.REVISIONS, schemas.DEFINITIONS, schemas.ENTRIES)


class RegistryStore:
    def __init__(self, tables: Tables):
        self.tables = tables

    def load(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Revisions, definitions and entries as last published."""
        generation = self.tables.generation(NAMES[0])
        if generation == 0:
            return registry.empty_tables(self.tables.spark)
        return tuple(self.tables.current(name, generation) for name in NAMES)

    def refresh(self, source: DataFrame | None, at: datetime) -> str:
        """One load of the registry source: loaded, invalid, rejected, source_error, or locked while another job refreshes.

        Whatever goes wrong, the active revision stays. A document that is loaded again leaves equal tables.
        """
        with self.tables.claim("registry") as alone:
            if not alone:
                return "locked"
            new, status = registry.refresh(source, self.load(), at)
            if status in ("loaded", "invalid"):
                parts = [cut(df.select(*[f.split()[0] for f in schema.split(",")])) for df, schema in zip(new, SCHEMAS)]
                generation = self.tables.generation(NAMES[0]) + 1
                for name, rows in reversed(list(zip(NAMES, parts))):
                    self.tables.replace(name, rows, generation)
            return status

    def active(self) -> tuple[DataFrame | None, str | None]:
        """Definitions of the active revision with their status in it, and its name; None before the first publication."""
        revisions, definitions, entries = self.load()
        row = registry.load_active(revisions).first()
        if row is None:
            return None, None
        return registry.active_definitions(revisions, definitions, entries), row["registry_revision"]
