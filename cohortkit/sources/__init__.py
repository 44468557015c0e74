"""Sessions, tables and lineage cuts."""

from cohortkit.sources.people import people
from cohortkit.sources.tables import cut_lineage, discard, keep, load, new_path, session, table

__all__ = ["cut_lineage", "discard", "keep", "load", "new_path", "people", "session", "table"]
