"""Tables in, shared work files out."""

from auditloom.sources.tables import table
from auditloom.sources.work import shared_dir, spread, stage_table

__all__ = ["table", "stage_table", "shared_dir", "spread"]
