"""Input tables: schemas, readers, and the fixture adapter over the driver's tables."""

from .schemas import SCHEMAS, TABLE_NAMES
from .tables import Tables, read_bucketed, read_tables, write_bucketed, write_tables

__all__ = ["SCHEMAS", "TABLE_NAMES", "Tables", "read_bucketed", "read_tables", "write_bucketed", "write_tables"]
