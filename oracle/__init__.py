"""DuckDB restatement of the ledger, used as the correctness oracle for the Spark views."""

from .queries import queries

__all__ = ["queries"]
