"""settlekit: an instalment-receivables ledger for ticketing checkouts, on Spark DataFrames.

    from settlekit import Params, ledger, read_tables
    tables = read_tables(spark, "/data/checkout")          # 28 parquet tables
    df = ledger(tables, Params(as_of=date(2024, 1, 5)))     # 47 columns
"""

from .operators.filters import Params
from .plans.folded import folded_ledger
from .plans.ledger import display_names, ledger, ledger_rows, ordered
from .plans import reports
from .session import build_session
from .sources import Tables, read_tables

__all__ = [
    "Params", "Tables", "build_session", "display_names", "folded_ledger", "ledger", "ledger_rows", "ordered",
    "read_tables", "reports",
]
