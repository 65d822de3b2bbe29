"""The receivables ledger: one row per sold item and instalment, 47 columns.

Plan shape (see README "Physical plan"):

1. order context, one row per paid session (joins on the session id, one shuffle key);
2. tickets and extras joined to their catalogue tables and to the context;
3. union, gateway charge lookup per item, then the instalment explode and all per-instalment
   arithmetic (narrow, one whole-stage-codegen block);
4. week calendar lookup (broadcast);
5. report filters and the final projection.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.present import LEDGER_COLUMNS, presented, settlement_status
from ..operators.calendar import attach_week
from ..operators.filters import Params, apply, between
from ..operators.gateway import attach_charge_rate, with_gateway_cost
from ..operators.instalments import add_splits, explode_instalments
from ..operators.items import items
from ..sources import Tables


def item_rows(
    tables: Tables, params: Params | None = None, weighted: bool = False, orders: DataFrame | None = None
) -> DataFrame:
    """Level 1: sold items of both branches."""
    return items(tables, params or Params(), weighted=weighted, orders=orders)


def instalment_rows(tables: Tables, params: Params | None = None, weighted: bool = False) -> DataFrame:
    """Levels 2-4 without the gateway lookup: item x instalment with splits."""
    params = params or Params()
    return add_splits(explode_instalments(item_rows(tables, params, weighted), params))


def ledger_rows(
    tables: Tables, params: Params | None = None, weighted: bool = False, orders: DataFrame | None = None
) -> DataFrame:
    """Every computed column (the 47 output columns and the intermediate ones). Building the
    plan starts no Spark job. ``orders`` as for :func:`.items.items`."""
    params = params or Params()
    return rows_of_items(charged_items(tables, params, weighted, orders), tables, params)


def charged_items(
    tables: Tables, params: Params, weighted: bool = False, orders: DataFrame | None = None
) -> DataFrame:
    """Level 1 with the gateway's charge rates: all that does not depend on the instalment."""
    return attach_charge_rate(item_rows(tables, params, weighted, orders), tables)


def rows_of_items(charged: DataFrame, tables: Tables, params: Params) -> DataFrame:
    """:func:`ledger_rows` of its :func:`charged_items`, or of some of them; narrow but for the lookup of the week."""
    rows = with_gateway_cost(add_splits(explode_instalments(charged, params)))
    rows = attach_week(rows, tables)
    rows = rows.select(
        "*",
        settlement_status(F.col("settlement_date"), params.as_of).alias("settlement_status"),
        *[v.alias(k) for k, v in presented().items()],
    )
    return chosen_rows(rows, params)


def chosen_rows(rows: DataFrame, params: Params) -> DataFrame:
    """F11-F13 on rows with a settlement date and class."""
    return apply(
        rows,
        between(F.col("settlement_date"), params.settled_between),
        between(F.col("purchase_date"), params.bought_between),
        None if params.status is None else F.col("settlement_status") == F.lit(params.status),
    )


def ledger(
    tables: Tables, params: Params | None = None, weighted: bool = False, orders: DataFrame | None = None
) -> DataFrame:
    """The 47-column ledger (PR01). Unused columns are pruned by Catalyst downstream.

    With ``weighted`` a row that stands for several equal ones comes once, with their number in a
    48th column ``copies``: the form that :mod:`.reports` adds up without expanding it."""
    return ledger_rows(tables, params, weighted, orders).select(*LEDGER_COLUMNS, *(["copies"] if weighted else []))


def ordered(ledger_df: DataFrame) -> DataFrame:
    """Newest orders first, at the very end of a job. Ties are broken by item and instalment,
    so the rows of one hot order span several range partitions."""
    return ledger_df.orderBy(*_newest_first())


def ordered_of_items(placed: DataFrame, tables: Tables, params: Params) -> DataFrame:
    """:func:`ordered` of the ledger of items that lie in ranges already (:func:`.order.in_ranges`): the rows of an
    item stay in its partition, which is sorted; nothing is shuffled."""
    return rows_of_items(placed, tables, params).select(*LEDGER_COLUMNS).sortWithinPartitions(*_newest_first())


def _newest_first() -> list:
    return [F.col("order_id").desc(), "item_id", "instalment_no", "settlement_date"]


def display_names(ledger_df: DataFrame, headings: Mapping[str, str]) -> DataFrame:
    """The ledger under the caller's headings (column -> heading); others keep their names."""
    return ledger_df.select(*[F.col(c).alias(headings.get(c, c)) for c in ledger_df.columns])
