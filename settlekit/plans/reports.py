"""Report jobs over the ledger (P01-P05), the pivots the source shows as spreadsheet examples.

Each is a single hash aggregate (partial aggregation before the shuffle, so a hot group costs
one row per map task) over a handful of ledger columns; Catalyst prunes the rest of the ledger.
Money is summed in whole units of 1e-12 and the total rounded once (:func:`~settlekit.functions.money.total`), so totals
do not depend on the order rows arrive in. Items are counted, not summed: rows per instalment
count first, then each count over its instalments. A weighted ledger (``ledger(...,
weighted=True)``) counts each row ``copies`` times, in the aggregate itself: nothing is expanded.
P01-P04 also take a :func:`~settlekit.plans.folded.folded_ledger` by their keys (``LOT``, ``EVENT``,
or none for P04), whose items are added up before they are exploded into instalments.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import total, units
from ..functions.order import COURTESY
from ..sources import Tables


LOT = ["edition", "event", "item_name", "item_type", "list_price"]
EVENT = ["edition", "event"]


def _copies(ledger: DataFrame) -> Column:
    """How many equal rows a row stands for."""
    return F.col("copies") if "copies" in ledger.columns else F.lit(1).cast("long")


def _units(ledger: DataFrame, column: str) -> Column:
    """A column in units, for all copies of the row."""
    if f"{column}_units" in ledger.columns:  # a folded ledger has them added up
        return F.col(f"{column}_units")
    return units(F.col(column)) * _copies(ledger) if "copies" in ledger.columns else units(F.col(column))


def _per_fraction(ledger: DataFrame, keys: Sequence[str], **sums: str) -> DataFrame:
    """Rows and sums of columns (in units) per key and instalment count of the rows."""
    return ledger.groupBy(*keys, F.round(1 / F.col("item_fraction")).alias("_n")).agg(
        F.sum(_copies(ledger)).alias("_rows"), *[F.sum(_units(ledger, c)).alias(name) for name, c in sums.items()]
    )


def _items() -> Column:
    """Items of :func:`_per_fraction` groups: n rows of n instalments are one item."""
    return total(units(F.col("_rows") / F.col("_n")))


def lots(ledger: DataFrame, editions: Sequence[str] | None = None) -> DataFrame:
    """Per lot (event, item, type, list price) the items sold and the producer total."""
    if editions is not None:
        ledger = ledger.where(F.col("edition").isin(list(editions)))
    return _lots(_per_fraction(ledger, LOT, producer="producer_total"))


def _lots(counted: DataFrame) -> DataFrame:
    return counted.groupBy(*LOT).agg(_items().alias("items_sold"), total(F.col("producer")).alias("producer_total"))


def producer_totals(ledger: DataFrame) -> DataFrame:
    """Producer total per edition and event, payable versus future."""
    return ledger.groupBy("edition", "event", "settlement_status").agg(
        total(_units(ledger, "producer_total")).alias("producer_total"),
        F.sum(_copies(ledger)).alias("rows"),
    )


def courtesies(ledger: DataFrame) -> DataFrame:
    """Courtesies per event and what their issue costs the producer."""
    return _courtesies(_per_fraction(ledger.where(F.col("payment_method") == COURTESY), EVENT, cost="platform_issue_fixed"))


def _courtesies(counted: DataFrame) -> DataFrame:
    return counted.groupBy(*EVENT).agg(_items().alias("courtesies"), total(F.col("cost")).alias("issue_cost"))


def weekly(ledger: DataFrame) -> DataFrame:
    """Receipts per settlement week."""
    return ledger.groupBy("settlement_week", "settlement_status").agg(
        *[total(_units(ledger, c)).alias(c) for c in ("instalment_amount", "producer_total", "gateway_cost")]
    )


def reconcile(ledger: DataFrame, tables: Tables) -> DataFrame:
    """Per order the instalments in the ledger against the order total of its summary.

    Equal only for paid orders where every item is present and the shares add up; transfers,
    extras-only orders and cancelled items make them differ by design, and that gap is the
    report's point.
    """
    paid = ledger.groupBy("order_id").agg(total(_units(ledger, "instalment_amount")).alias("ledger_amount"))
    summary = tables.checkoutsummary.select(
        F.col("sessionid").alias("order_id"), F.col("totalAmount").alias("order_total")
    )
    joined = paid.join(summary, "order_id", "left")
    six = lambda c: F.round(F.col(c).cast("decimal(30,12)"), 6)
    return joined.select(
        "order_id",
        "ledger_amount",
        "order_total",
        (six("ledger_amount") - six("order_total")).cast("double").alias("difference"),
    )


def week_sums(ledger: DataFrame) -> dict[str, DataFrame]:
    """What P01-P04 need of each settlement week: counts and whole-unit sums, which add up over
    weeks without rounding. `_rows` is above 0 in every row."""
    week = "settlement_week"
    sums = lambda *cs: [F.sum(_units(ledger, c)).alias(c) for c in cs]
    rows = F.sum(_copies(ledger)).alias("_rows")
    return {
        "lots": _per_fraction(ledger, [week, *LOT], producer="producer_total"),
        "producer_totals": ledger.groupBy(week, *EVENT, "settlement_status").agg(rows, *sums("producer_total")),
        "courtesies": _per_fraction(ledger.where(F.col("payment_method") == COURTESY), [week, *EVENT], cost="platform_issue_fixed"),
        "weekly": ledger.groupBy(week, "settlement_status").agg(rows, *sums("instalment_amount", "producer_total", "gateway_cost")),
    }


def from_week_sums(parts: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """P01-P04 from the sums of all weeks (:func:`week_sums`, as read back)."""
    of = {name: df.where(F.col("_rows") > 0) for name, df in parts.items()}
    again = lambda df, keys, name: df.groupBy(*keys, "_n").agg(F.sum("_rows").alias("_rows"), F.sum(name).alias(name))
    amounts = ("instalment_amount", "producer_total", "gateway_cost")
    return {
        "lots": _lots(again(of["lots"], LOT, "producer")),
        "producer_totals": of["producer_totals"].groupBy(*EVENT, "settlement_status").agg(
            total(F.col("producer_total")).alias("producer_total"), F.sum("_rows").alias("rows")
        ),
        "courtesies": _courtesies(again(of["courtesies"], EVENT, "cost")),
        "weekly": of["weekly"].groupBy("settlement_week", "settlement_status").agg(*[total(F.col(c)).alias(c) for c in amounts]),
    }
