"""Level 2-4: one row per item and instalment (L01, R22-R43 minus the gateway lookup)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import instalment as I
from .filters import Params


def explode_instalments(items: DataFrame, params: Params | None = None) -> DataFrame:
    """An item paid in N instalments becomes N rows (an empty plan drops the item).

    The explode is narrow; everything that does not depend on the instalment number was
    computed per item before it, so joins and shuffles upstream see items, not item x N.
    """
    params = params or Params()
    c = F.col
    n = c("instalments")
    rows = items.select("*", F.explode("instalment_plan").alias("plan_k")).drop("instalment_plan")
    rows = rows.select(
        "*",
        I.item_fraction(n).alias("item_fraction"),
        I.instalment_seq(c("payment_method"), c("plan_k")).alias("instalment_seq"),
        I.settlement_date(c("purchase_date"), c("payment_method"), c("plan_k"), params.settlement_days)
        .alias("settlement_date"),
        *[v.alias(k) for k, v in I.instalment_amounts(n).items()],
    )
    return rows


def add_splits(rows: DataFrame) -> DataFrame:
    """Platform / producer splits and the producer's total."""
    rows = rows.select("*", *[v.alias(k) for k, v in I.revenue_splits().items()])
    rows = rows.select("*", *[v.alias(k) for k, v in I.issue_charges().items()])
    return rows.withColumn("producer_total", I.producer_total())
