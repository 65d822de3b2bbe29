"""Presentation rules (R44-R51) and the 47 output columns."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from .instalment import EXTRA
from .order import COURTESY, CREDIT_CARD

# ---- fixed values: settlement classes ------------------------------------------------------
PAYABLE = "repassável"
FUTURE = "futuro"
# --------------------------------------------------------------------------------------------


def settlement_status(settlement: Column, as_of: dt.date) -> Column:
    """Payable once the settlement date is reached (no date -> future)."""
    return F.when(settlement <= F.lit(as_of), F.lit(PAYABLE)).otherwise(F.lit(FUTURE))


def presented() -> dict[str, Column]:
    """R45-R51."""
    c = F.col
    courtesy = c("payment_method") == COURTESY
    not_card = c("payment_method") != CREDIT_CARD
    discount = F.when(c("discount_share") > c("list_share"), c("list_share")).otherwise(c("discount_share"))
    return {
        "race_group": F.when(c("category") == EXTRA, F.lit(EXTRA)).otherwise(c("race_name")),
        "list_price": F.when(courtesy, F.lit(0.0)).otherwise(c("item_price")),
        "instalment_count": F.when(not_card, F.lit(0)).otherwise(c("instalments")),
        "instalment_no": F.when(not_card, F.lit(0)).otherwise(c("instalment_seq")),
        "instalment_amount": F.when(c("item_total") < 0, F.lit(0.0)).otherwise(c("item_total")),
        "gross_amount": F.when(courtesy, F.lit(0.0)).otherwise(c("list_share")),
        "discount_amount": F.when(courtesy, F.lit(0.0)).otherwise(discount),
        "net_amount": F.when(courtesy, F.lit(0.0)).otherwise(c("list_share") - discount),
    }


#: The 47 output columns in order.
LEDGER_COLUMNS: list[str] = [
    "item_id", "order_id", "purchase_date", "settlement_date", "settlement_status", "edition", "event",
    "category", "race_group", "item_name", "item_type", "item_fraction", "list_price", "order_status",
    "item_status", "item_status_detail", "linked_item_id", "payment_method", "card_brand", "gateway",
    "gateway_order_ref", "gateway_cost", "convenience_rate", "issue_rate", "issue_fixed",
    "refund_cover_rate", "transfer_rate", "instalment_count", "instalment_no", "instalment_amount",
    "gross_amount", "discount_amount", "net_amount", "platform_convenience", "producer_items",
    "platform_issue_pct", "platform_issue_fixed", "refund_cover_amount", "platform_refund_cover",
    "producer_refund_cover", "transfer_amount", "platform_transfer", "producer_transfer",
    "platform_interest", "platform_freight", "producer_total", "settlement_week",
]
