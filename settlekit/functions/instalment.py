"""Instalment-level rules (R22-R43): one row per item and instalment.

``k`` is the instalment number taken from the plan, ``n`` the order's instalment count
(0 allowed; used as 1 when dividing).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .money import non_zero_count, per_instalment, zero_if_null
from .order import COURTESY, CREDIT_CARD
from .status import TAKEN_OVER

TICKET = "ticket"
EXTRA = "extra"


def square_days(k: Column) -> Column:
    """Default settlement delay: instalment k settles k*k days after the purchase."""
    return k * k


def item_fraction(n: Column) -> Column:
    """1/n per row, so summing it counts items."""
    return F.lit(1) / non_zero_count(n).cast("double")


def instalment_seq(method: Column, k: Column) -> Column:
    """The instalment number; 1 for anything but a credit card."""
    return F.when(method != CREDIT_CARD, F.lit(1)).otherwise(k)


def settlement_date(
    purchase: Column, method: Column, k: Column, days: Callable[[Column], Column] = square_days
) -> Column:
    """Card instalments settle ``days(k)`` after the purchase, everything else at once; an
    instalment whose number is null has no date."""
    delay = F.when(method != CREDIT_CARD, F.lit(0)).otherwise(days(k))
    return F.date_add(purchase, F.when(k.isNotNull(), delay))


def instalment_amounts(n: Column) -> dict[str, Column]:
    """R25-R33 from the item-level totals and shares."""
    c = F.col
    ts, es = c("ticket_share"), c("extra_share")
    is_ticket = c("category") == TICKET
    products_part = per_instalment(c("products_value"), es, n)
    gross_total = (
        zero_if_null(c("tickets_value")) + zero_if_null(c("tax")) + zero_if_null(c("insurance"))
        + zero_if_null(c("interest")) + zero_if_null(c("freight")) - zero_if_null(c("discount"))
    )
    return {
        "platform_convenience": per_instalment(c("tax"), ts, n),
        "refund_cover_amount": per_instalment(c("insurance"), ts, n),
        "discount_share": per_instalment(c("discount"), ts, n),
        "platform_interest": per_instalment(c("interest"), ts, n),
        "platform_freight": per_instalment(c("freight"), es, n),
        "transfer_amount": per_instalment(c("transfer"), ts, n),
        "item_total": F.when(is_ticket, per_instalment(gross_total, ts, n))
        .when(c("category") == EXTRA, products_part),
        "producer_items": F.when(is_ticket, per_instalment(c("net_tickets"), ts, n)).otherwise(products_part),
        "list_share": F.when(is_ticket, per_instalment(c("tickets_value"), ts, n)).otherwise(products_part),
    }


def revenue_splits() -> dict[str, Column]:
    """Refund cover and transfers split between platform and producer."""
    c = F.col
    return {
        "platform_refund_cover": c("refund_cover_amount") * c("refund_cover_rate"),
        "producer_refund_cover": c("refund_cover_amount") * (F.lit(1) - c("refund_cover_rate")),
        "platform_transfer": c("transfer_amount") * c("transfer_rate"),
        "producer_transfer": c("transfer_amount") * (F.lit(1) - c("transfer_rate")),
    }


def issue_charges(seq: Column | None = None) -> dict[str, Column]:
    """Issue charges; the percentage falls whole on the first instalment and the
    fixed charge only on courtesies that were not received by an owner change. ``seq`` is the
    instalment's number, the row's own if not given."""
    c = F.col
    seq = c("instalment_seq") if seq is None else seq
    return {
        "platform_issue_pct": F.when(
            seq <= 1, c("producer_items") * c("issue_rate") * c("instalments")
        ).otherwise(F.lit(0.0)),
        "platform_issue_fixed": F.when(
            (seq > 1)
            | (c("item_status_detail") == TAKEN_OVER)
            | (c("payment_method") != COURTESY),
            F.lit(0.0),
        ).otherwise(c("issue_fixed")),
    }


def producer_total(charges: dict[str, Column] | None = None) -> Column:
    """What the producer receives for the row, less its issue charges (the row's own if not
    given)."""
    c = F.col
    charges = charges or {name: c(name) for name in ("platform_issue_pct", "platform_issue_fixed")}
    return (c("producer_items") + c("producer_refund_cover") + c("producer_transfer")) - (
        charges["platform_issue_pct"] + charges["platform_issue_fixed"]
    )


def gateway_cost(charge_rate: Column) -> Column:
    """The gateway's percentage of the row's total plus its share of fixed charges."""
    return F.col("item_total") * charge_rate + F.col("fixed_gateway_cost")
