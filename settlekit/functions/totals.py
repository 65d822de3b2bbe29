"""Order totals as seen by one item (R13-R16), for the ticket and the extra branch.

Inputs are the raw checkout-summary columns (``sum_*``) and the raw payment option (null for
a courtesy). A received ticket transfer (``sum_transfer > 0``) zeroes the ticket amounts: such
an order only pays the transfer.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .money import ratio, zero_if_null


def _zero():
    return F.lit(0.0)


@dataclass(frozen=True)
class Summary:
    total: Column
    tickets: Column
    products: Column
    discount: Column
    interest: Column
    freight: Column
    tax: Column
    insurance: Column
    transfer: Column
    option: Column

    @classmethod
    def from_context(cls) -> Summary:
        c = F.col
        return cls(
            c("sum_total"), c("sum_tickets"), c("sum_products"), c("sum_discount"),
            c("sum_interest"), c("sum_freight"), c("sum_tax"), c("sum_insurance"),
            c("sum_transfer"), c("pay_option"),
        )


def _unless_transfer_or_unpaid(s: Summary, value: Column) -> Column:
    """Ticket pattern: 0 on a transfer, 0 when the order total is not positive, else value."""
    return (
        F.when(s.transfer > 0, _zero())
        .when(F.coalesce(s.total, _zero()) <= 0, _zero())
        .otherwise(zero_if_null(value))
    )


def ticket_totals(s: Summary, batch_price: Column, transfer_price: Column) -> dict[str, Column]:
    """R13-R16 for a ticket. ``batch_price`` is the lot price, ``transfer_price`` the event's."""
    no_payment = s.option.isNull()
    tickets0, tax0, discount0 = zero_if_null(s.tickets), zero_if_null(s.tax), zero_if_null(s.discount)
    return {
        "order_total": F.when(s.total.isNull(), _zero())
        .when((s.total <= 0) | no_payment, _zero())
        .otherwise(s.total),
        "tickets_value": F.when(s.transfer > 0, _zero()).otherwise(tickets0),
        "net_tickets": F.when(s.transfer > 0, _zero())
        .when(no_payment, _zero())
        .when(tickets0 + tax0 <= discount0, _zero())
        .otherwise(tickets0 - discount0),
        "products_value": _zero(),
        "discount": F.when(s.transfer > 0, _zero())
        .when(F.coalesce(s.total, _zero()) >= 0, discount0)
        .otherwise(s.tickets + s.interest + s.freight + s.tax + s.insurance),
        "interest": _unless_transfer_or_unpaid(s, s.interest),
        "freight": _unless_transfer_or_unpaid(s, s.freight),
        "tax": _unless_transfer_or_unpaid(s, s.tax),
        "insurance": _unless_transfer_or_unpaid(s, s.insurance),
        "transfer": zero_if_null(s.transfer),
        "item_price": F.when(s.transfer > 0, transfer_price).otherwise(batch_price),
        "ticket_share": F.coalesce(ratio(batch_price, s.tickets), _zero()),
        "extra_share": _zero(),
        "order_share": order_share(batch_price, s.total),
    }


def extra_totals(s: Summary, size_price: Column) -> dict[str, Column]:
    """R13-R16 for an extra (a product sold with the checkout)."""
    no_payment = s.option.isNull()
    return {
        "order_total": F.when(no_payment | s.total.isNull() | (s.total <= 0), _zero()).otherwise(s.total),
        "tickets_value": _zero(),
        "net_tickets": _zero(),
        "products_value": F.when(no_payment, _zero()).otherwise(zero_if_null(s.products)),
        "discount": _zero(),
        "interest": F.when(no_payment, _zero()).otherwise(zero_if_null(s.interest)),
        "freight": F.when(no_payment, _zero()).otherwise(zero_if_null(s.freight)),
        "tax": _zero(),
        "insurance": _zero(),
        "transfer": _zero(),
        "item_price": size_price,
        "ticket_share": _zero(),
        "extra_share": F.coalesce(ratio(size_price, s.products), _zero()),
        "order_share": order_share(size_price, s.total),
    }


def order_share(price: Column, total: Column) -> Column:
    """The item's share of the order total, never negative."""
    share = F.coalesce(ratio(price, F.coalesce(total, _zero())), _zero())
    return F.when(share < 0, _zero()).otherwise(share)
