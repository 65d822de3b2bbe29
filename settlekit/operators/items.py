"""Sold items: the ticket branch, the extras branch and their union (level 1, U01).

Plan: each branch first gets what depends on the item alone (its cancel reason, trade links or
form-answer count, and the catalogue dimension with the rates). The two item streams are then
unioned and joined to the order context **once**, on ``order_id``: the session-level facts are
scanned and shuffled a single time for both branches, and the branch-specific rules are picked
per row with ``branch``. Rows of extras are repeated per buyer row and form answer: cut into chunks
and rebalanced while they are a few columns wide, expanded in place at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import order as R
from ..functions.status import (
    extra_status,
    extra_status_detail,
    payable,
    ticket_status,
    ticket_status_detail,
)
from ..functions.totals import Summary, extra_totals, ticket_totals
from ..sources import Tables
from . import dims, fanout
from .context import buyer_counts, order_context
from .filters import Params, apply, isin
from .skew import hot_keys, join_spread, shuffled
from .trades import attach_links

#: Buyers of a session above which its extras are cut into chunks before the order join.
MANY_BUYERS = 8

TICKETS = "tickets"
EXTRAS = "extras"

ITEM_COLUMNS = [
    "branch", "item_id", "order_id", "purchase_date", "edition", "event_id", "event", "category",
    "race_name", "item_name", "item_type", "order_status", "payment_method", "instalments",
    "instalment_plan", "gateway", "gateway_order_ref", "convenience_rate", "issue_rate",
    "issue_fixed", "refund_cover_rate", "transfer_rate", "rebate_rate", "tax_rate",
    "fixed_gateway_cost", "order_total", "tickets_value", "net_tickets", "products_value",
    "discount", "interest", "freight", "tax", "insurance", "transfer", "item_price",
    "ticket_share", "extra_share", "order_share", "item_status", "item_status_detail",
    "linked_item_id", "card_brand", "card_prefix",
]

def participants(tables: Tables, params: Params) -> DataFrame:
    """The chosen participants."""
    p = tables.checkoutparticipant.select(
        F.col("id").alias("item_id"),
        F.col("sessionid").alias("order_id"),
        F.col("checkoutEventTicketBatchPriceId").alias("batch_price_ref"),
    )
    p = apply(p, isin(F.col("item_id"), params.participant_ids), isin(F.col("order_id"), params.order_ids))
    if params.extra_ids is not None:  # choosing extras leaves the ticket branch empty
        p = p.where(F.lit(False))
    return p


def payable_tickets(tables: Tables, params: Params) -> DataFrame:
    """Participants that count (F02, F05, F07, F09), with their cancel reason."""
    p = participants(tables, params)
    cancels = tables.checkoutorderticketpartialcancel.select(
        F.col("participantId").alias("cancel_item"), F.col("reason").alias("cancel_reason")
    )
    return (
        p.join(cancels, p.item_id == cancels.cancel_item, "left")
        .where(payable(F.col("cancel_reason"), params.payable_ticket_reasons))
        .drop("cancel_item")
    )


def ticket_lines(tables: Tables, params: Params) -> DataFrame:
    """Ticket stream before the order join: trade links (J17/J18) and catalogue."""
    p = tables.lines_part(attach_links(payable_tickets(tables, params), tables.tradecheckoutsession))
    p = dims.attach_tickets(p, tables)
    p = apply(p, isin(F.col("edition"), params.editions), isin(F.col("event_id"), params.event_ids))
    return p.select(
        F.lit(TICKETS).alias("branch"),
        "item_id", "order_id", "edition", "event_id", "event", "category", "race_name", "item_name",
        "item_type", "convenience_rate", "issue_rate", "issue_fixed", "refund_cover_rate",
        "transfer_rate", "rebate_rate", "tax_rate",
        F.col("batch_price").alias("unit_price"),
        "transfer_price", "cancel_reason", "linked_item_id",
        F.lit(1).cast("long").alias("copies"),
        F.lit(True).alias("bought"),
    )


def product_lines(tables: Tables, params: Params) -> DataFrame:
    """The chosen product lines."""
    e = tables.checkoutproductcomplement.select(
        F.col("id").alias("item_id"),
        F.col("sessionId").alias("order_id"),
        F.col("productId").alias("product_id"),
        F.col("modelId").alias("model_id"),
        F.col("sizeId").alias("size_id"),
    )
    e = apply(e, isin(F.col("item_id"), params.extra_ids), isin(F.col("order_id"), params.order_ids))
    if params.participant_ids is not None:  # choosing participants leaves extras empty
        e = e.where(F.lit(False))
    return e


def payable_extras(tables: Tables, params: Params) -> DataFrame:
    """Product lines that count (F03, F05, F08, F10), with their cancel reason."""
    e = product_lines(tables, params)
    cancels = tables.checkoutorderproductpartialcancel.select(
        F.col("checkoutProductComplementId").alias("cancel_item"), F.col("reason").alias("cancel_reason")
    )
    return (
        e.join(cancels, e.item_id == cancels.cancel_item, "left")
        .where(payable(F.col("cancel_reason"), params.payable_extra_reasons))
        .drop("cancel_item")
    )


def answer_counts(tables: Tables) -> DataFrame:
    """J33 as a count per extra (no column of the answers is used)."""
    return fanout.counts(tables.checkoutproductcomplementanswer, "checkoutProductComplementId", "answer_item", "answers")


def extra_lines(
    tables: Tables, params: Params, orders: DataFrame | None = None, hot: DataFrame | None = None, weighted: bool = False
) -> DataFrame:
    """Extras stream before the order join: copies (J21, J33) and catalogue.

    The copies are those by answers; the order context knows the buyers. Without ``weighted`` a session
    of many buyers multiplies them here (``orders``: those whose buyers are counted, None: all), which
    ``bought`` says, and the rows are chunks of :func:`.fanout.chunked`. ``hot`` as for
    :func:`.skew.join_spread`."""
    c, one = F.col, F.lit(1).cast("long")
    answers = answer_counts(tables)
    e = payable_extras(tables, params).join(answers, c("item_id") == c("answer_item"), "left").drop("answer_item")
    e = e.withColumn("copies", F.coalesce(c("answers"), one)).drop("answers")
    if weighted:
        e = e.withColumn("bought", F.lit(False))
    else:
        many = buyer_counts(tables, orders).where(c("buyers") > MANY_BUYERS)
        many = many.select(c("buyer_session").alias("order_id"), c("buyers").alias("_many"))
        e = join_spread(e, many, "order_id", hot, c("item_id"), "left")
        e = e.withColumns({"copies": c("copies") * F.coalesce(c("_many"), one), "bought": c("_many").isNotNull()}).drop("_many")
        e = fanout.chunked(e, "copies")
    if tables.keep_lines is not None:
        # never null, but files mark every column nullable
        e = tables.lines_part(e)
        e = e.withColumns({"copies": F.coalesce(c("copies"), one), "bought": F.coalesce(c("bought"), F.lit(False))})
    e = dims.attach_sizes(e, tables)
    e = dims.attach_sold_products(e, tables).join(dims.product_models(tables), c("model_id") == c("model_key"), "left")
    e = apply(e, isin(c("edition"), params.editions), isin(c("event_id"), params.event_ids))
    rates = dims.extra_rates()
    return e.select(
        F.lit(EXTRAS).alias("branch"),
        "item_id", "order_id", "edition", "event_id", "event", "category",
        F.lit("-").alias("race_name"),
        "item_name", "item_type", "convenience_rate",
        *[rates[name].alias(name) for name in rates],
        "tax_rate",
        c("size_price").alias("unit_price"),
        F.lit(None).cast("double").alias("transfer_price"),
        "cancel_reason",
        F.lit(None).cast("long").alias("linked_item_id"),
        "copies",
        "bought",
    )


def _pick(is_ticket: Column, ticket: Column, extra: Column) -> Column:
    return F.when(is_ticket, ticket).otherwise(extra)


def chosen_orders(tables: Tables, params: Params) -> DataFrame | None:
    """The orders (``order_id``) of the items that filters on items (F04, F06-F08) leave, and maybe
    of cancelled ones; None without such a filter. Chosen ids need two columns of the item table;
    editions and events need those joins of the catalogue that lead to them."""
    by_event = params.editions is not None or params.event_ids is not None
    if not by_event and params.participant_ids is None and params.extra_ids is None:
        return None
    c = F.col
    tickets, extras = participants(tables, params), product_lines(tables, params)
    if by_event:
        left = [isin(c("edition"), params.editions), isin(c("event_id"), params.event_ids)]
        tickets = tickets.join(shuffled(apply(dims.ticket_events(tables), *left)), "batch_price_ref", "left_semi")
        extras = extras.join(shuffled(apply(dims.product_events(tables), *left)), "product_id", "left_semi")
    if params.extra_ids is not None:
        orders = extras.select("order_id")
    elif params.participant_ids is not None:
        orders = tickets.select("order_id")
    else:
        orders = tickets.select("order_id").unionAll(extras.select("order_id"))
    return orders.distinct()


def items(
    tables: Tables, params: Params | None = None, context: DataFrame | None = None, weighted: bool = False,
    orders: DataFrame | None = None,
) -> DataFrame:
    """U01 and level 1: tickets and extras of paid orders with every item-level value.

    An item that the source repeats (J21, J33) is a row per copy, or with ``weighted`` one row
    whose further column ``copies`` says how many it stands for. ``orders``: what
    :func:`chosen_orders` gives, if the caller has it as a table."""
    params = params or Params()
    if orders is None:
        orders = chosen_orders(tables, params)
    if context is None:
        context = order_context(tables, params, orders)
    hot = None
    if params.hot_key_rows is not None:
        # counted on the item tables themselves: at least as many rows as the lines have
        keys = participants(tables, params).select("order_id").unionAll(product_lines(tables, params).select("order_id"))
        hot = hot_keys(keys, "order_id", params.hot_key_rows)
    lines = ticket_lines(tables, params).unionByName(extra_lines(tables, params, orders, hot, weighted))
    rows = join_spread(lines, context, "order_id", hot, F.col("item_id"))

    c, one = F.col, F.lit(1).cast("long")
    is_ticket = c("branch") == TICKETS
    s = Summary.from_context()
    t_tot = ticket_totals(s, c("unit_price"), c("transfer_price"))
    e_tot = extra_totals(s, c("unit_price"))
    reason, transfer = c("cancel_reason"), c("sum_transfer")
    no_brand = _pick(is_ticket, F.lit(R.NO_BRAND_TICKET), F.lit(R.NO_BRAND_EXTRA))
    out = rows.select(
        "branch", "item_id", "order_id", "purchase_date", "edition", "event_id", "event", "category",
        "race_name", "item_name", "item_type", "order_status", "payment_method", "instalments",
        "instalment_plan", "gateway", "gateway_order_ref", "convenience_rate", "issue_rate",
        "issue_fixed", "refund_cover_rate", "transfer_rate", "rebate_rate", "tax_rate",
        "fixed_gateway_cost",
        *[_pick(is_ticket, t_tot[name], e_tot[name]).alias(name) for name in t_tot],
        _pick(is_ticket, ticket_status(reason, transfer), extra_status(reason)).alias("item_status"),
        _pick(is_ticket, ticket_status_detail(reason, transfer), extra_status_detail(reason))
        .alias("item_status_detail"),
        "linked_item_id",
        R.card_brand(
            c("pay_option"), c("card_brand_stored"), c("pay_card_brand"), c("pay_digits"), c("card_digits"), no_brand
        ).alias("card_brand"),
        "card_prefix",
        (c("copies") * _pick(is_ticket | c("bought"), one, F.coalesce(c("buyers"), one))).alias("copies"),
    )
    return out if weighted else fanout.expanded(out, "copies").select(*ITEM_COLUMNS)


def tickets(tables: Tables, params: Params | None = None) -> DataFrame:
    """Ticket branch alone (the union is pruned to one side by Catalyst)."""
    return items(tables, params).where(F.col("branch") == TICKETS)


def extras(tables: Tables, params: Params | None = None) -> DataFrame:
    """Extras branch alone."""
    return items(tables, params).where(F.col("branch") == EXTRAS)
