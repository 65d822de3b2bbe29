"""Catalogue of tickets and products, with their rates.

The ticket chain (lot price -> price type, lot -> ticket -> event -> complements) is a chain of
left joins. The tables that grow with the checkouts (lot prices, lots, products, sizes) are joined
with each other first and never broadcast: a broadcast is built in the driver, and the planner
guesses their size far too low. Items meet the result once, by a shuffle of narrow rows where AQE
splits a best-selling lot or product. Events, tickets and types are joined as the planner sees fit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rates import fallback, fallback_percent, percent
from ..sources import Tables
from .skew import shuffled, split_join


def _zero():
    return F.lit(0.0)


def _attach_events(df: DataFrame, tables: Tables, event_ref: str) -> DataFrame:
    """Events with their event complement."""
    ev = tables.event.select(
        F.col("id").alias("event_id"),
        F.col("title").alias("event"),
        F.col("taxaevent").alias("event_fee_pct"),
        F.col("ticketTransferValue").alias("transfer_price"),
    )
    ec = tables.eventcomplement.select(
        F.col("eventid").alias("ec_event"),
        F.col("globalevent").alias("edition"),
        F.col("emissionChargePercent").alias("ec_issue_pct"),
        F.col("emissionChargeFixed").alias("ec_issue_fixed"),
        F.col("comissionSecurityPerc").alias("ec_cover_pct"),
        F.col("transferPercent").alias("ec_transfer_pct"),
        F.col("rebateTax").alias("ec_rebate_pct"),
        F.col("taxRate").alias("ec_tax_pct"),
        F.col("productChargePercent").alias("ec_product_pct"),
        F.col("productChargeFixed").alias("ec_product_fixed"),
    )
    return df.join(ev, F.col(event_ref) == F.col("event_id"), "left").join(
        ec, F.col("event_id") == F.col("ec_event"), "left"
    )


def attach_tickets(df: DataFrame, tables: Tables) -> DataFrame:
    """``df`` (with ``batch_price_ref``) and the ticket's names, prices and rates."""
    c = F.col
    refs = tables.checkouteventticketbatchprice.select(
        c("id").alias("ref_key"), c("eventTicketBatchPriceId").alias("price_ref")
    )
    price = tables.eventticketbatchprice.select(
        c("id").alias("price_id"), c("price").alias("batch_price"),
        c("typeid").alias("type_id"), c("ticketBatchId").alias("batch_id"),
    )
    types = tables.eventticketbatchpricetype.select(c("id").alias("type_key"), c("name").alias("item_type"))
    batches = tables.eventticketbatch.select(c("id").alias("batch_key"), c("ticketId").alias("ticket_id"))
    tickets = tables.eventticket.select(
        c("id").alias("ticket_key"), c("name").alias("item_name"), c("eventid").alias("ticket_event")
    )
    complement = tables.eventticketcomplement.select(
        c("ticketid").alias("tc_ticket"),
        c("category"),
        c("nameparsed").alias("race_name"),
        c("emissionChargePercent").alias("tc_issue_pct"),
        c("emissionChargeFixed").alias("tc_issue_fixed"),
        c("comissionSecurityPerc").alias("tc_cover_pct"),
        c("transferPercent").alias("tc_transfer_pct"),
    )
    lots = (
        refs.join(shuffled(price), c("price_ref") == c("price_id"), "left")
        .join(types, c("type_id") == c("type_key"), "left")
        .join(shuffled(batches), c("batch_id") == c("batch_key"), "left")
        .join(tickets, c("ticket_id") == c("ticket_key"), "left")
    )
    lots = _attach_events(lots, tables, "ticket_event").join(complement, c("ticket_key") == c("tc_ticket"), "left")
    found = lots.select(
        c("ref_key").alias("batch_price_ref"),
        "batch_price", "transfer_price", "item_type", "item_name", "event_id", "event",
        "edition", "category", "race_name",
        percent(c("event_fee_pct")).alias("convenience_rate"),
        fallback_percent(c("tc_issue_pct"), c("ec_issue_pct")).alias("issue_rate"),
        fallback(c("tc_issue_fixed"), c("ec_issue_fixed")).alias("issue_fixed"),
        fallback_percent(c("tc_cover_pct"), c("ec_cover_pct")).alias("refund_cover_rate"),
        fallback_percent(c("tc_transfer_pct"), c("ec_transfer_pct")).alias("transfer_rate"),
        percent(c("ec_rebate_pct")).alias("rebate_rate"),
        percent(c("ec_tax_pct")).alias("tax_rate"),
    )
    return _attach(df, tables.part(found, "tickets"), "batch_price_ref")


def _attach(df: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """``df`` left-joined with a large catalogue on ``key``, its columns first."""
    return split_join(df, shuffled(found), key, "left").select(*df.columns, *[c for c in found.columns if c != key])


def ticket_events(tables: Tables) -> DataFrame:
    """``batch_price_ref``, ``event_id`` and ``edition`` of each of the checkout's lot prices that
    has an event: J04, J05, J07-J09 and J11 without what a filter on them does not need."""
    c = F.col
    refs = tables.checkouteventticketbatchprice.select(
        c("id").alias("batch_price_ref"), c("eventTicketBatchPriceId").alias("price_ref")
    )
    price = tables.eventticketbatchprice.select(c("id").alias("price_ref"), c("ticketBatchId").alias("batch_id"))
    batches = tables.eventticketbatch.select(c("id").alias("batch_id"), c("ticketId").alias("ticket_id"))
    tickets = tables.eventticket.select(c("id").alias("ticket_id"), c("eventid").alias("event_ref"))
    found = refs.join(shuffled(price), "price_ref").join(shuffled(batches), "batch_id").join(tickets, "ticket_id")
    return found.join(event_editions(tables), "event_ref").select("batch_price_ref", "event_id", "edition")


def product_events(tables: Tables) -> DataFrame:
    """``product_id``, ``event_id`` and ``edition`` of each product that has an event."""
    product = tables.product.select(F.col("id").alias("product_id"), F.col("eventId").alias("event_ref"))
    return product.join(event_editions(tables), "event_ref").select("product_id", "event_id", "edition")


def event_editions(tables: Tables) -> DataFrame:
    """``event_ref``, ``event_id`` (the same) and ``edition`` of each event; broadcast, or the planner
    might broadcast the products and lots of the events instead."""
    ev = tables.event.select(F.col("id").alias("event_ref"), F.col("id").alias("event_id"))
    ec = tables.eventcomplement.select(F.col("eventid").alias("event_ref"), F.col("globalevent").alias("edition"))
    return F.broadcast(ev.join(ec, "event_ref", "left"))


def ticket_dim(tables: Tables) -> DataFrame:
    """The whole ticket catalogue, keyed by ``batch_price_ref`` (the checkout's lot price id)."""
    refs = tables.checkouteventticketbatchprice.select(F.col("id").alias("batch_price_ref"))
    return attach_tickets(refs, tables)


def attach_products(df: DataFrame, tables: Tables) -> DataFrame:
    """J23 + J29: ``df`` (with ``product_id``) and the product's event and event complement."""
    return _attach(df, _sold(_products(tables), tables), "product_id")


def attach_sold_products(df: DataFrame, tables: Tables) -> DataFrame:
    """:func:`attach_products` and the product's own category and charges."""
    c = F.col
    # a product may be in either table alone; equal ids multiply, as in a join after the other
    both = _products(tables).join(product_manual(tables), c("product_id") == c("manual_product"), "full")
    both = both.withColumn("product_id", F.coalesce("product_id", "manual_product"))
    found = tables.part(_sold(both, tables, "category", "pm_pct", "pm_fixed"), "products")
    return _attach(df, found, "product_id")


def _products(tables: Tables) -> DataFrame:
    c = F.col
    return tables.product.select(c("id").alias("product_id"), c("title").alias("item_name"), c("eventId").alias("product_event"))


def _sold(products: DataFrame, tables: Tables, *own: str) -> DataFrame:
    """Products with their event, its complement and columns of their ``own``."""
    c = F.col
    return _attach_events(products, tables, "product_event").select(
        "product_id", "item_name", "event_id", "event", "edition",
        percent(c("event_fee_pct")).alias("convenience_rate"),
        "ec_product_pct", "ec_product_fixed",
        percent(c("ec_tax_pct")).alias("tax_rate"),
        *own,
    )


def product_dim(tables: Tables) -> DataFrame:
    """The products with their event and event complement, keyed by ``product_key``."""
    products = tables.product.select(F.col("id").alias("product_id"))
    return attach_products(products, tables).withColumnRenamed("product_id", "product_key")


def product_manual(tables: Tables) -> DataFrame:
    """The product's own category and charges, keyed by product id."""
    return tables.productcomplementmanual.select(
        F.col("productId").alias("manual_product"),
        F.col("category"),
        F.col("productChargePercent").alias("pm_pct"),
        F.col("productChargeFixed").alias("pm_fixed"),
    )


def product_models(tables: Tables) -> DataFrame:
    return tables.productmodel.select(F.col("id").alias("model_key"), F.col("name").alias("item_type"))


def attach_sizes(df: DataFrame, tables: Tables) -> DataFrame:
    """``df`` (with ``size_id``) and the size's price."""
    sizes = tables.productsize.select(F.col("id").alias("size_id"), F.col("price").alias("size_price"))
    return _attach(df, sizes, "size_id")


def extra_rates() -> dict:
    """R06-R11 for extras, from the product's own charges with the event's as fallback."""
    c = F.col
    return {
        "issue_rate": fallback_percent(c("pm_pct"), c("ec_product_pct")),
        "issue_fixed": fallback(c("pm_fixed"), c("ec_product_fixed")),
        "refund_cover_rate": _zero(),
        "transfer_rate": _zero(),
        "rebate_rate": _zero(),
    }
