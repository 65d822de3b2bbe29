"""Named views over the fixture tables, one per operator group of the ledger.

Each takes ``(spark, sf_dir)``, builds the 28 tables from the driver tables under ``sf_dir``
and returns a DataFrame whose column names match the SQL oracle of the same name
(``oracle/queries.py``). They are what the correctness gate and the benchmark run.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dims
from ..operators.context import card_per_id, order_context, paid_sessions
from ..operators.filters import Params
from ..operators.items import (
    ITEM_COLUMNS, chosen_orders, extras, participants, payable_extras, payable_tickets, product_lines, tickets
)
from ..operators.trades import attach_links, trade_links
from ..session import checkpoint_dir, shuffles_freed
from ..sources import SCHEMAS, Tables, read_bucketed, write_bucketed
from ..sources import adapter
from . import checks, order, reports
from .folded import folded_ledger
from .ledger import charged_items, instalment_rows, item_rows, ledger, ledger_rows, ordered_of_items

AS_OF = dt.date(2001, 7, 1)
BASE = Params(as_of=AS_OF)

# ---- report parameters used by the filter views ----------------------------------------------
EDITIONS = ["AMERICA", "ASIA"]
EVENT_IDS = [1, 2, 3, 5, 8, 13, 21]
ORDER_IDS = [1, 3, 5, 7, 32, 37, 70, 100, 1000, 2000, 4000, 10000, 20000]
PARTICIPANT_IDS = [order * 100 + place for order in range(1, 3001, 7) for place in (1, 2)]
EXTRA_IDS = [order * 100 + place for order in range(1, 3001, 3) for place in (4, 5)]
SETTLED = (dt.date(2000, 1, 1), dt.date(2000, 12, 31))
BOUGHT = (dt.date(1998, 1, 1), dt.date(1998, 6, 30))
STATUS = "futuro"
# ------------------------------------------------------------------------------------------------

ITEM_VALUE_COLUMNS = [c for c in ITEM_COLUMNS if c != "instalment_plan"]
ROW_KEY = ["branch", "item_id", "order_id", "instalment_seq", "settlement_date"]


def _tables(spark: SparkSession, sf_dir: str) -> Tables:
    return adapter.build(spark, sf_dir)


def _shared(spark, name: str) -> str:
    """A new folder for files that a view writes and reads again."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _removed(spark: SparkSession, path: str) -> None:
    """Gives back a folder of :func:`_shared` that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _written(spark: SparkSession, sf_dir: str) -> Tables:
    """The tables for a view that needs most of them, over lines that are numbered once and written.

    The driver plans a query anew after each of its stages and keeps the metrics of every such plan:
    its memory goes by the number of steps, and half of a ledger's would be numbering the same lines."""
    with shuffles_freed(spark):
        return adapter.build(spark, sf_dir, adapter.write_lines(spark, sf_dir, _shared(spark, "lines")))


def _kept(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read again."""
    path = _shared(spark, name)
    with shuffles_freed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _parted(spark: SparkSession, sf_dir: str, paths: tuple[str, str] | None = None) -> Tables:
    """:func:`_written` for a ledger in parts: its order context, its catalogues and the lines of each branch are
    written before they meet, so that no plan holds the joins of all 28 tables. So are the values of the
    orders' lines. ``paths``: folders for the numbered lines and for these values."""
    lines_path, valued_path = paths or (_shared(spark, "lines"), _shared(spark, "valued"))
    with shuffles_freed(spark):
        lines = adapter.write_lines(spark, sf_dir, lines_path)
        valued = adapter.write_orders(spark, sf_dir, lines, valued_path)
    keep = lambda df: _kept(spark, df, "part")
    return adapter.build(spark, sf_dir, lines, valued).in_parts(keep, keep)


def _chosen(spark: SparkSession, t: Tables, params: Params) -> DataFrame | None:
    """:func:`chosen_orders` as a table: six tables of session facts are semi-joined with it, and
    with editions or events each would hold the catalogue's joins."""
    orders = chosen_orders(t, params)
    if orders is None or params.editions is None and params.event_ids is None:
        return orders
    return _kept(spark, orders, "orders")


def source_counts(spark, sf_dir):
    t = _tables(spark, sf_dir)
    parts = [t[name].agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
             for name in SCHEMAS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def paid_sessions_view(spark, sf_dir):
    s = paid_sessions(_tables(spark, sf_dir), BASE)
    return s.select(
        "order_id", (F.col("createdat") - F.expr("INTERVAL 3 HOURS")).cast("date").alias("purchase_date"),
        "order_status", "provider_card_id",
    )


def _with_paid(df: DataFrame, t: Tables) -> DataFrame:
    paid = paid_sessions(t, BASE).select("order_id")
    return df.join(paid, "order_id")


def payable_tickets_view(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return _with_paid(payable_tickets(t, BASE), t).select("item_id", "order_id", "cancel_reason")


def payable_extras_view(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return _with_paid(payable_extras(t, BASE), t).select("item_id", "order_id", "cancel_reason")


def order_context_view(spark, sf_dir):
    return _context_columns(order_context(_tables(spark, sf_dir), BASE))


def _context_columns(ctx: DataFrame) -> DataFrame:
    return ctx.select(
        "order_id", "purchase_date", "payment_method", "instalments", "instalment_plan_text", "gateway",
        "gateway_order_ref", "fixed_gateway_cost", "card_prefix",
    )


def session_card_view(spark, sf_dir):
    t = _tables(spark, sf_dir)
    s = paid_sessions(t, BASE).where(F.col("provider_card_id").isNotNull())
    cards = card_per_id(t.customerpaymentprovidercard)
    return s.join(cards, s.provider_card_id == cards.card_id).select(
        "order_id", "provider_card_id", "card_digits", "card_brand_stored"
    )


def trade_links_view(spark, sf_dir):
    return trade_links(_tables(spark, sf_dir).tradecheckoutsession)


def linked_items_view(spark, sf_dir):
    t = _tables(spark, sf_dir)
    linked = attach_links(_with_paid(payable_tickets(t, BASE), t), t.tradecheckoutsession)
    return linked.select("item_id", "order_id", "linked_item_id")


def fixed_gateway_charges_view(spark, sf_dir):
    ctx = order_context(_tables(spark, sf_dir), BASE)
    return ctx.select("order_id", "gateway", "fixed_gateway_cost")


def ticket_dim_view(spark, sf_dir):
    return dims.ticket_dim(_tables(spark, sf_dir))


def product_dim_view(spark, sf_dir):
    return dims.product_dim(_tables(spark, sf_dir)).drop("ec_product_pct", "ec_product_fixed")


RATE_COLUMNS = ["convenience_rate", "issue_rate", "issue_fixed", "refund_cover_rate", "transfer_rate",
                "rebate_rate", "tax_rate", "fixed_gateway_cost"]
TOTAL_COLUMNS = ["order_total", "tickets_value", "net_tickets", "products_value", "discount", "interest",
                 "freight", "tax", "insurance", "transfer", "item_price"]


def _branch(spark, sf_dir, which: str) -> DataFrame:
    t = _written(spark, sf_dir)
    return tickets(t, BASE) if which == "tickets" else extras(t, BASE)


def effective_rates_tickets(spark, sf_dir):
    return _branch(spark, sf_dir, "tickets").select("item_id", "order_id", "category", *RATE_COLUMNS)


def effective_rates_extras(spark, sf_dir):
    return _branch(spark, sf_dir, "extras").select("item_id", "order_id", "category", *RATE_COLUMNS)


def order_totals_tickets(spark, sf_dir):
    return _branch(spark, sf_dir, "tickets").select("item_id", "order_id", *TOTAL_COLUMNS)


def order_totals_extras(spark, sf_dir):
    return _branch(spark, sf_dir, "extras").select("item_id", "order_id", *TOTAL_COLUMNS)


def _items(spark, sf_dir) -> DataFrame:
    return item_rows(_parted(spark, sf_dir), BASE)


def item_shares(spark, sf_dir):
    return _items(spark, sf_dir).select("branch", "item_id", "ticket_share", "extra_share", "order_share")


def item_status_view(spark, sf_dir):
    return _items(spark, sf_dir).select("branch", "item_id", "item_status", "item_status_detail", "linked_item_id")


def card_brand_view(spark, sf_dir):
    return _items(spark, sf_dir).select("branch", "item_id", "payment_method", "card_brand")


def card_prefix_view(spark, sf_dir):
    return _items(spark, sf_dir).select("branch", "item_id", "payment_method", "card_prefix")


def items_union(spark, sf_dir):
    return _items(spark, sf_dir).select(*ITEM_VALUE_COLUMNS)


def extras_answer_fanout(spark, sf_dir):
    e = _branch(spark, sf_dir, "extras")
    return e.groupBy("item_id").agg(F.count(F.lit(1)).alias("item_rows"))


def _inst(spark, sf_dir) -> DataFrame:
    return instalment_rows(_parted(spark, sf_dir), BASE)


def instalment_rows_view(spark, sf_dir):
    return _inst(spark, sf_dir).select(*ROW_KEY, "plan_k", "item_fraction")


def instalment_amounts(spark, sf_dir):
    return _inst(spark, sf_dir).select(
        *ROW_KEY, "platform_convenience", "refund_cover_amount", "discount_share", "platform_interest",
        "platform_freight", "transfer_amount", "item_total", "producer_items", "list_share",
    )


def revenue_splits(spark, sf_dir):
    return _inst(spark, sf_dir).select(
        *ROW_KEY, "platform_refund_cover", "producer_refund_cover", "platform_transfer", "producer_transfer"
    )


def issue_charges(spark, sf_dir):
    return _inst(spark, sf_dir).select(*ROW_KEY, "platform_issue_pct", "platform_issue_fixed")


def producer_total_view(spark, sf_dir):
    return _inst(spark, sf_dir).select(*ROW_KEY, "producer_total")


def _rows(spark, sf_dir, params: Params = BASE) -> DataFrame:
    return ledger_rows(_parted(spark, sf_dir), params)


def gateway_cost_view(spark, sf_dir):
    return _rows(spark, sf_dir).select(
        *ROW_KEY, "gateway", "card_brand", "gateway_charge_type", "gateway_charge_rate", "gateway_cost"
    )


def settlement_week_view(spark, sf_dir):
    return _rows(spark, sf_dir).select(*ROW_KEY, "settlement_week")


def settlement_status_view(spark, sf_dir):
    return _rows(spark, sf_dir).select(*ROW_KEY, "settlement_status")


def presented_amounts(spark, sf_dir):
    return _rows(spark, sf_dir).select(
        *ROW_KEY, "race_group", "list_price", "instalment_count", "instalment_no", "instalment_amount",
        "gross_amount", "discount_amount", "net_amount",
    )


def _ledger(spark, sf_dir, weighted=False, **kw) -> DataFrame:
    params = Params(as_of=AS_OF, **kw)
    t = _parted(spark, sf_dir)
    return ledger(t, params, weighted, _chosen(spark, t, params))


def _folded(spark, sf_dir, keys=()) -> DataFrame:
    return folded_ledger(_parted(spark, sf_dir), Params(as_of=AS_OF), keys)


def filter_editions(spark, sf_dir):
    return _ledger(spark, sf_dir, editions=EDITIONS)


def filter_events(spark, sf_dir):
    return _ledger(spark, sf_dir, event_ids=EVENT_IDS)


def filter_orders(spark, sf_dir):
    return _ledger(spark, sf_dir, order_ids=ORDER_IDS)


def filter_participants(spark, sf_dir):
    return _ledger(spark, sf_dir, participant_ids=PARTICIPANT_IDS)


def filter_extras(spark, sf_dir):
    return _ledger(spark, sf_dir, extra_ids=EXTRA_IDS)


def filter_branches(spark, sf_dir):
    """rows per branch with participants chosen, extras chosen, and both (none)."""
    settings = {
        "participants": {"participant_ids": PARTICIPANT_IDS},
        "extras": {"extra_ids": EXTRA_IDS},
        "both": {"participant_ids": PARTICIPANT_IDS, "extra_ids": EXTRA_IDS},
    }
    t = _parted(spark, sf_dir)
    count = lambda branch: F.coalesce(F.sum((F.col("branch") == branch).cast("long")), F.lit(0)).alias(f"{branch}_rows")
    out = None
    for name, kw in settings.items():
        rows = ledger_rows(t, Params(as_of=AS_OF, **kw)).agg(count("tickets"), count("extras"))
        part = rows.select(F.lit(name).alias("chosen"), "tickets_rows", "extras_rows")
        out = part if out is None else out.unionByName(part)
    return out


def filter_settled(spark, sf_dir):
    return _ledger(spark, sf_dir, settled_between=SETTLED)


def filter_bought(spark, sf_dir):
    return _ledger(spark, sf_dir, bought_between=BOUGHT)


def filter_status(spark, sf_dir):
    return _ledger(spark, sf_dir, status=STATUS)


def ledger_view(spark, sf_dir):
    return _ledger(spark, sf_dir)


def ledger_ordered(spark, sf_dir):
    at_once, paths = max(2, spark.sparkContext.defaultParallelism), (_shared(spark, "lines"), _shared(spark, "valued"))
    t = _parted(spark, sf_dir, paths)
    keys = [f(t, BASE).select("order_id", "item_id") for f in (participants, product_lines)]
    cuts = order.item_cuts(keys[0].unionAll(keys[1]), at_once)
    items = charged_items(t, BASE)
    for path in paths:  # the items' plan reads the parts that were made of them
        _removed(spark, path)
    placed = order.in_ranges(items, cuts, at_once, _shared(spark, "items"))
    return ordered_of_items(placed, t, BASE)


def ledger_positions(spark, sf_dir):
    """The rows of the ledger with their places in O01, from ordered files."""
    path, least = _shared(spark, "ordered"), 2 * spark.sparkContext.defaultParallelism
    rows = _rows(spark, sf_dir).select("order_id", "item_id", "instalment_no", "settlement_date", "net_amount")
    rows.write.parquet(f"{path}/ledger")
    written = spark.read.schema(rows.schema).parquet(f"{path}/ledger")
    order.write_ordered(written, f"{path}/ordered", order.ranges_for(written, least))
    return order.positions(spark, f"{path}/ordered").select(
        "position", "order_id", "item_id", "instalment_no", "settlement_date"
    )


def bucketed_context(spark, sf_dir):
    """`order_context` over session facts in buckets."""
    root, buckets = _shared(spark, "bucketed"), 2 * spark.sparkContext.defaultParallelism
    t = _tables(spark, sf_dir)
    write_bucketed(t, root, buckets)
    return _context_columns(order_context(read_bucketed(t, spark, root, buckets), BASE))


def lots(spark, sf_dir):
    return reports.lots(_folded(spark, sf_dir, reports.LOT))


def producer_totals(spark, sf_dir):
    return reports.producer_totals(_folded(spark, sf_dir, reports.EVENT))


def courtesies(spark, sf_dir):
    return reports.courtesies(_folded(spark, sf_dir, reports.EVENT))


def weekly(spark, sf_dir):
    return reports.weekly(_folded(spark, sf_dir))


def reconcile(spark, sf_dir):
    t = _parted(spark, sf_dir)
    return reports.reconcile(ledger(t, BASE, weighted=True), t)


def duplicate_keys(spark, sf_dir):
    return checks.duplicate_keys(_tables(spark, sf_dir))


def anomalies(spark, sf_dir):
    return checks.anomalies(_rows(spark, sf_dir))


VIEWS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "source_counts": source_counts,
    "paid_sessions": paid_sessions_view,
    "payable_tickets": payable_tickets_view,
    "payable_extras": payable_extras_view,
    "order_context": order_context_view,
    "session_card": session_card_view,
    "trade_links": trade_links_view,
    "linked_items": linked_items_view,
    "fixed_gateway_charges": fixed_gateway_charges_view,
    "ticket_dim": ticket_dim_view,
    "product_dim": product_dim_view,
    "effective_rates_tickets": effective_rates_tickets,
    "effective_rates_extras": effective_rates_extras,
    "order_totals_tickets": order_totals_tickets,
    "order_totals_extras": order_totals_extras,
    "item_shares": item_shares,
    "item_status": item_status_view,
    "card_brand": card_brand_view,
    "card_prefix": card_prefix_view,
    "items_union": items_union,
    "extras_answer_fanout": extras_answer_fanout,
    "instalment_rows": instalment_rows_view,
    "instalment_amounts": instalment_amounts,
    "revenue_splits": revenue_splits,
    "issue_charges": issue_charges,
    "producer_total": producer_total_view,
    "gateway_cost": gateway_cost_view,
    "settlement_week": settlement_week_view,
    "settlement_status": settlement_status_view,
    "presented_amounts": presented_amounts,
    "filter_editions": filter_editions,
    "filter_events": filter_events,
    "filter_orders": filter_orders,
    "filter_participants": filter_participants,
    "filter_extras": filter_extras,
    "filter_branches": filter_branches,
    "filter_settled": filter_settled,
    "filter_bought": filter_bought,
    "filter_status": filter_status,
    "ledger": ledger_view,
    "ledger_ordered": ledger_ordered,
    "ledger_positions": ledger_positions,
    "bucketed_context": bucketed_context,
    "lots": lots,
    "producer_totals": producer_totals,
    "courtesies": courtesies,
    "weekly": weekly,
    "reconcile": reconcile,
    "duplicate_keys": duplicate_keys,
    "anomalies": anomalies,
}

