"""DuckDB SQL for every named view (``settlekit/plans/views.py``), same names, same columns.

Each string is self-contained: the adapter CTEs, the ledger CTEs, then one SELECT. Money is summed
as decimals and the total rounded once.
"""

from __future__ import annotations

from .adapter import ADAPTER_CTES, TABLES
from .ledger import LEDGER_COLUMNS, ledger_ctes

AS_OF = "2001-07-01"

# ---- report parameters (same as the Spark views) ----------------------------------------------
EDITIONS = "'AMERICA', 'ASIA'"
EVENT_IDS = "1, 2, 3, 5, 8, 13, 21"
ORDER_IDS = "1, 3, 5, 7, 32, 37, 70, 100, 1000, 2000, 4000, 10000, 20000"
PARTICIPANT_IDS = ", ".join(str(order * 100 + place) for order in range(1, 3001, 7) for place in (1, 2))
EXTRA_IDS = ", ".join(str(order * 100 + place) for order in range(1, 3001, 3) for place in (4, 5))
SETTLED = ("2000-01-01", "2000-12-31")
BOUGHT = ("1998-01-01", "1998-06-30")
STATUS = "futuro"
# ------------------------------------------------------------------------------------------------

ROW_KEY = "branch, item_id, order_id, instalment_seq, settlement_date"
LEDGER = ", ".join(LEDGER_COLUMNS)
ITEM_VALUES = (
    "branch, item_id, order_id, purchase_date, edition, event_id, event, category, race_name, item_name,"
    " item_type, order_status, payment_method, instalments, gateway, gateway_order_ref,"
    " convenience_rate, issue_rate, issue_fixed, refund_cover_rate, transfer_rate, rebate_rate, tax_rate,"
    " fixed_gateway_cost, order_total, tickets_value, net_tickets, products_value, discount, interest,"
    " freight, tax, insurance, transfer, item_price, ticket_share, extra_share, order_share, item_status,"
    " item_status_detail, linked_item_id, card_brand, card_prefix"
)
RATES = ("convenience_rate, issue_rate, issue_fixed, refund_cover_rate, transfer_rate, rebate_rate,"
         " tax_rate, fixed_gateway_cost")
TOTALS = ("order_total, tickets_value, net_tickets, products_value, discount, interest, freight, tax,"
          " insurance, transfer, item_price")


def money(col: str) -> str:
    """A total to six places, summed exactly as decimals of twelve."""
    return f"round(sum({col}::DECIMAL(38, 12)), 6)::DOUBLE"


def counted(keys: str, items: str, where: str, **sums: str) -> str:
    """Items per key: rows are counted per instalment count, and n rows of n instalments are one."""
    totals = ", ".join(f"{money(name)} AS {name}" for name in sums)
    parts = ", ".join(f"sum({col}::DECIMAL(38, 12)) AS {name}" for name, col in sums.items())
    return (
        f"SELECT {keys}, {money('row_count / n')} AS {items}, {totals} FROM ("
        f"SELECT {keys}, n1 AS n, count(*)::DOUBLE AS row_count, {parts} FROM ledger_rows {where} GROUP BY {keys}, n1) GROUP BY {keys}"
    )


def _with(select: str) -> str:
    return f"WITH {ADAPTER_CTES},{ledger_ctes(AS_OF)}\n{select}"


def _ledger_where(cond: str) -> str:
    return _with(f"SELECT {LEDGER} FROM ledger_rows WHERE {cond}")


FAN_KEYS = [
    ("checkoutsession", "id", None), ("checkoutsummary", "sessionid", None),
    ("checkoutpayment", "sessionid", None), ("checkoutpaypaldetails", "sessionId", None),
    ("checkoutbuyer", "sessionId", None), ("checkoutorderticketpartialcancel", "participantId", None),
    ("checkoutorderproductpartialcancel", "checkoutProductComplementId", None),
    ("checkoutproductcomplementanswer", "checkoutProductComplementId", None),
    ("tradecheckoutsession", "originalParticipantId", "status = 'Paid'"),
    ("tradecheckoutsession", "participantId", "status = 'Paid'"),
    ("customerpaymentprovidercard", "cardId", None), ("checkouteventticketbatchprice", "id", None),
    ("eventticketbatchprice", "id", None), ("eventticketbatchpricetype", "id", None),
    ("eventticketbatch", "id", None), ("eventticket", "id", None), ("eventticketcomplement", "ticketid", None),
    ("event", "id", None), ("eventcomplement", "eventid", None), ("product", "id", None),
    ("productmodel", "id", None), ("productsize", "id", None), ("productcomplementmanual", "productId", None),
    ("installmentsrange", "installments", None), ("paymentprovider", "id", None),
    ("gatecharges", "gateway,chargeOn,cardBrand,installments", "negotiationNumber = 1"),
    ("weeksarrange", "data", None),
]


def _duplicate_keys() -> str:
    parts = []
    for table, keys, where in FAN_KEYS:
        cond = " AND ".join([*([where] if where else []), *(f"{k} IS NOT NULL" for k in keys.split(","))])
        text = table == "gatecharges"  # its texts are compared without case
        by = ", ".join(f"lower({k})" if text and k != "installments" else k for k in keys.split(","))
        parts.append(
            f"SELECT '{table}' AS table_name, '{keys}' AS key_columns, CAST(count(*) AS BIGINT) AS duplicated_keys,"
            f" CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS extra_rows"
            f" FROM (SELECT count(*) AS n FROM {table} WHERE {cond} GROUP BY {by} HAVING count(*) > 1) d"
        )
    return _with("\nUNION ALL\n".join(parts))


ANOMALIES = {
    "plan_missing": "plan_k = 0 AND instalments > 0",
    "non_card_instalments": "payment_method <> 'CreditCard' AND instalments > 1",
    "ticket_sold_as_extra": "branch = 'tickets' AND category = 'extra'",
    "extra_sold_as_ticket": "branch = 'extras' AND category = 'ticket'",
    "other_category": "NOT coalesce(category IN ('ticket', 'extra'), false)",
    "null_producer_total": "producer_total IS NULL",
    "negative_item_total": "item_total < 0",
}


def _anomalies() -> str:
    parts = [
        f"SELECT '{name}' AS check_name, CAST(coalesce(sum(CASE WHEN {cond} THEN 1 ELSE 0 END), 0) AS BIGINT) AS row_count"
        f" FROM ledger_rows"
        for name, cond in ANOMALIES.items()
    ]
    return _with("\nUNION ALL\n".join(parts))


def queries() -> dict[str, str]:
    counts = "\nUNION ALL\n".join(
        f"SELECT '{t}' AS table_name, CAST(count(*) AS BIGINT) AS row_count FROM {t}" for t in TABLES
    )
    return {
        "source_counts": _with(counts),
        "paid_sessions": _with(
            "SELECT order_id, CAST(createdat - INTERVAL 3 HOUR AS DATE) AS purchase_date, order_status,"
            " provider_card_id FROM paid"
        ),
        "payable_tickets": _with(
            "SELECT t.item_id, t.order_id, t.cancel_reason FROM payable_tickets t JOIN paid p ON p.order_id = t.order_id"
        ),
        "payable_extras": _with(
            "SELECT e.item_id, e.order_id, e.cancel_reason FROM payable_extras e JOIN paid p ON p.order_id = e.order_id"
        ),
        "order_context": _with(
            "SELECT order_id, purchase_date, payment_method, instalments, instalment_plan_text, gateway,"
            " gateway_order_ref, fixed_gateway_cost, card_prefix FROM ctx"
        ),
        "bucketed_context": _with(
            "SELECT order_id, purchase_date, payment_method, instalments, instalment_plan_text, gateway,"
            " gateway_order_ref, fixed_gateway_cost, card_prefix FROM ctx"
        ),
        "session_card": _with(
            "SELECT p.order_id, p.provider_card_id, c.card_digits, c.card_brand_stored"
            " FROM paid p JOIN card_pick c ON c.card_id = p.provider_card_id"
        ),
        "trade_links": _with("SELECT original_item_id, new_owner_item_id FROM trade_links"),
        "linked_items": _with(
            "SELECT l.item_id, l.order_id, l.linked_item_id FROM linked l JOIN paid p ON p.order_id = l.order_id"
        ),
        "fixed_gateway_charges": _with("SELECT order_id, gateway, fixed_gateway_cost FROM ctx"),
        "ticket_dim": _with("SELECT * FROM ticket_dim"),
        "product_dim": _with(
            "SELECT product_key, item_name, event_id, event, edition, convenience_rate, tax_rate FROM product_dim"
        ),
        "effective_rates_tickets": _with(f"SELECT item_id, order_id, category, {RATES} FROM tickets"),
        "effective_rates_extras": _with(f"SELECT item_id, order_id, category, {RATES} FROM extras"),
        "order_totals_tickets": _with(f"SELECT item_id, order_id, {TOTALS} FROM tickets"),
        "order_totals_extras": _with(f"SELECT item_id, order_id, {TOTALS} FROM extras"),
        "item_shares": _with("SELECT branch, item_id, ticket_share, extra_share, order_share FROM items"),
        "item_status": _with(
            "SELECT branch, item_id, item_status, item_status_detail, linked_item_id FROM items"
        ),
        "card_brand": _with("SELECT branch, item_id, payment_method, card_brand FROM items"),
        "card_prefix": _with("SELECT branch, item_id, payment_method, card_prefix FROM items"),
        "items_union": _with(f"SELECT {ITEM_VALUES} FROM items"),
        "extras_answer_fanout": _with(
            "SELECT item_id, CAST(count(*) AS BIGINT) AS item_rows FROM extras GROUP BY item_id"
        ),
        "instalment_rows": _with(f"SELECT {ROW_KEY}, plan_k, item_fraction FROM inst"),
        "instalment_amounts": _with(
            f"SELECT {ROW_KEY}, platform_convenience, refund_cover_amount, discount_share, platform_interest,"
            " platform_freight, transfer_amount, item_total, producer_items, list_share FROM inst"
        ),
        "revenue_splits": _with(
            f"SELECT {ROW_KEY}, platform_refund_cover, producer_refund_cover, platform_transfer,"
            " producer_transfer FROM splits"
        ),
        "issue_charges": _with(f"SELECT {ROW_KEY}, platform_issue_pct, platform_issue_fixed FROM splits"),
        "producer_total": _with(f"SELECT {ROW_KEY}, producer_total FROM totals"),
        "gateway_cost": _with(
            f"SELECT {ROW_KEY}, gateway, card_brand, gateway_charge_type, gateway_charge_rate, gateway_cost"
            " FROM ledger_rows"
        ),
        "settlement_week": _with(f"SELECT {ROW_KEY}, settlement_week FROM ledger_rows"),
        "settlement_status": _with(f"SELECT {ROW_KEY}, settlement_status FROM ledger_rows"),
        "presented_amounts": _with(
            f"SELECT {ROW_KEY}, race_group, list_price, instalment_count, instalment_no, instalment_amount,"
            " gross_amount, discount_amount, net_amount FROM ledger_rows"
        ),
        "filter_editions": _ledger_where(f"edition IN ({EDITIONS})"),
        "filter_events": _ledger_where(f"event_id IN ({EVENT_IDS})"),
        "filter_orders": _ledger_where(f"order_id IN ({ORDER_IDS})"),
        "filter_participants": _ledger_where(f"branch = 'tickets' AND item_id IN ({PARTICIPANT_IDS})"),
        "filter_extras": _ledger_where(f"branch = 'extras' AND item_id IN ({EXTRA_IDS})"),
        "filter_branches": _with(
            "SELECT chosen, count(*) FILTER (branch = 'tickets') AS tickets_rows,"
            " count(*) FILTER (branch = 'extras') AS extras_rows FROM (VALUES ('participants'), ('extras'), ('both')) c(chosen)"
            " LEFT JOIN ledger_rows ON"
            f" (chosen = 'participants' AND branch = 'tickets' AND item_id IN ({PARTICIPANT_IDS}))"
            f" OR (chosen = 'extras' AND branch = 'extras' AND item_id IN ({EXTRA_IDS})) GROUP BY chosen"
        ),
        "filter_settled": _ledger_where(f"settlement_date BETWEEN DATE '{SETTLED[0]}' AND DATE '{SETTLED[1]}'"),
        "filter_bought": _ledger_where(f"purchase_date BETWEEN DATE '{BOUGHT[0]}' AND DATE '{BOUGHT[1]}'"),
        "filter_status": _ledger_where(f"settlement_status = '{STATUS}'"),
        "ledger": _with(f"SELECT {LEDGER} FROM ledger_rows"),
        "ledger_ordered": _with(f"SELECT {LEDGER} FROM ledger_rows ORDER BY order_id DESC"),
        "ledger_positions": _with(
            "SELECT row_number() OVER (ORDER BY order_id DESC NULLS LAST, item_id NULLS FIRST, instalment_no NULLS FIRST,"
            " settlement_date NULLS FIRST) AS position, order_id, item_id, instalment_no, settlement_date FROM ledger_rows"
        ),
        "lots": _with(
            counted("edition, event, item_name, item_type, list_price", "items_sold", "", producer_total="producer_total")
        ),
        "producer_totals": _with(
            f"SELECT edition, event, settlement_status, {money('producer_total')} AS producer_total,"
            " CAST(count(*) AS BIGINT) AS rows FROM ledger_rows GROUP BY ALL"
        ),
        "courtesies": _with(
            counted("edition, event", "courtesies", "WHERE courtesy", issue_cost="platform_issue_fixed")
        ),
        "weekly": _with(
            f"SELECT settlement_week, settlement_status, {money('instalment_amount')} AS instalment_amount,"
            f" {money('producer_total')} AS producer_total, {money('gateway_cost')} AS gateway_cost"
            " FROM ledger_rows GROUP BY ALL"
        ),
        "reconcile": _with(
            "SELECT order_id, amount::DOUBLE AS ledger_amount, totalAmount AS order_total,"
            " (amount - round(totalAmount::DECIMAL(38, 12), 6))::DOUBLE AS difference FROM"
            " (SELECT order_id, round(sum(instalment_amount::DECIMAL(38, 12)), 6) AS amount FROM ledger_rows GROUP BY ALL)"
            " LEFT JOIN checkoutsummary ON sessionid = order_id"
        ),
        "duplicate_keys": _duplicate_keys(),
        "anomalies": _anomalies(),
    }
