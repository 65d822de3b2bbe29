"""

Neither job changes the ledger; they count. Both are single aggregations, so they scale like
the reports.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import Tables

# Joins that repeat a row when their key repeats: (table, key columns, row filter or None).
FAN_KEYS: list[tuple[str, list[str], str | None]] = [
    ("checkoutsession", ["id"], None),
    ("checkoutsummary", ["sessionid"], None),
    ("checkoutpayment", ["sessionid"], None),
    ("checkoutpaypaldetails", ["sessionId"], None),
    ("checkoutbuyer", ["sessionId"], None),
    ("checkoutorderticketpartialcancel", ["participantId"], None),
    ("checkoutorderproductpartialcancel", ["checkoutProductComplementId"], None),
    ("checkoutproductcomplementanswer", ["checkoutProductComplementId"], None),
    ("tradecheckoutsession", ["originalParticipantId"], "status = 'Paid'"),
    ("tradecheckoutsession", ["participantId"], "status = 'Paid'"),
    ("customerpaymentprovidercard", ["cardId"], None),
    ("checkouteventticketbatchprice", ["id"], None),
    ("eventticketbatchprice", ["id"], None),
    ("eventticketbatchpricetype", ["id"], None),
    ("eventticketbatch", ["id"], None),
    ("eventticket", ["id"], None),
    ("eventticketcomplement", ["ticketid"], None),
    ("event", ["id"], None),
    ("eventcomplement", ["eventid"], None),
    ("product", ["id"], None),
    ("productmodel", ["id"], None),
    ("productsize", ["id"], None),
    ("productcomplementmanual", ["productId"], None),
    ("installmentsrange", ["installments"], None),
    ("paymentprovider", ["id"], None),
    ("gatecharges", ["gateway", "chargeOn", "cardBrand", "installments"], "negotiationNumber = 1"),
    ("weeksarrange", ["data"], None),
]


def duplicate_keys(tables: Tables) -> DataFrame:
    """Per fan-out join: how many keys repeat and how many extra rows they add."""
    parts = []
    for table, keys, where in FAN_KEYS:
        df = tables[table]
        if where:
            df = df.where(where)
        # a null never equals a key, and the charge table's texts are compared without case
        df = df.dropna(subset=keys)
        if table == "gatecharges":
            df = df.withColumns({k: F.lower(k) for k in keys if k != "installments"})
        per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
        parts.append(per_key.agg(
            F.count(F.lit(1)).alias("duplicated_keys"),
            F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra_rows"),
        ).select(
            F.lit(table).alias("table_name"), F.lit(",".join(keys)).alias("key_columns"),
            "duplicated_keys", "extra_rows",
        ))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def anomalies(rows: DataFrame) -> DataFrame:
    """Counts of ledger rows that follow the source's rules literally but look wrong.

    ``rows`` is :func:`settlekit.plans.ledger.ledger_rows` (it needs intermediate columns).
    """
    c = F.col
    cases = {
        "plan_missing": (c("plan_k") == 0) & (c("instalments") > 0),
        "non_card_instalments": (c("payment_method") != "CreditCard") & (c("instalments") > 1),
        "ticket_sold_as_extra": (c("branch") == "tickets") & (c("category") == "extra"),
        "extra_sold_as_ticket": (c("branch") == "extras") & (c("category") == "ticket"),
        "other_category": ~F.coalesce(c("category").isin("ticket", "extra"), F.lit(False)),
        "null_producer_total": c("producer_total").isNull(),
        "negative_item_total": c("item_total") < 0,
    }
    counted = rows.agg(*[F.sum(F.when(cond, 1).otherwise(0)).alias(name) for name, cond in cases.items()])
    pairs = ", ".join(f"'{name}', `{name}`" for name in cases)
    return counted.select(F.expr(f"stack({len(cases)}, {pairs}) AS (check_name, row_count)")).select(
        "check_name", F.coalesce(c("row_count"), F.lit(0)).cast("long").alias("row_count")
    )
