"""Order context: everything about a paid checkout session, one row per session.

Paid sessions are joined with their summary, payment, PayPal capture, stored card, provider,
instalment plan and the gateway's fixed charges, and the order-level rules are evaluated here,
once per session, before the (much larger) item tables are joined to it. All fact joins are on
the session id, so the result comes out hash-partitioned on ``order_id`` and both item branches
join it without shuffling it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import order as R
from ..sources import Tables
from . import fanout
from .filters import Params, apply, created_between, isin, settled_bounds
from .skew import hot_keys, join_spread, shuffled

PAID = "Paid"


def paid_sessions(tables: Tables, params: Params | None = None) -> DataFrame:
    """F01 (+ F05 and the scan-side part of F11 and F12): paid sessions, renamed."""
    params = params or Params()
    s = tables.checkoutsession
    bounds = settled_bounds(tables.installmentsrange, params)
    s = apply(
        s.where(F.col("status") == PAID),
        isin(F.col("id"), params.order_ids),
        created_between(F.col("createdat"), params.bought_between),
        None if bounds is None else (F.col("createdat") >= bounds[0]) & (F.col("createdat") < bounds[1]),
    )
    return s.select(
        F.col("id").alias("order_id"),
        "createdat",
        F.col("status").alias("order_status"),
        F.col("providerOrderId").alias("provider_order_id"),
        F.col("providerCardId").alias("provider_card_id"),
    )


def card_per_id(cards: DataFrame) -> DataFrame:
    """One stored card row per card id.

    The source picks an arbitrary row per session among the cards with the session's card id;
    here the pick is deterministic: smallest first digits, then smallest brand, nulls last. It
    is an aggregate, so duplicates of a card are combined map-side before any shuffle.
    """
    best = F.min(
        F.struct(
            F.col("first_six_digits").isNull().alias("digits_missing"),
            F.col("first_six_digits").alias("digits"),
            F.col("brand").isNull().alias("brand_missing"),
            F.col("brand").alias("brand"),
        )
    )
    return cards.groupBy(F.col("cardId").alias("card_id")).agg(best.alias("card")).select(
        "card_id",
        F.col("card.digits").alias("card_digits"),
        F.col("card.brand").alias("card_brand_stored"),
    )


def attach_card(sessions: DataFrame, tables: Tables, hot_rows: int | None = None) -> DataFrame:
    """Add the session's stored card (nulls when it has none).

    A session without a card id (every non-card payment) gets a key of its own that no card has:
    null keys would all go to a single shuffle partition. A card that pays very many sessions is
    split (:mod:`.skew`).
    """
    c = F.col
    own = F.when(c("provider_card_id").isNull(), F.concat(F.lit("-"), c("order_id").cast("string")))
    keyed = sessions.withColumn("_card", F.coalesce(own, F.concat(F.lit("="), c("provider_card_id").cast("string"))))
    picked = card_per_id(tables.customerpaymentprovidercard).select(
        F.concat(F.lit("="), c("card_id").cast("string")).alias("_card"), "card_digits", "card_brand_stored"
    )
    hot = None
    if hot_rows is not None:
        hot = hot_keys(keyed.where(c("provider_card_id").isNotNull()).select("_card"), "_card", hot_rows)
    return join_spread(keyed, shuffled(picked), "_card", hot, c("order_id"), "left").drop("_card")


def fixed_gateway_charges(gatecharges: DataFrame) -> DataFrame:
    """A02 + F15: per gateway, the sum of its fixed charges other than boleto's. Texts of the
    charge table are compared without regard to case, here as in the charge lookup (J34)."""
    return (
        gatecharges.where((F.lower("chargeType") == "fixed") & (F.lower("chargeOn") != "boleto"))
        .groupBy(F.lower("gateway").alias("fixed_gateway"))
        .agg(F.sum("chargeAmount").alias("fixed_charge"))
    )


def instalment_plans(ranges: DataFrame) -> DataFrame:
    """Instalment plans with the JSON array parsed once per plan (a malformed one fails)."""
    return ranges.select(
        F.col("installments").alias("plan_instalments"),
        F.col("installmentsArray").alias("plan_text"),
        F.from_json("installmentsArray", "array<int>", {"mode": "FAILFAST"}).alias("plan"),
    )


def buyer_counts(tables: Tables, orders: DataFrame | None = None) -> DataFrame:
    """J21 as a count per session (no column of the buyers is used)."""
    return fanout.counts(of_orders(tables.checkoutbuyer, "sessionId", orders), "sessionId", "buyer_session", "buyers")


def of_orders(df: DataFrame, key: str, orders: DataFrame | None) -> DataFrame:
    """The rows of ``df`` whose ``key`` is among ``orders`` (one column, ``order_id``; None: all)."""
    if orders is None:
        return df
    return df.join(orders.select(F.col("order_id").alias("_wanted")), F.col(key) == F.col("_wanted"), "left_semi")


def order_context(tables: Tables, params: Params | None = None, orders: DataFrame | None = None) -> DataFrame:
    """One row per paid session (more if a summary, payment or capture repeats).

    ``orders`` (one column, ``order_id``, distinct) restricts the context to those orders: the
    sessions and every table of session facts are semi-joined with it before anything else.

    The stored card is joined first, while rows are narrow; over bucketed session facts
    (``sources.read_bucketed``) last, as its shuffle would undo the buckets.
    """
    params = params or Params()

    def wanted(df: DataFrame, key: str) -> DataFrame:
        return of_orders(df, key, orders)

    sessions = wanted(paid_sessions(tables, params), "order_id")
    if not tables.bucketed:
        sessions = attach_card(sessions, tables, params.hot_key_rows)
    summary = wanted(tables.checkoutsummary, "sessionid").select(
        F.col("sessionid").alias("summary_session"),
        F.col("totalAmount").alias("sum_total"),
        F.col("ticketsValue").alias("sum_tickets"),
        F.col("productsValue").alias("sum_products"),
        F.col("discount").alias("sum_discount"),
        F.col("interest").alias("sum_interest"),
        F.col("freight").alias("sum_freight"),
        F.col("tax").alias("sum_tax"),
        F.col("ticketInsurance").alias("sum_insurance"),
        F.col("ticketTransfer").alias("sum_transfer"),
    )
    payment = wanted(tables.checkoutpayment, "sessionid").select(
        F.col("sessionid").alias("payment_session"),
        F.col("paymentOption").alias("pay_option"),
        F.col("installments").alias("pay_instalments"),
        F.col("paymentProviderId").alias("pay_provider_id"),
        F.col("cardBrand").alias("pay_card_brand"),
        F.col("cardFirstSixDigits").alias("pay_digits"),
    )
    paypal = wanted(tables.checkoutpaypaldetails, "sessionId").select(
        F.col("sessionId").alias("paypal_session"), F.col("captureId").alias("capture_id")
    )
    providers = tables.paymentprovider.select(F.col("id").alias("provider_id"), F.col("name").alias("provider_name"))
    plans = instalment_plans(tables.installmentsrange)
    fixed = fixed_gateway_charges(tables.gatecharges)

    c = F.col
    facts = (
        sessions.join(summary, c("order_id") == c("summary_session"), "left")
        .join(payment, c("order_id") == c("payment_session"), "left")
        .join(paypal, c("order_id") == c("paypal_session"), "left")
        # Buyer rows add no column, only multiply the extras
        .join(buyer_counts(tables, orders), c("order_id") == c("buyer_session"), "left")
    )
    if tables.bucketed:
        # the joins above find their sides in place; the card's shuffle, by another key, comes after
        facts = attach_card(facts, tables, params.hot_key_rows)
    ctx = (
        facts.join(providers, c("pay_provider_id") == c("provider_id"), "left")
        .join(plans, c("pay_instalments") == c("plan_instalments"), "left")
        .withColumn("gateway_key", R.gateway_key(c("pay_option"), c("provider_name")))
        .join(fixed, F.lower("gateway_key") == c("fixed_gateway"), "left")
        .drop(
            "summary_session", "payment_session", "paypal_session", "buyer_session", "provider_id",
            "plan_instalments", "gateway_key", "fixed_gateway",
        )
    )
    if tables.keep is not None:
        # paid sessions have a status, but files mark every column nullable
        ctx = tables.part(ctx).withColumn("order_status", F.coalesce("order_status", F.lit(PAID)))
    option = c("pay_option")
    return ctx.select(
        "order_id",
        "order_status",
        "provider_card_id",
        R.purchase_date(c("createdat")).alias("purchase_date"),
        R.payment_method(option).alias("payment_method"),
        R.instalments(c("pay_instalments")).alias("instalments"),
        R.instalment_plan(c("plan")).alias("instalment_plan"),
        F.coalesce(c("plan_text"), F.lit("[0]")).alias("instalment_plan_text"),
        R.gateway(option, c("provider_name")).alias("gateway"),
        R.gateway_order_ref(option, c("capture_id"), c("provider_order_id")).alias("gateway_order_ref"),
        R.fixed_gateway_cost(c("fixed_charge"), c("pay_instalments")).alias("fixed_gateway_cost"),
        R.card_prefix(option, c("pay_digits"), c("card_digits")).alias("card_prefix"),
        "pay_option", "pay_card_brand", "pay_digits", "card_digits", "card_brand_stored",
        "sum_total", "sum_tickets", "sum_products", "sum_discount", "sum_interest",
        "sum_freight", "sum_tax", "sum_insurance", "sum_transfer", "buyers",
    )
