"""Gateway cost (J34, R41-R43): the percentage a gateway charges for the row's payment.

The source matches a text key ``gateway_1_method_brand_instalments``; here the same five parts
are an equi-join key, so it is a hash join. Text parts are compared without regard to case,
like the source database's collation. A null part never matches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import instalment as I
from ..functions.order import NO_BRAND_TICKET
from ..sources import Tables

NEGOTIATION = 1
NO_BRAND_CHARGED_AS = "Master"


def charge_table(gatecharges: DataFrame) -> DataFrame:
    """Charges of the standard negotiation, keyed by lower-cased text parts."""
    c = F.col
    return gatecharges.where(c("negotiationNumber") == NEGOTIATION).select(
        F.lower(c("gateway")).alias("gk_gateway"),
        F.lower(c("chargeOn")).alias("gk_method"),
        F.lower(c("cardBrand")).alias("gk_brand"),
        c("installments").alias("gk_instalments"),
        c("chargeType").alias("gk_type"),
        c("chargeAmount").alias("gk_amount"),
    )


def attach_charge_rate(items: DataFrame, tables: Tables) -> DataFrame:
    """Add ``gateway_charge_type`` and ``gateway_charge_rate``; a key that repeats in the charge
    table repeats the row, as in the source. No part of the key depends on the instalment, so
    items are looked up before they become instalments."""
    c = F.col
    charges = charge_table(tables.gatecharges)
    brand = F.when(c("card_brand") == NO_BRAND_TICKET, F.lit(NO_BRAND_CHARGED_AS)).otherwise(c("card_brand"))
    keyed = items.select(
        "*",
        F.lower(c("gateway")).alias("rk_gateway"),
        F.lower(c("payment_method")).alias("rk_method"),
        F.lower(brand).alias("rk_brand"),
        F.coalesce(c("instalments"), F.lit(1)).alias("rk_instalments"),
    )
    cond = (
        (c("rk_gateway") == c("gk_gateway"))
        & (c("rk_method") == c("gk_method"))
        & (c("rk_brand") == c("gk_brand"))
        & (c("rk_instalments") == c("gk_instalments"))
    )
    joined = keyed.join(charges, cond, "left")
    return joined.select(
        *items.columns,
        F.coalesce(c("gk_type"), F.lit("Cortesia")).alias("gateway_charge_type"),
        F.coalesce(c("gk_amount"), F.lit(0.0)).alias("gateway_charge_rate"),
    )


def with_gateway_cost(rows: DataFrame) -> DataFrame:
    """R43 on rows of :func:`attach_charge_rate` that have their amounts."""
    return rows.select("*", I.gateway_cost(F.col("gateway_charge_rate")).alias("gateway_cost"))
