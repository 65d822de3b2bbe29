"""Order-level rules (one value per checkout session): date, method, gateway, card.

They read the columns of :func:`settlekit.operators.context.order_context`, so they are
evaluated once per session before the session is joined to its items.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .money import ratio

COURTESY = "Cortesia"
CREDIT_CARD = "CreditCard"
PAYPAL = "PayPal"

# ---- fixed values: card brand by the first two digits of the card number ------------------
VISA_PREFIXES = ["40", "41", "42", "43", "44", "45", "46", "47", "48", "49"]
MASTER_PREFIXES = ["22", "23", "24", "25", "26", "27", "51", "52", "53", "54", "55"]
ELO_PREFIXES = ["50", "63", "65"]
HIPERCARD_PREFIXES = ["38", "60"]
AMEX_PREFIXES = ["34", "35", "36", "37"]
MASKED_DIGITS = "******"
NO_BRAND_TICKET = "sem bandeira"
NO_BRAND_EXTRA = "Master"
# --------------------------------------------------------------------------------------------


def purchase_date(createdat: Column) -> Column:
    """The checkout's local date (timestamps are stored 3 h ahead of local time)."""
    return (createdat - F.expr("INTERVAL 3 HOURS")).cast("date")


def payment_method(option: Column) -> Column:
    """The payment option; no payment means a courtesy."""
    return F.coalesce(option, F.lit(COURTESY))


def instalments(raw: Column) -> Column:
    """Number of instalments, 0 when unknown."""
    return F.coalesce(raw, F.lit(0))


def instalment_plan(plan: Column) -> Column:
    """The plan's instalment numbers; without a plan one instalment numbered 0."""
    return F.coalesce(plan, F.array(F.lit(0)))


def gateway_key(option: Column, provider: Column) -> Column:
    """Gateway a payment went through (PayPal has its own), null without payment."""
    return F.when(option == PAYPAL, F.lit(PAYPAL)).otherwise(provider)


def gateway(option: Column, provider: Column) -> Column:
    """R04."""
    return F.coalesce(gateway_key(option, provider), F.lit(COURTESY))


def gateway_order_ref(option: Column, capture_id: Column, provider_order_id: Column) -> Column:
    """Reference to look the payment up at the gateway."""
    return F.when(option == PAYPAL, capture_id).otherwise(provider_order_id)


def fixed_gateway_cost(fixed_charge: Column, raw_instalments: Column) -> Column:
    """The gateway's fixed charges spread over the instalments (0 instalments -> 0)."""
    return F.coalesce(
        ratio(F.coalesce(fixed_charge, F.lit(0.0)), F.coalesce(raw_instalments, F.lit(1))),
        F.lit(0.0),
    )


def _first_two_in(pay_digits: Column, card_digits: Column, prefixes: list[str]) -> Column:
    return F.left(pay_digits, F.lit(2)).isin(prefixes) | F.left(card_digits, F.lit(2)).isin(prefixes)


def card_brand(
    option: Column, stored_brand: Column, pay_brand: Column, pay_digits: Column,
    card_digits: Column, no_brand: str,
) -> Column:
    """Brand of the card, from the stored brand, the payment's brand or the digits.

    ``no_brand`` is what a card payment without any brand gets: ``sem bandeira`` for tickets
    and ``Master`` for extras. The stored brand is compared without regard to case, as the
    source database's text collation does.
    """
    return (
        F.when(option.isNull(), F.lit(COURTESY))
        .when(option != CREDIT_CARD, option)
        .when(F.lower(stored_brand) == "mastercard", F.lit("Master"))
        .when(stored_brand.isNull() & pay_brand.isNotNull(), pay_brand)
        .when(_first_two_in(pay_digits, card_digits, VISA_PREFIXES), F.lit("visa"))
        .when(_first_two_in(pay_digits, card_digits, MASTER_PREFIXES), F.lit("Master"))
        .when(_first_two_in(pay_digits, card_digits, ELO_PREFIXES), F.lit("elo"))
        .when(_first_two_in(pay_digits, card_digits, HIPERCARD_PREFIXES), F.lit("hipercard"))
        .when(_first_two_in(pay_digits, card_digits, AMEX_PREFIXES), F.lit("Amex"))
        .when(stored_brand.isNull() & pay_brand.isNull(), F.lit(no_brand))
        .otherwise(stored_brand)
    )


def card_prefix(option: Column, pay_digits: Column, card_digits: Column) -> Column:
    """First four digits of the card, from whichever source is not masked."""
    card_unusable = card_digits.isNull() | (card_digits == MASKED_DIGITS)
    pay_usable = pay_digits.isNotNull() & (pay_digits != MASKED_DIGITS)
    return (
        F.when(option.isNull(), F.lit(COURTESY))
        .when((card_digits == MASKED_DIGITS) & (pay_digits == MASKED_DIGITS), F.lit("masked"))
        .when(card_unusable & pay_usable, F.left(pay_digits, F.lit(4)))
        .otherwise(F.left(card_digits, F.lit(4)))
    )
