"""Rule tests: one hand-made row per CASE arm."""

import pytest
from pyspark.sql import functions as F

from settlekit.functions import order as R
from settlekit.functions import rates, status
from settlekit.functions.money import exact_sum, per_instalment
from settlekit.functions.present import presented
from settlekit.functions.totals import Summary, extra_totals, ticket_totals


def evaluate(spark, schema, rows, exprs):
    df = spark.createDataFrame(rows, schema)
    return [r.asDict() for r in df.select(*[e.alias(n) for n, e in exprs.items()]).collect()]


BRAND_SCHEMA = "opt string, stored string, pay_brand string, pay_digits string, card_digits string"
BRAND_CASES = [
    ((None, "visa", None, None, None), "Cortesia", "Cortesia"),
    (("Pix", "visa", None, None, None), "Pix", "Pix"),
    (("CreditCard", "MasterCard", None, "411111", None), "Master", "Master"),
    (("CreditCard", None, "elo", "411111", None), "elo", "elo"),
    (("CreditCard", "diners", None, "411111", None), "visa", "visa"),
    (("CreditCard", "diners", None, None, "491111"), "visa", "visa"),
    (("CreditCard", "diners", None, "222100", None), "Master", "Master"),
    (("CreditCard", "diners", None, "650000", None), "elo", "elo"),
    (("CreditCard", "diners", None, "384100", None), "hipercard", "hipercard"),
    (("CreditCard", "diners", None, None, "371449"), "Amex", "Amex"),
    (("CreditCard", None, None, "981234", None), "sem bandeira", "Master"),
    (("CreditCard", "diners", None, "981234", "******"), "diners", "diners"),
]


def test_card_brand_arms(spark):
    c = F.col
    args = (c("opt"), c("stored"), c("pay_brand"), c("pay_digits"), c("card_digits"))
    got = evaluate(spark, BRAND_SCHEMA, [case for case, _, _ in BRAND_CASES], {
        "t": R.card_brand(*args, R.NO_BRAND_TICKET),
        "e": R.card_brand(*args, R.NO_BRAND_EXTRA),
    })
    assert [(g["t"], g["e"]) for g in got] == [(t, e) for _, t, e in BRAND_CASES]


def test_card_prefix_arms(spark):
    rows = [
        (None, "411111", "411111"),
        ("CreditCard", "******", "******"),
        ("CreditCard", "411111", None),
        ("CreditCard", "411111", "******"),
        ("CreditCard", "******", "545454"),
        ("CreditCard", None, "545454"),
        ("CreditCard", None, None),
    ]
    c = F.col
    got = evaluate(spark, "opt string, pay string, card string", rows,
                   {"p": R.card_prefix(c("opt"), c("pay"), c("card"))})
    assert [g["p"] for g in got] == ["Cortesia", "masked", "4111", "4111", "5454", "5454", None]


def test_rate_fallback(spark):
    rows = [(None, 5.0), (0.0, 5.0), (7.0, 5.0), (None, None)]
    c = F.col
    got = evaluate(spark, "specific double, general double", rows, {
        "pct": rates.fallback_percent(c("specific"), c("general")),
        "fixed": rates.fallback(c("specific"), c("general")),
    })
    assert [(g["pct"], g["fixed"]) for g in got] == [(0.05, 5.0), (0.05, 5.0), (0.07, 7.0), (None, None)]


SUMMARY_SCHEMA = (
    "sum_total double, sum_tickets double, sum_products double, sum_discount double, sum_interest double,"
    " sum_freight double, sum_tax double, sum_insurance double, sum_transfer double, pay_option string,"
    " price double, transfer_price double"
)


def _ticket(spark, rows):
    s = Summary.from_context()
    return evaluate(spark, SUMMARY_SCHEMA, rows, ticket_totals(s, F.col("price"), F.col("transfer_price")))


def test_ticket_totals_transfer_zeroes_everything(spark):
    (r,) = _ticket(spark, [(25.0, 100.0, 0.0, 5.0, 1.0, 2.0, 3.0, 4.0, 25.0, "Pix", 100.0, 25.0)])
    assert r["tickets_value"] == r["net_tickets"] == r["discount"] == r["interest"] == r["tax"] == 0.0
    assert r["transfer"] == 25.0
    assert r["item_price"] == 25.0


def test_ticket_totals_negative_total_discount_arm(spark):
    # total < 0: discount = tickets + interest + freight + tax + insurance, without null handling
    rows = [
        (-10.0, 100.0, 0.0, 120.0, 1.0, 2.0, 3.0, 4.0, 0.0, "Pix", 50.0, 25.0),
        (-10.0, 100.0, 0.0, 120.0, None, 2.0, 3.0, 4.0, 0.0, "Pix", 50.0, 25.0),
    ]
    a, b = _ticket(spark, rows)
    assert a["discount"] == 110.0
    assert b["discount"] is None
    assert a["interest"] == a["tax"] == 0.0  # total <= 0 zeroes these
    assert a["order_share"] == 0.0  # negative share is clamped


def test_ticket_net_tickets_arms(spark):
    rows = [
        (1.0, 100.0, 0.0, 110.0, 0.0, 0.0, 8.0, 0.0, 0.0, "Pix", 50.0, 25.0),  # tickets + tax <= discount
        (1.0, 100.0, 0.0, 105.0, 0.0, 0.0, 8.0, 0.0, 0.0, "Pix", 50.0, 25.0),  # between: negative
        (1.0, 100.0, 0.0, 10.0, 0.0, 0.0, 8.0, 0.0, None, None, 50.0, 25.0),  # no payment
    ]
    got = _ticket(spark, rows)
    assert [g["net_tickets"] for g in got] == [0.0, -5.0, 0.0]
    assert got[2]["order_total"] == 0.0
    assert got[2]["transfer"] == 0.0  # null transfer -> 0


def test_ticket_share_zero_tickets_value(spark):
    (r,) = _ticket(spark, [(15.0, 0.0, 100.0, 0.0, 0.0, 15.0, 0.0, 0.0, 0.0, "Pix", 50.0, 25.0)])
    assert r["ticket_share"] == 0.0


def test_extra_totals(spark):
    s = Summary.from_context()
    rows = [
        (115.0, 0.0, 100.0, 0.0, 0.0, 15.0, 0.0, 0.0, 0.0, "Pix", 50.0, None),
        (115.0, 0.0, 100.0, 0.0, 3.0, 15.0, 0.0, 0.0, 0.0, None, 50.0, None),
        (115.0, 0.0, 0.0, 0.0, 3.0, 15.0, 0.0, 0.0, 0.0, "Pix", 50.0, None),
    ]
    got = evaluate(spark, SUMMARY_SCHEMA, rows, extra_totals(s, F.col("price")))
    assert [g["extra_share"] for g in got] == [0.5, 0.5, 0.0]
    assert [g["products_value"] for g in got] == [100.0, 0.0, 0.0]
    assert [g["interest"] for g in got] == [0.0, 0.0, 3.0]
    assert got[1]["order_total"] == 0.0


def test_status_arms(spark):
    rows = [
        ("Troca de Titularidade", 25.0), (None, 25.0), (None, 0.0), ("Cancelamento Reembolsável", None),
    ]
    c = F.col
    got = evaluate(spark, "reason string, transfer double", rows, {
        "s": status.ticket_status(c("reason"), c("transfer")),
        "d": status.ticket_status_detail(c("reason"), c("transfer")),
        "es": status.extra_status(c("reason")),
        "ed": status.extra_status_detail(c("reason")),
        "ok": status.payable(c("reason"), status.PAYABLE_TICKET_REASONS),
    })
    assert [(g["s"], g["d"]) for g in got] == [
        ("transferido", "Troca de Titularidade (de)"),
        ("recebido", "Troca de Titularidade (para)"),
        ("aprovado", "aprovado"),
        ("cancelado", "Cancelamento Reembolsável"),
    ]
    assert [(g["es"], g["ed"]) for g in got] == [
        ("aprovado", "aprovado"), ("aprovado", "aprovado"), ("aprovado", "aprovado"),
        ("cancelado", "Cancelamento Reembolsável"),
    ]
    assert [g["ok"] for g in got] == [True, True, True, True]


def test_presented_discount_is_capped_by_gross(spark):
    rows = [("Pix", 10.0, 4.0), ("Pix", 3.0, 4.0), ("Cortesia", 3.0, 4.0), ("Pix", None, 4.0)]
    p = presented()
    got = evaluate(spark, "payment_method string, discount_share double, list_share double", rows, {
        "d": p["discount_amount"], "n": p["net_amount"], "g": p["gross_amount"],
    })
    assert [(g["g"], g["d"], g["n"]) for g in got] == [
        (4.0, 4.0, 0.0), (4.0, 3.0, 1.0), (0.0, 0.0, 0.0), (4.0, None, None),
    ]


def test_per_instalment_and_exact_sum(spark):
    df = spark.createDataFrame([(1.0 / 3,)] * 3 + [(0.1,)] * 10, "x double")
    (r,) = df.agg(exact_sum(F.col("x")).alias("s")).collect()
    assert r["s"] == 2.0
    got = evaluate(spark, "a double, s double, n int", [(30.0, 0.5, 0), (30.0, 0.5, 3)],
                   {"v": per_instalment(F.col("a"), F.col("s"), F.col("n"))})
    assert [g["v"] for g in got] == [15.0, 5.0]


def test_fixed_gateway_cost(spark):
    rows = [(0.6, 3), (0.6, 0), (None, 2), (0.6, None)]
    got = evaluate(spark, "fixed double, n int", rows,
                   {"v": R.fixed_gateway_cost(F.col("fixed"), F.col("n"))})
    assert [g["v"] for g in got] == [pytest.approx(0.2), 0.0, 0.0, 0.6]
