"""Hand-made checkout tables for rule and golden-row tests."""

from __future__ import annotations

import datetime as dt

from settlekit.sources import SCHEMAS, Tables


def make_tables(spark, **rows) -> Tables:
    """Tables with the given rows (lists of tuples in schema order); other tables empty."""
    frames = {}
    for name, schema in SCHEMAS.items():
        frames[name] = spark.createDataFrame(rows.get(name, []), schema)
    return Tables(frames)


def ts(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


def golden_tables(spark) -> Tables:
    """G1-G4 of FIXTURES.md §4.

    Shared catalogue: event 7 ('Event', fee 10 %, transfer price 25) with edition 'ED' and
    event-level rates; ticket 3000 ('ticket A', 10 %, 5 fixed, 30 % cover, 50 % transfer) on lot
    price 1000 (price 100); ticket 3001 with a 40 % transfer rate for G3; product 500 (size price
    50, own charge 5 % and 5 fixed). Gateway Pagarme charges 3 % for visa in 3 instalments and
    0.6 fixed; Stone has no charges.
    """
    d = dt.date
    return make_tables(
        spark,
        checkoutsession=[
            (1, ts("2024-01-01 02:00:00"), "Paid", "or_1", "card_1"),
            (2, ts("2024-01-01 12:00:00"), "Paid", "or_2", None),
            (3, ts("2024-01-01 12:00:00"), "Paid", "or_3", None),
            (4, ts("2024-01-01 12:00:00"), "Paid", "or_4", None),
        ],
        checkoutsummary=[
            (1, 196.0, 200.0, 0.0, 40.0, 6.0, 0.0, 20.0, 10.0, 0.0),
            (2, 0.0, 100.0, 0.0, 100.0, 0.0, 0.0, 0.0, 0.0, 0.0),
            (3, 25.0, 100.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 25.0),
            (4, 115.0, 0.0, 100.0, 0.0, 0.0, 15.0, 0.0, 0.0, 0.0),
        ],
        checkoutpayment=[
            (1, "CreditCard", 3, 1, None, "411111"),
            (3, "Pix", 1, 2, None, None),
            (4, "Pix", 1, 2, None, None),
        ],
        customerpaymentprovidercard=[("card_1", "411111", "visa")],
        checkoutbuyer=[(1,), (2,), (3,), (4,)],
        checkoutparticipant=[(10, 1, 100), (20, 2, 100), (30, 3, 101)],
        checkouteventticketbatchprice=[(100, 1000), (101, 1001)],
        eventticketbatchprice=[(1000, 100.0, 0, 2000), (1001, 100.0, 0, 2001)],
        eventticketbatchpricetype=[(0, "inteira")],
        eventticketbatch=[(2000, 3000), (2001, 3001)],
        eventticket=[(3000, "ticket A", 7), (3001, "ticket B", 7)],
        eventticketcomplement=[
            (3000, "ticket", "10k", 10.0, 5.0, 30.0, 50.0),
            (3001, "ticket", "10k", 10.0, 5.0, 30.0, 40.0),
        ],
        event=[(7, "Event", 10.0, 25.0)],
        eventcomplement=[(7, "ED", 3.0, 1.0, 20.0, 45.0, 1.0, 6.0, 4.0, 1.0)],
        installmentsrange=[(1, "[1]"), (3, "[1,2,3]")],
        paymentprovider=[(1, "Pagarme"), (2, "Stone")],
        gatecharges=[
            ("Pagarme", 1, "CreditCard", "visa", 3, "percent", 0.03),
            ("Pagarme", 0, "CreditCard", "all", 0, "fixed", 0.6),
        ],
        checkoutproductcomplement=[(40, 4, 500, 1, 500)],
        product=[(500, "T-shirt", 7)],
        productmodel=[(1, "model 1")],
        productsize=[(500, 50.0)],
        productcomplementmanual=[(500, "extra", 5.0, 5.0)],
        weeksarrange=[(d(2023, 12, 31), "2023-12-25"), (d(2024, 1, 1), "2024-01-01"),
                      (d(2024, 1, 4), "2024-01-01"), (d(2024, 1, 9), "2024-01-08")],
    )
