"""Report parameters F04-F13 on the golden tables, and the purchase-range rewrite."""

import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from settlekit import Params, ledger
from settlekit.operators.filters import created_between

from tables_builder import golden_tables

AS_OF = dt.date(2024, 1, 5)


_TABLES = {}


def ids(spark, **kw):
    if "t" not in _TABLES:
        _TABLES["t"] = golden_tables(spark)
    df = ledger(_TABLES["t"], Params(as_of=AS_OF, **kw))
    return sorted(r["item_id"] for r in df.select("item_id").collect())


def test_no_filter(spark):
    assert ids(spark) == [10, 10, 10, 20, 30, 40]


def test_participants_drop_extras_and_extras_drop_tickets(spark):
    assert ids(spark, participant_ids=[10, 40]) == [10, 10, 10]
    assert ids(spark, extra_ids=[40, 10]) == [40]
    assert ids(spark, participant_ids=[10], extra_ids=[40]) == []


def test_orders_events_editions(spark):
    assert ids(spark, order_ids=[1, 4]) == [10, 10, 10, 40]
    assert ids(spark, event_ids=[7]) == [10, 10, 10, 20, 30, 40]
    assert ids(spark, event_ids=[8]) == []
    assert ids(spark, editions=["ED"]) == [10, 10, 10, 20, 30, 40]


def test_dates_and_status(spark):
    assert ids(spark, settled_between=(dt.date(2024, 1, 2), dt.date(2024, 1, 9))) == [10, 10]
    assert ids(spark, bought_between=(dt.date(2023, 12, 31), dt.date(2023, 12, 31))) == [10, 10, 10]
    assert ids(spark, status="futuro") == [10]


def test_cancel_reason_allow_list(spark):
    t = golden_tables(spark)
    # give participant 20 a cancel that is not payable, 10 one that is
    cancels = spark.createDataFrame([(20, "Desistência"), (10, "Cancelamento Reembolsável")],
                                    "participantId long, reason string")
    frames = {name: t[name] for name in t}
    frames["checkoutorderticketpartialcancel"] = cancels
    from settlekit.sources import Tables
    df = ledger(Tables(frames), Params(as_of=AS_OF))
    got = {(r["item_id"], r["item_status"]) for r in df.collect()}
    assert (10, "cancelado") in got
    assert all(i != 20 for i, _ in got)


@settings(max_examples=60, deadline=None)
@given(
    created=st.datetimes(min_value=dt.datetime(2023, 12, 25), max_value=dt.datetime(2024, 1, 10)),
    lo=st.dates(min_value=dt.date(2023, 12, 25), max_value=dt.date(2024, 1, 10)),
    span=st.integers(min_value=0, max_value=5),
)
def test_created_between_matches_purchase_date(created, lo, span):
    hi = lo + dt.timedelta(days=span)
    local_day = (created - dt.timedelta(hours=3)).date()
    start = dt.datetime.combine(lo, dt.time(3))
    end = dt.datetime.combine(hi + dt.timedelta(days=1), dt.time(3))
    assert (lo <= local_day <= hi) == (start <= created < end)


def test_created_between_expression(spark):
    df = spark.createDataFrame(
        [(dt.datetime(2024, 1, 1, 2, 59),), (dt.datetime(2024, 1, 1, 3, 0),), (dt.datetime(2024, 1, 3, 2, 59),),
         (dt.datetime(2024, 1, 3, 3, 0),)],
        "createdat timestamp_ntz",
    )
    got = [r[0] for r in df.select(created_between(F.col("createdat"), (dt.date(2024, 1, 1), dt.date(2024, 1, 2)))).collect()]
    assert got == [False, True, True, False]
