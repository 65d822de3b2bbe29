
import datetime as dt

import pytest
from pyspark.sql import functions as F

from settlekit import Params
from settlekit.operators.gateway import NEGOTIATION, charge_table
from settlekit.plans.ledger import instalment_rows, ledger_rows


@pytest.fixture(scope="module")
def rows(spark, small_tables):
    return ledger_rows(small_tables, Params(as_of=dt.date(2001, 7, 1))).cache()


def count(df) -> int:
    return df.count()


def test_splits_add_up(rows):
    c = F.col
    bad = rows.where(
        (F.abs(c("platform_refund_cover") + c("producer_refund_cover") - c("refund_cover_amount")) > 1e-9)
        | (F.abs(c("platform_transfer") + c("producer_transfer") - c("transfer_amount")) > 1e-9)
    )
    assert count(bad) == 0


def test_net_is_gross_minus_discount(rows):
    c = F.col
    assert count(rows.where(F.abs(c("net_amount") - (c("gross_amount") - c("discount_amount"))) > 1e-9)) == 0


def test_item_fraction_counts_items(rows):
    c = F.col
    plan_len = rows.groupBy("branch", "item_id").agg(
        F.sum("item_fraction").alias("f"), F.count(F.lit(1)).alias("n"), F.first("instalments").alias("k"),
        F.countDistinct("instalment_seq").alias("seqs"),
    )
    # a card item paid in k instalments on a plan of length k: each copy of the item sums to 1
    card = plan_len.where((c("k") > 0) & (c("seqs") == c("k")))
    assert count(card.where(F.abs(c("f") / (c("n") / c("k")) - 1.0) > 1e-9)) == 0


def test_lookups_repeat_rows_only_where_their_keys_repeat(rows, small_tables):
    """Charge and calendar lookups add rows for keys that repeat, and none else."""
    # the lookup takes the standard negotiation and compares texts without regard to case
    charges = charge_table(small_tables.gatecharges).dropDuplicates(["gk_gateway", "gk_method", "gk_brand", "gk_instalments"])
    single = {
        "gatecharges": charges.select(
            F.col("gk_gateway").alias("gateway"), F.lit(NEGOTIATION).alias("negotiationNumber"), F.col("gk_method").alias("chargeOn"),
            F.col("gk_brand").alias("cardBrand"), F.col("gk_instalments").alias("installments"),
            F.col("gk_type").alias("chargeType"), F.col("gk_amount").alias("chargeAmount"),
        ),
        "weeksarrange": small_tables.weeksarrange.dropDuplicates(["data"]),
    }
    inst = instalment_rows(small_tables, Params(as_of=dt.date(2001, 7, 1))).count()
    once = ledger_rows(small_tables.with_frames(**single), Params(as_of=dt.date(2001, 7, 1))).count()
    assert once == inst <= count(rows)


def test_courtesy_rows(rows):
    c = F.col
    courtesy = rows.where(c("payment_method") == "Cortesia")
    assert count(courtesy) > 0
    assert count(courtesy.where((c("list_price") != 0) | (c("gross_amount") != 0) | (c("card_brand") != "Cortesia"))) == 0


def test_settlement_status_by_date(rows):
    c = F.col
    wrong = rows.where(
        ((c("settlement_date") <= F.lit(dt.date(2001, 7, 1))) & (c("settlement_status") != "repassável"))
        | ((c("settlement_date") > F.lit(dt.date(2001, 7, 1))) & (c("settlement_status") != "futuro"))
    )
    assert count(wrong) == 0
