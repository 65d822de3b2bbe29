"""Golden rows G1-G4 (FIXTURES.md §4), worked out by hand from the rules."""

import datetime as dt

import pytest

from settlekit import Params, ledger
from settlekit.functions.present import LEDGER_COLUMNS

from tables_builder import golden_tables

AS_OF = dt.date(2024, 1, 5)


@pytest.fixture(scope="module")
def rows(spark):
    df = ledger(golden_tables(spark), Params(as_of=AS_OF))
    assert df.columns == LEDGER_COLUMNS
    out = {}
    for r in df.collect():
        out.setdefault(r["item_id"], []).append(r.asDict())
    for v in out.values():
        v.sort(key=lambda r: r["instalment_no"])
    return out


def approx(x):
    return pytest.approx(x, abs=5e-7)


def test_g1_card_ticket(rows):
    g1 = rows[10]
    assert len(g1) == 3
    assert [r["settlement_date"] for r in g1] == [dt.date(2024, 1, 1), dt.date(2024, 1, 4), dt.date(2024, 1, 9)]
    assert [r["settlement_status"] for r in g1] == ["repassável", "repassável", "futuro"]
    assert [r["instalment_no"] for r in g1] == [1, 2, 3]
    for r in g1:
        assert r["purchase_date"] == dt.date(2023, 12, 31)
        assert r["instalment_count"] == 3
        assert r["item_fraction"] == approx(1 / 3)
        assert r["list_price"] == 100.0
        assert (r["item_status"], r["item_status_detail"]) == ("aprovado", "aprovado")
        assert r["gross_amount"] == approx(33.333333)
        assert r["discount_amount"] == approx(6.666667)
        assert r["net_amount"] == approx(26.666667)
        assert r["instalment_amount"] == approx(32.666667)
        assert r["platform_convenience"] == approx(3.333333)
        assert r["platform_interest"] == approx(1.0)
        assert r["platform_freight"] == 0.0
        assert r["producer_items"] == approx(26.666667)
        assert r["platform_issue_fixed"] == 0.0
        assert r["refund_cover_amount"] == approx(1.666667)
        assert r["platform_refund_cover"] == approx(0.5)
        assert r["producer_refund_cover"] == approx(1.166667)
        assert r["gateway_cost"] == approx(1.18)
        assert r["race_group"] == "10k"
        assert r["card_brand"] == "visa"
        assert r["gateway"] == "Pagarme"
    assert [r["platform_issue_pct"] for r in g1] == [approx(8.0), 0.0, 0.0]
    assert [r["producer_total"] for r in g1] == [approx(19.833333), approx(27.833333), approx(27.833333)]
    assert [r["settlement_week"] for r in g1] == ["2024-01-01", "2024-01-01", "2024-01-08"]


def test_g2_courtesy(rows):
    (g2,) = rows[20]
    assert g2["payment_method"] == "Cortesia"
    assert g2["card_brand"] == "Cortesia"
    assert g2["gateway"] == "Cortesia"
    assert g2["purchase_date"] == g2["settlement_date"] == dt.date(2024, 1, 1)
    assert g2["settlement_status"] == "repassável"
    assert (g2["instalment_count"], g2["instalment_no"]) == (0, 0)
    assert g2["item_fraction"] == 1.0
    assert g2["list_price"] == 0.0
    assert (g2["gross_amount"], g2["discount_amount"], g2["net_amount"]) == (0.0, 0.0, 0.0)
    assert g2["instalment_amount"] == 0.0
    assert g2["producer_items"] == 0.0
    assert g2["platform_issue_pct"] == 0.0
    assert g2["platform_issue_fixed"] == 5.0
    assert g2["producer_total"] == -5.0
    assert g2["gateway_cost"] == 0.0


def test_g3_received_transfer(rows):
    (g3,) = rows[30]
    assert (g3["item_status"], g3["item_status_detail"]) == ("recebido", "Troca de Titularidade (para)")
    assert g3["list_price"] == 25.0
    assert (g3["gross_amount"], g3["discount_amount"], g3["net_amount"]) == (0.0, 0.0, 0.0)
    assert g3["instalment_amount"] == 0.0
    assert g3["transfer_amount"] == 25.0
    assert g3["platform_transfer"] == approx(10.0)
    assert g3["producer_transfer"] == approx(15.0)
    assert g3["producer_total"] == approx(15.0)
    assert g3["gateway_cost"] == 0.0


def test_g4_extra(rows):
    (g4,) = rows[40]
    assert g4["race_group"] == "extra"
    assert g4["category"] == "extra"
    assert g4["list_price"] == 50.0
    assert (g4["gross_amount"], g4["discount_amount"], g4["net_amount"]) == (50.0, 0.0, 50.0)
    assert g4["instalment_amount"] == 50.0
    assert g4["platform_freight"] == 7.5
    assert g4["producer_items"] == 50.0
    assert g4["platform_issue_pct"] == approx(2.5)
    assert g4["producer_total"] == approx(47.5)
    assert g4["gateway_cost"] == 0.0
    assert g4["linked_item_id"] is None
