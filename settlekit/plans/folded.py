"""The ledger folded below its instalment explode: what the reports P01-P04 add up.

An item's amounts are the same for all its instalments, but for the issue charges, which only ask
whether an instalment is the first, a later one or has no number. So items are added up first, per
report key, purchase date, payment method and instalment plan, with one sum for each of these three
cases; the explode, the settlement date and class and the week calendar then meet groups (days x
methods x plans x report keys) and no items. A group's rows stand for `copies` ledger rows, and its
`*_units` are the sums of an amount over them in whole units: totals are those of the ledger, digit
for digit.

A gateway charge that repeats still repeats its item, before the sums; a date that the calendar
lists twice still repeats the instalment, after them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import instalment as I
from ..functions.money import units
from ..functions.present import presented, settlement_status
from ..operators.calendar import attach_week
from ..operators.filters import Params, apply, between
from ..operators.gateway import attach_charge_rate, with_gateway_cost
from ..sources import Tables
from .ledger import chosen_rows, item_rows

#: Amounts that are the same for each instalment of an item.
EVEN = ("instalment_amount", "gateway_cost")
#: Amounts that ask for the instalment's number.
UNEVEN = ("producer_total", "platform_issue_fixed")
#: A number of each case that the issue charges tell apart.
CASES = {"first": 1, "later": 2, "unnumbered": None}


def folded_ledger(tables: Tables, params: Params | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """`keys` (item-level columns of the ledger), payment_method, purchase_date, item_fraction,
    settlement_date, settlement_status, settlement_week, copies, and the sums `<amount>_units` of
    `EVEN` and `UNEVEN`. Building the plan starts no Spark job."""
    params, c = params or Params(), F.col
    n = c("instalments")
    items = apply(item_rows(tables, params, weighted=True), between(c("purchase_date"), params.bought_between))
    items = items.select("*", *[v.alias(k) for k, v in I.instalment_amounts(n).items()])
    items = items.select("*", *[v.alias(k) for k, v in I.revenue_splits().items()])
    items = with_gateway_cost(attach_charge_rate(items, tables))

    shown = presented()
    sums = {"copies": F.sum("copies"), **{name: F.sum(units(shown.get(name, c(name))) * c("copies")) for name in EVEN}}
    for case, number in CASES.items():
        charges = I.issue_charges(F.lit(number).cast("int"))
        amounts = {"producer_total": I.producer_total(charges), "platform_issue_fixed": charges["platform_issue_fixed"]}
        sums |= {f"{name}_{case}": F.sum(units(amounts[name]) * c("copies")) for name in UNEVEN}
    by = dict.fromkeys([*keys, "payment_method"])  # in order, each once
    groups = items.groupBy(
        *[shown.get(k, c(k)).alias(k) for k in by], "purchase_date", "instalments", "instalment_plan"
    ).agg(*[v.alias(k) for k, v in sums.items()])

    rows = groups.select("*", F.explode("instalment_plan").alias("plan_k")).drop("instalment_plan")
    rows = rows.withColumn("seq", I.instalment_seq(c("payment_method"), c("plan_k")))
    case = lambda name: F.when(c("seq") <= 1, c(f"{name}_first")).when(c("seq") > 1, c(f"{name}_later")).otherwise(c(f"{name}_unnumbered"))
    rows = rows.select(
        *by,
        "purchase_date",
        I.item_fraction(n).alias("item_fraction"),
        I.settlement_date(c("purchase_date"), c("payment_method"), c("plan_k"), params.settlement_days).alias("settlement_date"),
        "copies",
        *[c(name).alias(f"{name}_units") for name in EVEN],
        *[case(name).alias(f"{name}_units") for name in UNEVEN],
    )
    rows = attach_week(rows, tables)
    rows = rows.select("*", settlement_status(c("settlement_date"), params.as_of).alias("settlement_status"))
    return chosen_rows(rows, params)
