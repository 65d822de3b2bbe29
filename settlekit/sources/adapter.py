"""Derive the 28 checkout tables from the driver's TPC-H-like tables.

The project has no checkout data of its own, so tests and benchmarks map ``lineitem``,
``orders``, ``part``, ``customer``, ``nation`` and ``region`` onto the checkout schema with
fixed rules (FIXTURES.md §0-1). The DuckDB oracle applies the same rules in SQL, so both
engines see identical inputs. Everything here is a distributed DataFrame job; the only
driver-side rows are the four tiny parameter tables whose contents are fixed values.
"""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..operators.skew import shuffled
from .schemas import SCHEMAS
from .tables import Tables

# ---- fixed values of the fixture rules (FIXTURES.md §1) -----------------------------------
PRICE_TYPES = [(0, "inteira"), (1, "meia"), (2, "idoso"), (3, "assessoria")]
PAYMENT_PROVIDERS = [(1, "Pagarme"), (2, "Stone")]
# instalment plans 1..10 and 12; 11 is left out on purpose (the "missing plan" case)
INSTALMENT_PLANS = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12]
# the plan of 7 has an instalment without a number
NULL_PLAN = (7, "[1,2,null,4,5,6,7]")
CHARGE_GATEWAYS = ["Pagarme", "Stone"]
CHARGE_BRANDS = ["visa", "Master", "elo", "hipercard", "Amex"]
CHARGE_FLAT_METHODS = ["Pix", "boleto"]
CHARGE_EXTRA_ROWS = [
    ("PayPal", 1, "PayPal", "PayPal", 1, "percent", 0.045),
    ("Pagarme", 0, "CreditCard", "all", 0, "fixed", 0.5),
    ("Pagarme", 0, "antifraude", "all", 0, "fixed", 0.4),
    ("Pagarme", 0, "boleto", "all", 0, "fixed", 3.0),
    ("PayPal", 0, "PayPal", "all", 0, "fixed", 0.6),
    # a key that repeats in another case, and a fixed charge in another case
    ("pagarme", 1, "CREDITCARD", "VISA", 3, "percent", 0.05),
    ("PAGARME", 0, "Antifraude", "all", 0, "FIXED", 0.1),
]
#: What the checkout tables need of a numbered line.
LINE_COLUMNS = ["l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "price", "item_id", "kind"]
# --------------------------------------------------------------------------------------------


def _fixed(spark: SparkSession, name: str, rows: list[tuple]) -> DataFrame:
    """A parameter table with fixed rows, as a local relation: the planner knows that it is tiny."""
    schema = SCHEMAS[name]
    columns = [pa.array(list(values), to_arrow_type(f.dataType)) for values, f in zip(zip(*rows), schema.fields)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, names=schema.names), schema)


def _cast(df: DataFrame, name: str) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMAS[name].fields])


def _str(c: Column) -> Column:
    return c.cast("string")


def _cents(scale: float, c: Column) -> Column:
    """``floor(scale * c + 0.5) / 100``: rounding both engines agree on."""
    return F.floor(F.lit(scale) * c + F.lit(0.5)) / F.lit(100.0)


def read_driver(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    names = ["lineitem", "orders", "part", "customer", "nation", "region"]
    return {n: spark.read.parquet(os.path.join(sf_dir, f"{n}.parquet")) for n in names}


def item_view(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """One row per order line with a unique ``item_id`` and its kind (ticket or extra).

    The last two columns only tell apart lines that are equal in the others; with them every table
    made from lines needs the same columns of them, so all share one shuffle of the lines."""
    order = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "price"
    )
    lines = lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_returnflag"
    )
    prices = part.select("p_partkey", F.col("p_retailprice").alias("price"))
    return (
        lines.join(shuffled(prices), lines.l_partkey == prices.p_partkey)
        .withColumn("item_id", F.col("l_orderkey") * 100 + F.row_number().over(order))
        .withColumn("kind", F.when(F.col("l_linenumber") % 4 == 0, "extra").otherwise("ticket"))
    )


def order_view(orders: DataFrame, item: DataFrame) -> DataFrame:
    """Orders with their ticket and extra values and the payment option of the fixture."""
    # an item id (null without an order): the values come from the shuffle that numbers the items
    values = item.where(F.col("item_id").isNotNull()).groupBy(F.col("l_orderkey").alias("ok")).agg(
        F.round(F.sum(F.when(F.col("kind") == "ticket", F.col("price")).otherwise(0.0)), 2).alias("tv"),
        F.round(F.sum(F.when(F.col("kind") == "extra", F.col("price")).otherwise(0.0)), 2).alias("pv"),
    )
    key = F.col("o_orderkey")
    prio = F.col("o_orderpriority")
    opt = (
        F.when((prio == "5-LOW") & (key % 3 == 0), F.lit(None).cast("string"))
        .when(prio.isin("1-URGENT", "2-HIGH", "3-MEDIUM"), "CreditCard")
        .when(prio == "4-NOT SPECIFIED", "Pix")
        .when(key % 3 == 1, "PayPal")
        .otherwise("boleto")
    )
    return (
        orders.join(values, orders.o_orderkey == values.ok, "left")
        .select(
            "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate",
            F.coalesce("tv", F.lit(0.0)).alias("tv"),
            F.coalesce("pv", F.lit(0.0)).alias("pv"),
            opt.alias("opt"),
        )
    )


def summary_view(ord_: DataFrame) -> DataFrame:
    key, tv, pv, opt = F.col("o_orderkey"), F.col("tv"), F.col("pv"), F.col("opt")
    return ord_.select(
        key.alias("sid"), opt, tv, pv,
        F.when(key % 101 == 0, tv + 1000.0)
        .when(key % 53 == 0, tv + 1.0)
        .when(key % 4 == 0, _cents(10.0, tv))
        .otherwise(0.0).alias("discount"),
        F.when(opt == "CreditCard", _cents(2.0, tv)).otherwise(0.0).alias("interest"),
        F.when(pv > 0, 15.0).otherwise(0.0).alias("freight"),
        _cents(8.0, tv).alias("tax"),
        F.when(key % 6 == 0, _cents(5.0, tv)).otherwise(0.0).alias("insurance"),
        F.when(key % 43 == 0, F.lit(None).cast("double"))
        .when(key % 41 == 5, 25.0)
        .otherwise(0.0).alias("transfer"),
    )


def _mod_case(key: Column, modulus: int, values: list) -> Column:
    """``case key % modulus when 0 then values[0] when 1 then values[1] ...`` (None = no arm)."""
    out = None
    for i, value in enumerate(values):
        if value is None:
            continue
        out = F.when(key % modulus == i, value) if out is None else out.when(key % modulus == i, value)
    return out


def _repeat(df: DataFrame, which: Column) -> DataFrame:
    """``df`` with the rows where ``which`` holds twice: keys that repeat (FIXTURES.md §1)."""
    return df.withColumn("_copy", F.explode(F.when(which, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_copy")


def write_lines(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    """The numbered lines of :func:`item_view`, less the columns that no table needs, written to ``path``."""
    d = read_driver(spark, sf_dir)
    lines = item_view(d["lineitem"], d["part"]).select(*LINE_COLUMNS)
    lines.write.parquet(path)
    return spark.read.schema(lines.schema).parquet(path)


def write_orders(spark: SparkSession, sf_dir: str, lines: DataFrame, path: str) -> DataFrame:
    """The orders of :func:`order_view` with the values of their ``lines``, written to ``path``."""
    valued = order_view(read_driver(spark, sf_dir)["orders"], lines)
    valued.write.parquet(path)
    return spark.read.schema(valued.schema).parquet(path)


def build(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None, valued: DataFrame | None = None) -> Tables:
    """The 28 checkout tables derived from the driver tables under ``sf_dir``.

    Nine of them come from the numbered lines. Each holds the joins and the window that number them,
    unless the caller has them as a table (``lines``, of :func:`write_lines`). Five come from the orders
    and the values of their lines (``valued``, of :func:`write_orders`)."""
    d = read_driver(spark, sf_dir)
    part, orders, customer, nation, region = d["part"], d["orders"], d["customer"], d["nation"], d["region"]
    item = item_view(d["lineitem"], part) if lines is None else lines
    ord_ = order_view(orders, item) if valued is None else valued
    summ = summary_view(ord_)
    key = F.col("o_orderkey")
    t: dict[str, DataFrame] = {}

    t["checkoutsession"] = _cast(ord_.select(
        key.alias("id"),
        (F.col("o_orderdate") + F.make_dt_interval(hours=(key % 24).cast("int"))).alias("createdat"),
        F.when(F.col("o_orderstatus") == "P", "Pending").otherwise("Paid").alias("status"),
        F.concat(F.lit("or_"), _str(key)).alias("providerOrderId"),
        F.when(F.col("opt") == "CreditCard", F.concat(F.lit("card_"), _str(F.col("o_custkey"))))
        .alias("providerCardId"),
    ), "checkoutsession")

    s = F.col("sid")
    t["checkoutsummary"] = _cast(_repeat(summ, s % 211 == 0).select(
        s.alias("sessionid"),
        F.when(s % 67 == 0, F.lit(None).cast("double"))
        .otherwise(F.col("tv") + F.col("pv") + F.col("tax") + F.col("interest") + F.col("freight")
                   + F.col("insurance") - F.col("discount")).alias("totalAmount"),
        F.col("tv").alias("ticketsValue"), F.col("pv").alias("productsValue"),
        "discount", "interest", "freight", "tax",
        F.col("insurance").alias("ticketInsurance"), F.col("transfer").alias("ticketTransfer"),
    ), "checkoutsummary")

    opt = F.col("opt")
    t["checkoutpayment"] = _cast(_repeat(ord_.where(opt.isNotNull()), key % 223 == 0).select(
        key.alias("sessionid"),
        opt.alias("paymentOption"),
        F.when(key % 97 == 0, F.lit(None))
        .when(key % 109 == 0, 0)
        .when(opt == "CreditCard", 1 + key % 12)
        .when(key % 71 == 0, 2)
        .otherwise(1).alias("installments"),
        F.when(key % 89 == 0, F.lit(None)).otherwise(1 + key % 2).alias("paymentProviderId"),
        _mod_case(key, 5, ["visa", "elo"]).alias("cardBrand"),
        _mod_case(key, 8, ["******", "411111", "222100", "506700", "606282", "371449", "981234"])
        .alias("cardFirstSixDigits"),
    ), "checkoutpayment")

    t["checkoutpaypaldetails"] = _cast(_repeat(ord_.where(opt == "PayPal"), key % 10 == 0).select(
        key.alias("sessionId"), F.concat(F.lit("cap_"), _str(key)).alias("captureId")
    ), "checkoutpaypaldetails")

    c = F.col("c_custkey")
    cards = customer.where(c % 9 != 7).select(c, F.lit(0).alias("dup")).unionByName(
        customer.where(c % 10 == 0).select(c, F.lit(1).alias("dup"))
    )
    t["customerpaymentprovidercard"] = _cast(cards.select(
        F.concat(F.lit("card_"), _str(c)).alias("cardId"),
        F.when(F.col("dup") == 1, "555555").otherwise(
            _mod_case(c, 7, ["******", "411111", "545454", "636368", "384100", "341111"])
        ).alias("first_six_digits"),
        _mod_case(c, 8, ["mastercard", "visa", "elo", None, "hipercard", "amex", None, "diners"])
        .alias("brand"),
    ), "customerpaymentprovidercard")

    t["checkoutbuyer"] = _cast(_repeat(ord_, key % 7 == 0).select(key.alias("sessionId")), "checkoutbuyer")

    iid = F.col("item_id")
    tickets = item.where(F.col("kind") == "ticket")
    extras = item.where(F.col("kind") == "extra")
    returned = F.col("l_returnflag") == "R"
    t["checkoutparticipant"] = _cast(tickets.select(
        iid.alias("id"), F.col("l_orderkey").alias("sessionid"),
        (F.col("l_partkey") + 1000000).alias("checkoutEventTicketBatchPriceId"),
    ), "checkoutparticipant")
    t["checkoutorderticketpartialcancel"] = _cast(_repeat(tickets.where(returned & (iid % 5 < 3)), iid % 11 == 0).select(
        iid.alias("participantId"),
        _mod_case(iid, 5, ["Troca de Titularidade", "Cancelamento Reembolsável"])
        .otherwise("Desistência").alias("reason"),
    ), "checkoutorderticketpartialcancel")
    t["tradecheckoutsession"] = _cast(_repeat(tickets.where(returned & (iid % 5 == 0)), iid % 3 == 0).select(
        iid.alias("originalParticipantId"), (iid + 1).alias("participantId"),
        F.lit(25.0).alias("transferValue"),
        F.when(F.col("l_linenumber") % 2 == 0, "Pending").otherwise("Paid").alias("status"),
    ), "tradecheckoutsession")

    p = F.col("p_partkey")
    t["checkouteventticketbatchprice"] = _cast(part.select(
        (p + 1000000).alias("id"), p.alias("eventTicketBatchPriceId")
    ), "checkouteventticketbatchprice")
    t["eventticketbatchprice"] = _cast(part.select(
        p.alias("id"), F.col("p_retailprice").alias("price"), (F.col("p_size") % 4).alias("typeid"),
        p.alias("ticketBatchId"),
    ), "eventticketbatchprice")
    t["eventticketbatchpricetype"] = _fixed(spark, "eventticketbatchpricetype", PRICE_TYPES)
    t["eventticketbatch"] = _cast(part.select(p.alias("id"), (p % 200).alias("ticketId")), "eventticketbatch")

    tid = F.col("id")
    ticket_ids = part.select((p % 200).alias("id")).distinct()
    t["eventticket"] = _cast(ticket_ids.select(
        tid, F.concat(F.lit("ticket "), _str(tid)).alias("name"), (tid % 25).alias("eventid")
    ), "eventticket")
    t["eventticketcomplement"] = _cast(_repeat(ticket_ids, tid == 5).select(
        tid.alias("ticketid"),
        F.when(tid % 13 == 0, "extra").when(tid % 29 == 1, "servico").otherwise("ticket").alias("category"),
        F.concat(_str(5 * (1 + tid % 4)), F.lit("k")).alias("nameparsed"),
        _mod_case(tid, 3, [0.0, 7.0]).alias("emissionChargePercent"),
        _mod_case(tid, 4, [0.0, 3.5]).alias("emissionChargeFixed"),
        _mod_case(tid, 5, [0.0, 40.0]).alias("comissionSecurityPerc"),
        _mod_case(tid, 6, [0.0, 60.0]).alias("transferPercent"),
    ), "eventticketcomplement")

    n = F.col("n_nationkey")
    t["event"] = _cast(nation.select(
        n.alias("id"), F.col("n_name").alias("title"), (F.lit(8.0) + n % 5).alias("taxaevent"),
        F.lit(25.0).alias("ticketTransferValue"),
    ), "event")
    t["eventcomplement"] = _cast(
        _repeat(nation.join(region, region.r_regionkey == nation.n_regionkey).where(n != 24), n == 3).select(
            n.alias("eventid"), F.col("r_name").alias("globalevent"),
            F.lit(5.0).alias("emissionChargePercent"), F.lit(2.0).alias("emissionChargeFixed"),
            F.lit(30.0).alias("comissionSecurityPerc"), F.lit(50.0).alias("transferPercent"),
            F.lit(1.0).alias("rebateTax"), F.lit(6.0).alias("taxRate"),
            F.lit(4.0).alias("productChargePercent"), F.lit(1.0).alias("productChargeFixed"),
        ), "eventcomplement")

    plans = [(k, "[" + ",".join(str(i) for i in range(1, k + 1)) + "]") for k in INSTALMENT_PLANS]
    plans = [plan for plan in plans if plan[0] != NULL_PLAN[0]] + [NULL_PLAN]
    t["installmentsrange"] = _fixed(spark, "installmentsrange", plans)
    t["paymentprovider"] = _fixed(spark, "paymentprovider", PAYMENT_PROVIDERS)
    charges = [
        (g, 1, "CreditCard", b, k, "percent", 0.02 + 0.001 * k)
        for g in CHARGE_GATEWAYS for b in CHARGE_BRANDS for k in range(1, 13)
    ]
    charges += [(g, 1, m, m, 1, "percent", 0.01) for g in CHARGE_GATEWAYS for m in CHARGE_FLAT_METHODS]
    charges += CHARGE_EXTRA_ROWS
    t["gatecharges"] = _fixed(spark, "gatecharges", charges)

    t["checkoutproductcomplement"] = _cast(extras.select(
        iid.alias("id"), F.col("l_orderkey").alias("sessionId"), F.col("l_partkey").alias("productId"),
        (F.col("l_partkey") % 50).alias("modelId"), F.col("l_partkey").alias("sizeId"),
    ), "checkoutproductcomplement")
    t["product"] = _cast(part.select(p.alias("id"), F.col("p_name").alias("title"), (p % 25).alias("eventId")), "product")
    model_ids = part.select((p % 50).alias("id")).distinct()
    t["productmodel"] = _cast(model_ids.select(tid, F.concat(F.lit("model "), _str(tid)).alias("name")), "productmodel")
    t["productsize"] = _cast(part.select(p.alias("id"), F.col("p_retailprice").alias("price")), "productsize")
    t["productcomplementmanual"] = _cast(_repeat(part, p % 50 == 7).select(
        p.alias("productId"),
        F.when(p % 20 == 0, "ticket").otherwise("extra").alias("category"),
        _mod_case(p, 3, [0.0, 10.0]).alias("productChargePercent"),
        _mod_case(p, 4, [0.0, 1.5]).alias("productChargeFixed"),
    ), "productcomplementmanual")
    t["checkoutorderproductpartialcancel"] = _cast(_repeat(extras.where(returned & (iid % 5 < 3)), iid % 11 == 0).select(
        iid.alias("checkoutProductComplementId"),
        _mod_case(iid, 5, ["Troca de Titularidade", "another option"]).otherwise("Desistência").alias("reason"),
    ), "checkoutorderproductpartialcancel")
    t["checkoutproductcomplementanswer"] = _cast(
        extras.select(iid.alias("checkoutProductComplementId")).unionAll(
            extras.where(F.col("l_returnflag") == "A").select(iid.alias("checkoutProductComplementId"))
        ), "checkoutproductcomplementanswer")

    days = orders.select(F.col("o_orderdate").cast("date").alias("d")).distinct()
    t["weeksarrange"] = _cast(_repeat(days, F.dayofmonth("d") == 15).select(
        F.col("d").alias("data"), _str(F.trunc("d", "week")).alias("semana")
    ), "weeksarrange")

    return Tables(t)
