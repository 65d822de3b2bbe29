"""Physical plan shape: pushdown, pruning, one order context."""

import datetime as dt
import re
import tempfile

import pytest

from pyspark.sql import functions as F

from settlekit import Params, ledger, read_tables, reports
from settlekit.functions.present import FUTURE
from settlekit.plans import views
from settlekit.plans.folded import folded_ledger
from settlekit.sources import adapter, write_tables

from conftest import SF001


@pytest.fixture(scope="module")
def parquet_tables(spark):
    root = tempfile.mkdtemp(prefix="settlekit-test-tables-")
    write_tables(adapter.build(spark, SF001), root)
    return read_tables(spark, root)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def scans(plan: str, table: str) -> list[str]:
    return [line for line in plan.splitlines() if "FileScan parquet" in line and f"/{table}]" in line]


def test_order_filter_reaches_the_scans(spark, parquet_tables):
    df = ledger(parquet_tables, Params(as_of=dt.date(2001, 7, 1), order_ids=[1, 3, 5]))
    plan = plan_of(df)
    # sessions are read twice (with and without a stored card id); both reads get the filter
    session_scans = scans(plan, "checkoutsession")
    assert session_scans and all("In(id" in s for s in session_scans)
    assert any("In(sessionid" in s for s in scans(plan, "checkoutparticipant"))
    assert any("In(sessionId" in s for s in scans(plan, "checkoutproductcomplement"))


def test_purchase_range_reaches_the_session_scan(spark, parquet_tables):
    df = ledger(parquet_tables, Params(as_of=dt.date(2001, 7, 1),
                                       bought_between=(dt.date(1998, 1, 1), dt.date(1998, 1, 31))))
    plan = plan_of(df)
    # the scan text is truncated by Spark, so the upper bound is checked on the optimized plan
    assert any("GreaterThanOrEqual(createdat" in s for s in scans(plan, "checkoutsession"))
    optimized = df._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"createdat#\d+ >= 1998-01-01 03:00", optimized)
    assert re.search(r"createdat#\d+ < 1998-02-01 03:00", optimized)


def test_session_facts_are_read_once(spark, parquet_tables):
    plan = plan_of(ledger(parquet_tables, Params(as_of=dt.date(2001, 7, 1))))
    for table in ["checkoutsummary", "checkoutpayment", "checkoutpaypaldetails"]:
        assert len(scans(plan, table)) == 1, table
    # items are read for the lines, and their order ids alone to find hot orders
    for table in ["checkoutparticipant", "checkoutproductcomplement"]:
        found = scans(plan, table)
        assert 1 <= len(found) <= 3 and any("sessionid" in s.lower() for s in found), table


def test_report_prunes_columns(spark, parquet_tables):
    plan = plan_of(reports.courtesies(ledger(parquet_tables, Params(as_of=dt.date(2001, 7, 1)))))
    (paypal,) = scans(plan, "checkoutpaypaldetails") or [None]
    # the gateway reference is not needed for the report, so no capture id is read
    assert paypal is None or "captureId" not in paypal


def test_small_catalogue_tables_are_broadcast_by_their_size(spark, parquet_tables):
    plan = plan_of(ledger(parquet_tables, Params(as_of=dt.date(2001, 7, 1))))
    assert "BroadcastHashJoin" in plan


@pytest.mark.parametrize("chosen", [{"participant_ids": [101, 102]}, {"editions": ["ASIA"]}, {"event_ids": [1]}, {"extra_ids": [104]}])
def test_item_filters_prune_the_session_facts(spark, parquet_tables, chosen):
    """The sessions and each table of session facts are semi-joined with the orders left."""
    df = ledger(parquet_tables, Params(as_of=dt.date(2001, 7, 1), **chosen))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") >= 5
    assert df._jdf.queryExecution().analyzed().toString().count("_wanted") >= 5


def test_choosing_participants_prunes_the_extras_branch(spark, parquet_tables):
    df = ledger(parquet_tables, Params(as_of=dt.date(2001, 7, 1), participant_ids=[101, 102]))
    plan = plan_of(df)
    assert scans(plan, "checkoutparticipant")
    assert not scans(plan, "checkoutproductcomplement")
    assert any("In(id" in s for s in scans(plan, "checkoutparticipant"))


def joins(plan: str) -> int:
    return plan.count("Join ")


def test_each_item_table_and_the_sessions_are_read_once(spark, parquet_tables):
    """Hot orders and cards are split by AQE: no second read to find them, no union for null cards."""
    plan = plan_of(ledger(parquet_tables, Params(as_of=dt.date(2001, 7, 1))))
    for table in ["checkoutsession", "checkoutparticipant", "checkoutproductcomplement"]:
        assert len(scans(plan, table)) == 1, table
    assert joins(plan) <= 32


@pytest.mark.parametrize("chosen", [{"participant_ids": [101, 102]}, {"extra_ids": [104]}, {"order_ids": [1, 3]}])
def test_chosen_ids_need_no_catalogue_to_find_their_orders(spark, parquet_tables, chosen):
    plan = plan_of(ledger(parquet_tables, Params(as_of=dt.date(2001, 7, 1), **chosen)))
    assert joins(plan) <= 50
    assert len(scans(plan, "event")) <= 2 and len(scans(plan, "checkouteventticketbatchprice")) <= 1


def test_editions_find_their_orders_without_what_has_no_say(spark, parquet_tables):
    df = ledger(parquet_tables, Params(as_of=dt.date(2001, 7, 1), editions=["ASIA"]))
    optimized = df._jdf.queryExecution().optimizedPlan().toString()
    # price types, trades and cancels only in the lines themselves
    assert plan_of(df).count("/eventticketbatchpricetype]") <= 1 and plan_of(df).count("/tradecheckoutsession]") <= 2
    assert optimized.count("LeftSemi") >= 5


def test_settlement_range_bounds_the_session_scan(spark, parquet_tables):
    params = Params(as_of=dt.date(2001, 7, 1), settled_between=(dt.date(1998, 1, 1), dt.date(1998, 1, 31)))
    df = ledger(parquet_tables, params)
    (session,) = scans(plan_of(df), "checkoutsession")
    assert "createdat" in session.split("DataFilters")[1].split("PushedFilters")[0]
    whole = ledger(parquet_tables, Params(as_of=params.as_of))
    inside = whole.where(whole.settlement_date.between(*params.settled_between))
    assert df.count() == inside.count() > 0 and df.exceptAll(inside).isEmpty()


def test_reports_of_a_weighted_ledger_expand_nothing(spark, parquet_tables):
    base = Params(as_of=dt.date(2001, 7, 1))
    weighted, whole = ledger(parquet_tables, base, weighted=True), ledger(parquet_tables, base)
    made = lambda of: {
        "lots": reports.lots(of),
        "producer_totals": reports.producer_totals(of),
        "courtesies": reports.courtesies(of),
        "weekly": reports.weekly(of),
        "reconcile": reports.reconcile(of, parquet_tables),
    }
    assert whole.count() == weighted.selectExpr("sum(copies)").first()[0] > weighted.count()
    expanded = made(whole)
    for name, df in made(weighted).items():
        plan = plan_of(df)
        assert "REBALANCE" not in plan and "_copy" not in plan and "_chunk" not in plan, name
        assert sorted(map(tuple, df.collect()), key=str) == sorted(map(tuple, expanded[name].collect()), key=str), name


@pytest.mark.parametrize(
    "chosen",
    [
        {},
        {"settled_between": (dt.date(1998, 1, 1), dt.date(1998, 3, 31))},
        {"status": FUTURE, "bought_between": (dt.date(1996, 1, 1), dt.date(1998, 1, 31))},
    ],
)
def test_reports_of_a_folded_ledger_equal_those_of_the_ledger(spark, parquet_tables, chosen):
    params = Params(as_of=dt.date(1998, 2, 1), **chosen)
    whole = ledger(parquet_tables, params).persist()
    made = {
        "lots": (reports.lots, reports.LOT),
        "producer_totals": (reports.producer_totals, reports.EVENT),
        "courtesies": (reports.courtesies, reports.EVENT),
        "weekly": (reports.weekly, []),
    }
    for name, (report, keys) in made.items():
        got = report(folded_ledger(parquet_tables, params, keys))
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, report(whole).collect()), key=str), name
        # items are added up below the only explode of a plan
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        below = plan[plan.index("Generate explode(instalment_plan") :]
        assert below.count("Generate explode(instalment_plan") == 1 and "Aggregate [" in below.split("Join")[0], name
    whole.unpersist()


def test_a_folded_ledger_keeps_repeated_dates_and_odd_plans(spark, parquet_tables):
    """A calendar date listed three times, plans with a null number, and instalments without a method."""
    weeks = parquet_tables.weeksarrange
    twice = weeks.unionByName(weeks.where("dayofmonth(data) < 9")).unionByName(weeks.where("dayofmonth(data) < 4"))
    ranges = parquet_tables.installmentsrange.withColumn(
        "installmentsArray", F.when(F.col("installments") == 3, F.lit("[1, null, 2, 3]")).otherwise(F.col("installmentsArray"))
    )
    tables = parquet_tables.with_frames(weeksarrange=twice, installmentsrange=ranges)
    params = Params(as_of=dt.date(1998, 2, 1))
    whole = ledger(tables, params).persist()
    assert whole.where("settlement_date is null").count() > 0
    for report, keys in [(reports.lots, reports.LOT), (reports.producer_totals, reports.EVENT), (reports.weekly, [])]:
        got = report(folded_ledger(tables, params, keys)).collect()
        assert sorted(map(tuple, got), key=str) == sorted(map(tuple, report(whole).collect()), key=str)
    whole.unpersist()


def test_charges_are_looked_up_per_item(spark, parquet_tables):
    """The charge lookup sits below the instalment explode, in the ledger as in the folded one."""
    for df in (ledger(parquet_tables, Params(as_of=dt.date(2001, 7, 1))), folded_ledger(parquet_tables, Params(as_of=dt.date(2001, 7, 1)))):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        explode = plan.index("Generate explode(instalment_plan")
        assert "gk_method" in plan[explode:] and "gk_method" not in plan[:explode]


def above(plan: str, mark: str) -> list[str]:
    """For each line of the plan that reads `mark`: the nearest exchange above it."""
    lines = plan.splitlines()
    exchange = lambda i: next((x for x in reversed(lines[:i]) if "Exchange" in x), "")
    return [exchange(i) for i, line in enumerate(lines) if mark in line]


@pytest.mark.parametrize("chosen", [{}, {"editions": ["ASIA"]}, {"order_ids": [1, 3]}])
def test_tables_that_grow_with_the_checkouts_are_not_broadcast(spark, parquet_tables, chosen):
    """However small the planner takes them for: here a few kilobytes."""
    plan = plan_of(ledger(parquet_tables, Params(as_of=dt.date(2001, 7, 1), **chosen)))
    grow = ["checkouteventticketbatchprice", "eventticketbatchprice", "eventticketbatch", "product", "productsize",
            "productcomplementmanual", "customerpaymentprovidercard"]
    for table in grow:
        found = above(plan, f"/{table}]")
        assert found and not any("BroadcastExchange" in x for x in found), table
    assert any("BroadcastExchange" in x for x in above(plan, "/event]"))


def test_the_calendar_and_parameters_shuffle_no_items(spark, small_tables):
    """Price types, providers, plans, charges and weeks have a few rows; items and instalments stay where they are."""
    plan = plan_of(ledger(small_tables, Params(as_of=dt.date(2001, 7, 1))))
    keys = re.findall(r"Exchange hashpartitioning\((?:lower\()?([a-z_]+)", plan)
    assert keys and not {"settlement_date", "rk_gateway", "type_id", "pay_provider_id", "pay_instalments", "gateway_key"} & set(keys)


def test_a_large_calendar_is_still_broadcast(spark, parquet_tables):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        plan = plan_of(ledger(parquet_tables, Params(as_of=dt.date(2001, 7, 1))))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(settlement_date" not in plan


def test_copies_are_rebalanced_below_the_order_join(spark, parquet_tables):
    """Chunks of copies are dealt out while a row has a few columns, not with every column of the item."""
    df = ledger(parquet_tables, Params(as_of=dt.date(2001, 7, 1)))
    optimized = df._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.count("RebalancePartitions") == 1 and optimized.index("RebalancePartitions") > optimized.index("Union")
    assert df.count() == parquet_count(parquet_tables)


def parquet_count(tables) -> int:
    weighted = ledger(tables, Params(as_of=dt.date(2001, 7, 1)), weighted=True)
    return weighted.selectExpr("sum(copies)").first()[0]


def test_hot_buyers_and_answers_multiply_extras(spark, parquet_tables):
    """A session with 150 buyer rows, one of whose extras has 70 answers: 10,500 rows of it."""
    paid = parquet_tables.checkoutsession.where("status = 'Paid'").select(F.col("id").alias("sessionId"))
    extra = parquet_tables.checkoutproductcomplement.join(paid, "sessionId").orderBy("id").first()
    base = Params(as_of=dt.date(2001, 7, 1), order_ids=[extra.sessionId])
    buyers = spark.range(150).selectExpr(f"{extra.sessionId}L as sessionId").unionByName(spark.sql("select cast(null as long) as sessionId"))
    answers = spark.range(70).selectExpr(f"{extra.id}L as checkoutProductComplementId")
    plain = parquet_tables.checkoutorderproductpartialcancel.limit(0)
    one = parquet_tables.with_frames(
        checkoutbuyer=buyers.limit(0), checkoutproductcomplementanswer=answers.limit(0), checkoutorderproductpartialcancel=plain
    )
    many = one.with_frames(checkoutbuyer=buyers, checkoutproductcomplementanswer=answers)
    of = lambda tables: ledger(tables, base).where(F.col("item_id") == extra.id).count()
    assert of(many) == 150 * 70 * of(one) > 0


def test_all_tables_made_from_lines_share_one_shuffle_of_them(spark, small_tables):
    plan = plan_of(ledger(small_tables, Params(as_of=dt.date(2001, 7, 1))))
    read = {re.sub(r"#\d+L?", "", line.split("FileScan")[1]) for line in plan.splitlines() if "/lineitem.parquet]" in line}
    assert len(read) == 1


def test_equal_lines_are_numbered_once_each(spark, tmp_path):
    """Lines equal in every column that numbers them, and parts and orders that repeat or are null."""
    for name in ("lineitem", "orders", "part", "customer", "nation", "region"):
        df = spark.read.parquet(f"{SF001}/{name}.parquet")
        key = df.columns[0]
        none = df.limit(3).withColumn(key, F.lit(None).cast(df.schema[key].dataType))
        df.unionByName(df.where(F.col(key) % 5 == 0)).unionByName(none).write.parquet(str(tmp_path / f"{name}.parquet"))
    d = adapter.read_driver(spark, str(tmp_path))
    item = adapter.item_view(d["lineitem"], d["part"])
    lines = d["lineitem"].join(d["part"].select("p_partkey"), F.col("l_partkey") == F.col("p_partkey"))
    assert item.count() == lines.count()
    assert item.where("l_orderkey is not null").select("item_id").distinct().count() == lines.where("l_orderkey is not null").count()
    sums = adapter.order_view(d["orders"], item).where("o_orderkey is not null")
    want = item.groupBy("l_orderkey").agg(F.round(F.sum("price"), 2).alias("all"))
    got = sums.join(want, F.col("o_orderkey") == F.col("l_orderkey"))
    assert got.where("abs(tv + pv - all) > 0.011").isEmpty() and got.count() > 0


@pytest.mark.parametrize("name", ["ledger_ordered", "filter_events", "filter_editions", "filter_orders", "filter_status", "gateway_cost", "presented_amounts"])
def test_plans_of_whole_ledgers_do_not_number_the_lines(spark, name):
    """The driver keeps every step that it plans: lines are numbered once, before, and orders chosen once."""
    plan = plan_of(views.VIEWS[name](spark, SF001))
    assert "Window" not in plan and not scans(plan, "lineitem.parquet")
    assert joins(plan) <= 42


@pytest.mark.parametrize("name", ["ledger_ordered", "filter_events", "filter_orders", "filter_status", "gateway_cost", "lots", "instalment_rows"])
def test_plans_of_whole_ledgers_are_made_in_parts(spark, name):
    """No plan holds the joins of all 28 tables: the order context and the catalogues are tables by then."""
    assert joins(plan_of(views.VIEWS[name](spark, SF001))) <= 22


@pytest.mark.parametrize("chosen, weighted", [({}, False), ({}, True), ({"event_ids": views.EVENT_IDS}, False), ({"order_ids": views.ORDER_IDS}, False)])
def test_a_ledger_in_parts_equals_that_of_one_plan(spark, tmp_path, chosen, weighted):
    """Keys that repeat or are null, in every table of the driver."""
    for name in ("lineitem", "orders", "part", "customer", "nation", "region"):
        df = spark.read.parquet(f"{SF001}/{name}.parquet")
        key = df.columns[0]
        odd = df.unionByName(df.limit(9)).unionByName(df.limit(3).withColumn(key, F.lit(None).cast(df.schema[key].dataType)))
        odd.write.parquet(str(tmp_path / f"{name}.parquet"))
    root, params = str(tmp_path), Params(as_of=views.AS_OF, **chosen)
    parts, tables = [], adapter.build(spark, root)

    def keep(df):
        parts.append(views._kept(spark, df, "part"))
        return parts[-1]

    lines = adapter.write_lines(spark, root, str(tmp_path / "lines"))
    valued = adapter.write_orders(spark, root, lines, str(tmp_path / "valued"))
    whole = ledger(tables, params, weighted)
    got = ledger(adapter.build(spark, root, lines, valued).in_parts(keep), params, weighted)
    assert len(parts) == 3 and got.schema == whole.schema and got.count() > 0
    assert got.exceptAll(whole).isEmpty() and whole.exceptAll(got).isEmpty()


@pytest.mark.parametrize("name, chosen", [("filter_events", {"event_ids": views.EVENT_IDS}), ("filter_editions", {"editions": views.EDITIONS}), ("ledger", {})])
def test_written_lines_and_orders_give_the_same_ledger(spark, small_tables, name, chosen):
    whole = ledger(small_tables, Params(as_of=views.AS_OF, **chosen))
    got = views.VIEWS[name](spark, SF001)
    assert got.schema == whole.schema and got.count() > 0
    assert got.exceptAll(whole).isEmpty() and whole.exceptAll(got).isEmpty()


@pytest.mark.parametrize("path", ["empty", "nulls"])
def test_written_lines_are_those_of_the_item_view(spark, tmp_path, path):
    """No line at all, and lines without an order or that repeat."""
    for name in ("lineitem", "orders", "part", "customer", "nation", "region"):
        df = spark.read.parquet(f"{SF001}/{name}.parquet")
        key = df.columns[0]
        odd = df.limit(0) if path == "empty" else df.unionByName(df.limit(9)).unionByName(
            df.limit(3).withColumn(key, F.lit(None).cast(df.schema[key].dataType))
        )
        odd.write.parquet(str(tmp_path / f"{name}.parquet"))
    d = adapter.read_driver(spark, str(tmp_path))
    lines = adapter.item_view(d["lineitem"], d["part"]).select(*adapter.LINE_COLUMNS)
    got = adapter.write_lines(spark, str(tmp_path), str(tmp_path / "lines"))
    assert got.dtypes == lines.dtypes and (got.count() > 0) == (path == "nulls")
    assert got.exceptAll(lines).isEmpty() and lines.exceptAll(got).isEmpty()
    tables = (adapter.build(spark, str(tmp_path), got), adapter.build(spark, str(tmp_path)))
    for name in ("checkoutsummary", "checkoutparticipant", "tradecheckoutsession", "checkoutproductcomplementanswer"):
        a, b = (t[name] for t in tables)
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty(), name


@pytest.mark.parametrize("name", ["ledger_ordered", "filter_events", "filter_orders", "filter_status", "gateway_cost", "lots"])
def test_lines_meet_the_catalogues_as_tables(spark, name):
    """The last plan of a ledger holds no cancel, trade or answer, and the context's numbers no line."""
    plan = plan_of(views.VIEWS[name](spark, SF001))
    assert joins(plan) <= 9 and len(re.findall("FileScan", plan)) <= 10


@pytest.mark.parametrize("chosen, weighted", [({"status": FUTURE}, False), ({}, True), ({"order_ids": views.ORDER_IDS}, False), ({"participant_ids": views.PARTICIPANT_IDS}, False)])
def test_a_ledger_of_written_lines_equals_that_of_one_plan(spark, tmp_path, chosen, weighted):
    """Keys that repeat or are null, in every table of the driver; a branch without a line."""
    for name in ("lineitem", "orders", "part", "customer", "nation", "region"):
        df = spark.read.parquet(f"{SF001}/{name}.parquet")
        key = df.columns[0]
        odd = df.unionByName(df.limit(9)).unionByName(df.limit(3).withColumn(key, F.lit(None).cast(df.schema[key].dataType)))
        odd.write.parquet(str(tmp_path / f"{name}.parquet"))
    params, lines = Params(as_of=dt.date(1998, 2, 1), **chosen), []
    tables = adapter.build(spark, str(tmp_path))

    def keep_lines(df):
        lines.append(views._kept(spark, df, "lines"))
        return lines[-1]

    whole = ledger(tables, params, weighted)
    got = ledger(tables.in_parts(lambda df: views._kept(spark, df, "part"), keep_lines), params, weighted)
    assert len(lines) == 2 and got.schema == whole.schema and got.count() > 0
    assert got.exceptAll(whole).isEmpty() and whole.exceptAll(got).isEmpty()
