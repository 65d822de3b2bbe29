"""The written-ledger job, the ordered ledger and the display names."""

import datetime as dt
import os
from urllib.parse import quote
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from settlekit import Params, display_names, ledger, ordered
from settlekit.functions.present import LEDGER_COLUMNS
from settlekit.plans import jobs, reports
from settlekit.sources import TABLE_NAMES, Tables

from tables_builder import golden_tables


PARAMS = Params(as_of=dt.date(2001, 7, 1))


def test_reports_from_written_ledger_match_direct(spark, small_tables, tmp_path):
    out = jobs.run(small_tables, PARAMS, str(tmp_path))
    direct = reports.weekly(ledger(small_tables, PARAMS))
    cols = sorted(direct.columns)
    assert out["weekly"].select(cols).exceptAll(direct.select(cols)).count() == 0
    assert out["lots"].count() == reports.lots(ledger(small_tables, PARAMS)).count()
    written = jobs.write_ledger(small_tables, PARAMS, str(tmp_path / "again"), by_week=False)
    assert written.count() == ledger(small_tables, PARAMS).count()


def test_written_ledger_keeps_types(spark, small_tables, tmp_path):
    df = ledger(small_tables, PARAMS)
    for by_week in (True, False):
        assert jobs.write_ledger(small_tables, PARAMS, str(tmp_path / str(by_week)), by_week).dtypes == df.dtypes


def test_a_hot_week_is_written_by_many_tasks(spark, small_tables, tmp_path):
    one_week = small_tables.with_frames(weeksarrange=small_tables.weeksarrange.withColumn("semana", F.lit("hot")))
    sizes = ["spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.minPartitionSize"]
    for size in sizes:  # as if the rows were many
        spark.conf.set(size, "64k")
    try:
        jobs.write_ledger(one_week, PARAMS, str(tmp_path / "hot"))
    finally:
        for size in sizes:
            spark.conf.unset(size)
    files = list((tmp_path / "hot").glob("settlement_week=hot/*.parquet"))
    assert len(files) > 1


def test_ordered_is_newest_first(spark, small_tables):
    ids = [r[0] for r in ordered(ledger(small_tables, PARAMS)).select("order_id").collect()]
    assert ids == sorted(ids, reverse=True)


def test_display_names(spark, small_tables):
    headings = {"item_id": "item", "order_id": "order no."}
    df = display_names(ledger(small_tables, PARAMS).limit(1), headings)
    assert df.columns == ["item", "order no.", *LEDGER_COLUMNS[2:]] and len(df.columns) == 47


def test_no_job_runs_before_an_action(spark, small_tables):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plan only", "ledger and reports without an action")
    df = ledger(small_tables, Params(as_of=dt.date(2001, 7, 1), order_ids=[1]))
    ordered(ledger(small_tables, PARAMS))
    for report in jobs.report_all(df, small_tables).values():
        assert report.columns
    assert not tracker.getJobIdsForGroup("plan only")
    spark.sparkContext.setJobGroup("other", "")


def test_replaced_tables_are_used(spark):
    """A table set keeps nothing of the tables that it replaces, for each of the 28."""
    tables = golden_tables(spark)
    for name in TABLE_NAMES:
        other = tables[name].limit(0)
        replaced = tables.with_frames(**{name: other})
        assert replaced[name].sameSemantics(other.select(*other.columns))
        assert all(replaced[n].sameSemantics(tables[n]) for n in TABLE_NAMES if n != name)
    before = ledger(tables, PARAMS).collect()
    answers = spark.createDataFrame([(40,)] * 3, tables.checkoutproductcomplementanswer.schema)
    dear = tables.gatecharges.withColumn("chargeAmount", F.when(F.col("chargeType") == "percent", 0.5).otherwise(F.col("chargeAmount")))
    after = ledger(tables.with_frames(checkoutproductcomplementanswer=answers, gatecharges=dear), PARAMS).collect()
    assert [sum(r.item_id == 40 for r in rows) for rows in (before, after)] == [1, 3]
    low, high = (sum(r.gateway_cost for r in rows if r.item_id == 10) for rows in (before, after))
    assert high > 10 * low


def test_reports_count_whole_items_and_show_no_false_gap(spark, small_tables):
    rows = ledger(small_tables, PARAMS).cache()
    whole = {}
    for r in rows.collect():
        key = (r.edition, r.event, r.item_name, r.item_type, r.list_price)
        whole[key] = whole.get(key, 0) + Fraction(1, round(1 / r.item_fraction))
    for r in reports.lots(rows).collect():
        exact = whole[(r.edition, r.event, r.item_name, r.item_type, r.list_price)]
        assert abs(r.items_sold - float(exact)) < 1e-6
        assert exact.denominator > 1 or r.items_sold == exact
    sums = {r.order_id: r.s for r in rows.groupBy("order_id").agg(F.sum("instalment_amount").alias("s")).collect()}
    gaps = reports.reconcile(rows, small_tables).collect()
    equal = [r for r in gaps if r.order_total is not None and sums[r.order_id] is not None and abs(sums[r.order_id] - r.order_total) < 1e-8]
    assert equal and all(r.difference == 0 for r in equal)
    rows.unpersist()


def test_checkpoint_dir_is_read_from_the_session(spark):
    from settlekit.session import checkpoint_dir

    configured = spark.conf.get("spark.checkpoint.dir")
    assert checkpoint_dir(spark) == configured


def test_a_cluster_without_a_shared_folder_is_refused(monkeypatch):
    from settlekit import session

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"
        getConf = lambda self: Conf()
        getCheckpointDir = lambda self: None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        session.checkpoint_dir(Session())


def _same(one, other):
    rows = lambda df: sorted((tuple(r) for r in df.select(sorted(df.columns)).collect()), key=str)
    return rows(one) == rows(other)


def test_week_sums_read_only_the_weeks_that_changed(spark, small_tables, tmp_path):
    path, sums = f"{tmp_path}/ledger", f"{tmp_path}/sums"
    written = jobs.write_ledger(small_tables, PARAMS, path)
    jobs.update_week_sums(written, sums)
    found = jobs.reports_of_week_sums(spark, sums, written)
    for name, df in jobs.report_all(written, small_tables).items():
        assert name == "reconcile" or _same(found[name], df), name

    # one week loses some rows, another all, and those without a week are read again
    counts = {r[0]: r[1] for r in written.groupBy("settlement_week").count().collect() if r[0] is not None}
    less, gone = sorted(counts, key=counts.get)[-2:]
    kept = written.where(F.col("settlement_week") == less).where("order_id % 2 = 0").drop("settlement_week").collect()
    schema = written.drop("settlement_week").schema
    folder = lambda week: next(d for d in os.scandir(path) if d.name == f"settlement_week={quote(week, safe=' -')}").path
    spark.createDataFrame(kept, schema).coalesce(1).write.mode("overwrite").parquet(folder(less))
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(folder(gone))
    written = spark.read.schema(written.schema).parquet(path).select(*written.columns)
    changed = [less, gone, None]
    files = jobs._of_weeks(written, changed).select(F.input_file_name()).distinct().count()
    assert files < written.select(F.input_file_name()).distinct().count() / 4

    jobs.update_week_sums(written, sums, changed)
    found = jobs.reports_of_week_sums(spark, sums, written)
    for name, df in jobs.report_all(written, small_tables).items():
        assert name == "reconcile" or _same(found[name], df), name
    assert found["weekly"].where(F.col("settlement_week") == gone).isEmpty()
