"""O01 as files: ranges by sampled bounds, read back without a sort."""

import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F

from settlekit import Params, ledger, ordered
from settlekit.plans import order, views

PARAMS = Params(as_of=dt.date(2001, 7, 1))
KEYS = ["order_id", "item_id", "instalment_no", "settlement_date"]


def in_order(row):
    """The sort key of O01 in Python."""
    first = lambda v: (v is not None, v)
    return (row[0] is None, -(row[0] or 0), first(row[1]), first(row[2]), first(row[3]))


@pytest.fixture(scope="module")
def written(spark, small_tables, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("ledger"))
    ledger(small_tables, PARAMS).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def path(written, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("ordered"))
    order.write_ordered(written, path, 7)
    return path


def test_files_hold_all_rows_in_the_order_of_the_sorted_ledger(spark, written, path):
    got = spark.read.parquet(path)
    assert got.exceptAll(written).isEmpty() and got.count() == written.count()
    placed = [tuple(r)[1:] for r in order.positions(spark, path).select("position", *KEYS).orderBy("position").collect()]
    assert placed == [tuple(r) for r in ordered(written).select(KEYS).collect()]
    assert placed == sorted(placed, key=in_order)


def test_positions_number_all_rows_once(spark, written, path):
    found = sorted(r.position for r in order.positions(spark, path).select("position").collect())
    assert found == list(range(1, written.count() + 1))


def test_ranges_are_about_equal_and_do_not_overlap(spark, written, path):
    files = sorted(order.ordered_files(spark, path).collect())
    assert len(files) == 7 and max(f.rows for f in files) < 2 * written.count() / 7
    for one, after in zip(files, files[1:]):
        assert one.oldest_order >= after.newest_order


def test_reading_positions_sorts_nothing(spark, path):
    plan = order.positions(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "Sort " not in plan and "hashpartitioning" not in plan and "rangepartitioning" not in plan


@pytest.mark.parametrize("rows", [1, 50, 5000])
def test_newest_reads_the_first_files(spark, written, path, rows):
    df = order.newest(spark, path, rows)
    whole = [tuple(r) for r in ordered(written).select(KEYS).collect()]
    assert [tuple(r) for r in df.select(KEYS).collect()] == whole[:rows]
    if rows == 1:
        assert len(df.inputFiles()) == 1


def test_a_key_with_most_rows_spans_several_files(spark, written, tmp_path):
    """An extra that the source repeats: two thirds of all rows are equal in every sort column."""
    n = written.count()
    hot = written.limit(1).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(2 * n)))).drop("_copy")
    order.write_ordered(written.unionByName(hot).repartition(4), str(tmp_path / "hot"), 9)
    files = order.ordered_files(spark, str(tmp_path / "hot")).collect()
    assert sum(f.rows for f in files) == 3 * n and max(f.rows for f in files) < 2 * 3 * n / 9
    placed = [tuple(r)[1:] for r in order.positions(spark, str(tmp_path / "hot")).select("position", *KEYS).orderBy("position").collect()]
    assert placed == sorted(placed, key=in_order)


def test_many_ranges_use_both_levels_of_the_search(spark, tmp_path):
    rows = spark.range(4000).select(
        F.pmod(F.xxhash64("id"), F.lit(1500)).alias("order_id"),
        F.col("id").alias("item_id"),
        F.when(F.col("id") % 5 > 0, (F.col("id") % 3).cast("int")).alias("instalment_no"),
        F.when(F.col("id") % 7 > 0, F.lit("2001-02-03").cast("date")).alias("settlement_date"),
    )
    for ranges in (1, 64, 65, 200):
        path = str(tmp_path / str(ranges))
        found = order.bounds(rows, ranges)
        assert len(found) == ranges - 1
        order.write_ordered(rows, path, ranges)
        placed = [tuple(r)[1:] for r in order.positions(spark, path).select("position", *KEYS).orderBy("position").collect()]
        assert len(placed) == 4000 and placed == sorted(placed, key=in_order)


def test_nulls_and_an_empty_ledger(spark, tmp_path):
    kinds = "order_id long, item_id long, instalment_no int, settlement_date date"
    rows = spark.createDataFrame([(None, 1, None, None), (3, None, 1, None), (3, 5, None, dt.date(2001, 1, 1)), (9, 2, 1, None), (3, 5, 1, None)], kinds)
    order.write_ordered(rows, str(tmp_path / "nulls"), 3)
    placed = order.positions(spark, str(tmp_path / "nulls")).select("position", *KEYS).orderBy("position").collect()
    assert [tuple(r)[1:] for r in placed] == [
        (9, 2, 1, None), (3, None, 1, None), (3, 5, None, dt.date(2001, 1, 1)), (3, 5, 1, None), (None, 1, None, None)
    ]
    order.write_ordered(rows.limit(0), str(tmp_path / "none"), 3)
    assert order.positions(spark, str(tmp_path / "none")).count() == 0
    assert order.newest(spark, str(tmp_path / "none"), 5).count() == 0


def test_ranges_grow_with_the_rows(spark, monkeypatch):
    rows = spark.range(4000)
    assert order.ranges_for(rows, 3) == 3 and order.ranges_for(rows.limit(0)) == 1
    monkeypatch.setattr(order, "RANGE_ROWS", 100)
    assert order.ranges_for(rows, 3) == 40


def test_a_ledger_in_ranges_equals_the_sorted_one(spark, tmp_path, monkeypatch):
    """Several turns of a few ranges, partitions in order; keys of every table of the driver that repeat or are null."""
    monkeypatch.setattr(order, "RANGE_ITEMS", 500, raising=False)
    for name in ("lineitem", "orders", "part", "customer", "nation", "region"):
        df = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        key = df.columns[0]
        odd = df.unionByName(df.limit(9)).unionByName(df.limit(3).withColumn(key, F.lit(None).cast(df.schema[key].dataType)))
        odd.write.parquet(str(tmp_path / f"{name}.parquet"))
    whole, got = ordered(views._ledger(spark, str(tmp_path))), views.ledger_ordered(spark, str(tmp_path))
    assert got.schema == whole.schema and got.exceptAll(whole).isEmpty() and whole.exceptAll(got).isEmpty()
    rows = got.select(F.spark_partition_id(), *KEYS).collect()
    assert [tuple(r)[1:] for r in rows] == [tuple(r) for r in whole.select(KEYS).collect()]
    assert len({r[0] for r in rows}) > 8
    # the wide rows are not shuffled: only the week calendar is
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "gateway_cost" not in "".join(x for x in plan.splitlines() if "Exchange" in x)


def test_ranges_of_items_with_a_hot_order_and_a_hot_item(spark, tmp_path, monkeypatch):
    for name, value in {"RANGE_ITEMS": 100, "FEW_ITEMS": 10}.items():
        monkeypatch.setattr(order, name, value)
    rows = [(o, i, f"{o}-{i}") for o in range(1, 40) for i in range(5)] + [(17, i, "hot order") for i in range(900)]
    rows += [(23, 3, f"copy {i}") for i in range(400)] + [(5, None, "no id")] * 3
    items = spark.createDataFrame(rows, "order_id long, item_id long, name string").repartition(5)
    cuts = order.item_cuts(items.select("order_id", "item_id"), 4, 16)
    assert cuts == sorted(set(cuts), key=lambda c: (-c[0], c[1])) and sum(c[0] == 17 for c in cuts) > 3
    before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    placed = order.in_ranges(items, cuts, 4, str(tmp_path / "items"))
    assert placed.rdd.getNumPartitions() >= len(cuts) + 1
    found = placed.sortWithinPartitions(F.desc("order_id"), "item_id", "name").select("order_id", "item_id", "name").collect()
    assert [tuple(r) for r in found] == sorted(rows, key=lambda r: (-r[0], r[1] is not None, r[1] or 0, r[2]))
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == before
    assert order.in_ranges(items.limit(0), [], 4, str(tmp_path / "none")).collect() == []
    assert order.item_cuts(items.limit(0).select("order_id", "item_id"), 4) == []


def test_a_written_part_leaves_no_shuffle_files(spark):
    """Parts are written before the last plan, whose own come on top of whatever is left."""
    store = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    folders = [str(d) for d in store.localDirsString()]

    def files():
        return {f for d in folders for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_") and f.endswith(".data")}

    before = files()
    kept = views._kept(spark, spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "part")
    for _ in range(20):  # they are removed a moment later
        left = files() - before
        if not left:
            break
        time.sleep(0.1)
    assert not left and kept.count() == 7
