"""Hot keys: an order or a card holding a large share of the rows is joined by many tasks."""

import contextlib
import datetime as dt

from pyspark.sql import functions as F

from settlekit import Params
from settlekit.operators.context import attach_card, card_per_id, paid_sessions
from settlekit.operators.skew import hot_keys, salted_join, split_join
from settlekit.plans.ledger import item_rows


@contextlib.contextmanager
def conf(spark, settings):
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def _key(r):
    return tuple("" if v is None else str(v) for v in r)


def test_hot_order_is_spread_and_result_unchanged(spark, small_tables):
    base = Params(as_of=dt.date(2001, 7, 1))
    hot = paid_sessions(small_tables, base).agg(F.min("order_id")).first()[0]
    participants = small_tables.checkoutparticipant.withColumn(
        "sessionid", F.when(F.col("id") % 3 == 0, F.lit(hot)).otherwise(F.col("sessionid"))
    )
    tables = small_tables.with_frames(checkoutparticipant=participants)
    cols = ["item_id", "order_id", "item_price", "order_total", "card_brand"]
    salted = item_rows(tables, Params(as_of=base.as_of, hot_key_rows=100)).select(cols).collect()
    plain = item_rows(tables, base).select(cols).collect()
    assert sorted(map(tuple, salted), key=_key) == sorted(map(tuple, plain), key=_key)

    lines = participants.select(F.col("id").alias("item_id"), F.col("sessionid").alias("order_id"))
    with conf(spark, {"spark.sql.adaptive.coalescePartitions.enabled": "false",
                      "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}):
        found = hot_keys(lines.select("order_id"), "order_id", 100)
        joined = salted_join(lines, paid_sessions(tables, base), "order_id", found, F.col("item_id"))
        tasks = joined.where(F.col("order_id") == hot).select(F.spark_partition_id().alias("task")).distinct().count()
    assert tasks > 1


def test_hot_keys_are_bounded_and_salted(spark, small_tables):
    sessions = small_tables.checkoutsession.select(F.col("providerCardId").alias("card"))
    hot = hot_keys(sessions, "card", 1)
    rows = hot.collect()
    assert rows and all(r["salts"] >= 2 for r in rows)


def test_salted_left_join_equals_plain_join(spark, small_tables):
    base = Params(as_of=dt.date(2001, 7, 1))
    s = paid_sessions(small_tables, base)
    # a third of the sessions on one card
    s = s.withColumn("provider_card_id", F.when(F.col("order_id") % 3 == 0, F.lit("card_1"))
                     .otherwise(F.col("provider_card_id")))
    cards = card_per_id(small_tables.customerpaymentprovidercard).withColumnRenamed("card_id", "provider_card_id")
    hot = hot_keys(s.select("provider_card_id"), "provider_card_id", 50)
    assert hot.count() >= 1
    salted = salted_join(s, cards, "provider_card_id", hot, F.col("order_id"), "left")
    plain = s.join(cards, "provider_card_id", "left")
    cols = sorted(plain.columns)
    assert salted.select(cols).exceptAll(plain.select(cols)).count() == 0
    assert plain.select(cols).exceptAll(salted.select(cols)).count() == 0


def test_a_hot_order_is_split_by_aqe(spark, small_tables):
    """Below the join lies an aggregate on its key, and still AQE reads the hot partition in pieces."""
    lines = small_tables.checkoutparticipant.select(
        F.col("id").alias("item_id"), F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("sessionid")).alias("order_id")
    )
    pad = F.sha2(F.concat_ws(":", "item_id", "n"), 512)
    lines = lines.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(40)))).withColumn("pad", pad).repartition(8)
    orders = small_tables.checkoutsession.groupBy(F.col("id").alias("order_id")).agg(F.max("createdat").alias("at"))
    with conf(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
                      "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
                      "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k"}):
        joined = split_join(lines, orders, "order_id").select(F.spark_partition_id().alias("task"), "order_id", "pad", "at")
        rows = joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    assert len({r.task for r in rows if r.order_id == 1}) > 1
    assert len(rows) == lines.join(orders, "order_id").count()


def test_sessions_without_a_card_and_a_hot_card(spark, small_tables):
    base = Params(as_of=dt.date(2001, 7, 1))
    s = paid_sessions(small_tables, base)
    s = s.withColumn("provider_card_id", F.when(F.col("order_id") % 3 == 0, F.lit("card_1"))
                     .when(F.col("order_id") % 3 == 1, F.lit(None)).otherwise(F.col("provider_card_id")))
    cards = card_per_id(small_tables.customerpaymentprovidercard).withColumnRenamed("card_id", "provider_card_id")
    plain = s.join(cards, "provider_card_id", "left")
    for hot_rows in (None, 50):
        got = attach_card(s, small_tables, hot_rows).select(plain.columns)
        assert got.exceptAll(plain).isEmpty() and plain.exceptAll(got).isEmpty()
