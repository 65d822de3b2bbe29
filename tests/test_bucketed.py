"""Session facts in buckets by session id: joins in place, same results."""

import datetime as dt
import re

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from settlekit import Params, ledger
from settlekit.operators.context import order_context
from settlekit.sources import read_bucketed, write_bucketed
from settlekit.sources.tables import SESSION_FACTS

PARAMS = Params(as_of=dt.date(2001, 7, 1))
BUCKETS = 6


@pytest.fixture(scope="module")
def root(spark, small_tables, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("bucketed"))
    write_bucketed(small_tables, root, BUCKETS)
    return root


@pytest.fixture(scope="module")
def bucketed(spark, small_tables, root):
    return read_bucketed(small_tables, spark, root, BUCKETS)


def test_tables_come_back_whole(small_tables, bucketed):
    for name in SESSION_FACTS:
        assert bucketed[name].dtypes == small_tables[name].dtypes, name
        assert bucketed[name].count() == small_tables[name].count() > 0, name
        assert bucketed[name].exceptAll(small_tables[name]).isEmpty(), name


def test_context_and_ledger_are_the_same(small_tables, bucketed):
    assert bucketed.bucketed and not small_tables.bucketed
    plain, placed = order_context(small_tables, PARAMS), order_context(bucketed, PARAMS)
    assert placed.columns == plain.columns
    assert placed.exceptAll(plain).isEmpty() and placed.count() == plain.count()
    for params in (PARAMS, Params(as_of=PARAMS.as_of, order_ids=[1, 3, 5, 7]), Params(as_of=PARAMS.as_of, editions=["ASIA"])):
        plain, placed = ledger(small_tables, params), ledger(bucketed, params)
        assert placed.exceptAll(plain).isEmpty() and placed.count() == plain.count() > 0


def test_session_joins_need_no_exchange(spark, bucketed):
    """Joins with summaries, payments, PayPal captures and buyer counts, sorted and hashed in place."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = order_context(bucketed, PARAMS)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    keys = re.findall(r"Exchange hashpartitioning\(([^#]+)#", plan)
    assert keys and not {"order_id", "id", "sessionid", "sessionId", "summary_session", "payment_session", "paypal_session", "buyer_session"} & set(keys)
    for name in SESSION_FACTS:
        assert sum("Bucketed: true" in line and f".settlekit_{name}_" in line for line in plan.splitlines()) == 1, name
    # only the card's join shuffles sessions
    assert sum(k == "_card" for k in keys) == 2


def test_another_number_of_buckets_is_an_error(spark, small_tables, root):
    with pytest.raises(AnalysisException):
        read_bucketed(small_tables, spark, root, BUCKETS + 1)


def test_null_and_repeated_session_ids(spark, small_tables, tmp_path):
    """Null ids join nothing, repeated ones multiply, as without buckets; written again, the rows are the new ones."""
    odd = {}
    for name, key in SESSION_FACTS.items():
        df = small_tables[name].where(F.col(key) < 60)
        none = df.limit(2).withColumn(key, F.lit(None).cast(df.schema[key].dataType))
        odd[name] = df.unionByName(df.where(F.col(key) < 9) if name != "checkoutsession" else df.limit(0)).unionByName(none)
    tables = small_tables.with_frames(**odd)
    write_bucketed(small_tables, str(tmp_path), 3)
    read_bucketed(small_tables, spark, str(tmp_path), 3)
    write_bucketed(tables, str(tmp_path), 3)
    placed, plain = order_context(read_bucketed(tables, spark, str(tmp_path), 3), PARAMS), order_context(tables, PARAMS)
    assert placed.exceptAll(plain).isEmpty() and placed.count() == plain.count() > 0
