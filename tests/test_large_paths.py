"""The plan for large catalogues (no table broadcast) gives the same ledger as the small one."""

import datetime as dt

from settlekit import Params, ledger
from settlekit.sources import adapter

from conftest import SF001


def test_ledger_without_broadcasts_matches(spark):
    params = Params(as_of=dt.date(2001, 7, 1))
    small = ledger(adapter.build(spark, SF001), params)
    expected = small.collect()

    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    old = {k: spark.conf.get(k, None) for k in keys}
    for k in keys:
        spark.conf.set(k, "-1")
    try:
        large = ledger(adapter.build(spark, SF001), params)
        got = large.collect()
        plan = large._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    assert plan.count("SortMergeJoin") >= 10
    key = lambda r: tuple("" if v is None else str(v) for v in r)
    assert sorted(got, key=key) == sorted(expected, key=key)
