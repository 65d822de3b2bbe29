"""Benchmark: the ledger and its reports on the fixture tables of one scale factor.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

The 28 checkout tables are derived from the driver tables once and written as parquet to a
scratch folder (as a deployment would read them). Each headline query is then planned from
those files and written to the ``noop`` sink: a warm-up pass over all queries, then three
interleaved timed rounds and the median of each query's three runs. Every run reads the tables
anew, so its planning counts.
Prints one JSON line.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from settlekit import Params, folded_ledger, ledger, read_tables, reports  # noqa: E402
from settlekit.plans import jobs  # noqa: E402
from settlekit.plans.ledger import ordered  # noqa: E402
from settlekit.plans.views import EXTRA_IDS, PARTICIPANT_IDS  # noqa: E402
from settlekit.session import build_session  # noqa: E402
from settlekit.sources import adapter, write_tables  # noqa: E402

AS_OF = dt.date(2001, 7, 1)


def headline(read):
    """The timed queries; each reads its tables anew, so that planning counts."""
    base = Params(as_of=AS_OF)
    return {
        "ledger": lambda: ledger(read(), base),
        "ledger_ordered": lambda: ordered(ledger(read(), base)),
        "filter_bought": lambda: ledger(read(), Params(as_of=AS_OF, bought_between=(dt.date(1998, 1, 1), dt.date(1998, 6, 30)))),
        "filter_orders": lambda: ledger(read(), Params(as_of=AS_OF, order_ids=[1, 3, 5, 7, 32, 37, 70, 100, 1000, 2000])),
        "filter_participants": lambda: ledger(read(), Params(as_of=AS_OF, participant_ids=PARTICIPANT_IDS)),
        "filter_extras": lambda: ledger(read(), Params(as_of=AS_OF, extra_ids=EXTRA_IDS)),
        # weighted where the groups of a report are nearly as many as its items, folded where they are few
        "lots": lambda: reports.lots(ledger(read(), base, weighted=True)),
        "producer_totals": lambda: reports.producer_totals(ledger(read(), base, weighted=True)),
        "courtesies": lambda: reports.courtesies(ledger(read(), base, weighted=True)),
        "weekly": lambda: reports.weekly(folded_ledger(read(), base)),
        "reconcile": lambda: _reconcile(read(), base),
        # the job as deployed: write the ledger once, then the five reports from the written files
        # (flat week-sorted files: at sf0.1 a week directory would hold only ~4,000 rows)
        "ledger_job": lambda: _job(read(), base),
    }


def _reconcile(tables, params):
    return reports.reconcile(ledger(tables, params, weighted=True), tables)


def _job(tables, params) -> None:
    out = tempfile.mkdtemp(prefix="settlekit-bench-job-")
    for df in jobs.run(tables, params, out, by_week=False).values():
        df.count()


def run(build) -> float:
    """Seconds to run one headline query: a DataFrame is written to the ``noop`` sink, a job
    (which writes its own outputs) just runs."""
    t0 = time.perf_counter()
    df = build()
    if df is not None:
        df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=str(max(8, 2 * int(cpus))),
        spark__driver__memory="16g",
    )
    scratch = tempfile.mkdtemp(prefix="settlekit-bench-")
    t0 = time.perf_counter()
    write_tables(adapter.build(spark, sf_dir), scratch)
    fixture_sec = time.perf_counter() - t0
    queries = headline(lambda: read_tables(spark, scratch))
    # warm-up pass over every query first (warms the JIT), then three timed rounds over all queries (interleaved, so no query is
    # always timed first while the JVM is still warming up); the median of each query's three
    first = {name: round(run(build), 3) for name, build in queries.items()}
    runs = {name: [] for name in queries}
    for _ in range(3):
        for name, build in queries.items():
            runs[name].append(run(build))
    timings = {name: round(statistics.median(xs), 3) for name, xs in runs.items()}
    sf = os.path.basename(os.path.normpath(sf_dir)).replace("sf", "")
    print(json.dumps({
        "metric": "ledger_and_reports_total",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": int(cpus),
        "fixture_build_sec": round(fixture_sec, 3),
        "first_run_sec": first,
    }))


if __name__ == "__main__":
    main()
