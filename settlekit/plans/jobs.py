"""The ledger job as a deployment runs it: build the ledger once, write it, report from it.

The five reports read the written ledger instead of re-running the 28-table plan five times, and
a lost executor during a report recomputes from those files, not from the sources.

Layout. By default the ledger is written in one directory per settlement week. Rows are rebalanced
by week first: AQE cuts a week that holds more than the advisory partition size (or a third of all
rows) into several partitions and merges small weeks, so a hot week is written by many tasks and
no task writes a file for every week. For small ledgers ``by_week=False`` writes flat files sorted
by week instead; their row-group statistics still skip weeks a query filters out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.filters import Params
from ..sources import Tables
from . import reports
from .ledger import ledger


def write_ledger(tables: Tables, params: Params, path: str, by_week: bool = True) -> DataFrame:
    """Write the 47-column ledger to ``path`` as parquet; return a DataFrame reading it back."""
    df = ledger(tables, params)
    if by_week:
        df.hint("rebalance", "settlement_week").write.mode("overwrite").partitionBy("settlement_week").parquet(path)
    else:
        df.sortWithinPartitions("settlement_week").write.mode("overwrite").parquet(path)
    # the schema is given: a week in a directory name would be read as a date or a number
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def report_all(written: DataFrame, tables: Tables, editions=None) -> dict[str, DataFrame]:
    """P01-P05 over a written ledger."""
    return {
        "lots": reports.lots(written, editions),
        "producer_totals": reports.producer_totals(written),
        "courtesies": reports.courtesies(written),
        "weekly": reports.weekly(written),
        "reconcile": reports.reconcile(written, tables),
    }


def _of_weeks(written: DataFrame, weeks: Sequence[str | None] | None) -> DataFrame:
    """The rows of the given settlement weeks (None among them: rows without one); all without."""
    if weeks is None:
        return written
    week, named = F.col("settlement_week"), [w for w in weeks if w is not None]
    return written.where(week.isin(named) | (week.isNull() if None in weeks else F.lit(False)))


def update_week_sums(written: DataFrame, path: str, weeks: Sequence[str | None] | None = None) -> None:
    """Store, under ``path`` and by settlement week, the sums that the reports P01-P04 add up.

    ``written`` is a ledger partitioned by week (:func:`write_ledger`). With ``weeks`` only these are
    read and their sums replaced, so the work follows what has changed; a week that has no row any
    more gets a row of count 0, which the reports leave out. Writing a week is all or nothing, and a
    run that is repeated gives the same. ``weeks`` must be distinct.
    """
    spark = written.sparkSession
    for name, sums in reports.week_sums(_of_weeks(written, weeks)).items():
        if weeks is not None:
            gone = spark.createDataFrame([(w,) for w in weeks], "settlement_week string")
            empty = gone.select(
                F.col("settlement_week").cast(sums.schema["settlement_week"].dataType).alias("settlement_week"), F.lit(0).cast("long").alias("_rows")
            )
            sums = sums.unionByName(empty, allowMissingColumns=True)
        sums.write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if weeks is not None else "static").partitionBy(
            "settlement_week"
        ).parquet(f"{path.rstrip('/')}/{name}")


def reports_of_week_sums(spark: SparkSession, path: str, written: DataFrame) -> dict[str, DataFrame]:
    """P01-P04 from what :func:`update_week_sums` has stored; ``written`` gives the columns' types."""
    parts = {}
    for name, sums in reports.week_sums(written).items():
        parts[name] = spark.read.schema(sums.schema).parquet(f"{path.rstrip('/')}/{name}")
    return reports.from_week_sums(parts)


def run(tables: Tables, params: Params, out_dir: str, by_week: bool = True) -> dict[str, DataFrame]:
    """Write the ledger to ``out_dir``, a folder that all executors share, and each report next
    to it; return the reports read back."""
    root = out_dir.rstrip("/")
    written = write_ledger(tables, params, f"{root}/ledger", by_week)
    out = {}
    for name, df in report_all(written, tables).items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")
        out[name] = written.sparkSession.read.parquet(f"{root}/{name}")
    return out
