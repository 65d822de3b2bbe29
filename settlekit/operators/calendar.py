"""Settlement week (J35) from the week calendar table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import Tables


def attach_week(rows: DataFrame, tables: Tables) -> DataFrame:
    """Add ``settlement_week``; a date listed twice repeats the row, as in the source.

    The calendar has a row or two for a day, whatever the size of the other tables, but a planner that
    sees only what it was derived from would shuffle all instalments by date: it is always broadcast."""
    weeks = tables.weeksarrange.select(F.col("data").alias("week_day"), F.col("semana").alias("settlement_week"))
    return rows.join(F.broadcast(weeks), rows.settlement_date == weeks.week_day, "left").drop("week_day")
