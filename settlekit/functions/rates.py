"""Rates (R06-R11): percentages stored 0-100, returned as fractions.

An item-level rate (ticket or product complement) wins over the event-level one unless it is
null or zero.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(c: Column) -> Column:
    return c / F.lit(100)


def fallback(specific: Column, general: Column) -> Column:
    """The specific value unless it is null or 0, else the general one."""
    return F.when((specific == 0) | specific.isNull(), general).otherwise(specific)


def fallback_percent(specific: Column, general: Column) -> Column:
    return F.when((specific == 0) | specific.isNull(), percent(general)).otherwise(percent(specific))
