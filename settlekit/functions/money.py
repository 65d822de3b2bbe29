"""Arithmetic helpers shared by the rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = 1_000_000_000_000.0


def ratio(numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator`` that is null for a zero or null denominator.

    The source database returns null on division by zero; Spark's ANSI ``/`` would raise.
    """
    return F.try_divide(numerator, denominator)


def zero_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def non_zero_count(n: Column) -> Column:
    """Instalment count used as a divisor: 0 becomes 1."""
    return F.when(n == 0, F.lit(1)).otherwise(n)


def per_instalment(amount: Column, share: Column, n: Column) -> Column:
    """``(amount * share) / n1``: an order amount's share for one item and one instalment."""
    return (amount * share) / non_zero_count(n)


def units(c: Column) -> Column:
    """A double as a whole number of 1e-12 units."""
    return (c * F.lit(UNITS)).cast("decimal(38,0)")


def total(whole_units: Column) -> Column:
    """The sum of :func:`units` as a double, rounded once, to six places.

    Integers are summed, so neither the partitioning nor the order of rows matters, and the
    rounding of a row (half a unit) is far below the sixth place of any total.
    """
    return F.round(F.sum(whole_units) / F.lit(UNITS).cast("decimal(13,0)"), 6).cast("double")


def exact_sum(c: Column) -> Column:
    """Sum of doubles that does not depend on the order rows arrive in, to six places."""
    return total(units(c))
