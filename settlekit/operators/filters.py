"""Report parameters (F02-F13) as one immutable object.

The source report takes them as optional template tags; an unset tag means "no filter". Here
each is a keyword argument, ``None`` meaning unset.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.instalment import square_days
from ..functions.status import PAYABLE_EXTRA_REASONS, PAYABLE_TICKET_REASONS


@dataclass(frozen=True)
class Params:
    """Parameters of one ledger run.

    ``as_of`` replaces the report's ``now()`` so that a run can be repeated. Giving
    ``extra_ids`` drops every ticket and giving ``participant_ids`` drops every extra, as the
    source report does; giving both returns nothing.
    """

    as_of: dt.date = field(default_factory=dt.date.today)
    editions: Sequence[str] | None = None  # event edition (event complement's global event)
    order_ids: Sequence[int] | None = None  # checkout session ids
    event_ids: Sequence[int] | None = None  # event ids
    participant_ids: Sequence[int] | None = None  # F07/F10
    extra_ids: Sequence[int] | None = None  # F08/F09
    settled_between: tuple[dt.date, dt.date] | None = None  # F11, inclusive
    bought_between: tuple[dt.date, dt.date] | None = None  # F12, inclusive
    status: str | None = None  # settlement class
    payable_ticket_reasons: tuple[str, ...] = PAYABLE_TICKET_REASONS  # F02
    payable_extra_reasons: tuple[str, ...] = PAYABLE_EXTRA_REASONS  # F03
    settlement_days: Callable[[Column], Column] = square_days  # R24
    hot_key_rows: int | None = None  # rows above which an order or card is salted (None: AQE splits it)


def isin(c: Column, values: Sequence | None) -> Column | None:
    return None if values is None else c.isin(list(values))


def apply(df, *predicates: Column | None):
    """``df.where(p1 & p2 ...)`` for the predicates that are set."""
    for p in predicates:
        if p is not None:
            df = df.where(p)
    return df


def between(c: Column, bounds: tuple[dt.date, dt.date] | None) -> Column | None:
    """Inclusive range, applied only when both ends are given; a null value is dropped."""
    if bounds is None:
        return None
    lo, hi = bounds
    return c.between(F.lit(lo), F.lit(hi))


def settled_bounds(ranges: DataFrame, params: "Params") -> tuple[Column, Column] | None:
    """F11 restated on the raw timestamp of the purchase, as bounds that reach the session scan.

    An instalment settles 0 days after the purchase or ``settlement_days(k)`` for a ``k`` of a plan, so
    a purchase lies at most the longest such delay before the range, and not after the range by
    more than the most negative one. Both delays are scalar subqueries over the plan table.
    """
    if params.settled_between is None:
        return None
    lo, hi = params.settled_between
    k = ranges.select(F.explode(F.from_json("installmentsArray", "array<int>", {"mode": "FAILFAST"})).alias("k"))
    days = k.select(params.settlement_days(F.col("k")).alias("days"))
    longest, least = (days.agg(F.coalesce(f("days"), F.lit(0)).alias("d")) for f in (F.max, F.min))
    first = F.date_sub(F.lit(lo), F.greatest(longest.scalar(), F.lit(0))).cast("timestamp_ntz")
    last = F.date_sub(F.lit(hi), F.least(least.scalar(), F.lit(0))).cast("timestamp_ntz")
    return first + F.expr("INTERVAL 3 HOURS"), last + F.expr("INTERVAL 27 HOURS")


def created_between(createdat: Column, bought: tuple[dt.date, dt.date] | None) -> Column | None:
    """F12 restated on the raw timestamp so it reaches the session scan.

    ``purchase_date = date(createdat - 3 h)`` lies in ``[lo, hi]`` exactly when ``createdat``
    lies in ``[lo 03:00, hi + 1 day 03:00)``.
    """
    if bought is None:
        return None
    lo, hi = bought
    start = dt.datetime.combine(lo, dt.time(3))
    end = dt.datetime.combine(hi + dt.timedelta(days=1), dt.time(3))
    # built from text: a Python datetime literal would pass through the session's time zone
    start_ts = F.lit(start.isoformat(sep=" ")).cast("timestamp_ntz")
    end_ts = F.lit(end.isoformat(sep=" ")).cast("timestamp_ntz")
    return (createdat >= start_ts) & (createdat < end_ts)
