"""Calendar arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_end(d: Column) -> Column:
    return F.last_day(d)


def next_month_end(d: Column) -> Column:
    """The first month end strictly after ``d``."""
    return F.last_day(F.date_add(d, 1))


def month_begin_back(d: Column, k: int) -> Column:
    """The k-th month begin strictly before ``d``."""
    return F.add_months(F.trunc(F.date_sub(d, 1), "MM"), -(k - 1)).cast("date")


def quarter_start(d: Column) -> Column:
    return F.trunc(d, "QUARTER")


def nearest_quarter_end(d: Column) -> Column:
    """Closest calendar quarter end; a tie goes to the end of d's own quarter."""
    start = F.trunc(d, "QUARTER")
    before = F.date_sub(start, 1)
    own = F.last_day(F.add_months(start, 2))
    return F.when(F.datediff(d, before) < F.datediff(own, d), before).otherwise(own)


def quarter_label(d: Column) -> Column:
    """Q1..Q4 for quarter-end months, null for any other month."""
    return F.when(F.month(d) % 3 == 0, F.concat(F.lit("Q"), F.quarter(d).cast("string")))


def quarters_between(start: Column, end: Column) -> Column:
    """Whole calendar quarters from ``start``'s quarter to ``end``'s."""
    return (F.year(end) - F.year(start)) * 4 + F.quarter(end) - F.quarter(start)


def incremental_start(last_stored: Column, today: Column, adv_window: int = 60,
                      full_start: str = "2000-01-01") -> Column:
    """First date an incremental price load must cover.

    The earlier of a two-month overlap with the stored history and the liquidity window
    (in calendar days, with a margin for holidays); ``full_start`` when nothing is stored.
    """
    lookback = F.date_sub(today, int(adv_window * 7 / 5) + 21)
    return F.coalesce(
        F.when(last_stored.isNotNull(), F.least(month_begin_back(last_stored, 2), lookback)),
        F.lit(full_start).cast("date"),
    )
