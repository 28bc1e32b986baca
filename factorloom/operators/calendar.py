"""Global calendars, positions and the dense grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def calendar(dates: DataFrame, date: str = "date", pos: str = "pos") -> DataFrame:
    """Distinct dates with their 0-based position.

    The unpartitioned window sorts one row per distinct date, a number the calendar bounds
    (a century of trading days is about 25,000 rows) whatever the size of the table; the
    distinct is combined before its shuffle.
    """
    days = dates.select(date).where(F.col(date).isNotNull()).distinct()
    return days.withColumn(pos, F.row_number().over(Window.orderBy(date)) - 1)


def with_position(df: DataFrame, cal: DataFrame, how: str = "inner", date: str = "date") -> DataFrame:
    """Attach calendar positions; the calendar side is bounded, so it is broadcast."""
    return df.join(F.broadcast(cal), date, how)


def last_position(cal: DataFrame, pos: str = "pos") -> Column:
    """The calendar's last position, as a scalar subquery."""
    return cal.agg(F.max(pos)).scalar()


def densify(df: DataFrame, cal: DataFrame, key: str = "ticker", date: str = "date",
            pos: str = "pos") -> DataFrame:
    """One row per (key, calendar date); other columns are null where ``df`` has no row.

    Each row fills the gap up to the key's next row, so the grid grows out of one
    key-partitioned window: no product of keys and dates is joined, and the output keeps
    the partitioning on ``key``.
    """
    rest = [c for c in df.columns if c not in (key, date)]
    w = Window.partitionBy(key).orderBy(F.col(pos).asc_nulls_first())
    end = last_position(cal, pos)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # rows off the calendar sort first; only the first of them stands for the leading gap
    following = F.when(F.col(pos).isNull(), F.min(pos).over(whole)).otherwise(F.lead(pos).over(w))
    placed = with_position(df, cal, "left", date).withColumns({"_rn": F.row_number().over(w), "_next": following})
    start = F.when(F.col("_rn") == 1, F.lit(0)).otherwise(F.col(pos))
    stop = F.coalesce(F.col("_next") - 1, end)
    gap = F.when(start <= stop, F.sequence(start, stop))
    grown = placed.select(key, F.col(pos).alias("_at"), *rest, F.explode(gap).alias(pos))
    here = F.col("_at") == F.col(pos)
    grown = grown.select(key, pos, *(F.when(here, F.col(c)).alias(c) for c in rest))
    return grown.join(F.broadcast(cal), pos).select(key, date, pos, *rest)


def every_kth(df: DataFrame, k: int, date: str = "date", since: str | None = None) -> DataFrame:
    """Rows from ``since`` on, on every k-th calendar date counted from there."""
    if since:
        df = df.where(F.col(date) >= F.lit(since).cast("date"))
    if k <= 1:
        return df
    return with_position(df, calendar(df, date, "_p"), date=date).where(F.col("_p") % k == 0).drop("_p")
