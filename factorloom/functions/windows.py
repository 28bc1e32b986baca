"""Positional windows over (ticker, pos).

``pos`` is the row's index on the global calendar, so an offset counts calendar steps, not
rows of one ticker. RANGE frames over ``pos`` give that meaning on sparse rows directly: a
missing date is simply absent from the frame and fails the full-count guard, and no grid of
empty rows has to be built first.

A ticker has at most one row per calendar date, so a window partition is never longer than
the calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Spark re-reads a sliding frame for every row, while a frame that starts at the partition's first
# row is only ever extended. So longer frames are differences of running totals, or for maxima two
# running ones.
_LONG_FRAME = 32


class Positional:
    """Window builder for one key and position column."""

    def __init__(self, key: str = "ticker", pos: str = "pos"):
        self.key, self.pos = key, pos
        self.base = Window.partitionBy(key).orderBy(pos)

    def frame(self, lo: int, hi: int):
        return self.base.rangeBetween(lo, hi)

    def previous(self, c: str) -> Column:
        """Value one calendar step back."""
        here = F.lag(self.pos).over(self.base) == F.col(self.pos) - 1
        return F.when(here, F.lag(c).over(self.base))

    def following(self, c: str) -> Column:
        """Value one calendar step ahead."""
        here = F.lead(self.pos).over(self.base) == F.col(self.pos) + 1
        return F.when(here, F.lead(c).over(self.base))

    def centred(self, df: DataFrame, *cols: str) -> DataFrame:
        """``df`` ready for long frames over ``cols``: each key's first value, and the distance to it.

        Running totals of distances lose no digits to a level that all values share.
        """
        first = {f"_mid_{c}": F.coalesce(F.first(c, ignorenulls=True).over(self.base.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))
                 for c in cols}
        return df.withColumns(first).withColumns({f"_off_{c}": F.col(c) - F.col(f"_mid_{c}") for c in cols})

    def uncentred(self, df: DataFrame, *cols: str) -> DataFrame:
        """``df`` without the helper columns of ``centred``."""
        return df.drop(*(f"_{x}_{c}" for x in ("mid", "off") for c in cols))

    def _between(self, x: Column, lo: int, hi: int) -> Column:
        """Sum of ``x`` over [lo, hi] as the difference of two running totals."""
        upto = self.base.rangeBetween(Window.unboundedPreceding, hi)
        before = self.base.rangeBetween(Window.unboundedPreceding, lo - 1)
        return F.coalesce(F.sum(x).over(upto), F.lit(0.0)) - F.coalesce(F.sum(x).over(before), F.lit(0.0))

    def _count(self, c: str, lo: int, hi: int) -> Column:
        upto = self.base.rangeBetween(Window.unboundedPreceding, hi)
        before = self.base.rangeBetween(Window.unboundedPreceding, lo - 1)
        return F.count(c).over(upto) - F.count(c).over(before)

    def _total(self, c: str, lo: int, hi: int) -> tuple[Column, Column]:
        if hi - lo + 1 <= _LONG_FRAME:
            w = self.frame(lo, hi)
            return F.sum(c).over(w), F.count(c).over(w)
        n = self._count(c, lo, hi)
        return self._between(F.col(f"_off_{c}"), lo, hi) + n * F.col(f"_mid_{c}"), n

    def compound(self, log_return: str, lo: int, hi: int) -> Column:
        """Compound return over [lo, hi] relative positions; every step must be present.

        This and the means, sums and deviations below need a ``centred`` frame if longer than 32 steps.
        """
        total, n = self._total(log_return, lo, hi)
        return F.when(n == hi - lo + 1, F.expm1(total))

    def rolling_sum(self, c: str, n: int, min_count: int | None = None) -> Column:
        total, k = self._total(c, -(n - 1), 0)
        return F.when(k >= (min_count or n), total)

    def rolling_mean(self, c: str, n: int, min_count: int | None = None) -> Column:
        if n > _LONG_FRAME:
            total, k = self._total(c, -(n - 1), 0)
            return F.when(k >= (min_count or n), total / k)
        w = self.frame(-(n - 1), 0)
        return F.when(F.count(c).over(w) >= (min_count or n), F.avg(c).over(w))

    def rolling_std(self, c: str, n: int, min_count: int | None = None) -> Column:
        if n > _LONG_FRAME:
            lo, off = -(n - 1), F.col(f"_off_{c}")
            k, one, two = self._count(c, lo, 0), self._between(off, lo, 0), self._between(off * off, lo, 0)
            spread = F.greatest(two - one * one / k, F.lit(0.0)) / F.nullif(k - 1, F.lit(0))
            return F.when(k >= (min_count or n), F.sqrt(spread))
        w = self.frame(-(n - 1), 0)
        return F.when(F.count(c).over(w) >= (min_count or n), F.stddev_samp(c).over(w))

    def rolling_max(self, c: str, n: int, min_count: int | None = None) -> Column:
        if n > _LONG_FRAME:
            raise ValueError("take with_long_max for frames over 32 steps")
        w = self.frame(-(n - 1), 0)
        return F.when(F.count(c).over(w) >= (min_count or n), F.max(c).over(w))

    def with_long_max(self, df: DataFrame, c: str, n: int, out: str, min_count: int | None = None) -> DataFrame:
        """``df`` with ``out``, the maximum of ``c`` over the last ``n`` positions, in constant work a row.

        Positions are cut into blocks of ``n``. A frame is the end of one block and the beginning of
        the next, so its maximum is the larger of a running maximum backwards and one forwards. The
        position where a frame begins may have no row: each row stands once at its own
        position and once, asking, where its frame begins.
        """
        block = lambda at: F.floor(at / n)
        pos, at, value = F.col(self.pos), F.col("_at"), F.col("_value")
        forwards = Window.partitionBy(self.key, block(pos)).orderBy(self.pos).rowsBetween(Window.unboundedPreceding, 0)
        seen = df.withColumns({"_head": F.max(c).over(forwards), "_heads": F.count(c).over(forwards)})
        asked = seen.withColumn("_asks", F.explode(F.array(F.lit(False), F.lit(True)))).withColumns({
            "_at": F.when(F.col("_asks"), pos - (n - 1)).otherwise(pos), "_value": F.when(~F.col("_asks"), F.col(c))})
        backwards = Window.partitionBy(self.key, block(at)).orderBy(at.desc(), "_asks").rowsBetween(Window.unboundedPreceding, 0)
        told = asked.withColumns({"_tail": F.max(value).over(backwards), "_tails": F.count(value).over(backwards)}).where("_asks")
        apart = block(at) != block(pos)  # else the frame is one whole block, and its head has it all
        known = F.col("_heads") + F.when(apart, F.col("_tails")).otherwise(F.lit(0))
        most = F.greatest("_head", F.when(apart, F.col("_tail")))
        return told.withColumn(out, F.when(known >= (min_count or n), most)).select(*[F.col(x) for x in df.columns if x != out], out)


def row_sum_full(c: str, key: str, order: str, n: int) -> Column:
    """Sum of the last n rows present (rows, not calendar steps); null unless all have a value."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-(n - 1), 0)
    return F.when(F.count(c).over(w) == n, F.sum(c).over(w))


def row_growth(c: str, key: str, order: str, k: int) -> Column:
    """Growth against the k-th row back."""
    before = F.lag(c, k).over(Window.partitionBy(key).orderBy(order))
    return F.try_divide(F.col(c), before) - 1


def mask_outside(c: Column, bounds: tuple[float, float]) -> Column:
    """Null outside the band; both ends stay."""
    return F.when(c.between(*bounds), c)
