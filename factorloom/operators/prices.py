"""Price operators: bars, monthly closes, returns, liquidity, seams and merges."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom import params
from factorloom.functions.windows import Positional, mask_outside
from factorloom.operators.calendar import calendar, with_position

BAR_FIELDS = ("open", "high", "low", "close", "volume")


def bars_from_wide(wide: DataFrame, tickers: Sequence[str], date: str = "date",
                   fields: Sequence[str] = BAR_FIELDS, sep: str = "_") -> DataFrame:
    """One ``<field>_<ticker>`` column per field and ticker -> long bars with a close."""
    have = set(wide.columns)
    rows = F.explode(F.array(*(
        F.struct(F.lit(t).alias("ticker"), *(
            (F.col(f"{f}{sep}{t}").cast("double") if f"{f}{sep}{t}" in have
             else F.lit(None).cast("double")).alias(f) for f in fields))
        for t in tickers)))
    return (wide.select(F.col(date).cast("date").alias("date"), rows.alias("b"))
            .select("date", "b.*").where(F.col("close").isNotNull()))


def to_wide(prices: DataFrame, tickers: Sequence[str] | None = None, value: str = "close") -> DataFrame:
    """Date x ticker matrix; pass ``tickers`` to spare the extra pass that lists them."""
    pivot = prices.groupBy("date").pivot("ticker", list(tickers) if tickers else None)
    return pivot.agg(F.first(value))


def monthly_close(bars: DataFrame, key: str = "ticker", date: str = "date",
                  close: str = "close") -> DataFrame:
    """Last non-null close of each month, dated at the month end."""
    return (bars.where(F.col(close).isNotNull())
            .groupBy(key, F.last_day(date).alias(date))
            .agg(F.max_by(close, date).alias(close)))


def simple_returns(prices: DataFrame, cal: DataFrame | None = None, *, key: str = "ticker",
                   close: str = "close", out: str = "ret") -> DataFrame:
    """Return against the previous calendar date, without filling gaps; adds ``pos``."""
    cal = cal if cal is not None else calendar(prices)
    placed = with_position(prices, cal)
    before = Positional(key).previous(close)
    return placed.withColumn(out, F.try_divide(F.col(close), before) - 1)


def masked_returns(returns: DataFrame, bounds: tuple[float, float], ret: str = "ret") -> DataFrame:
    """Null the implausible returns (both ends of the band stay)."""
    return returns.withColumn(ret, mask_outside(F.col(ret), bounds))


def count_masked(returns: DataFrame, bounds: tuple[float, float], ret: str = "ret") -> DataFrame:
    return returns.agg(F.count_if(~F.col(ret).between(*bounds)).alias("n_masked"))


def average_dollar_volume(bars: DataFrame, cal: DataFrame | None = None, *, window: int = 60,
                          min_periods: int = 30, key: str = "ticker") -> DataFrame:
    """Trailing mean dollar volume per key at the calendar's last date.

    Only the last ``window`` dates matter, so older rows are dropped before the aggregate
    and no window function is needed. Keys without a row there have a null value.
    """
    cal = cal if cal is not None else calendar(bars)
    last = cal.agg(F.max("pos")).scalar()
    recent = with_position(bars, cal).where(F.col("pos") > last - window)
    dollars = F.col("close") * F.col("volume")
    return recent.groupBy(key).agg(
        F.when(F.count(dollars) >= min_periods, F.avg(dollars)).alias("adv"))


def liquid(universe: DataFrame, adv: DataFrame, min_dollar_volume: float | None = None,
           key: str = "ticker") -> DataFrame:
    """Universe rows whose dollar volume reaches the floor."""
    floor = params.UniverseParams.min_dollar_volume if min_dollar_volume is None else min_dollar_volume
    return universe.join(adv.where(F.col("adv") >= floor).select(key), key, "left_semi")


def coalesce_merge(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union of keys; a non-null new value wins, else the old one stays."""
    values = [c for c in dict.fromkeys([*old.columns, *new.columns]) if c not in keys]
    tagged_old = old.withColumnsRenamed({c: f"_o_{c}" for c in old.columns if c not in keys})
    joined = new.join(tagged_old, list(keys), "full_outer")

    def pick(c):
        sides = ([F.col(c)] if c in new.columns else []) + ([F.col(f"_o_{c}")] if c in old.columns else [])
        return F.coalesce(*sides).alias(c)

    return joined.select(*keys, *(pick(c) for c in values))


def rebased_tickers(new: DataFrame, stored: DataFrame, before, *, tol: float = params.REBASE_TOLERANCE,
                    key: str = "ticker", date: str = "date", close: str = "close") -> DataFrame:
    """Keys whose fresh closes disagree with the stored ones (median |new/old - 1| > tol)
    on the overlap before the newest stored date."""
    cut = F.lit(before).cast("date") if isinstance(before, str) else before
    overlap = new.select(key, date, F.col(close).alias("_new")).where(F.col(date) < cut).join(
        stored.select(key, date, F.col(close).alias("_old")), [key, date])
    dev = F.abs(F.try_divide("_new", "_old") - 1)
    return (overlap.groupBy(key).agg(F.median(dev).alias("deviation"))
            .where(F.col("deviation") > tol))


def suspect_tickers(returns: DataFrame, key: str = "ticker", ret: str = "ret",
                    moves: tuple[float, float] = params.SUSPECT_MOVES) -> DataFrame:
    """Keys with any monthly move beyond the bounds (adjustment seams)."""
    up, down = moves
    hit = (F.col(ret) > up) | (F.col(ret) < down)
    return (returns.where(hit).groupBy(key)
            .agg(F.count(F.lit(1)).alias("n_moves"), F.min(ret).alias("worst"), F.max(ret).alias("best")))


def replace_history(stored: DataFrame, fresh: DataFrame, key: str = "ticker") -> DataFrame:
    """Stored rows of keys absent from ``fresh``, plus all of ``fresh``."""
    kept = stored.join(fresh.select(key).distinct(), key, "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


def append_keep_last(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Union of frames; for equal keys the row of the last frame wins.

    An aggregate, not a window: copies of one key are combined before the shuffle.
    """
    tagged = [f.withColumn("_src", F.lit(i)) for i, f in enumerate(frames)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    rest = [c for c in both.columns if c not in keys and c != "_src"]
    row = F.struct(*rest)
    best = both.groupBy(*keys).agg(F.max_by(row, F.struct("_src", row)).alias("_row"))
    return best.select(*keys, "_row.*")


def latest_close(bars: DataFrame, days: int = 10, key: str = "ticker", date: str = "date",
                 close: str = "close") -> DataFrame:
    """Newest close per key among the last ``days`` days of the table."""
    last = bars.agg(F.max(date)).scalar()
    return (bars.where(F.col(date) >= F.date_sub(last, days)).groupBy(key)
            .agg(F.max_by(close, date).alias(close)))


def valid_prices(prices: DataFrame, volume: DataFrame | None = None) -> DataFrame:
    """Rows worth storing: a present, positive close, with volume where known."""
    rows = prices.where(F.col("close").isNotNull() & ~F.isnan("close") & (F.col("close") > 0))
    if volume is not None:
        return rows.drop("volume").join(volume.select("ticker", "date", "volume"), ["ticker", "date"], "left")
    return rows


def has_data(df: DataFrame, flags: dict[str, str], key: str = "ticker") -> DataFrame:
    """Keys for which every named SQL predicate holds on at least one row."""
    hits = df.groupBy(key).agg(*(F.max(F.expr(p)).alias(n) for n, p in flags.items()))
    return hits.where(reduce(lambda a, b: a & b, (F.col(n) for n in flags))).select(key)
