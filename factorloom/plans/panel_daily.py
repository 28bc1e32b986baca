"""The daily multi-horizon panel: one row per (trading day, ticker) with a price."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.functions.cross_section import normalize, pct_rank, pct_rank_frames
from factorloom.functions.scalars import with_valuation
from factorloom.functions.windows import Positional
from factorloom.operators.calendar import calendar, every_kth
from factorloom.operators.fundamentals import unique_sectors
from factorloom.operators.prices import masked_returns, simple_returns
from factorloom.params import DailyPanelParams
from factorloom.plans.panel import attach_fundamentals
from factorloom.schema import DAILY_FEATURES

TRADING_YEAR = 252


def daily_returns(bars: DataFrame, bounds=DailyPanelParams.return_bounds,
                  price_calendar: DataFrame | None = None) -> DataFrame:
    """Bars with position and masked simple return; every close date is a position.

    ``price_calendar`` (date, pos) spares the pass that derives it from the bars.
    """
    priced = bars.where(F.col("close").isNotNull())
    cal = price_calendar if price_calendar is not None else calendar(priced)
    return masked_returns(simple_returns(priced, cal), bounds)


def technical_features(bars: DataFrame) -> DataFrame:
    """Daily technical features on rows (ticker, pos, close, high, low, volume, ret).

    All frames range over positions of one window, so one sort serves every feature but the
    year's high. No frame over 32 steps is re-read: they are running totals and running maxima.
    """
    p = Positional()
    c = F.col
    dollars = F.nullif(c("close") * c("volume"), F.lit(0.0))
    rows = bars.withColumns({
        "_lr": F.log1p("ret"),
        "_illiq": F.abs("ret") / dollars,
        "_span": F.try_divide(c("high") - c("low"), c("close")),
    })
    long = ("_lr", "ret", "volume")
    rows = p.centred(p.with_long_max(rows, "close", TRADING_YEAR, "_high", 126), *long)
    return p.uncentred(rows.withColumns({
        "rev_1d": c("ret"),
        "rev_5d": p.compound("_lr", -4, 0),
        "rev_21d": p.compound("_lr", -20, 0),
        "mom_252_21": p.compound("_lr", -(TRADING_YEAR - 1), -21),
        "vol_21d": p.rolling_std("ret", 21),
        "vol_63d": p.rolling_std("ret", 63),
        "volume_surge": F.try_divide(p.rolling_mean("volume", 20), p.rolling_mean("volume", 60)),
        "amihud_21d": p.rolling_mean("_illiq", 21, 15) * 1e6,
        "range_21d": p.rolling_mean("_span", 21, 15),
        "dist_52w_high": F.try_divide(c("close"), c("_high")),
    }), *long).drop("_lr", "_illiq", "_span", "_high")


def forward_labels(rows: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """Return over the next h positions per horizon; null unless all h are present."""
    p = Positional()
    out = rows.withColumn("_lr", F.log1p("ret"))
    return out.withColumns({f"fwd_{h}d": p.compound("_lr", 1, h) for h in horizons}).drop("_lr")


def assemble_panel_daily(bars: DataFrame, fundamentals: DataFrame, sectors: DataFrame, *,
                         since: str | None = None, every: int = 1, normalized: bool = True,
                         params: DailyPanelParams = DailyPanelParams(),
                         price_calendar: DataFrame | None = None, wide_groups: bool = False) -> DataFrame:
    """Daily bars, quarterly features and sectors -> panel with fwd_{h}d and target_{h}d.

    ``since`` and ``every`` thin the output dates only; windows see the whole history.
    Only priced rows leave the panel, so the windows run on those rows alone.
    """
    horizons = list(params.horizons)
    rows = forward_labels(technical_features(daily_returns(bars, params.return_bounds, price_calendar)), horizons)
    if since or every > 1:
        rows = every_kth(rows, every, since=since)
    panel = attach_fundamentals(rows.withColumnRenamed("close", "price"), fundamentals)
    panel = with_valuation(panel.join(unique_sectors(sectors), "ticker", "left"))
    fwd = [f"fwd_{h}d" for h in horizons]
    panel = panel.select("date", "ticker", "gics_sector", "market_cap", *DAILY_FEATURES, *fwd)
    if not normalized:
        return panel
    # a date holds at most all names, so ranks may be taken a date at a time
    by, keys = ["date", "gics_sector"], ("date", "ticker")
    targets = {f"target_{h}d": F.col(f"fwd_{h}d") for h in horizons}
    panel = panel.withColumns(targets)
    if params.scheme == "rank" and params.sector_neutral:
        if not wide_groups:
            return pct_rank_frames(panel, [*DAILY_FEATURES, *targets], by, frame=["date"])
        return pct_rank(panel, [*DAILY_FEATURES, *targets], by, keys=keys, wide_groups=True)
    panel = normalize(panel, DAILY_FEATURES, scheme=params.scheme, sector_neutral=params.sector_neutral,
                      winsorize_pct=params.winsorize_pct, wide_groups=wide_groups)
    return pct_rank(panel, list(targets), by, keys=keys, wide_groups=wide_groups)
