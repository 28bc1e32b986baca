"""The monthly feature panel: one row per (date, ticker)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.functions.cross_section import normalize, pct_rank, pct_rank_frames
from factorloom.functions.scalars import with_valuation
from factorloom.functions.windows import Positional
from factorloom.operators.asof import asof_join
from factorloom.operators.calendar import calendar, densify, with_position
from factorloom.operators.fundamentals import unique_sectors
from factorloom.operators.prices import masked_returns, simple_returns
from factorloom.params import PanelParams
from factorloom.schema import MACRO_FEATURES, MONTHLY_FEATURES, PANEL_COLUMNS

FUNDAMENTAL_INPUTS = [
    "net_income_ttm", "ebitda_ttm", "equity", "assets", "debt", "cash", "shares",
    "roe", "gross_margin", "profit_margin", "accruals", "revenue_growth_yoy", "asset_growth_yoy",
]


def monthly_grid(prices: DataFrame, bounds=PanelParams.return_bounds, drop_unpriced: bool = False,
                 price_calendar: DataFrame | None = None) -> DataFrame:
    """Prices and masked returns on the monthly return calendar, with positions.

    ``price_calendar`` (date, pos) spares the pass that derives it from the prices.

    Return dates are the price dates on which at least one ticker has a return; offsets
    count those dates. The grid is dense unless ``drop_unpriced``.
    """
    raw = simple_returns(prices.select("ticker", "date", "close"), price_calendar)
    raw = raw.select("ticker", "date", "close", "ret")
    cal = calendar(raw.where(F.col("ret").isNotNull()))
    rows = masked_returns(raw, bounds)
    return with_position(rows, cal) if drop_unpriced else densify(rows, cal)


def price_features(grid: DataFrame) -> DataFrame:
    """Momentum, volatility and the one-month forward return on (ticker, pos) rows."""
    p = Positional()
    return grid.withColumn("_lr", F.log1p("ret")).withColumns({
        "momentum_12_2": p.compound("_lr", -12, -2),
        "momentum_6_1": p.compound("_lr", -6, -1),
        "volatility_12m": p.rolling_std("ret", 12),
        "forward_return": p.following("ret"),
    }).drop("_lr")


def attach_fundamentals(panel: DataFrame, fundamentals: DataFrame) -> DataFrame:
    """Latest quarter available on each date; of quarters published together the newest wins."""
    cols = ["ticker", "availability_date", "period_end", *FUNDAMENTAL_INPUTS]
    return asof_join(panel, fundamentals.select(*cols), ["ticker"], "date", "availability_date",
                     tie="period_end").drop("period_end")


def assemble_panel(prices: DataFrame, fundamentals: DataFrame, macro: DataFrame, sectors: DataFrame, *,
                   normalized: bool = True, drop_unpriced: bool = False, params: PanelParams = PanelParams(),
                   price_calendar: DataFrame | None = None, wide_groups: bool = False) -> DataFrame:
    """Monthly closes, quarterly features, macro series and sectors -> feature panel.

    Features, as-of join and sector tag share the partitioning on ticker; the ranks need
    one more shuffle, on (date, sector). Market cap and the forward return stay raw.
    """
    grid = price_features(monthly_grid(prices, params.return_bounds, drop_unpriced, price_calendar))
    panel = attach_fundamentals(grid.withColumnRenamed("close", "price"), fundamentals)
    panel = with_valuation(panel.join(unique_sectors(sectors), "ticker", "left"))
    # one row per month end: bounded by the calendar
    have = [c for c in MACRO_FEATURES if c in macro.columns]
    panel = panel.join(F.broadcast(macro.select("date", *have)), "date", "left")
    panel = panel.withColumns({c: F.lit(None).cast("double") for c in MACRO_FEATURES if c not in have})
    panel = panel.select(*[c for c in PANEL_COLUMNS if c != "target"])
    if not normalized:
        return panel
    # a date holds at most all names, so ranks may be taken a date at a time
    # the target is ranked with the features: same groups, same shuffle
    panel = panel.withColumn("target", F.col("forward_return"))
    by = ["date", "gics_sector"]
    if params.scheme == "rank" and params.sector_neutral:
        if not wide_groups:
            return pct_rank_frames(panel, [*MONTHLY_FEATURES, "target"], by, frame=["date"]).select(*PANEL_COLUMNS)
        return pct_rank(panel, [*MONTHLY_FEATURES, "target"], by, keys=("date", "ticker"), wide_groups=True).select(*PANEL_COLUMNS)
    panel = normalize(panel, MONTHLY_FEATURES, scheme=params.scheme, sector_neutral=params.sector_neutral,
                      winsorize_pct=params.winsorize_pct, wide_groups=wide_groups)
    return pct_rank(panel, ["target"], by, keys=("date", "ticker"), wide_groups=wide_groups).select(*PANEL_COLUMNS)
