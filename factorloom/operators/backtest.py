"""Cost-aware monthly backtest of long-only portfolios."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions.dates import next_month_end
from factorloom.operators.attribution import factor_attribution
from factorloom.operators.portfolio import Strategy, build_portfolio, turnover
from factorloom.session import settle

_KEY = ["model_version", "strategy"]
MONTHS = 12


@dataclass(frozen=True)
class BacktestResult:
    """Lazy frames, keyed by (model_version, strategy); returns are dated at realisation."""

    returns: DataFrame
    holdings: DataFrame
    strategy: DataFrame
    benchmark: DataFrame
    attribution: DataFrame | None


def realized_only(preds: DataFrame, fwd: str = "forward_return") -> DataFrame:
    """Rows of the dates on which some name has a forward return."""
    live = preds.groupBy("model_version", "date").agg(F.count(fwd).alias("_n")).where("_n > 0")
    return preds.join(live.select("model_version", "date"), ["model_version", "date"], "left_semi")


def gross_returns(portfolio: DataFrame, preds: DataFrame, fwd: str = "forward_return") -> DataFrame:
    """Weighted forward return per date; a held name without one contributes 0."""
    keys = ["model_version", "date", "ticker"]
    joined = portfolio.join(preds.select(*keys, fwd), keys, "left")
    return joined.groupBy(*_KEY, "date").agg(
        F.sum(F.col("weight") * F.coalesce(fwd, F.lit(0.0))).alias("gross"))


def benchmark_returns(preds: DataFrame, fwd: str = "forward_return",
                      by: Sequence[str] = ("model_version",)) -> DataFrame:
    """Equal-weight mean forward return per date."""
    return preds.groupBy(*by, "date").agg(F.avg(fwd).alias("benchmark"))


def cost_of(turnover_col: Column, bps_per_side: Column) -> Column:
    return turnover_col * 2 * bps_per_side / 10_000.0


def backtest_returns(portfolio: DataFrame, preds: DataFrame, strategies: Sequence[Strategy],
                     fwd: str = "forward_return") -> DataFrame:
    """Gross, turnover, cost, net and benchmark per formation date."""
    bps = F
    for s in strategies:
        bps = bps.when(F.col("strategy") == s.name, F.lit(s.cost_bps))
    out = (gross_returns(portfolio, preds, fwd)
           .join(turnover(portfolio), [*_KEY, "date"])
           .join(benchmark_returns(preds, fwd), ["model_version", "date"], "left"))
    out = out.withColumn("cost", cost_of(F.col("turnover"), bps))
    return out.select(*_KEY, "date", "gross", "turnover", "cost",
                      (F.col("gross") - F.col("cost")).alias("net"), "benchmark")


def growth_and_drawdown(returns: DataFrame, ret: str, by: Sequence[str], date: str = "date") -> DataFrame:
    """Growth of 1 and the drawdown from its running peak (the peak starts at month one)."""
    w = Window.partitionBy(*by).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    grown = returns.withColumn("equity", F.product(1 + F.coalesce(ret, F.lit(0.0))).over(w))
    return grown.withColumn("drawdown", F.col("equity") / F.max("equity").over(w) - 1)


def performance_summary(returns: DataFrame, ret: str = "net", by: Sequence[str] = _KEY, *,
                        rf: float | DataFrame = 0.0, date: str = "date") -> DataFrame:
    """Annualised return, volatility, Sharpe, Sortino, worst drawdown and hit rate per group.

    ``rf`` is a constant, or a frame (date, rf).
    """
    by = list(by)
    rows = returns.where(F.col(ret).isNotNull())
    if isinstance(rf, DataFrame):
        rows = rows.join(rf.select(date, F.col("rf").alias("_rf")), date, "left")
    else:
        rows = rows.withColumn("_rf", F.lit(float(rf)))
    rows = growth_and_drawdown(rows, ret, by, date)
    r = F.col(ret)
    stats = rows.groupBy(*by).agg(
        F.product(1 + r).alias("_g"), F.stddev_samp(r).alias("_s"),
        F.stddev_samp(F.when(r < 0, r)).alias("_d"), F.avg(r - F.col("_rf")).alias("_x"),
        F.min("drawdown").alias("max_drawdown"), F.avg((r > 0).cast("double")).alias("hit_rate"),
        F.count(r).alias("n_months"))
    root = F.sqrt(F.lit(float(MONTHS)))
    vol, down, excess = F.col("_s") * root, F.col("_d") * root, F.col("_x") * MONTHS
    return stats.select(
        *by, (F.pow("_g", MONTHS / F.col("n_months")) - 1).alias("ann_return"), vol.alias("ann_vol"),
        F.try_divide(excess, vol).alias("sharpe"), F.try_divide(excess, down).alias("sortino"),
        "max_drawdown", "hit_rate", "n_months")


def run_strategy_backtest(preds: DataFrame, factors: DataFrame | None = None,
                          strategies: Sequence[Strategy] = (Strategy(),), *, stored: bool = False) -> BacktestResult:
    """Predictions -> hold-buffer portfolio -> net monthly returns, summary, attribution.

    Predictions are read several times, so unless ``stored`` already they are written once
    to the shared scratch folder, and so are the holdings (a few rows per date).

    Months without any realised return are live picks and stay out. Returns are re-keyed
    from formation to realisation month.
    """
    if "model_version" not in preds.columns:
        preds = preds.withColumn("model_version", F.lit("model"))
    preds = realized_only(preds if stored else settle(preds, "predictions"))
    holdings = settle(build_portfolio(preds, strategies), "holdings")
    returns = backtest_returns(holdings, preds, strategies).withColumn("date", next_month_end(F.col("date")))
    return BacktestResult(
        returns=returns,
        holdings=holdings,
        strategy=performance_summary(returns, "net"),
        benchmark=performance_summary(returns, "benchmark"),
        attribution=None if factors is None else factor_attribution(returns, factors, by=_KEY),
    )
