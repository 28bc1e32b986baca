"""Quarterly fundamental features from restatement-versioned facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions.scalars import junk_to_null, ratio, sum_if_any
from factorloom.functions.windows import row_growth, row_sum_full
from factorloom.schema import CONCEPTS, FLOW_CONCEPTS, FUNDAMENTAL_COLUMNS


def first_reported(facts: DataFrame) -> DataFrame:
    """As first reported: earliest non-null value, and the earliest filing date, per
    (ticker, concept, period_end)."""
    dated = F.when(F.col("value").isNotNull(), F.col("filed_date"))
    return facts.groupBy("ticker", "concept", "period_end").agg(
        F.min_by("value", dated).alias("value"), F.min("filed_date").alias("filed_date"))


def quarterly_wide(facts: DataFrame, concepts: Sequence[str] = CONCEPTS) -> DataFrame:
    """One row per (ticker, period_end): first-reported value per concept, availability date.

    The first report of every concept is found in the same aggregate that pivots, so facts
    are combined down to one row per quarter before the only shuffle. A row is available
    once the last of its concepts was first filed.
    """
    c = F.col("concept")
    known = facts.where(c.isin(list(concepts)))
    value, filed = F.col("value"), F.col("filed_date")
    dated = F.when(value.isNotNull(), filed)
    wide = known.groupBy("ticker", "period_end").agg(
        *(F.min_by("value", F.when(c == n, dated)).alias(n) for n in concepts),
        *(F.min(F.when(c == n, filed)).alias(f"_f_{n}") for n in concepts))
    first = [F.col(f"_f_{n}") for n in concepts]
    available = F.greatest(*first) if len(first) > 1 else first[0]
    return wide.select("ticker", "period_end", available.alias("availability_date"), *concepts)


def operating_tickers(wide: DataFrame) -> DataFrame:
    """Tickers that reported revenue at least once and equity at least once."""
    seen = wide.groupBy("ticker").agg(F.count("revenue").alias("r"), F.count("equity").alias("e"))
    return seen.where("r > 0 AND e > 0").select("ticker")


def unique_sectors(sectors: DataFrame, sector: str = "gics_sector") -> DataFrame:
    """One clean sector per ticker; unlabelled tickers drop out."""
    labelled = sectors.select("ticker", junk_to_null(F.col(sector)).alias(sector))
    return labelled.where(F.col(sector).isNotNull()).groupBy("ticker").agg(F.min(sector).alias(sector))


def derive_fundamental_features(facts: DataFrame, sectors: DataFrame | None = None) -> DataFrame:
    """Trailing-year flows, balance-sheet levels, ratios and growth per (ticker, period_end).

    Quarters are counted as rows present per ticker. The windows run on one row per ticker
    and quarter, after all restatements were aggregated away.
    """
    # the gate rides on the ticker partitioning the windows below need anyway
    whole = Window.partitionBy("ticker")
    wide = quarterly_wide(facts).withColumn(
        "_ok", (F.count("revenue").over(whole) > 0) & (F.count("equity").over(whole) > 0)).where("_ok")
    c = F.col
    ttm = {f"{n}_ttm": row_sum_full(n, "ticker", "period_end", 4) for n in FLOW_CONCEPTS}
    growth = {"revenue_growth_yoy": row_growth("revenue", "ticker", "period_end", 4),
              "asset_growth_yoy": row_growth("assets", "ticker", "period_end", 4)}
    out = wide.withColumns(ttm | growth)
    debt = F.coalesce(c("debt_lt"), F.lit(0.0)) + F.coalesce(c("debt_cur"), F.lit(0.0))
    out = out.withColumns({
        "debt": F.nullif(debt, F.lit(0.0)),
        "ebitda_ttm": sum_if_any(c("operating_income_ttm"), c("dna_ttm")),
        "roe": ratio(c("net_income_ttm"), c("equity")),
        "gross_margin": ratio(c("gross_profit_ttm"), c("revenue_ttm")),
        "profit_margin": ratio(c("net_income_ttm"), c("revenue_ttm")),
        "accruals": ratio(c("net_income_ttm") - c("op_cashflow_ttm"), c("assets")),
    })
    if sectors is None:
        out = out.withColumn("gics_sector", F.lit(None).cast("string"))
    else:
        out = out.join(unique_sectors(sectors), "ticker", "left")
    return out.select(*FUNDAMENTAL_COLUMNS)


def filing_lags(features: DataFrame, period: str = "period_end", available: str = "availability_date") -> DataFrame:
    """Median and longest filing lag in days."""
    from factorloom.functions.cross_section import exact_quantiles

    lag = features.select(F.datediff(available, period).cast("double").alias("lag_days"))
    stats = exact_quantiles(lag, ["lag_days"], [0.5, 1.0])
    return stats.agg(F.max(F.when(F.col("prob") == 0.5, F.col("value"))).alias("median_lag"),
                     F.max(F.when(F.col("prob") == 1.0, F.col("value"))).alias("max_lag"))


def quarters_per_ticker(features: DataFrame) -> DataFrame:
    return features.groupBy("ticker").agg(F.countDistinct("period_end").alias("n_quarters"))
