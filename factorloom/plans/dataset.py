"""Build the stored dataset from landed files, in full or incrementally."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factorloom import params
from factorloom.operators.facts import extract_facts
from factorloom.operators.fundamentals import derive_fundamental_features
from factorloom.operators.prices import (
    append_keep_last, average_dollar_volume, coalesce_merge, liquid, monthly_close, rebased_tickers, replace_history)
from factorloom.operators.universe import remap_sectors, set_active
from factorloom.sinks import tables as sink
from factorloom.sources.tables import Warehouse


def update_prices(stored: DataFrame | None, bars: DataFrame, universe: DataFrame, *,
                  min_dollar_volume: float = params.UniverseParams.min_dollar_volume,
                  full_bars: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(monthly closes, liquid universe) after a load of daily bars.

    New closes win over stored ones; tickers on a new adjustment basis take their history
    from ``full_bars``.
    """
    from pyspark.sql import functions as F

    keep = liquid(universe, average_dollar_volume(bars), min_dollar_volume)
    fresh = monthly_close(bars.join(keep.select("ticker"), "ticker", "left_semi"))
    if stored is None:
        return fresh, keep
    merged = coalesce_merge(stored, fresh, ["ticker", "date"])
    if full_bars is not None:
        moved = rebased_tickers(fresh, stored, stored.agg(F.max("date")).scalar()).select("ticker")
        merged = replace_history(merged, monthly_close(full_bars.join(moved, "ticker", "left_semi")))
    return merged, keep


def build_dataset(spark: SparkSession, root: str, *, listing: DataFrame, bars: DataFrame, filings: DataFrame | None,
                  factors: DataFrame | None = None, macro: DataFrame | None = None, sectors: DataFrame | None = None,
                  full_bars: DataFrame | None = None, incremental: bool = False) -> Warehouse:
    """Write universe, prices, facts, features, factors and macro below ``root``."""
    wh = Warehouse(spark, root)
    sink.write_universe(spark, wh.path("universe"), listing)
    if sectors is not None:
        sink.write_universe(spark, wh.path("universe"), remap_sectors(sectors))
    stored = wh.table("prices").select("ticker", "date", "close") if incremental and wh.exists("prices") else None
    closes, keep = update_prices(stored, bars, wh.table("universe"), full_bars=full_bars)
    sink.write_table(sink.year_of(closes.where("close > 0")), wh.path("prices"), ["year"], ["ticker", "date"])
    universe = wh.table("universe")
    if "is_active" in universe.columns:
        sink.write_table(set_active(universe, keep), wh.path("universe"))
    else:
        from pyspark.sql import functions as F

        flagged = universe.withColumn("is_active", F.lit(False))
        sink.write_table(set_active(flagged, keep), wh.path("universe"))
    if filings is not None:
        facts = extract_facts(filings)
        if incremental and wh.exists("fundamental_facts"):
            facts = append_keep_last([wh.table("fundamental_facts"), facts],
                                     ["ticker", "concept", "period_end", "filed_date"])
        sink.write_facts(spark, wh.path("fundamental_facts"), facts)
        has_sector = "gics_sector" in wh.table("universe").columns
        features = derive_fundamental_features(wh.table("fundamental_facts"),
                                               wh.table("universe") if has_sector else None)
        sink.write_fundamental_features(spark, wh.path("fundamental_features"), features)
    if factors is not None:
        sink.write_factors(spark, wh.path("ff_factors"), factors)
    if macro is not None:
        sink.write_macro(spark, wh.path("macro"), macro)
    return wh
