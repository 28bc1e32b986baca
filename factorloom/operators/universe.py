"""Security master, sector mapping and the investable set."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom import params
from factorloom.functions.scalars import clean_ticker, first_range, junk_to_null, safe_int

# Patterns of the security master.
COMMON_STOCK_TICKER = r"^[A-Z]{1,5}(-[A-Z])?$"
NOT_COMMON_STOCK = r"(?i)(?:Warrants?|Units?|Rights?|Preferred|Depositary|Notes?|Debentures?)"

# Industry code ranges and their sectors; the first range that holds a code wins.
SIC_RANGES: list[tuple[int, int, str]] = [
    (1311, 1389, "Energy"),
    (1200, 1299, "Energy"),
    (2911, 2999, "Energy"),
    (4610, 4619, "Energy"),
    (2833, 2836, "Health Care"),
    (3840, 3851, "Health Care"),
    (8000, 8099, "Health Care"),
    (8731, 8731, "Health Care"),
    (3570, 3579, "Information Technology"),
    (3670, 3679, "Information Technology"),
    (3661, 3669, "Information Technology"),
    (7370, 7379, "Information Technology"),
    (3820, 3829, "Information Technology"),
    (7310, 7319, "Communication Services"),
    (4800, 4899, "Communication Services"),
    (2700, 2799, "Communication Services"),
    (7800, 7841, "Communication Services"),
    (3711, 3716, "Consumer Discretionary"),
    (3630, 3639, "Consumer Discretionary"),
    (5400, 5499, "Consumer Staples"),
    (5912, 5912, "Consumer Staples"),
    (2000, 2199, "Consumer Staples"),
    (2080, 2085, "Consumer Staples"),
    (100, 299, "Consumer Staples"),
    (6798, 6798, "Real Estate"),
    (6500, 6599, "Real Estate"),
    (300, 999, "Materials"),
    (1000, 1099, "Materials"),
    (1400, 1499, "Materials"),
    (1500, 1799, "Industrials"),
    (2200, 2399, "Consumer Discretionary"),
    (2400, 2499, "Materials"),
    (2500, 2599, "Consumer Discretionary"),
    (2600, 2699, "Materials"),
    (2800, 2899, "Materials"),
    (3000, 3399, "Materials"),
    (3400, 3499, "Industrials"),
    (3500, 3599, "Industrials"),
    (3600, 3699, "Industrials"),
    (3700, 3799, "Industrials"),
    (3800, 3899, "Industrials"),
    (3900, 3999, "Consumer Discretionary"),
    (4000, 4799, "Industrials"),
    (4900, 4999, "Utilities"),
    (5000, 5199, "Industrials"),
    (5200, 5999, "Consumer Discretionary"),
    (6000, 6499, "Financials"),
    (6600, 6799, "Financials"),
    (7000, 7099, "Consumer Discretionary"),
    (7100, 7399, "Industrials"),
    (7400, 7799, "Industrials"),
    (7900, 7999, "Consumer Discretionary"),
    (8100, 8199, "Industrials"),
    (8200, 8399, "Consumer Discretionary"),
    (8400, 8999, "Industrials"),
    (9000, 9999, "Industrials"),
]

# A data vendor's sector words and ours.
VENDOR_SECTORS = {
    "Financial Services": "Financials",
    "Technology": "Information Technology",
    "Healthcare": "Health Care",
    "Energy": "Energy",
    "Industrials": "Industrials",
    "Consumer Cyclical": "Consumer Discretionary",
    "Consumer Defensive": "Consumer Staples",
    "Basic Materials": "Materials",
    "Real Estate": "Real Estate",
    "Communication Services": "Communication Services",
    "Utilities": "Utilities",
}


def security_master(*listings: DataFrame) -> DataFrame:
    """Common stocks of several listings, one row per ticker.

    Each listing has ticker, name, exchange and optionally ``test_issue`` and ``etf``. For a
    ticker listed twice the earlier listing wins, then the smallest (name, exchange).
    """
    frames = []
    for i, df in enumerate(listings):
        for flag in ("test_issue", "etf"):
            if flag in df.columns:
                df = df.where(F.col(flag).isNull() | (F.col(flag) != "Y"))
        frames.append(df.select(clean_ticker(F.col("ticker")).alias("ticker"), "name", "exchange",
                                F.lit(i).alias("_src")))
    rows = frames[0]
    for f in frames[1:]:
        rows = rows.unionByName(f)
    flagged = F.coalesce(F.col("name").rlike(NOT_COMMON_STOCK), F.lit(False))
    rows = rows.where(F.col("ticker").rlike(COMMON_STOCK_TICKER) & ~flagged)
    best = rows.groupBy("ticker").agg(F.min(F.struct("_src", "name", "exchange")).alias("r"))
    return best.select("ticker", "r.name", "r.exchange")


def map_sectors(df: DataFrame, code: str, ranges: Sequence[tuple[int, int, str]] = SIC_RANGES,
                out: str = "gics_sector") -> DataFrame:
    """First range holding the integer code; codes that are no number map to null."""
    return df.withColumn(out, first_range(safe_int(F.col(code)), ranges))


def resolve_sectors(df: DataFrame, sic: str = "sic", vendor: str = "vendor_sector") -> DataFrame:
    """Sector from the industry code, else from the vendor's word, with its source."""
    mapping = F.create_map(*(F.lit(x) for kv in VENDOR_SECTORS.items() for x in kv))
    from_code = first_range(safe_int(F.col(sic)), SIC_RANGES)
    from_vendor = F.try_element_at(mapping, F.col(vendor))
    return df.withColumns({
        "gics_sector": F.coalesce(from_code, from_vendor),
        "sector_source": F.when(from_code.isNotNull(), "sec_sic").when(from_vendor.isNotNull(), "vendor"),
    })


def remap_sectors(universe: DataFrame) -> DataFrame:
    """Derive the sector again for every row with a stored code; others keep theirs."""
    derived = first_range(safe_int(F.col("sic")), SIC_RANGES)
    return universe.withColumn(
        "gics_sector", F.when(F.col("sic").isNotNull(), derived).otherwise(F.col("gics_sector")))


def clean_sectors(universe: DataFrame) -> DataFrame:
    """Active tickers with their sector, junk labels as null."""
    return universe.where("is_active").select("ticker", junk_to_null(F.col("gics_sector")).alias("gics_sector"))


def set_active(universe: DataFrame, active: DataFrame,
               min_keep_fraction: float = params.ACTIVE_MIN_KEEP_FRACTION) -> DataFrame:
    """Flag exactly the ``active`` tickers; refuses to shrink the set below the fraction."""
    now = universe.where("is_active").count()
    new = active.select("ticker").distinct().count()
    if now and new < min_keep_fraction * now:
        raise ValueError(f"active set not changed: {new} names would replace {now} "
                         f"(less than {min_keep_fraction:.0%} of them)")
    hits = active.select("ticker").distinct().withColumn("_hit", F.lit(True))
    return (universe.drop("is_active").join(hits, "ticker", "left")
            .withColumn("is_active", F.coalesce("_hit", F.lit(False))).drop("_hit"))


def key_difference(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of ``a`` that ``b`` lacks."""
    return a.select(*keys).distinct().join(b.select(*keys).distinct(), list(keys), "left_anti")


def key_intersection(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys both frames hold."""
    return a.select(*keys).distinct().join(b.select(*keys).distinct(), list(keys), "left_semi")
