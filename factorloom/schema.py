"""Column contracts of the tables the library reads and writes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Column names and orders that stored tables rely on.
FLOW_CONCEPTS = ["revenue", "net_income", "gross_profit", "operating_income", "dna", "op_cashflow"]
STOCK_CONCEPTS = ["equity", "assets", "cash", "debt_lt", "debt_cur", "shares"]
CONCEPTS = FLOW_CONCEPTS + STOCK_CONCEPTS

PRICE_FEATURES = ["momentum_12_2", "momentum_6_1", "volatility_12m", "size_log_mktcap"]
VALUE_FEATURES = ["earnings_yield", "book_to_price", "ev_ebitda_inv"]
QUALITY_FEATURES = ["roe", "gross_margin", "profit_margin", "accruals"]
GROWTH_FEATURES = ["revenue_growth_yoy", "asset_growth_yoy"]
MACRO_FEATURES = ["yield_curve", "vix", "credit_spread"]
MONTHLY_FEATURES = (
    PRICE_FEATURES + VALUE_FEATURES + QUALITY_FEATURES + GROWTH_FEATURES + MACRO_FEATURES
)
DAILY_FEATURES = [
    "rev_1d", "rev_5d", "rev_21d", "mom_252_21", "vol_21d", "vol_63d", "volume_surge",
    "amihud_21d", "range_21d", "dist_52w_high", "size_log_mktcap", "book_to_price",
    "earnings_yield", "roe",
]
PANEL_COLUMNS = (
    ["date", "ticker", "gics_sector", "forward_return", "market_cap"]
    + MONTHLY_FEATURES
    + ["target"]
)
FUNDAMENTAL_COLUMNS = [
    "ticker", "period_end", "availability_date", "gics_sector",
    "revenue_ttm", "net_income_ttm", "gross_profit_ttm", "op_cashflow_ttm",
    "ebitda_ttm", "equity", "assets", "debt", "cash", "shares",
    "roe", "gross_margin", "profit_margin", "accruals",
    "revenue_growth_yoy", "asset_growth_yoy",
]
FACT_COLUMNS = [
    "ticker", "cik", "concept", "gaap_tag", "period_end", "fiscal_period",
    "duration_days", "filed_date", "form", "value", "unit",
]
FACTOR_NAMES = {
    "mkt_rf": "Mkt-RF", "smb": "SMB", "hml": "HML", "rmw": "RMW",
    "cma": "CMA", "rf": "RF", "mom": "MOM",
}
JUNK_LABELS = ["NaN", "nan", "None", "none", ""]
# Theory sign of each signal's information coefficient (0 = no expectation).
EXPECTED_SIGNS = {
    "momentum_12_2": 1, "momentum_6_1": 1, "earnings_yield": 1, "book_to_price": 1,
    "ev_ebitda_inv": 1, "roe": 1, "gross_margin": 1, "profit_margin": 1,
    "volatility_12m": -1, "size_log_mktcap": -1, "accruals": -1, "asset_growth_yoy": -1,
    "revenue_growth_yoy": 0,
}

_STR, _DATE, _DBL, _INT = T.StringType(), T.DateType(), T.DoubleType(), T.IntegerType()


def _struct(spec: dict[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in spec.items()])


UNIVERSE = _struct({"ticker": _STR, "name": _STR, "exchange": _STR, "sic": _STR,
                    "gics_sector": _STR, "is_active": T.BooleanType()})
PRICES = _struct({"ticker": _STR, "date": _DATE, "close": _DBL, "volume": _DBL})
PRICES_DAILY = _struct({"ticker": _STR, "date": _DATE, "open": _DBL, "high": _DBL, "low": _DBL,
                        "close": _DBL, "volume": _DBL})
FACTS = _struct({"ticker": _STR, "cik": _STR, "concept": _STR, "gaap_tag": _STR,
                 "period_end": _DATE, "fiscal_period": _STR, "duration_days": _INT,
                 "filed_date": _DATE, "form": _STR, "value": _DBL, "unit": _STR})
FUNDAMENTALS = _struct({c: _STR if c in ("ticker", "gics_sector")
                        else _DATE if c in ("period_end", "availability_date") else _DBL
                        for c in FUNDAMENTAL_COLUMNS})
FACTORS = _struct({"date": _DATE, **{c: _DBL for c in FACTOR_NAMES}})
MACRO = _struct({"date": _DATE, "yield_curve": _DBL, "vix": _DBL, "credit_spread": _DBL})
PANEL = _struct({c: _DATE if c == "date" else _STR if c in ("ticker", "gics_sector") else _DBL
                 for c in PANEL_COLUMNS})
PREDICTIONS = _struct({"date": _DATE, "ticker": _STR, "horizon": _STR, "model_version": _STR,
                       "score": _DBL})
RECOMMENDATIONS = _struct({"as_of": _DATE, "model_version": _STR, "rank": _INT, "ticker": _STR,
                           "gics_sector": _STR, "score": _DBL, "scored_at": T.TimestampType()})
HOLDINGS = _struct({"account_id": _STR, "as_of": _DATE, "ticker": _STR, "shares": _DBL,
                    "cost_basis": _DBL})
CASH_TICKER = "$CASH"


def require_columns(df: DataFrame, columns: Iterable[str], what: str = "input") -> DataFrame:
    """Raise when ``df`` lacks any of ``columns``; otherwise return it."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks columns {missing}")
    return df
