"""Scalar helpers: text cleaning, safe numbers and the accounting ratios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factorloom.schema import JUNK_LABELS


def clean_ticker(c: Column) -> Column:
    return F.replace(F.upper(F.trim(c)), F.lit("."), F.lit("-"))


def pad_cik(c: Column) -> Column:
    return F.lpad(c.cast("string"), 10, "0")


def accounting_number(c: Column) -> Column:
    """``$1,234.50`` / ``(12.0)`` / ``--`` to double; brackets mean negative."""
    text = F.trim(c)
    bare = F.regexp_replace(text, r"[$,()%\s]", "")
    number = bare.try_cast("double")
    negative = text.startswith("(") & text.endswith(")")
    return F.when(negative, -number).otherwise(number)


def safe_int(c: Column) -> Column:
    return F.trim(c.cast("string")).try_cast("int")


def junk_to_null(c: Column) -> Column:
    return F.when(~c.isin(JUNK_LABELS), c)


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def nans_to_nulls(df: DataFrame) -> DataFrame:
    """Every NaN of a float column becomes NULL; applied once, where data enters."""
    floats = [f.name for f in df.schema.fields
              if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: nan_to_null(F.col(c)) for c in floats}) if floats else df


def ratio(num: Column, den: Column) -> Column:
    """num / den, null where den is 0."""
    return F.try_divide(num, den)


def sum_if_any(*cols: Column) -> Column:
    """Sum with nulls as 0, null when all are null."""
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cols[1:]), F.coalesce(cols[0], F.lit(0.0)))
    return F.when(F.coalesce(*cols).isNotNull(), total)


def with_valuation(df: DataFrame, price: str = "price") -> DataFrame:
    """Market cap and the price-dependent ratios."""
    c = F.col
    cap = c(price) * c("shares")
    ev = c("market_cap") + F.coalesce(c("debt"), F.lit(0.0)) - F.coalesce(c("cash"), F.lit(0.0))
    return df.withColumn("market_cap", cap).withColumns({
        "earnings_yield": ratio(c("net_income_ttm"), c("market_cap")),
        "book_to_price": ratio(c("equity"), c("market_cap")),
        "ev_ebitda_inv": ratio(c("ebitda_ttm"), ev),
        "size_log_mktcap": F.when(c("market_cap") > 0, F.log(c("market_cap"))),
    })


def first_range(value: Column, ranges: Sequence[tuple[int, int, str]]) -> Column:
    """Label of the first (lo, hi, label) range holding ``value``, both ends included.

    For a short, fixed list this is a projection: no join, no shuffle.
    """
    out = F
    for lo, hi, label in ranges:
        out = out.when(value.between(lo, hi), F.lit(label))
    return out if ranges else F.lit(None).cast("string")


def version_stamp(model: Column | str, horizon: Column | str, created: Column) -> Column:
    as_col = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.concat_ws("-", as_col(model), as_col(horizon), F.date_format(created, "yyyyMMddHHmmss"))
