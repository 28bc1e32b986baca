"""Registry of named queries over the star-schema tables, with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a (spark, sf_dir) -> DataFrame function under ``name``."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round every double column; engines sum in different orders."""
    out = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out[f.name] = F.round(F.col(f.name), special.get(f.name, digits)) + F.lit(0.0)
    return df.withColumns(out) if out else df


def r(expr: str, alias: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0 AS {alias}"


def rs(cols: Sequence[str], digits: int = 6, prefix: str = "") -> str:
    return ", ".join(r(f"{prefix}{c}", c, digits) for c in cols)


def pct_rank_sql(c: str, by: str, valid: str = "TRUE") -> str:
    """Average-tie rank over count of values, as SQL."""
    return (f"CASE WHEN {c} IS NOT NULL AND {valid} THEN (rank() OVER (PARTITION BY {by} ORDER BY {c} NULLS LAST)"
            f" + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2.0) / count({c}) OVER (PARTITION BY {by}) END")
