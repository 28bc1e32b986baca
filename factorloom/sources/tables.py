"""Readers of stored tables and of SQL over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factorloom import schema
from factorloom.functions.scalars import junk_to_null, nans_to_nulls
from factorloom.sinks.tables import find_table, read_table


class Warehouse:
    """Tables below one root folder, as written by :mod:`factorloom.sinks.tables`."""

    SCHEMAS: dict[str, T.StructType] = {
        "universe": schema.UNIVERSE, "prices": schema.PRICES, "prices_daily": schema.PRICES_DAILY,
        "fundamental_facts": schema.FACTS, "fundamental_features": schema.FUNDAMENTALS,
        "ff_factors": schema.FACTORS, "macro": schema.MACRO, "panel_monthly": schema.PANEL,
        "predictions": schema.PREDICTIONS, "recommendations": schema.RECOMMENDATIONS,
        "holdings": schema.HOLDINGS,
    }

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, name: str) -> DataFrame:
        """A stored table, NaN as NULL."""
        return nans_to_nulls(read_table(self.spark, self.path(name)))

    def exists(self, name: str) -> bool:
        return find_table(self.spark, self.path(name)) is not None

    def prices(self, since: str | None = None) -> DataFrame:
        """Monthly closes; ``since`` prunes the year folders and then the rows."""
        return date_range(self.table("prices"), since).select("ticker", "date", "close")

    def prices_daily(self, since: str | None = None, fields: Sequence[str] = ("open", "high", "low", "close", "volume")) -> DataFrame:
        return date_range(self.table("prices_daily"), since).select("ticker", "date", *fields)

    def fundamental_features(self) -> DataFrame:
        return self.table("fundamental_features")

    def macro(self) -> DataFrame:
        return renamed_macro(self.table("macro")).select("date", "yield_curve", "vix", "credit_spread")

    def panel(self, start: str | None = None, end: str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
        return load_panel(self.table("panel_monthly"), start, end, columns)

    def sectors(self) -> DataFrame:
        return self.table("universe").where("is_active").select(
            "ticker", junk_to_null(F.col("gics_sector")).alias("gics_sector"))

    def ff_factors(self, library_names: bool = False) -> DataFrame:
        df = self.table("ff_factors")
        return df.withColumnsRenamed(schema.FACTOR_NAMES) if library_names else df


def date_range(df: DataFrame, start: str | None = None, end: str | None = None, date: str = "date") -> DataFrame:
    """Rows within the dates; a ``year`` partition column, if any, is pruned as well."""
    for bound, op in ((start, ">="), (end, "<=")):
        if bound is None:
            continue
        day = F.lit(bound).cast("date")
        df = df.where(F.col(date) >= day if op == ">=" else F.col(date) <= day)
        if "year" in df.columns:
            df = df.where(F.col("year") >= F.year(day) if op == ">=" else F.col("year") <= F.year(day))
    return df


def load_panel(panel: DataFrame, start: str | None = None, end: str | None = None,
               columns: Sequence[str] | None = None) -> DataFrame:
    """Date range and column subset; both reach the parquet scan."""
    out = date_range(panel, start, end)
    return out.select(*columns) if columns else out


def sql(spark: SparkSession, query: str, **frames: DataFrame) -> DataFrame:
    """SQL over named frames: ``sql(spark, "SELECT ... FROM {panel}", panel=df)``."""
    return spark.sql(query, **frames)


def read_sql(spark: SparkSession, query: str, **params) -> DataFrame:
    """SQL with bound parameters: ``... WHERE date >= :d``."""
    return spark.sql(query, args=params)


def read_jdbc(spark: SparkSession, url: str, table: str, *, column: str | None = None, lower=None, upper=None,
              partitions: int | None = None, **options: str) -> DataFrame:
    """A database table, split on a numeric or date column when bounds are given."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if column is not None:
        reader = (reader.option("partitionColumn", column).option("lowerBound", str(lower))
                  .option("upperBound", str(upper)).option("numPartitions", str(partitions or 8)))
    return nans_to_nulls(reader.load())


def renamed_macro(df: DataFrame) -> DataFrame:
    """Accept the credit spread under its old name too."""
    if "hy_spread" not in df.columns:
        return df
    spread = F.coalesce("credit_spread", "hy_spread") if "credit_spread" in df.columns else F.col("hy_spread")
    return df.withColumn("credit_spread", spread).drop("hy_spread")
