"""Gapless places of rows in ordered groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factorloom.llm.text import fresh
from factorloom.session import settle


def key_of(column: str) -> Column:
    """A value as text that is never null; null sorts first, others bytewise."""
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{column}`").cast("string")), F.lit("-"))


def with_places(df: DataFrame, group: str, order: Sequence[str], place: str = "place", total: str = "total") -> DataFrame:
    """``df`` with the 0-based place of each row in its group and the group's number of rows.

    ``group`` must not be null; in ``order`` nulls come first, and rows equal in all of it follow each
    other in any order. Rows are cut into ranges of (group, order), a further column of row numbers
    splitting ranges of ties, sorted there and written with their row numbers. A place is the row
    number in its range plus the sizes of the group's ranges before. No task holds a group.
    """
    spread, number, part, first, rows, before = fresh(df, "spread_at", "number_at", "part_at", "first_at", "rows_at", "before_at")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [group, *order, spread]
    cut = df.withColumn(spread, F.monotonically_increasing_id()).repartitionByRange(n, *by).sortWithinPartitions(*by)
    cut = settle(cut.drop(spread).withColumn(number, F.monotonically_increasing_id()), "ranges")
    cut = cut.withColumn(part, F.shiftright(number, 33))
    sizes = cut.groupBy(group, part).agg(F.min(number).alias(first), F.count(F.lit(1)).alias(rows))
    g = Window.partitionBy(group)  # a row for each range of the group
    earlier = F.sum(rows).over(g.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(group, part, first, F.coalesce(earlier, F.lit(0)).alias(before), F.sum(rows).over(g).alias(total))
    at = (F.col(before) + F.col(number) - F.col(first)).alias(place)
    return cut.join(sizes, [group, part]).select(*df.columns, at, total)
