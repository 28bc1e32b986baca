"""Backward, inclusive as-of joins."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from factorloom.session import fine_parts, settle

_FIRST = Window.unboundedPreceding


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_on: str, right_on: str, *,
              tie: str | None = None, bucket: str | None = None, keep_right_on: bool = True) -> DataFrame:
    """Each left row with the right row of the same ``by`` and the latest ``right_on <= left_on``.

    Among right rows of one instant the one with the largest ``tie`` wins. Both sides are
    unioned and the last right row is carried along the key's time order: one shuffle,
    linear work, no pairs.

    ``bucket`` (a ``date_trunc`` unit) is for keys that may be hot: a task then holds one
    key's rows of one time bucket, and the last right row of earlier buckets is carried in
    from a small per-bucket summary.
    """
    by = list(by)
    payload = [c for c in right.columns if c not in by and (keep_right_on or c != right_on)]
    best = F.struct(*(F.col(c) for c in payload))
    order = F.col(tie) if tie else F.struct(*(F.col(c) for c in payload))
    r = right.where(F.col(right_on).isNotNull()).select(
        *by, F.col(right_on).alias("_t"), F.lit(0).alias("_side"), order.alias("_tie"), best.alias("_right"))
    row = [c for c in left.columns if c not in by]
    l = left.select(*by, F.col(left_on).alias("_t"), F.lit(1).alias("_side"),
                    F.struct(*row).alias("_left"))
    both = l.unionByName(r, allowMissingColumns=True)
    if bucket is None:
        both = both.repartition(fine_parts(left.sparkSession), *by)  # the one shuffle, in parts that sort in little memory
        w = Window.partitionBy(*by).orderBy("_t", "_side", "_tie").rowsBetween(_FIRST, 0)
        out = both.withColumn("_hit", F.last("_right", ignorenulls=True).over(w)).where("_side = 1")
    else:
        both = both.withColumn("_bucket", F.date_trunc(bucket, F.col("_t")))
        w = Window.partitionBy(*by, "_bucket").orderBy("_t", "_side", "_tie").rowsBetween(_FIRST, 0)
        local = both.withColumn("_here", F.last("_right", ignorenulls=True).over(w)).where("_side = 1")
        # one row per key and bucket, so this window is as long as the bucket calendar
        ends = both.groupBy(*by, "_bucket").agg(
            F.max_by("_right", F.when(F.col("_side") == 0, F.struct("_t", "_tie"))).alias("_end"))
        earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(_FIRST, -1)
        carry = ends.select(*by, "_bucket", F.last("_end", ignorenulls=True).over(earlier).alias("_carry"))
        out = local.join(carry, [*by, "_bucket"], "left").withColumn(
            "_hit", F.coalesce("_here", "_carry"))
    return out.select(*by, *(F.col(f"_left.{c}").alias(c) for c in row),
                      *(F.col(f"_hit.{c}").alias(c) for c in payload))


def as_known_on(facts: DataFrame, keys: Sequence[str], known_on, version: str = "filed_date",
                value: str = "value") -> DataFrame:
    """The value of each key as it was known on one date: its newest version up to then."""
    day = F.lit(known_on).cast("date") if isinstance(known_on, str) else known_on
    return (facts.where(F.col(version) <= day).groupBy(*keys)
            .agg(F.max_by(value, version).alias(value), F.max(version).alias(version)))


def asof_join_colocated(left: DataFrame, right: DataFrame, key: str, left_on: str, right_on: str, *, tie: str | None = None) -> DataFrame:
    """:func:`asof_join` of date columns for tables that are bucketed alike by ``key``: nothing is shuffled.

    A union would lose the layout, so both sides meet as co-grouped rows; a task holds one key's
    rows of both. Right columns keep their names and must not clash with left ones; rows of
    one day and tie resolve to the last stored.
    """
    payload = [c for c in right.columns if c != key]
    day = lambda c: F.unix_date(F.col(c)).cast("double")
    l = left.withColumn("_t", day(left_on))
    r = right.where(F.col(right_on).isNotNull()).withColumns({"_t": day(right_on), "_tie": day(tie) if tie else F.lit(0.0)})
    schema = StructType([*left.schema.fields, *(StructField(c, right.schema[c].dataType) for c in payload)])

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["_t", "_tie"], kind="stable", na_position="first")
        at = np.searchsorted(b["_t"].to_numpy(), a["_t"].to_numpy(), side="right") - 1
        at[a["_t"].isna().to_numpy()] = -1
        hit = b[payload].astype(object).reset_index(drop=True).reindex(np.where(at < 0, len(b), at))
        return pd.concat([a.drop(columns="_t").reset_index(drop=True), hit.where(hit.notna(), None).reset_index(drop=True)], axis=1)[schema.names]

    return l.groupBy(key).cogroup(r.groupBy(key)).applyInPandas(meet, schema)


def asof_known(left: DataFrame, right: DataFrame, by: Sequence[str], known_on: str, period: str = "period_end",
               version: str = "filed_date", *, bucket: str | None = None) -> DataFrame:
    """Each left row with what its own day ``known_on`` knew: the newest period, in its newest version.

    A right row counts from the day on which both its period is over and its version is
    public, so the two bounds are one order, and the answer is a running maximum of (period,
    version) in that order: a union, one shuffle and linear work, no pairs. Rows of one period and
    version that differ resolve to the largest. Right columns named like left ones must be renamed first.

    ``bucket`` (a ``date_trunc`` unit) is for keys that may be hot, as in :func:`asof_join`: a task holds
    one key's rows of one time bucket, and the maximum of earlier buckets is carried in.
    """
    by = list(by)
    payload = [c for c in right.columns if c not in (*by, period, version)]
    facts = right.where(F.col(period).isNotNull() & F.col(version).isNotNull()).select(
        *by, F.greatest(period, version).alias("_t"), F.struct(period, version, *payload).alias("_right"))
    r = facts.groupBy(*by, "_t").agg(F.max("_right").alias("_right")).withColumn("_side", F.lit(0))
    row = [c for c in left.columns if c not in by]
    l = left.select(*by, F.col(known_on).alias("_t"), F.lit(1).alias("_side"), F.struct(*row).alias("_left"))
    both = l.unionByName(r, allowMissingColumns=True)
    if bucket is None:
        w = Window.partitionBy(*by).orderBy("_t", "_side").rowsBetween(_FIRST, 0)
        out = both.withColumn("_hit", F.max("_right").over(w)).where("_side = 1")
    else:
        both = both.withColumn("_bucket", F.date_trunc(bucket, F.col("_t")))
        w = Window.partitionBy(*by, "_bucket").orderBy("_t", "_side").rowsBetween(_FIRST, 0)
        local = both.withColumn("_here", F.max("_right").over(w)).where("_side = 1")
        # one row per key and bucket, so this window is as long as the bucket calendar
        earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(_FIRST, -1)
        ends = both.groupBy(*by, "_bucket").agg(F.max("_right").alias("_end"))
        carry = ends.select(*by, "_bucket", F.max("_end").over(earlier).alias("_carry"))
        out = local.join(carry, [*by, "_bucket"], "left").withColumn("_hit", F.greatest("_here", "_carry"))
    return out.select(*by, *(F.col(f"_left.{c}").alias(c) for c in row),
                      *(F.col(f"_hit.{c}").alias(c) for c in (period, version, *payload)))


def asof_without_key(left: DataFrame, right: DataFrame, left_on: str, right_on: str) -> DataFrame:
    """Each left row with the right row of the largest ``right_on <= left_on``, over all rows at once.

    ``right_on`` values are unique and not null; columns don't clash. Both sides are cut into ranges of the
    value on sampled boundaries, a row number splitting ranges of one value, and written with
    their range; the last right row of earlier ranges is carried in from one summary row a range.
    """
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    r = right.select(F.col(right_on).alias("_t"), F.lit(0).alias("_side"), F.struct(*right.columns).alias("_right"))
    l = left.select(F.col(left_on).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_left"))
    both = l.unionByName(r, allowMissingColumns=True).withColumn("_row", F.monotonically_increasing_id())
    cut = settle(both.repartitionByRange(n, "_t", "_side", "_row").withColumn("_part", F.spark_partition_id()), "ranges")
    w = Window.partitionBy("_part").orderBy("_t", "_side").rowsBetween(_FIRST, 0)
    ends = cut.groupBy("_part").agg(F.max_by("_right", F.when(F.col("_side") == 0, F.col("_t"))).alias("_end"))
    earlier = Window.orderBy("_part").rowsBetween(_FIRST, -1)  # one row a range
    carry = F.broadcast(ends.select("_part", F.last("_end", ignorenulls=True).over(earlier).alias("_carry")))
    local = cut.withColumn("_here", F.last("_right", ignorenulls=True).over(w)).where("_side = 1")
    hit = F.when(F.col("_t").isNotNull(), F.coalesce("_here", "_carry"))
    return local.join(carry, "_part", "left").withColumn("_hit", hit).select("_left.*", "_hit.*")
