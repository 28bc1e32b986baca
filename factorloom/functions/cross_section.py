"""Order statistics within cross-sections: ranks, row numbers, quantiles, z-scores.

A missing value is null or NaN; infinities are ordered like other values. Ranking operators
have physical forms with equal results, and the caller names the one it wants:

* **window** (the default): one shuffle on the group, one sort per column. For groups that
  the domain bounds, such as the names of one date, or of one date and sector.
* **frames** (``pct_rank_frames``): the same bound, many columns at once, in Arrow tables.
* **split** (``wide_groups=True``): for groups without such a bound. Distinct values are counted,
  range-partitioned on sampled boundaries and numbered partition by partition; counts per
  partition give the offsets. Neither a group nor a hot value has to fit one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factorloom.session import fine_parts, settle

_FIRST, _LAST = Window.unboundedPreceding, Window.unboundedFollowing


def known(c: Column) -> Column:
    """The value, with NaN as null."""
    return F.when(~F.isnan(c.cast("double")), c)


def _groups_present(by: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(g).isNotNull() for g in by))


def _spread(by: Sequence[str], spread_on: Sequence[str]) -> list:
    """Window partition keys; rows of a null group are spread, they get no result anyway."""
    salt = F.when(~_groups_present(by), F.pmod(F.xxhash64(*spread_on), F.lit(4096)))
    return [*by, salt]


# ---------------------------------------------------------------------------------- ranks


def average_rank(c: Column, by: Sequence) -> tuple[Column, Column]:
    """(average-tie rank, count of values) of ``c`` in its group; nulls sort last."""
    w = Window.partitionBy(*by).orderBy(c.asc_nulls_last())
    upto_ties = F.count(c).over(w)
    return (F.rank().over(w) + upto_ties) / 2, F.count(c).over(w.rowsBetween(_FIRST, _LAST))


def pct_rank(df: DataFrame, cols: Sequence[str], by: Sequence[str], *, keys: Sequence[str],
             wide_groups: bool = False, names: dict[str, str] | None = None) -> DataFrame:
    """Average-tie rank over count of values, within the group.

    A null value or a null group key gives null. Replaces each column, or adds it under
    ``names[c]``. ``keys`` identify a row.
    """
    names = names or {}
    if wide_groups:
        return _pct_rank_split(df, cols, by, keys, names)
    parts = _spread(by, keys)
    present = _groups_present(by)
    out = {}
    for c in cols:
        x = known(F.col(c))
        r, n = average_rank(x, parts)
        out[names.get(c, c)] = F.when(x.isNotNull() & present, r / n)
    return df.withColumns(out)


def pct_rank_frames(df: DataFrame, cols: Sequence[str], by: Sequence[str], *, frame: Sequence[str],
                    names: dict[str, str] | None = None) -> DataFrame:
    """:func:`pct_rank` of many columns at once, in Arrow tables of one ``frame`` each.

    ``frame`` are some of the ``by`` columns, such as the date of (date, sector). One shuffle brings
    a frame's rows together, as for the window form, but no column is sorted with all others in
    tow. A frame must fit one task: the names of one date do.
    """
    names, cols, schema = names or {}, list(cols), df.schema
    rest = [b for b in by if b not in frame]
    for c in cols:
        if names.get(c, c) not in df.columns:
            schema = T.StructType([*schema.fields, T.StructField(names[c], T.DoubleType())])
    ranked = {names.get(c, c) for c in cols}
    schema = T.StructType([T.StructField(f.name, T.DoubleType()) if f.name in ranked else f for f in schema.fields])

    def rank(part: pa.Table) -> pa.Table:
        out = {f.name: part[f.name] for f in schema.fields if f.name not in ranked}
        if any(part[b].null_count for b in frame):
            out |= {c: pa.nulls(part.num_rows, pa.float64()) for c in ranked}
        else:
            x = part.select(cols).to_pandas().astype(float)
            if rest:
                x = x.groupby([part[b].to_pandas() for b in rest], dropna=True)
            order = x.rank(method="average", pct=True)
            out |= {names.get(c, c): pa.array(order[c], pa.float64(), from_pandas=True) for c in cols}
        return pa.table({f.name: out[f.name] for f in schema.fields})

    # rows of a null frame get no rank, and one task shall not hold them all; a union of both kinds would derive ``df`` twice
    salt = F.when(_groups_present(frame), F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64(*cols), F.lit(4096)))
    dealt = df.withColumn("_salt", salt).repartition(fine_parts(df.sparkSession), *frame, "_salt")
    return dealt.groupBy(*frame, "_salt").applyInArrow(rank, schema)


def _melt(df: DataFrame, cols: Sequence[str], by: Sequence[str], keys: Sequence[str]) -> DataFrame:
    ids = list(dict.fromkeys([*keys, *by]))
    pairs = F.explode(F.array(*(
        F.struct(F.lit(c).alias("column"), known(F.col(c)).cast("double").alias("x")) for c in cols)))
    return (df.where(_groups_present(by)).select(*ids, pairs.alias("p"))
            .select(*ids, "p.column", "p.x").where(F.col("x").isNotNull()))


def ranged(df: DataFrame, group: Sequence[str], order: Sequence[Column], weight: Column) -> DataFrame:
    """``df`` with ``_before``, the weight of all rows before it in its group, and ``_all``, the group's.

    Rows are cut into ranges of (group, order) on sampled boundaries and written with their
    range's number; ranges are then summed, and a row's sum is its range's offset plus the sum
    inside the range.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = df.withColumn("_w", weight).repartitionByRange(n, *group, *order).withColumn("_part", F.spark_partition_id())
    cut = settle(cut, "ranged")
    sizes = cut.groupBy(*group, "_part").agg(F.sum("_w").alias("_k"))
    g = Window.partitionBy(*group)
    sizes = sizes.select(
        *group, "_part", F.coalesce(F.sum("_k").over(g.orderBy("_part").rowsBetween(_FIRST, -1)), F.lit(0)).alias("_base"),
        F.sum("_k").over(g).alias("_all"))
    inside = F.sum("_w").over(Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(_FIRST, -1))
    placed = cut.join(sizes, [*group, "_part"]).withColumn("_before", F.col("_base") + F.coalesce(inside, F.lit(0)))
    return placed.drop("_w", "_part", "_base")


def value_order(long: DataFrame, group: Sequence[str], x: str = "x") -> DataFrame:
    """One row per distinct (group, x): ``below`` (values smaller), ``same`` and ``total``."""
    distinct = long.groupBy(*group, x).agg(F.count(F.lit(1)).alias("same"))
    placed = ranged(distinct, group, [F.col(x)], F.col("same"))
    return placed.select(*group, x, "same", F.col("_all").alias("total"), F.col("_before").alias("below"))


def _pct_rank_split(df, cols, by, keys, names):
    long = _melt(df, cols, by, keys)
    group = [*by, "column"]
    order = value_order(long, group)
    ranked = long.join(order, [*group, "x"]).withColumn(
        "_r", (F.col("below") + (F.col("same") + 1) / 2) / F.col("total"))
    wide = ranked.groupBy(*keys).agg(*(
        F.max(F.when(F.col("column") == c, F.col("_r"))).alias(f"_r_{c}") for c in cols))
    replaced = [c for c in cols if names.get(c, c) == c]
    out = df.drop(*replaced).join(wide, list(keys), "left")
    out = out.withColumnsRenamed({f"_r_{c}": names.get(c, c) for c in cols})
    order_cols = df.columns + [names[c] for c in cols if names.get(c, c) != c]
    return out.select(*order_cols)


def row_numbers(df: DataFrame, by: Sequence[str], value: str, tie: str, *, descending: bool = False,
                out: str = "row", count: str | None = None, wide_groups: bool = False) -> DataFrame:
    """1-based position by (value, tie ascending) in the group, with the group's row count.

    ``value`` must not be null.
    """
    x = F.col(value).desc() if descending else F.col(value).asc()
    if not wide_groups:
        w = Window.partitionBy(*by).orderBy(x, F.col(tie).asc())
        df = df.withColumn(out, F.row_number().over(w))
        return df.withColumn(count, F.count(F.lit(1)).over(w.rowsBetween(_FIRST, _LAST))) if count else df
    placed = ranged(df, by, [x, F.col(tie).asc()], F.lit(1))
    placed = placed.withColumn(out, (F.col("_before") + 1).cast("int"))
    if count:
        placed = placed.withColumn(count, F.col("_all"))
    return placed.drop("_before", "_all")


# ------------------------------------------------------------------------------ quantiles


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                    by: Sequence[str] = ()) -> DataFrame:
    """Linear-interpolated quantiles per (group, column): rows of (by, column, prob, value).

    Works on distinct values with their counts, so neither a group nor a hot value has to
    fit one task.
    """
    group = [*by, "column"]
    pairs = F.explode(F.array(*(
        F.struct(F.lit(c).alias("column"), known(F.col(c)).cast("double").alias("x")) for c in cols)))
    src = df.where(_groups_present(by)) if by else df
    long = (src.select(*by, pairs.alias("p")).select(*by, "p.column", "p.x")
            .where(F.col("x").isNotNull()))
    order = value_order(long, group)
    aggs = []
    for i, p in enumerate(probs):
        h = F.lit(float(p)) * (F.col("total") - 1)
        for name, k in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            hit = (F.col("below") <= k) & (k < F.col("below") + F.col("same"))
            aggs.append(F.max(F.when(hit, F.col("x"))).alias(f"_{name}{i}"))
    at = order.groupBy(*group).agg(F.max("total").alias("total"), *aggs)
    out = []
    for i, p in enumerate(probs):
        h = F.lit(float(p)) * (F.col("total") - 1)
        value = F.col(f"_lo{i}") + (h - F.floor(h)) * (F.col(f"_hi{i}") - F.col(f"_lo{i}"))
        out.append(F.struct(F.lit(float(p)).alias("prob"), value.alias("value")))
    return (at.select(*group, F.explode(F.array(*out)).alias("q"))
            .select(*group, "q.prob", "q.value"))


# ------------------------------------------------------------------------------- z-scores


def zscore(df: DataFrame, cols: Sequence[str], by: Sequence[str], *, keys: Sequence[str],
           winsorize_pct: float = 0.01, wide_groups: bool = False) -> DataFrame:
    """Clip at the group's quantiles, then (x - mean) / std; a zero spread gives 0."""
    present = _groups_present(by)
    lo_hi = [winsorize_pct, 1 - winsorize_pct]
    df = df.withColumns({c: known(F.col(c)) for c in cols})
    if wide_groups:
        df = _zscore_stats_split(df, cols, by, lo_hi)
        mean, std = (lambda c: F.col(f"_m_{c}")), (lambda c: F.col(f"_s_{c}"))
    else:
        g = Window.partitionBy(*_spread(by, keys))
        if winsorize_pct > 0:
            df = df.withColumns({
                f"_q_{c}": F.percentile(c, F.array(*map(F.lit, lo_hi))).over(g) for c in cols})
            df = df.withColumns({
                c: F.when(F.col(c).isNotNull(),
                          F.least(F.greatest(F.col(c), F.col(f"_q_{c}")[0]), F.col(f"_q_{c}")[1]))
                for c in cols})
        df = df.withColumns({f"_m_{c}": F.avg(c).over(g) for c in cols} |
                            {f"_s_{c}": F.stddev_samp(c).over(g) for c in cols})
        mean, std = (lambda c: F.col(f"_m_{c}")), (lambda c: F.col(f"_s_{c}"))
    out = {}
    for c in cols:
        # a constant column can leave a spread of rounding size: treat it as none
        z = F.when(F.coalesce(std(c), F.lit(0.0)) < 1e-12, F.lit(0.0)).otherwise(
            F.try_divide(F.col(c) - mean(c), std(c)))
        out[c] = F.when(F.col(c).isNotNull() & present, z)
    return df.withColumns(out).drop(*(f"_{k}_{c}" for k in "qms" for c in cols))


def _zscore_stats_split(df, cols, by, lo_hi):
    if lo_hi[0] > 0:
        q = exact_quantiles(df, cols, lo_hi, by)
        q = q.groupBy(*by).agg(*(
            F.max(F.when((F.col("column") == c) & (F.col("prob") == p), F.col("value")))
            .alias(f"_q{i}_{c}") for c in cols for i, p in enumerate(lo_hi)))
        df = df.join(q, list(by), "left")
        df = df.withColumns({
            c: F.when(F.col(c).isNotNull(),
                      F.least(F.greatest(F.col(c), F.col(f"_q0_{c}")), F.col(f"_q1_{c}")))
            for c in cols}).drop(*(f"_q{i}_{c}" for c in cols for i in (0, 1)))
    stats = df.groupBy(*by).agg(*(F.avg(c).alias(f"_m_{c}") for c in cols),
                                *(F.stddev_samp(c).alias(f"_s_{c}") for c in cols))
    return df.join(stats, list(by), "left")


def normalize(df: DataFrame, cols: Sequence[str], *, scheme: str = "rank", sector_neutral: bool = True,
              date: str = "date", sector: str = "gics_sector", keys: Sequence[str] = ("date", "ticker"),
              winsorize_pct: float = 0.01, wide_groups: bool = False) -> DataFrame:
    """Normalise ``cols`` per date, or per date and sector, by the chosen scheme."""
    by = [date, sector] if sector_neutral else [date]
    if scheme == "rank":
        return pct_rank(df, cols, by, keys=keys, wide_groups=wide_groups)
    if scheme == "zscore":
        return zscore(df, cols, by, keys=keys, winsorize_pct=winsorize_pct, wide_groups=wide_groups)
    raise ValueError(f"unknown normalisation scheme {scheme!r}")


# ------------------------------------------------------------------------------- buckets


def quantile_bucket(row: Column, n: Column, q: int) -> Column:
    """1..q bucket of position ``row`` (1-based) among ``n`` ordered rows."""
    i, span = (row - 1) * q, n - 1
    return F.greatest(F.lit(1), F.floor(F.try_divide(i + span - 1, span))).cast("int")
