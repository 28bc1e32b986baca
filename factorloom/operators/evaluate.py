"""Signal evaluation: information coefficients, quantile returns, coverage.

Signals (and horizons) are unpivoted, so one job evaluates all of them, grouped by
(signal, date) instead of looping.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factorloom.functions.cross_section import (
    average_rank, exact_quantiles, known, quantile_bucket, row_numbers, value_order)
from factorloom.operators.calendar import calendar, with_position
from factorloom.schema import EXPECTED_SIGNS
from factorloom.session import fine_parts

MIN_PAIRS = 5


def _pairs(panel: DataFrame, signals: Sequence[str], target: str, keep: Sequence[str]) -> DataFrame:
    """Complete (signal, target) pairs: one row per signal and panel row."""
    cells = F.explode(F.array(*(
        F.struct(F.lit(s).alias("signal"), known(F.col(s)).cast("double").alias("x")) for s in signals)))
    return (panel.where(known(F.col(target)).isNotNull())
            .select(*keep, F.col(target).cast("double").alias("y"), cells.alias("c"))
            .select(*keep, "c.signal", "c.x", "y").where(F.col("x").isNotNull()))


def spearman(pairs: DataFrame, by: Sequence[str], *, wide_groups: bool = False) -> DataFrame:
    """Rank correlation of (x, y) per group; groups under five pairs or constant drop out.

    Average-tie ranks have mean (n + 1) / 2, so centred sums need no second pass; the
    correlation comes from guarded sums because ``corr`` fails on constant input.
    """
    by = list(by)
    if wide_groups:
        for c in ("x", "y"):
            order = value_order(pairs, by, c).select(
                *by, c, (F.col("below") + (F.col("same") + 1) / 2).alias(f"r{c}"),
                F.col("total").alias("n"))
            pairs = pairs.drop("n").join(order, [*by, c])
    else:
        rx, n = average_rank(F.col("x"), by)
        ry, _ = average_rank(F.col("y"), by)
        pairs = pairs.withColumns({"rx": rx, "ry": ry, "n": n})
    mid = (F.col("n") + 1) / 2
    dx, dy = F.col("rx") - mid, F.col("ry") - mid
    sums = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n_pairs"), F.sum(dx * dy).alias("_xy"),
                                  F.sum(dx * dx).alias("_xx"), F.sum(dy * dy).alias("_yy"))
    ic = F.try_divide(F.col("_xy"), F.sqrt(F.col("_xx") * F.col("_yy")))
    return (sums.where(F.col("n_pairs") >= MIN_PAIRS).select(*by, ic.alias("ic"))
            .where(F.col("ic").isNotNull()))


def spearman_frames(rows: DataFrame, date: str, cells: Sequence[tuple[dict[str, str], str, str]]) -> DataFrame:
    """:func:`spearman` of many (labels, x, y) column pairs per date: rows (labels, date, ic).

    ``rows`` have doubles in which a value that does not count is null. One shuffle brings the names of a
    date together once, whatever the number of pairs, and they are ranked in an Arrow table. A date must fit one task.
    """
    cells, least = list(cells), MIN_PAIRS
    schema = T.StructType([*(T.StructField(k, T.StringType()) for k in cells[0][0]), rows.schema[date], T.StructField("ic", T.DoubleType())])
    used = list(dict.fromkeys(c for _, x, y in cells for c in (x, y)))

    def ranks(v: np.ndarray) -> np.ndarray:
        order = np.argsort(v)
        at = v[order]
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        end = np.r_[first[1:], len(v)]
        out = np.empty(len(v))
        out[order] = np.repeat((first + end + 1) / 2, end - first)
        return out - (len(v) + 1) / 2

    def correlate(part: pa.Table) -> pa.Table:
        values = {c: part[c].to_numpy() for c in used}  # null is NaN
        found = []
        for labels, x, y in cells:
            both = ~(np.isnan(values[x]) | np.isnan(values[y]))
            if both.sum() < least:
                continue
            dx, dy = ranks(values[x][both]), ranks(values[y][both])
            size = np.sqrt((dx * dx).sum() * (dy * dy).sum())
            if size > 0:
                found.append((labels, float((dx * dy).sum() / size)))
        day = part[date].slice(0, 1).combine_chunks()
        out = {k: pa.array([labels[k] for labels, _ in found], pa.string()) for k in cells[0][0]}
        out[date] = day.take(pa.array([0] * len(found), pa.int64()))
        return pa.table(out | {"ic": pa.array([ic for _, ic in found], pa.float64())})

    return rows.select(date, *used).repartition(fine_parts(rows.sparkSession), date).groupBy(date).applyInArrow(correlate, schema)


def information_coefficient(panel: DataFrame, signals: str | Sequence[str], *,
                            target: str = "forward_return", date: str = "date",
                            sector: str | None = None, wide_groups: bool = False) -> DataFrame:
    """Per-date Spearman IC of each signal: rows (signal, date, ic).

    With ``sector`` the IC is taken within sectors and averaged over them per date.
    """
    signals = [signals] if isinstance(signals, str) else list(signals)
    if sector is None and not wide_groups:
        value = {f"_x{i}": known(F.col(c)).cast("double") for i, c in enumerate([*signals, target])}
        rows = panel.select(date, *(c.alias(n) for n, c in value.items())).where(F.col(f"_x{len(signals)}").isNotNull())
        return spearman_frames(rows, date, [({"signal": c}, f"_x{i}", f"_x{len(signals)}") for i, c in enumerate(signals)])
    if sector is None:
        pairs = _pairs(panel, signals, target, [date])
        return spearman(pairs, ["signal", date], wide_groups=wide_groups)
    pairs = _pairs(panel.where(F.col(sector).isNotNull()), signals, target, [date, sector])
    per = spearman(pairs, ["signal", date, sector], wide_groups=wide_groups)
    return per.groupBy("signal", date).agg(F.avg("ic").alias("ic"))


def ic_summary(ic: DataFrame, by: Sequence[str] = ("signal",)) -> DataFrame:
    """Mean, std, information ratio, t-statistic, hit rate and count of an IC series."""
    c = F.col
    stats = ic.where(c("ic").isNotNull()).groupBy(*by).agg(
        F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("ic_std"),
        F.avg((c("ic") > 0).cast("double")).alias("hit_rate"), F.count("ic").alias("n_months"))
    ir = F.try_divide(c("ic_mean"), c("ic_std"))
    return stats.select(*by, "ic_mean", "ic_std", ir.alias("ic_ir"),
                        (ir * F.sqrt(c("n_months"))).alias("t_stat"), "hit_rate", "n_months")


def signal_report(panel: DataFrame, signals: Sequence[str], *, target: str = "forward_return",
                  date: str = "date", sector: str | None = None, wide_groups: bool = False) -> DataFrame:
    """IC summary of many signals, best information ratio first."""
    ic = information_coefficient(panel, signals, target=target, date=date, sector=sector,
                                 wide_groups=wide_groups)
    return ic_summary(ic).orderBy(F.col("ic_ir").desc_nulls_last(), "signal")


def sign_check(report: DataFrame, expected: dict[str, int] | None = None) -> DataFrame:
    """Compare each signal's mean IC with its expected sign (0 matches anything)."""
    table = expected or EXPECTED_SIGNS
    mapping = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    out = report.withColumn("expected", F.try_element_at(mapping, F.col("signal")))
    out = out.withColumn("actual_sign", F.when(F.col("ic_mean") > 0, 1).otherwise(-1))
    return out.withColumn("matches", (F.col("expected") == 0) | (F.col("expected") == F.col("actual_sign")))


def cumulative_ic(ic: DataFrame, date: str = "date", by: Sequence[str] = ("signal",)) -> DataFrame:
    """Running IC sum per signal; one row per date, so a partition is calendar-bounded."""
    w = Window.partitionBy(*by).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    return ic.withColumn("cum_ic", F.sum("ic").over(w))


def quantile_returns(panel: DataFrame, signals: str | Sequence[str], *, target: str = "forward_return",
                     n_quantiles: int = 10, date: str = "date", ticker: str = "ticker",
                     wide_groups: bool = False) -> DataFrame:
    """Mean forward return per signal quantile, averaged per date and then over dates.

    Rows (signal, quantile, mean_fwd_return), with a ``top_minus_bottom`` row per signal.
    """
    signals = [signals] if isinstance(signals, str) else list(signals)
    pairs = _pairs(panel, signals, target, [date, ticker])
    placed = row_numbers(pairs, ["signal", date], "x", ticker, out="_r", count="_n",
                         wide_groups=wide_groups).where(F.col("_n") >= n_quantiles)
    bucket = quantile_bucket(F.col("_r"), F.col("_n"), n_quantiles)
    per_date = placed.groupBy("signal", date, bucket.alias("q")).agg(F.avg("y").alias("m"))
    means = per_date.groupBy("signal", "q").agg(F.avg("m").alias("m"))
    ends = means.groupBy("signal").agg(
        (F.max(F.when(F.col("q") == n_quantiles, F.col("m")))
         - F.max(F.when(F.col("q") == 1, F.col("m")))).alias("m")).where(F.col("m").isNotNull())
    rows = means.select("signal", F.col("q").cast("string").alias("quantile"),
                        F.col("m").alias("mean_fwd_return"))
    return rows.unionByName(ends.select("signal", F.lit("top_minus_bottom").alias("quantile"),
                                        F.col("m").alias("mean_fwd_return")))


def ic_series_by_horizon(panel: DataFrame, signals: Sequence[str], horizons: Sequence[int], *,
                         date: str = "date", overlapping: bool = False,
                         wide_groups: bool = False) -> DataFrame:
    """Per-date IC of each signal against each horizon's forward return.

    Only every h-th date is used for horizon h, so samples do not overlap.
    """
    if not overlapping:
        panel = with_position(panel, calendar(panel, date, "_p"), date=date)
    if not wide_groups:
        x = {f"_x{i}": known(F.col(s)).cast("double") for i, s in enumerate(signals)}
        use = {h: F.lit(True) if overlapping else F.col("_p") % h == 0 for h in horizons}
        y = {f"_y{h}": F.when(use[h], known(F.col(f"fwd_{h}d")).cast("double")) for h in horizons}
        rows = panel.select(date, *(c.alias(n) for n, c in (x | y).items())).where(F.coalesce(*y).isNotNull())
        cells = [({"horizon": f"{h}d", "signal": s}, f"_x{i}", f"_y{h}") for h in horizons for i, s in enumerate(signals)]
        return spearman_frames(rows, date, cells)

    def cell(h, s) -> Column:
        use = F.lit(True) if overlapping else F.col("_p") % h == 0
        return F.when(use & known(F.col(s)).isNotNull() & known(F.col(f"fwd_{h}d")).isNotNull(), F.struct(
            F.lit(f"{h}d").alias("horizon"), F.lit(s).alias("signal"),
            F.col(s).cast("double").alias("x"), F.col(f"fwd_{h}d").alias("y")))

    cells = F.array_compact(F.array(*(cell(h, s) for h in horizons for s in signals)))
    pairs = panel.select(date, F.explode(cells).alias("c")).select(date, "c.*")
    return spearman(pairs, ["horizon", "signal", date], wide_groups=wide_groups)


def ic_by_horizon(panel: DataFrame, signals: Sequence[str], horizons: Sequence[int], *,
                  date: str = "date", overlapping: bool = False, wide_groups: bool = False) -> DataFrame:
    """IC summary per (horizon, signal) on non-overlapping dates."""
    return ic_summary(ic_series_by_horizon(panel, signals, horizons, date=date, overlapping=overlapping,
                                           wide_groups=wide_groups), ["horizon", "signal"])


def feature_coverage(panel: DataFrame, cols: Sequence[str], since: str | None = None,
                     date: str = "date") -> DataFrame:
    """Share of rows with a value, one row per column."""
    if since:
        panel = panel.where(F.col(date) >= F.lit(since).cast("date"))
    shares = panel.agg(*(F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in cols))
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("coverage")) for c in cols)))
    return shares.select(cells.alias("c")).select("c.*")


def usable_rows(panel: DataFrame, core: Sequence[str], target: str = "target") -> DataFrame:
    """Rows with a target and every core feature."""
    return panel.dropna(subset=[target, *core])


def label_quantiles(panel: DataFrame, horizons: Sequence[int],
                    probs: Sequence[float] = (0.01, 0.25, 0.5, 0.75, 0.99)) -> DataFrame:
    """Exact quantiles of each horizon's label: rows (column, prob, value)."""
    return exact_quantiles(panel, [f"fwd_{h}d" for h in horizons], probs)


def value_counts(df: DataFrame, c: str) -> DataFrame:
    return df.groupBy(c).agg(F.count(F.lit(1)).alias("n"))


def distinct_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct values of several columns in one pass: rows (column, n_distinct)."""
    cells = F.explode(F.array(*(
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in cols)))
    return (df.select(cells.alias("c")).select("c.*").where(F.col("v").isNotNull()).distinct()
            .groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct")))
