"""A permutation test of the walk-forward elastic net: many shuffled targets in one job.

Shuffling a target inside its date changes neither the feature moments nor the target's own sums
of that date, only the feature-target sums. So the moments are taken once, each permutation adds
one short vector a date, and all (fold, permutation) fits are rows of one solve.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorloom.models.elastic_net import date_sums, imputed, solve
from factorloom.models.folds import fold_table
from factorloom.models.grid import default_params
from factorloom.models.walkforward import permutation_key
from factorloom.operators.calendar import calendar
from factorloom.operators.evaluate import MIN_PAIRS, ic_summary
from factorloom.params import ELASTIC_NET, WalkForwardParams
from factorloom.session import fine_parts, settle, ship_package

#: Numbers of one block of (names, permutations) that a task holds.
BLOCK_CELLS = 1 << 22


def _blocks(names: int, n: int) -> list[slice]:
    """``n`` permutations of ``names`` names in blocks of about BLOCK_CELLS numbers."""
    step = max(1, BLOCK_CELLS // max(names, 1))
    return [slice(i, min(i + step, n)) for i in range(0, n, step)]


def average_ranks(v: np.ndarray) -> np.ndarray:
    """Average-tie ranks of a vector without NaN."""
    order = np.argsort(v)
    at = v[order]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    end = np.r_[first[1:], len(v)]
    out = np.empty(len(v))
    out[order] = np.repeat((first + end + 1) / 2, end - first)
    return out


def permuted_places(n: int, day: int, seed: int) -> np.ndarray:
    """Which place (0-based, by ticker) each of ``n`` names of a day takes its target from."""
    key = permutation_key(np.arange(1, n + 1, dtype=np.int64), day, seed)
    return np.argsort(key, kind="stable")


def permuted_sums(panel: DataFrame, features: Sequence[str], target: str, seeds: Sequence[int],
                  date: str = "date", ticker: str = "ticker") -> DataFrame:
    """(date, perm, sums): feature-target sums per date under each seed; perm 0 is the target as it is.

    Only rows with a target take part, so every permutation keeps the date's feature moments. A task
    holds the names of one date and a block of BLOCK_CELLS numbers.
    """
    ship_package(panel.sparkSession)
    seeds, k = list(seeds), len(features)
    cols = [c.alias(f"x{i}") for i, c in enumerate(imputed(features))]
    rows = panel.where(F.col(target).isNotNull()).select(
        date, ticker, F.unix_date(F.col(date).cast("date")).alias("_day"), F.col(target).cast("double").alias("_t"), *cols)

    def sums(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(ticker, kind="stable")
        x, t, day = part[[f"x{i}" for i in range(k)]].to_numpy(), part["_t"].to_numpy(), int(part["_day"].iloc[0])
        drawn = lambda s: t if s is None else t[permuted_places(len(t), day, s)]
        every = [None, *seeds]
        out = [(x.T @ np.stack([drawn(s) for s in every[b]], axis=1)).T for b in _blocks(len(t), len(every))]
        return pd.DataFrame({date: part[date].iloc[0], "perm": np.arange(len(every)), "sums": list(np.concatenate(out))})

    kind = panel.schema[date].dataType.simpleString()
    return rows.repartition(fine_parts(panel.sparkSession), date).groupBy(date).applyInPandas(sums, f"{date} {kind}, perm int, sums array<double>")


def permutation_ic(panel: DataFrame, features: Sequence[str], *, permutations: int = 200, seed: int = 42, target: str = "target",
                   params: WalkForwardParams = WalkForwardParams(), spec: dict | None = None, fwd: str = "forward_return",
                   date: str = "date", ticker: str = "ticker") -> DataFrame:
    """(perm, date, ic): out-of-sample rank correlation per date; perm 0 is trained on the real target.

    The panel is written once and read three times: moments, feature-target sums, scores. Prefix sums run over
    one short row per date and permutation, and the fits are broadcast by date, ``permutations`` vectors each.
    """
    features, seeds = list(features), [seed + b for b in range(permutations)]
    ship_package(panel.sparkSession)
    panel = settle(panel, "panel")
    p, cal = len(features), calendar(panel, date)
    folds = fold_table(panel, params, date)
    upto = Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)  # one row per calendar date
    moments = date_sums(panel, features, target, date)
    cols = [c for c in moments.columns if c != date]
    gram = cal.join(moments, date, "left").na.fill(0.0, cols).select(
        (F.col("pos") + 1).alias("train_end_pos"), F.array(*(F.sum(c).over(upto) for c in cols)).alias("gram"))
    own = Window.partitionBy("perm").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    zeros = F.array_repeat(F.lit(0.0), p)
    perms = cal.select(date, "pos", F.explode(F.sequence(F.lit(0), F.lit(permutations))).alias("perm"))
    sums = permuted_sums(panel, features, target, seeds, date, ticker)
    vectors = perms.join(sums, [date, "perm"], "left").withColumn("sums", F.coalesce("sums", zeros)).select(
        "perm", (F.col("pos") + 1).alias("train_end_pos"), F.array(*(F.sum(F.col("sums")[i]).over(own) for i in range(p))).alias("sums"))
    # where the target's products stand among the upper triangle of (1, features, target)
    place, swap = 0, {}
    for i in range(p + 2):
        for j in range(i, p + 2):
            if j == p + 1 and 1 <= i <= p:
                swap[place] = i - 1
            place += 1
    entries = [F.col("sums")[swap[k]] if k in swap else F.col("gram")[k] for k in range(place)]
    chosen = default_params(spec or ELASTIC_NET)
    ends = folds.select("fold", "train_end_pos").distinct()
    jobs = (ends.join(gram, "train_end_pos").where(F.col("gram")[0] >= params.min_rows_per_fold).join(vectors, "train_end_pos")
            .select("fold", "perm", F.lit(float(chosen["alpha"])).alias("alpha"), F.lit(float(chosen["l1_ratio"])).alias("l1_ratio"),
                    F.array(*entries).alias("gram")))
    models = settle(solve(jobs, p, ["fold", "perm"]), "models")
    per_fold = models.groupBy("fold").agg(F.sort_array(F.collect_list(F.struct("perm", "intercept", "coef"))).alias("models"))
    by_date = folds.select("fold", F.col("test_date").alias(date)).join(per_fold, "fold")
    rows = panel.where(F.col(fwd).isNotNull()).select(
        date, F.col(fwd).cast("double").alias("_y"), *(c.alias(f"x{i}") for i, c in enumerate(imputed(features))))

    def correlate(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({date: pd.Series([], dtype=object), "perm": pd.Series([], dtype="int32"), "ic": pd.Series([], dtype=float)})
        if len(left) < MIN_PAIRS or right.empty:
            return empty
        fits = right["models"].iloc[0]
        beta = np.array([f["coef"] for f in fits], float)
        x, y = left[[f"x{i}" for i in range(p)]].to_numpy(), left["_y"].to_numpy()
        add = np.array([f["intercept"] for f in fits])
        ic = np.full(len(fits), np.nan)
        if not np.isnan(y).any():
            dy = average_ranks(y) - (len(y) + 1) / 2
            for b in _blocks(len(y), len(fits)):
                scores = np.round(x @ beta[b].T + add[b], 9)
                for at, score in enumerate(scores.T, b.start):
                    if np.isnan(score).any():
                        continue
                    dx = average_ranks(score) - (len(y) + 1) / 2
                    size = np.sqrt((dx * dx).sum() * (dy * dy).sum())
                    if size > 0:
                        ic[at] = (dx * dy).sum() / size
        out = pd.DataFrame({date: left[date].iloc[0], "perm": [f["perm"] for f in fits], "ic": ic})
        return out.dropna()

    kind = panel.schema[date].dataType.simpleString()
    n = fine_parts(panel.sparkSession)
    rows, by_date = rows.repartition(n, date), by_date.repartition(n, date)
    return rows.groupBy(date).cogroup(by_date.groupBy(date)).applyInPandas(correlate, f"{date} {kind}, perm int, ic double")


def permutation_test(ic: DataFrame) -> DataFrame:
    """One row: the real t-statistic, the number of permutations, how many reach it, and the p-value.

    ``ic`` as from :func:`permutation_ic`. The p-value counts the real series among the permuted ones, so it
    is never 0; permutations without a scoreable month count as not reaching it.
    """
    stats = ic_summary(ic, ["perm"]).select("perm", "t_stat")
    real = stats.where("perm = 0").select(F.abs("t_stat").alias("real"), F.col("t_stat").alias("t_real"))
    reached = stats.where("perm > 0").join(F.broadcast(real), F.abs("t_stat") >= F.col("real"), "left")  # one row
    tried = ic.agg(F.max("perm").alias("n")).scalar()
    return reached.agg(F.max("t_real").alias("_t"), F.count("real").alias("n_reached")).select(
        real.select("t_real").scalar().alias("t_stat"), tried.cast("long").alias("n_permutations"), "n_reached",
        ((F.col("n_reached") + 1) / (tried + 1)).alias("p_value"))
