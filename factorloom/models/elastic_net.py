"""Walk-forward elastic net for all folds and parameters in one pass.

An expanding fold's training set is a prefix of the dates, and a linear model needs only
cross-product sums of it. Those sums are taken per date (one grouped aggregate with
map-side combine), turned into prefix sums over the calendar, and every (fold, parameter)
pair becomes one small solve on a vector of sums. The panel is read once, whatever the
number of folds and parameters, and scoring is a join on date.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factorloom.models.folds import fold_table, inner_folds, retune_fold
from factorloom.models.grid import param_grid
from factorloom.operators.calendar import calendar, with_position
from factorloom.operators.evaluate import spearman
from factorloom.params import ELASTIC_NET, IMPUTE_FILL, TuningParams, WalkForwardParams
from factorloom.session import settle


def imputed(features: Sequence[str], fill: float = IMPUTE_FILL) -> list[Column]:
    return [F.coalesce(F.col(f).cast("double"), F.lit(fill)) for f in features]


def date_sums(panel: DataFrame, features: Sequence[str], target: str, date: str = "date") -> DataFrame:
    """Cross-product sums of (1, features, target) per date over rows with a target."""
    z = [F.lit(1.0), *imputed(features), F.col(target).cast("double")]
    rows = panel.where(F.col(target).isNotNull()).select(date, *(c.alias(f"z{i}") for i, c in enumerate(z)))
    pairs = [(i, j) for i in range(len(z)) for j in range(i, len(z))]
    return rows.groupBy(date).agg(*(
        F.sum(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"g{k}") for k, (i, j) in enumerate(pairs)))


def prefix_sums(sums: DataFrame, cal: DataFrame, date: str = "date") -> DataFrame:
    """Rows (train_end_pos, gram): sums over the dates before that position.

    One row per calendar date goes through the unpartitioned window, so it is bounded by the
    calendar.
    """
    cols = [c for c in sums.columns if c != date]
    w = Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    dense = cal.join(sums, date, "left").na.fill(0.0, cols)
    return dense.select((F.col("pos") + 1).alias("train_end_pos"),
                        F.array(*(F.sum(c).over(w) for c in cols)).alias("gram"))


def coordinate_descent(sxx: np.ndarray, sxy: np.ndarray, alpha: np.ndarray, l1_ratio: np.ndarray,
                       tol: float = 1e-10, max_iter: int = 5000) -> np.ndarray:
    """Minimise 1/2 b'Sb - b's + alpha * l1 * |b|_1 + alpha * (1 - l1) / 2 * |b|^2 for a
    batch of problems: S is (batch, p, p), s is (batch, p), both centred second moments."""
    beta, residual = np.zeros_like(sxy), sxy.copy()
    l1, l2 = alpha * l1_ratio, alpha * (1 - l1_ratio)
    diag = np.diagonal(sxx, axis1=1, axis2=2)
    scale = np.where(diag > 0, diag + l2[:, None], 1.0)
    for _ in range(max_iter):
        moved = 0.0
        for j in range(sxy.shape[1]):
            rho = residual[:, j] + diag[:, j] * beta[:, j]
            new = np.sign(rho) * np.maximum(np.abs(rho) - l1, 0.0) / scale[:, j]
            step = np.where(diag[:, j] > 0, new - beta[:, j], 0.0)
            residual -= step[:, None] * sxx[:, :, j]
            beta[:, j] += step
            moved = max(moved, np.abs(step).max(initial=0.0))
        if moved < tol:
            break
    return beta


def _solver(p: int, id_cols: Sequence[str]):
    upper = np.triu_indices(p + 2)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            g = np.zeros((len(pdf), p + 2, p + 2))
            sums = np.stack(pdf["gram"].to_list()) if len(pdf) else np.zeros((0, len(upper[0])))
            g[:, upper[0], upper[1]] = sums
            g[:, upper[1], upper[0]] = sums
            n = g[:, 0, 0]
            mean = g[:, 0, 1:] / n[:, None]
            m2 = g[:, 1:, 1:] / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
            beta = coordinate_descent(m2[:, :p, :p], m2[:, :p, p].copy(), pdf["alpha"].to_numpy(),
                                      pdf["l1_ratio"].to_numpy())
            out = pdf[list(id_cols)].copy()
            out["intercept"] = mean[:, p] - (mean[:, :p] * beta).sum(axis=1)
            out["coef"] = list(beta)
            yield out

    return run


def solve(jobs: DataFrame, n_features: int, id_cols: Sequence[str]) -> DataFrame:
    """jobs (ids, alpha, l1_ratio, gram) -> (ids, intercept, coef).

    A job is a few kilobytes and a batch of them is solved at once; the jobs are spread
    over the cluster's cores.
    """
    kinds = [jobs.schema[c] for c in id_cols]
    schema = T.StructType([*kinds, T.StructField("intercept", T.DoubleType()),
                           T.StructField("coef", T.ArrayType(T.DoubleType()))])
    width = jobs.sparkSession.sparkContext.defaultParallelism
    return jobs.repartition(width, *id_cols).mapInPandas(_solver(n_features, id_cols), schema)


def linear_score(features: Sequence[str]) -> Column:
    terms = [c * F.col("coef")[i] for i, c in enumerate(imputed(features))]
    return sum(terms, F.col("intercept"))


def _grid_column(grid: Sequence[dict]) -> Column:
    return F.explode(F.array(*(F.struct(
        F.lit(i).alias("param_id"), F.lit(float(g["alpha"])).alias("alpha"),
        F.lit(float(g["l1_ratio"])).alias("l1_ratio")) for i, g in enumerate(grid))))


def tune(panel: DataFrame, prefixes: DataFrame, folds: DataFrame, features: Sequence[str], *,
         grid: Sequence[dict], tuning: TuningParams, cal: DataFrame, fwd: str = "forward_return",
         min_rows: int = 20, date: str = "date", wide_groups: bool = False) -> DataFrame:
    """Best parameters per re-tuning fold: (fold, param_id, inner_ic).

    All (fold, inner fold, parameter) fits are rows of one solve; validation dates are
    scored in one join and judged by the mean per-date IC. Ties go to the earlier
    candidate.
    """
    inner = inner_folds(folds, tuning)
    jobs = (inner.join(F.broadcast(prefixes), "train_end_pos")
            .where(F.col("gram")[0] >= min_rows)
            .select("fold", "inner", "val_pos", _grid_column(grid).alias("g"), "gram")
            .select("fold", "inner", "val_pos", "g.*", "gram"))
    models = solve(jobs, len(features), ["fold", "inner", "val_pos", "param_id"])
    # bounded by calendar dates x grid size
    scored = (with_position(panel.where(F.col(fwd).isNotNull()), cal, date=date)
              .join(F.broadcast(models), F.col("pos") == F.col("val_pos"))
              .select("fold", "inner", "param_id", linear_score(features).alias("x"),
                      F.col(fwd).cast("double").alias("y")))
    ic = spearman(scored, ["fold", "inner", "param_id"], wide_groups=wide_groups)
    # rounded, so that candidates which rank alike tie whatever the order of the sum
    mean = ic.groupBy("fold", "param_id").agg(F.round(F.avg("ic"), 12).alias("inner_ic"))
    best = mean.groupBy("fold").agg(F.max(F.struct("inner_ic", (-F.col("param_id")).alias("_p"))).alias("b"))
    return best.select("fold", (-F.col("b._p")).alias("param_id"), F.col("b.inner_ic").alias("inner_ic"))


def walk_forward(panel: DataFrame, features: Sequence[str], *, target: str = "target",
                 params: WalkForwardParams = WalkForwardParams(), spec: dict | None = None,
                 tuning: TuningParams | None = None, fwd: str = "forward_return", date: str = "date",
                 stored: bool = False, wide_groups: bool = False) -> tuple[DataFrame, DataFrame]:
    """Out-of-sample scores for every test date, and the fold models.

    The panel is read several times (calendar, sums, scoring), so unless it is ``stored``
    already it is written once to the shared scratch folder; so are the prefix sums, one
    short row per date.

    Returns (panel rows of the test dates with ``pred`` and ``fold``, fold models with the
    parameters used). Without ``tuning`` the default candidate is used throughout.
    """
    features = list(features)
    grid = param_grid(spec or ELASTIC_NET)
    if not stored:
        panel = settle(panel, "panel")
    cal = calendar(panel, date)
    folds = fold_table(panel, params, date)
    prefixes = settle(prefix_sums(date_sums(panel, features, target, date), cal, date), "prefixes")
    per_fold = folds.groupBy("fold").agg(F.max("train_end_pos").alias("train_end_pos"))
    if tuning is not None and len(grid) > 1:
        chosen = tune(panel, prefixes, folds, features, grid=grid, tuning=tuning, cal=cal, fwd=fwd,
                      min_rows=params.min_rows_per_fold, date=date, wide_groups=wide_groups)
        picked = per_fold.withColumn("_at", retune_fold(F.col("fold"), tuning)).join(
            chosen.withColumnRenamed("fold", "_at"), "_at", "left").drop("_at")
        picked = picked.withColumn("param_id", F.coalesce("param_id", F.lit(0)))
    else:
        picked = per_fold.withColumns({"param_id": F.lit(0), "inner_ic": F.lit(None).cast("double")})
    table = F.array(*(F.struct(F.lit(float(g["alpha"])).alias("alpha"),
                               F.lit(float(g["l1_ratio"])).alias("l1_ratio")) for g in grid))
    jobs = (picked.withColumn("g", F.get(table, F.col("param_id"))).join(F.broadcast(prefixes), "train_end_pos")
            .where(F.col("gram")[0] >= params.min_rows_per_fold)
            .select("fold", "param_id", "inner_ic", "train_end_pos", "g.alpha", "g.l1_ratio", "gram"))
    models = solve(jobs, len(features), ["fold", "param_id", "inner_ic", "train_end_pos", "alpha", "l1_ratio"])
    # one model per fold and one fold per test date: bounded by the calendar
    by_date = folds.select("fold", F.col("test_date").alias(date)).join(
        models.select("fold", "intercept", "coef"), "fold")
    scored = panel.join(F.broadcast(by_date), date)
    return scored.withColumn("pred", linear_score(features)).drop("intercept", "coef"), models


def fit_all(panel: DataFrame, features: Sequence[str], alpha: float, l1_ratio: float,
            target: str = "target", date: str = "date") -> DataFrame:
    """One deployment model on every row with a target: (intercept, coef, n_rows)."""
    sums = date_sums(panel, features, target, date)
    cols = [c for c in sums.columns if c != date]
    total = sums.agg(F.array(*(F.sum(c) for c in cols)).alias("gram")).select(
        F.lit("all").alias("fit"), F.lit(float(alpha)).alias("alpha"), F.lit(float(l1_ratio)).alias("l1_ratio"),
        "gram", F.col("gram")[0].alias("n_rows"))
    return solve(total, len(features), ["fit", "n_rows"]).drop("fit")
