"""Walk-forward evaluation of any Spark ML pipeline, with nested tuning.

Fits are driven from the driver (a fit is a job), a few in flight at once; data stays in
the cluster. The panel is written once to the shared scratch folder and read by every fold
with its date range pushed into the scan, which also cuts the lineage.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.models.folds import fold_bounds, fold_table
from factorloom.models.grid import default_params, param_grid
from factorloom.models.pipelines import drop_internals, get_factory
from factorloom.operators.evaluate import information_coefficient
from factorloom.params import TuningParams, WalkForwardParams
from factorloom.session import settle


def _between(panel: DataFrame, lo, hi, date: str = "date") -> DataFrame:
    return panel.where((F.col(date) >= F.lit(lo)) & (F.col(date) <= F.lit(hi)))


def _fit_score(panel, name, features, params, target, train_hi, test_lo, test_hi, min_rows):
    train = panel.where((F.col("date") <= F.lit(train_hi)) & F.col(target).isNotNull())
    if train.limit(min_rows).count() < min_rows:
        return None
    model = get_factory(name, features, params, target)(train).fit(train)
    return drop_internals(model.transform(_between(panel, test_lo, test_hi)))


def tune(panel: DataFrame, name: str, spec: dict, features: Sequence[str], dates: Sequence, *,
         target: str = "target", tuning: TuningParams = TuningParams(), min_rows: int = 20) -> tuple[dict, float | None]:
    """Best grid point on the last dates of the training window, by mean inner IC."""
    grid = param_grid(spec)
    k, emb = tuning.inner_splits, tuning.inner_embargo_months
    inner_min = len(dates) - k - emb
    if len(grid) == 1 or inner_min < tuning.inner_min_train_months:
        return default_params(spec), None
    best, best_score = None, None
    for params in grid:
        parts = []
        for i in range(k):
            val = dates[inner_min + i + emb]
            scored = _fit_score(panel, name, features, params, target, dates[inner_min + i - 1], val, val, min_rows)
            if scored is not None:
                parts.append(scored.select("date", "pred", "forward_return"))
        if not parts:
            continue
        ic = information_coefficient(reduce(DataFrame.unionByName, parts), "pred")
        score = ic.agg(F.avg("ic")).first()[0]
        if score is not None and (best_score is None or score > best_score):
            best, best_score = params, score
    return (best, best_score) if best is not None else (default_params(spec), None)


def walk_forward_predict(panel: DataFrame, name: str, features: Sequence[str], *, spec: dict,
                         target: str = "target", params: WalkForwardParams = WalkForwardParams(),
                         tuning: TuningParams | None = None, parallel_fits: int = 2,
                         is_stored: bool = False) -> tuple[DataFrame | None, list[dict]]:
    """(test rows with ``pred`` and ``fold``, tuning history); (None, []) when no fold fits.

    A panel that is stored already (``is_stored``) isn't written again.
    """
    stored = panel if is_stored else settle(panel, "walkforward")
    bounds = fold_bounds(fold_table(stored, params), stored).orderBy("fold").collect()  # calendar-bounded
    dates = [r["date"] for r in stored.select("date").distinct().orderBy("date").collect()] if tuning else []
    history, jobs, current = [], [], default_params(spec)
    for b in bounds:
        if tuning is not None and b["fold"] % tuning.retune_every == 0:
            known = stored.where(F.col("date") <= F.lit(b["train_last"]))
            current, score = tune(known, name, spec, features, dates[:b["n_train"]], target=target,
                                  tuning=tuning, min_rows=params.min_rows_per_fold)
            history.append({"fold": b["fold"], "date": b["test_first"], "params": current, "inner_ic": score})
        jobs.append((b, current))

    def fit(job):
        b, p = job
        scored = _fit_score(stored, name, features, p, target, b["train_last"], b["test_first"], b["test_last"],
                            params.min_rows_per_fold)
        return None if scored is None else scored.withColumn("fold", F.lit(b["fold"]))

    with ThreadPoolExecutor(parallel_fits) as pool:
        parts = [p for p in pool.map(fit, jobs) if p is not None]
    return (reduce(DataFrame.unionByName, parts) if parts else None), history


# The multipliers and the prime of the permutations, plain arithmetic that any engine repeats.
_PRIME, _STEP, _SHIFT = 2_147_483_647, 1_103_515_245, 69_069


def permutation_constants(seed: int) -> tuple[int, int]:
    """Factor and shift of a seeded permutation."""
    return (seed * _STEP + 12_345) % _PRIME, (seed * _SHIFT + 1) % _PRIME


def permutation_key(place, day, seed: int):
    """Where the ``place``-th name of a day stands in the seeded order: a cube modulo a prime. Columns or integer arrays."""
    factor, shift = permutation_constants(seed)
    u = (place * factor + day * shift + shift) % _PRIME
    return u * u % _PRIME * u % _PRIME


def shuffle_target(panel: DataFrame, target: str = "target", date: str = "date", ticker: str = "ticker",
                   seed: int = 42, wide_groups: bool = False) -> DataFrame:
    """Permute the target within each date (leakage test).

    The k-th name of a date by ticker gets the target of the k-th name by a seeded key of the
    place, so the permutation is reproducible whatever the partitioning.
    """
    from factorloom.functions.cross_section import row_numbers

    one = panel.select(date, ticker, F.col(target).alias("_t"), F.lit(0.0).alias("_c"))
    slots = row_numbers(one, [date], "_c", ticker, out="_k", wide_groups=wide_groups).drop("_c")
    key = permutation_key(F.col("_k").cast("long"), F.unix_date(F.col(date).cast("date")).cast("long"), seed)
    drawn = row_numbers(slots.select(date, ticker, key.cast("double").alias("_h"), "_t"), [date], "_h", ticker,
                        out="_k", wide_groups=wide_groups).select(date, "_k", "_t")
    shuffled = slots.drop("_t").join(drawn, [date, "_k"]).select(date, ticker, F.col("_t").alias(target))
    return panel.drop(target).join(shuffled, [date, ticker])


def leakage_passed(summary: DataFrame) -> DataFrame:
    """A shuffled target must leave no scoreable month or an insignificant IC."""
    ok = (F.coalesce(F.max("n_months"), F.lit(0)) == 0) | (F.abs(F.max("t_stat")) < 2.0)
    return summary.agg(F.coalesce(ok, F.lit(False)).alias("passed"), F.max("t_stat").alias("t_stat"),
                       F.coalesce(F.max("n_months"), F.lit(0)).alias("n_months"))
