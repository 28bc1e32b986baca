"""Walk-forward folds as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.operators.calendar import calendar
from factorloom.params import TuningParams, WalkForwardParams


def fold_table(dates: DataFrame, params: WalkForwardParams = WalkForwardParams(), date: str = "date") -> DataFrame:
    """One row per (fold, test date): the fold trains on all dates before ``train_end_pos``.

    Expanding windows: fold f trains on the first ``min_train + f * test`` dates, skips the
    embargo and tests the next ``test`` dates. Every test date belongs to one fold, so the
    table is the calendar with two numbers attached.
    """
    cal = calendar(dates, date)
    first = params.min_train_months + params.embargo_months
    step = params.test_months
    fold = F.floor((F.col("pos") - first) / step).cast("int")
    return cal.where(F.col("pos") >= first).select(
        fold.alias("fold"), F.col(date).alias("test_date"), "pos",
        (F.lit(params.min_train_months) + fold * step).cast("int").alias("train_end_pos"))


def fold_bounds(folds: DataFrame, dates: DataFrame, date: str = "date") -> DataFrame:
    """One row per fold with its first and last train and test dates."""
    cal = calendar(dates, date)
    ends = cal.select((F.col("pos") + 1).alias("train_end_pos"), F.col(date).alias("train_last"))
    start = cal.agg(F.min(date)).scalar()
    per = folds.groupBy("fold", "train_end_pos").agg(
        F.min("test_date").alias("test_first"), F.max("test_date").alias("test_last"))
    return per.join(F.broadcast(ends), "train_end_pos").select(
        "fold", start.alias("train_first"), "train_last", F.col("train_end_pos").alias("n_train"),
        "test_first", "test_last")


def inner_folds(folds: DataFrame, tuning: TuningParams = TuningParams()) -> DataFrame:
    """Inner validation points of each re-tuning fold.

    Rows (fold, inner, train_end_pos, val_pos): the last ``inner_splits`` dates of the
    fold's training window, each after its own embargo. Folds whose inner window is too
    short have no rows and fall back to the default parameters.
    """
    one = folds.groupBy("fold").agg(F.max("train_end_pos").alias("n"))
    k, emb = tuning.inner_splits, tuning.inner_embargo_months
    inner_min = F.col("n") - k - emb
    retuned = one.where((F.col("fold") % tuning.retune_every == 0) & (inner_min >= tuning.inner_min_train_months))
    return retuned.select("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("inner"), "n").select(
        "fold", "inner", (F.col("n") - k - emb + F.col("inner")).alias("train_end_pos"),
        (F.col("n") - k + F.col("inner")).alias("val_pos"))


def retune_fold(fold_col, tuning: TuningParams = TuningParams()):
    """The re-tuning fold whose parameters a fold uses."""
    return (F.floor(fold_col / tuning.retune_every) * tuning.retune_every).cast("int")


