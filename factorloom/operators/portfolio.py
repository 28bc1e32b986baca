"""Long-only portfolios: top-N, hold-buffer selection, weights, turnover."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factorloom import params


@dataclass(frozen=True)
class Strategy:
    """One parameter set of the hold-buffer portfolio."""

    name: str = "base"
    n_holdings: int = params.PortfolioParams.n_holdings
    buffer_rank: int = params.PortfolioParams.buffer_rank
    max_weight: float = params.PortfolioParams.max_weight
    cost_bps: float = params.CostParams.commission_bps + params.CostParams.spread_bps

    @property
    def buffer(self) -> int:
        return max(self.buffer_rank, self.n_holdings)

    @property
    def depth(self) -> int:
        """No rank below this is ever kept or bought: at most n names are held, so the
        n-th name not held is within the first 2n."""
        return max(self.buffer, 2 * self.n_holdings)


def top_n(preds: DataFrame, n: int, *, by: Sequence[str] = ("date",), score: str = "pred",
          ticker: str = "ticker") -> DataFrame:
    """Best n rows per group with their ``rank``.

    Spark limits each input partition to n rows per group before the shuffle, so a wide
    date never reaches one task whole.
    """
    w = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(ticker).asc())
    return (preds.where(F.col(score).isNotNull()).withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= n))


def equal_weights(held: DataFrame, by: Sequence[str], max_weight: float) -> DataFrame:
    """min(1/n, cap), renormalised to 1 per group."""
    w = Window.partitionBy(*by)
    raw = F.least(1 / F.count(F.lit(1)).over(w), F.lit(max_weight))
    return held.withColumn("_raw", raw).withColumn(
        "weight", F.col("_raw") / F.sum("_raw").over(w)).drop("_raw")


def _replay(pdf: pd.DataFrame) -> pd.DataFrame:
    """Chain the selection over one strategy's dates; rows arrive pruned by rank."""
    pdf = pdf.sort_values(["date", "rank"], kind="stable")
    n, buffer = int(pdf["n_holdings"].iloc[0]), int(pdf["buffer"].iloc[0])
    held: set = set()
    picks = []
    for _, day in pdf.groupby("date", sort=False):
        is_held = day["ticker"].isin(held)
        kept = day[is_held & (day["rank"] <= buffer)].head(n)
        bought = day[~is_held].head(n - len(kept))
        day_held = pd.concat([kept.assign(action="keep"), bought.assign(action="buy")])
        held = set(day_held["ticker"])
        picks.append(day_held)
    return pd.concat(picks)[["model_version", "strategy", "date", "ticker", "rank", "action"]]


def hold_buffer(preds: DataFrame, strategies: Sequence[Strategy] = (Strategy(),), *,
                score: str = "pred") -> DataFrame:
    """Holdings per (model_version, strategy, date) under the hold-buffer rule.

    A date keeps the held names still ranked within the buffer, best first, and fills the
    free slots with the best names not held; dates are chained. Ranks beyond what any
    strategy can reach are cut first (per input partition), so each chain is replayed over
    at most dates x depth rows, and all models and parameter sets run as one job.
    """
    if "model_version" not in preds.columns:
        preds = preds.withColumn("model_version", F.lit("model"))
    deepest = max(s.depth for s in strategies)
    ranked = top_n(preds.select("model_version", "date", "ticker", score), deepest,
                   by=["model_version", "date"], score=score)
    sets = F.explode(F.array(*(F.struct(
        F.lit(s.name).alias("strategy"), F.lit(s.n_holdings).alias("n_holdings"),
        F.lit(s.buffer).alias("buffer"), F.lit(s.depth).alias("depth")) for s in strategies)))
    runs = ranked.select("model_version", "date", "ticker", "rank", sets.alias("s")).select(
        "model_version", "date", "ticker", "rank", "s.*").where("rank <= depth").drop("depth")
    kinds = {f.name: f.dataType for f in preds.schema.fields}
    schema = T.StructType([
        T.StructField("model_version", kinds["model_version"]), T.StructField("strategy", T.StringType()),
        T.StructField("date", kinds["date"]), T.StructField("ticker", kinds["ticker"]),
        T.StructField("rank", T.IntegerType()), T.StructField("action", T.StringType())])
    return runs.groupBy("model_version", "strategy").applyInPandas(_replay, schema)


def build_portfolio(preds: DataFrame, strategies: Sequence[Strategy] = (Strategy(),), *,
                    score: str = "pred") -> DataFrame:
    """Hold-buffer holdings with weights: (model_version, strategy, date, ticker, weight)."""
    held = hold_buffer(preds, strategies, score=score)
    cap = F
    for s in strategies:
        cap = cap.when(F.col("strategy") == s.name, F.lit(s.max_weight))
    w = Window.partitionBy("model_version", "strategy", "date")
    raw = F.least(1 / F.count(F.lit(1)).over(w), cap)
    return held.withColumn("_raw", raw).select(
        "model_version", "strategy", "date", "ticker", "rank", "action",
        (F.col("_raw") / F.sum("_raw").over(w)).alias("weight"))


def sells(holdings: DataFrame, preds: DataFrame) -> DataFrame:
    """Names held on the previous rebalance date, still scored, but no longer held."""
    key = ["model_version", "strategy"]
    if "model_version" not in preds.columns:
        preds = preds.withColumn("model_version", F.lit("model"))
    dates = holdings.select(*key, "date").distinct()
    nxt = dates.withColumn("_next", F.lead("date").over(Window.partitionBy(*key).orderBy("date")))
    moved = (holdings.join(nxt, [*key, "date"]).where(F.col("_next").isNotNull())
             .select(*key, F.col("_next").alias("date"), "ticker"))
    gone = moved.join(holdings.select(*key, "date", "ticker"), [*key, "date", "ticker"], "left_anti")
    scored = preds.where(F.col("pred").isNotNull()).select("model_version", "date", "ticker")
    return gone.join(scored, ["model_version", "date", "ticker"], "left_semi")


def turnover(portfolio: DataFrame, by: Sequence[str] = ("model_version", "strategy")) -> DataFrame:
    """Half the absolute weight change per rebalance; the first build counts 0.5.

    Every weight is emitted at its own rebalance and, negated, at the next one, and the two
    meet in one aggregate instead of a self-join. A strategy's rows are its rebalance dates
    times its holdings, so the window that numbers the dates is bounded.
    """
    by = list(by)
    w = Window.partitionBy(*by).orderBy("date")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    i = F.dense_rank().over(w)
    placed = portfolio.select(*by, "date", "ticker", "weight", i.alias("_i"), F.max("date").over(whole).alias("_end"))
    moves = placed.select(*by, "ticker", F.explode(F.array(
        F.struct(F.col("_i").alias("i"), F.col("weight").alias("w"), F.col("date").alias("d")),
        F.when(F.col("date") < F.col("_end"), F.struct(
            (F.col("_i") + 1).alias("i"), (-F.col("weight")).alias("w"), F.lit(None).cast("date").alias("d"))))).alias("m"))
    change = moves.where(F.col("m").isNotNull()).groupBy(*by, F.col("m.i").alias("_i"), "ticker").agg(
        F.sum("m.w").alias("_c"), F.max("m.d").alias("_d"))
    total = change.groupBy(*by, "_i").agg(F.sum(F.abs("_c")).alias("_c"), F.max("_d").alias("date"))
    half = F.when(F.col("_i") == 1, F.lit(0.5)).otherwise(F.col("_c") / 2)
    return total.select(*by, "date", half.alias("turnover"))
