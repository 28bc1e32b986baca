"""Factor attribution: least squares per strategy on shared monthly factors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FACTORS = ("mkt_rf", "smb", "hml", "rmw", "cma", "mom")


def _solve(k: int, by: Sequence[str]):
    """Batch solver: each input row carries one group's cross-product sums."""
    size = k + 2  # intercept, factors, response
    upper = np.triu_indices(size)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                g = np.zeros((size, size))
                g[upper] = row.gram
                g = g + np.triu(g, 1).T
                n = int(round(g[0, 0]))
                head = {c: getattr(row, c) for c in by} | {"n_months": n, "error": None}
                if n < k + 2:
                    none = [None] * k
                    out.append(head | {"coefs": none, "tstats": none, "error": "too few common months"})
                    continue
                # centre on the means: better conditioned than the raw normal equations
                mean = g[0, 1:] / n
                c = g[1:, 1:] - n * np.outer(mean, mean)
                sxx, sxy, syy = c[:k, :k], c[:k, k], c[k, k]
                inv = np.linalg.pinv(sxx)
                beta = inv @ sxy
                alpha = mean[k] - mean[:k] @ beta
                rss = max(syy - beta @ sxy, 0.0)
                s2 = rss / (n - k - 1)
                se = np.sqrt(s2 * np.diag(inv))
                se_alpha = np.sqrt(s2 * (1.0 / n + mean[:k] @ inv @ mean[:k]))
                with np.errstate(divide="ignore", invalid="ignore"):
                    t, ta = beta / se, alpha / se_alpha
                    r2 = 1 - rss / syy if syy > 0 else np.nan
                num = lambda v: float(v) if np.isfinite(v) else None
                out.append(head | {
                    "alpha_monthly": num(alpha), "alpha_annual": num((1 + alpha) ** 12 - 1),
                    "alpha_tstat": num(ta), "r_squared": num(r2),
                    "coefs": [num(b) for b in beta], "tstats": [num(x) for x in t]})
            yield pd.DataFrame(out, columns=[*by, "alpha_monthly", "alpha_annual", "alpha_tstat",
                                             "r_squared", "coefs", "tstats", "n_months", "error"])

    return run


def factor_attribution(returns: DataFrame, factors: DataFrame, *, by: Sequence[str] = ("strategy",),
                       ret: str = "net", date: str = "date",
                       factor_cols: Sequence[str] = FACTORS) -> DataFrame:
    """Regress each group's return in excess of ``rf`` on the factors.

    Months are matched by calendar month. Spark reduces each group to its cross-product
    sums; only those (one short row per group) go to the solver.
    """
    by = list(by)
    cols = [c for c in factor_cols if c in factors.columns]
    right = factors.select(F.trunc(date, "MM").alias("_m"), *cols, "rf").dropna()
    left = returns.where(F.col(ret).isNotNull()).select(*by, F.trunc(date, "MM").alias("_m"), F.col(ret).alias("_r"))
    joined = left.join(right, "_m")
    terms = [F.lit(1.0), *(F.col(c) for c in cols), F.col("_r") - F.col("rf")]
    pairs = [(i, j) for i in range(len(terms)) for j in range(i, len(terms))]
    gram = joined.groupBy(*by).agg(F.array(*(F.sum(terms[i] * terms[j]) for i, j in pairs)).alias("gram"))
    series = T.ArrayType(T.DoubleType())
    schema = T.StructType(
        [gram.schema[c] for c in by]
        + [T.StructField(c, T.DoubleType()) for c in ("alpha_monthly", "alpha_annual", "alpha_tstat", "r_squared")]
        + [T.StructField("coefs", series), T.StructField("tstats", series),
           T.StructField("n_months", T.IntegerType()), T.StructField("error", T.StringType())])
    solved = gram.mapInPandas(_solve(len(cols), by), schema)
    names = F.array(*(F.lit(c) for c in cols))
    return solved.select(*by, "alpha_monthly", "alpha_annual", "alpha_tstat", "r_squared",
                         F.map_from_arrays(names, "coefs").alias("betas"),
                         F.map_from_arrays(names, "tstats").alias("beta_tstats"), "n_months", "error")


def coefficient_table(attribution: DataFrame, by: Sequence[str] = ("strategy",)) -> DataFrame:
    """One row per coefficient: (by, name, coef, t_stat)."""
    intercept = attribution.select(*by, F.lit("alpha").alias("name"), F.col("alpha_monthly").alias("coef"),
                                   F.col("alpha_tstat").alias("t_stat"))
    slopes = attribution.select(*by, F.explode("betas").alias("name", "coef"), "beta_tstats").select(
        *by, "name", "coef", F.try_element_at("beta_tstats", F.col("name")).alias("t_stat"))
    return intercept.unionByName(slopes)
