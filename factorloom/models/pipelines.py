"""Spark ML pipelines: imputation travels inside the model."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.params import IMPUTE_FILL


def _prepare(features: Sequence[str], fill: float = IMPUTE_FILL) -> list:
    """Constant imputation of every feature, also of all-null ones, then one vector."""
    filled = ", ".join(f"coalesce(cast(`{f}` as double), {fill}) AS `_in_{f}`" for f in features)
    return [SQLTransformer(statement=f"SELECT *, {filled} FROM __THIS__"),
            VectorAssembler(inputCols=[f"_in_{f}" for f in features], outputCol="_features")]


def elastic_net(features: Sequence[str], alpha: float, l1_ratio: float, label_std: float,
                target: str = "target") -> Pipeline:
    """Elastic net with penalty alpha * (l1 * |b| + (1 - l1) / 2 * b^2).

    The learner scales the label by its standard deviation, so the quadratic part of the
    penalty has to be multiplied by it.
    """
    l1, l2 = alpha * l1_ratio, label_std * alpha * (1 - l1_ratio)
    reg = LinearRegression(featuresCol="_features", labelCol=target, predictionCol="pred", standardization=False,
                           regParam=l1 + l2, elasticNetParam=l1 / (l1 + l2) if l1 + l2 else 0.0,
                           maxIter=500, tol=1e-9)
    return Pipeline(stages=[*_prepare(features), reg])


def boosted_trees(features: Sequence[str], params: dict, target: str = "target", seed: int = 7) -> Pipeline:
    keep = {k: v for k, v in params.items() if k in (
        "maxIter", "stepSize", "maxDepth", "subsamplingRate", "featureSubsetStrategy", "minInstancesPerNode", "maxBins")}
    gbt = GBTRegressor(featuresCol="_features", labelCol=target, predictionCol="pred", seed=seed, **keep)
    return Pipeline(stages=[*_prepare(features), gbt])


def label_std(df: DataFrame, target: str = "target") -> float:
    return float(df.agg(F.stddev_samp(target)).first()[0] or 1.0)


Factory = Callable[[DataFrame], Pipeline]


def tree_factory(features: Sequence[str], params: dict, target: str = "target") -> Factory:
    return lambda train: boosted_trees(features, params, target)


def elastic_net_factory(features: Sequence[str], params: dict, target: str = "target") -> Factory:
    return lambda train: elastic_net(features, params["alpha"], params["l1_ratio"], label_std(train, target), target)


FACTORIES = {"elasticnet": elastic_net_factory, "boosted_trees": tree_factory}


def get_factory(name: str, features: Sequence[str], params: dict, target: str = "target") -> Factory:
    if name not in FACTORIES:
        raise ValueError(f"unknown model {name!r}; options: {sorted(FACTORIES)}")
    return FACTORIES[name](features, params, target)


def drop_internals(df: DataFrame) -> DataFrame:
    return df.drop(*(c for c in df.columns if c.startswith("_in_") or c == "_features"))
