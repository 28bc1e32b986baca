"""Model store: one manifest row and one pipeline folder per model version."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factorloom.models.pipelines import drop_internals
from factorloom.schema import require_columns

MANIFEST = T.StructType([
    T.StructField("model_version", T.StringType()), T.StructField("model_name", T.StringType()),
    T.StructField("horizon", T.StringType()), T.StructField("feature_list", T.ArrayType(T.StringType())),
    T.StructField("hyperparams", T.StringType()), T.StructField("normalization", T.StringType()),
    T.StructField("target", T.StringType()), T.StructField("train_start", T.StringType()),
    T.StructField("train_end", T.StringType()), T.StructField("n_train_rows", T.LongType()),
    T.StructField("oos_metrics", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("code_sha", T.StringType()), T.StructField("created_at", T.StringType())])


@dataclass
class Manifest:
    model_version: str
    model_name: str
    horizon: str
    feature_list: list[str]
    hyperparams: dict
    normalization: str
    target: str
    train_start: str
    train_end: str
    n_train_rows: int
    oos_metrics: dict = field(default_factory=dict)
    code_sha: str = ""
    created_at: str = ""

    def row(self) -> dict:
        return asdict(self) | {"hyperparams": json.dumps(self.hyperparams, sort_keys=True)}


class ModelStore:
    """``<root>/manifests`` (one JSON row per version) and ``<root>/models/<version>``.

    The manifest is appended after the model folder is complete, so a listed version can
    always be loaded.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def save(self, model: PipelineModel, manifest: Manifest) -> None:
        model.write().overwrite().save(f"{self.root}/models/{manifest.model_version}")
        row = self.spark.createDataFrame([manifest.row()], MANIFEST)
        row.coalesce(1).write.mode("append").json(f"{self.root}/manifests")

    def manifests(self) -> DataFrame:
        return self.spark.read.schema(MANIFEST).json(f"{self.root}/manifests")

    def manifest(self, horizon: str, version: str = "latest") -> Manifest:
        rows = self.manifests().where(F.col("horizon") == horizon)
        if version == "latest":
            rows = rows.orderBy(F.col("created_at").desc(), F.col("model_version").desc())
        else:
            rows = rows.where(F.col("model_version") == version)
        hit = rows.limit(1).collect()
        if not hit:
            raise FileNotFoundError(f"no model for horizon {horizon!r}, version {version!r}")
        values = hit[0].asDict(recursive=True)
        return Manifest(**(values | {"hyperparams": json.loads(values["hyperparams"])}))

    def load(self, horizon: str, version: str = "latest") -> tuple[PipelineModel, Manifest]:
        m = self.manifest(horizon, version)
        return PipelineModel.load(f"{self.root}/models/{m.model_version}"), m


def newest_model(registry: DataFrame, horizon: str = "1m") -> DataFrame:
    """Newest version of a horizon by (created_at, version)."""
    return registry.where(F.col("horizon") == horizon).agg(
        F.max_by("model_version", F.struct("created_at", "model_version")).alias("model_version"))


def newest_models(registry: DataFrame) -> DataFrame:
    return registry.groupBy("horizon").agg(
        F.max_by("model_version", F.struct("created_at", "model_version")).alias("model_version"))


def score(model: PipelineModel, manifest: Manifest, rows: DataFrame) -> DataFrame:
    """Score with the skew guard: every manifest feature must be present."""
    require_columns(rows, manifest.feature_list, "live features (train/serve skew):")
    return drop_internals(model.transform(rows))


def load_oos_predictions(predictions: DataFrame, panel: DataFrame, model_version: str, horizon: str = "1m") -> DataFrame:
    """Scores of one model with the realised forward return and sector."""
    own = predictions.where((F.col("model_version") == model_version) & (F.col("horizon") == horizon))
    return own.join(panel.select("date", "ticker", "forward_return", "gics_sector"), ["date", "ticker"], "left").select(
        "date", "ticker", F.col("score").alias("pred"), "forward_return", "gics_sector")
