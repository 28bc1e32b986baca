"""Train, deploy and serve."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.functions.cross_section import row_numbers
from factorloom.models import walkforward
from factorloom.models.grid import default_params
from factorloom.models.pipelines import get_factory
from factorloom.models.registry import Manifest, ModelStore, score
from factorloom.operators.evaluate import ic_summary, information_coefficient
from factorloom.params import TuningParams, WalkForwardParams


@dataclass
class TrainResult:
    oos: DataFrame | None
    summary: dict
    manifest: Manifest | None
    tuning_history: list


def make_version(model: str, horizon: str, created: datetime | None = None) -> str:
    created = created or datetime.now(timezone.utc)
    return f"{model}-{horizon}-{created:%Y%m%d%H%M%S}"


def train_and_deploy(panel: DataFrame, features: Sequence[str], *, model_name: str = "boosted_trees", spec: dict,
                     horizon: str = "1m", store: ModelStore | None = None, tuning: TuningParams | None = None,
                     params: WalkForwardParams = WalkForwardParams(), scheme: str = "rank",
                     code_sha: str = "") -> TrainResult:
    """Walk-forward out-of-sample estimate, then one deployment fit on every labelled row."""
    oos, history = walkforward.walk_forward_predict(panel, model_name, features, spec=spec, params=params, tuning=tuning)
    if oos is None:
        return TrainResult(None, {}, None, history)
    summary = ic_summary(information_coefficient(oos, "pred")).first()
    summary = summary.asDict() if summary else {}
    if store is None:
        return TrainResult(oos, summary, None, history)
    rows = panel.where(F.col("target").isNotNull())
    chosen = default_params(spec)
    if tuning is not None:
        dates = [r["date"] for r in rows.select("date").distinct().orderBy("date").collect()]  # calendar-bounded
        chosen, _ = walkforward.tune(rows, model_name, spec, features, dates, tuning=tuning,
                                     min_rows=params.min_rows_per_fold)
    model = get_factory(model_name, features, chosen)(rows).fit(rows)
    span = rows.agg(F.min("date").alias("lo"), F.max("date").alias("hi"), F.count(F.lit(1)).alias("n")).first()
    now = datetime.now(timezone.utc)
    manifest = Manifest(
        make_version(model_name, horizon, now), model_name, horizon, list(features), chosen, scheme, "target",
        str(span["lo"]), str(span["hi"]), int(span["n"]),
        {k: summary.get(k) for k in ("ic_mean", "ic_ir", "t_stat", "hit_rate")}, code_sha,
        now.isoformat(timespec="seconds"))
    store.save(model, manifest)
    return TrainResult(oos, summary, manifest, history)


def cross_section_at(panel: DataFrame, asof: str | None = None, date: str = "date") -> DataFrame:
    """Rows of the newest date, or of ``asof``; the date test reaches the scan."""
    day = F.lit(asof).cast("date") if asof else panel.agg(F.max(date)).scalar()
    return panel.where(F.col(date) == day)


def rank_cross_section(scored: DataFrame, score_col: str = "pred", wide_groups: bool = True) -> DataFrame:
    """Best first: ranks 1..n by score, then ticker."""
    return row_numbers(scored.where(F.col(score_col).isNotNull()), ["date"], score_col, "ticker",
                       descending=True, out="rank", wide_groups=wide_groups)


def latest_recommendations(panel: DataFrame, store: ModelStore, *, horizon: str = "1m", version: str = "latest",
                           asof: str | None = None, wide_groups: bool = False) -> tuple[DataFrame, Manifest]:
    """Score the newest (or ``asof``) cross-section with the deployed model and rank it."""
    model, manifest = store.load(horizon, version)
    cross = cross_section_at(panel, asof)
    if cross.isEmpty():
        raise ValueError(f"no panel rows for {asof or 'the newest date'}")
    return rank_cross_section(score(model, manifest, cross), wide_groups=wide_groups), manifest
