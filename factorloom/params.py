"""Default parameters, as frozen dataclasses (one per stage)."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class PanelParams:
    return_bounds: tuple[float, float] = (-0.95, 3.0)
    scheme: str = "rank"
    sector_neutral: bool = True
    winsorize_pct: float = 0.01


@dataclass(frozen=True)
class DailyPanelParams:
    return_bounds: tuple[float, float] = (-0.9, 2.0)
    horizons: tuple[int, ...] = (5, 10, 30)
    scheme: str = "rank"
    sector_neutral: bool = True
    winsorize_pct: float = 0.01


@dataclass(frozen=True)
class UniverseParams:
    min_price: float = 5.0
    min_dollar_volume: float = 1_000_000.0
    adv_window: int = 60
    adv_min_periods: int = 30


@dataclass(frozen=True)
class WalkForwardParams:
    min_train_months: int = 36
    test_months: int = 1
    embargo_months: int = 1
    min_rows_per_fold: int = 20


@dataclass(frozen=True)
class TuningParams:
    retune_every: int = 12
    inner_splits: int = 3
    inner_embargo_months: int = 1
    inner_min_train_months: int = 24


@dataclass(frozen=True)
class PortfolioParams:
    n_holdings: int = 30
    buffer_rank: int = 90
    max_weight: float = 0.08


@dataclass(frozen=True)
class CostParams:
    commission_bps: float = 1.0
    spread_bps: float = 5.0

    @property
    def per_side(self) -> float:
        return (self.commission_bps + self.spread_bps) / 10_000.0


@dataclass(frozen=True)
class RebalanceParams:
    portfolio: PortfolioParams = field(default_factory=PortfolioParams)
    costs: CostParams = field(default_factory=CostParams)
    min_price: float = 5.0
    drift_band: float = 0.25
    min_trade: float = 100.0


# List values are search candidates, their first entry is the default.
ELASTIC_NET = {"alpha": [0.001, 0.0001, 0.01], "l1_ratio": [0.5, 0.2, 0.8]}
BOOSTED_TREES = {
    "maxIter": [500, 300],
    "stepSize": [0.02, 0.05],
    "maxDepth": [5, 6],
    "subsamplingRate": 0.8,
    "featureSubsetStrategy": "0.8",
    "minInstancesPerNode": 100,
}

IMPUTE_FILL = 0.5
LOOKAHEAD_TOLERANCE_DAYS = 60
REBASE_TOLERANCE = 0.02
PANEL_MIN_TARGET_COVERAGE = 0.80
ACTIVE_MIN_KEEP_FRACTION = 0.5
# Suspect monthly move: up by more than the first, or down past the second.
SUSPECT_MOVES = (1.0, -0.75)
