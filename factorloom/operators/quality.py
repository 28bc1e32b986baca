"""Data-quality checks.

A check is a named set of aggregate expressions over one table plus a verdict on them. All
checks of a table share a single aggregation pass; key checks add one keyed count. Each
result row: (check, passed, severity, blocking, metadata).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factorloom import params
from factorloom.schema import CONCEPTS, FACTS

ERROR, WARN = "ERROR", "WARN"


@dataclass(frozen=True)
class Check:
    """``metrics``: name -> aggregate; ``verdict``: SQL predicate over the metric names."""

    name: str
    metrics: dict[str, Column]
    verdict: str
    severity: str = ERROR
    blocking: bool = False
    extra: dict[str, str] = field(default_factory=dict)


def run_checks(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """All checks of one table in one pass."""
    def slot(check, metric):
        return f"{check.name}__{metric}"

    sums = df.agg(*(m.alias(slot(k, n)) for k in checks for n, m in k.metrics.items()))
    rows = []
    for k in checks:
        named = F.struct(*(F.col(slot(k, n)).alias(n) for n in k.metrics))
        meta = F.create_map(*(x for n in k.metrics for x in (F.lit(n), F.col(slot(k, n)).cast("string"))))
        rows.append(F.struct(F.lit(k.name).alias("check"), named.alias("m"), meta.alias("metadata"),
                             F.lit(k.severity).alias("severity"), F.lit(k.blocking).alias("blocking")))
    out = None
    for k, row in zip(checks, rows):
        one = sums.select(row.alias("r")).select("r.check", "r.m.*", "r.severity", "r.blocking", "r.metadata")
        one = one.select("check", F.coalesce(F.expr(k.verdict), F.lit(False)).alias("passed"),
                         "severity", "blocking", "metadata")
        out = one if out is None else out.unionByName(one)
    return out


def duplicate_keys(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Number of keys that occur more than once."""
    dups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return run_checks(dups, [Check(name, {"dup_keys": F.count(F.lit(1))}, "dup_keys = 0")])


def universe_checks(universe: DataFrame, lo: int = 2000, hi: int = 5000, min_share: float = 0.90,
                    min_with_sector: int = 2000) -> DataFrame:
    active = F.count_if("is_active")
    tagged = F.count_if(F.col("is_active") & F.col("gics_sector").isNotNull())
    return run_checks(universe, [
        Check("universe_active_band", {"investable": active}, f"investable between {lo} and {hi}", blocking=True),
        Check("universe_sector_coverage", {"investable": active, "with_sector": tagged},
              f"with_sector >= {min_share} * investable and with_sector >= {min_with_sector}", blocking=True),
    ])


def _age(date: str, today: str) -> Column:
    return F.datediff(F.lit(today).cast("date"), F.max(date))


def price_checks(prices: DataFrame, today: str, min_rows: int = 500_000, max_age: int = 45) -> DataFrame:
    bad = F.col("close").isNull() | F.isnan("close") | (F.col("close") <= 0)
    return run_checks(prices, [
        Check("prices_positive", {"bad_rows": F.count_if(bad)}, "bad_rows = 0"),
        Check("prices_freshness", {"latest": F.max("date"), "age_days": _age("date", today)},
              f"age_days <= {max_age}", WARN),
        Check("prices_row_count", {"rows": F.count(F.lit(1))}, f"rows >= {min_rows}"),
    ])


def fact_checks(facts: DataFrame, min_concepts: int = 10,
                tolerance: int = params.LOOKAHEAD_TOLERANCE_DAYS) -> DataFrame:
    early = F.datediff("period_end", "filed_date")
    rows = run_checks(facts, [
        Check("fundamentals_no_lookahead", {"lookahead_rows": F.count_if(early > tolerance),
                                            "snap_forward_rows": F.count_if(early > 0)}, "lookahead_rows = 0"),
        Check("fundamentals_concepts", {"distinct_concepts": F.countDistinct("concept")},
              f"distinct_concepts >= {min_concepts}", WARN),
    ])
    keys = ["ticker", "concept", "period_end", "filed_date"]
    return rows.unionByName(duplicate_keys(facts, keys, "fundamentals_unique_keys"))


def feature_checks(features: DataFrame, min_rows: int = 20_000,
                   tolerance: int = params.LOOKAHEAD_TOLERANCE_DAYS) -> DataFrame:
    lag = F.datediff("availability_date", "period_end")
    rows = run_checks(features, [
        Check("fundamental_features_no_lookahead", {"lookahead_rows": F.count_if(lag < -tolerance)}, "lookahead_rows = 0"),
        Check("fundamental_features_row_count", {"rows": F.count(F.lit(1))}, f"rows >= {min_rows}"),
        Check("fundamental_features_filing_lag", {"negative_lags": F.count_if(lag < 0)}, "negative_lags = 0", WARN),
    ])
    return rows.unionByName(duplicate_keys(features, ["ticker", "period_end"], "fundamental_features_unique_keys"))


def panel_checks(panel: DataFrame, min_rows: int = 500_000, bounds=params.PanelParams.return_bounds,
                 min_coverage: float = params.PANEL_MIN_TARGET_COVERAGE,
                 ranked: Sequence[str] = ("roe", "momentum_12_2", "book_to_price", "target")) -> DataFrame:
    last = panel.agg(F.max("date")).scalar()
    recent = F.col("date") > F.add_months(last, -12)
    outside = reduce(lambda a, b: a | b, (
        F.coalesce((F.col(c) < 0) | (F.col(c) > 1.0001), F.lit(False)) for c in ranked))
    fr = F.col("forward_return")
    # the newest date is a scalar subquery, so the flag is a plain column of the rows
    marked = panel.withColumn("_recent", recent)
    count = lambda c: F.count(F.when(F.col("_recent"), F.col(c)))
    rows = run_checks(marked, [
        Check("panel_monthly_target_coverage",
              {"n_forward": count("forward_return"), "n_target": count("target"), "momentum_rows": count("momentum_12_2")},
              f"n_target >= {min_coverage} * n_forward and n_forward > 0 and momentum_rows > 0", blocking=True),
        Check("panel_monthly_return_bounds", {"out_of_band_rows": F.count_if((fr < bounds[0]) | (fr > bounds[1]))},
              "out_of_band_rows = 0", blocking=True),
        Check("panel_monthly_row_count", {"rows": F.count(F.lit(1))}, f"rows >= {min_rows}", blocking=True),
        Check("panel_monthly_rank_bounds", {"out_of_range_rows": F.count_if(outside)}, "out_of_range_rows = 0"),
    ])
    return rows.unionByName(duplicate_keys(panel, ["date", "ticker"], "panel_monthly_unique_keys"))


def prediction_checks(predictions: DataFrame, panel: DataFrame, registry: DataFrame, horizon: str = "1m",
                      min_rows: int = 50_000, wide_groups: bool = False) -> DataFrame:
    """Row floor, and a positive mean IC of the newest model."""
    from factorloom.models.registry import newest_model
    from factorloom.operators.evaluate import information_coefficient

    rows = run_checks(predictions, [
        Check("predictions_row_count", {"rows": F.count(F.lit(1))}, f"rows >= {min_rows}")])
    newest = newest_model(registry, horizon).scalar()
    scored = predictions.where(F.col("model_version") == newest).join(
        panel.select("date", "ticker", "forward_return"), ["date", "ticker"])
    ic = information_coefficient(scored, "score", wide_groups=wide_groups)
    skill = run_checks(ic, [Check("predictions_ic_positive", {"mean_ic": F.avg("ic"), "months": F.count("ic")},
                                  "mean_ic > 0", WARN)])
    return rows.unionByName(skill)


def series_checks(factors: DataFrame, macro: DataFrame, today: str, max_age: int = 75) -> DataFrame:
    f = run_checks(factors, [Check(
        "ff_factors_fresh", {"latest": F.max("date"), "age_days": _age("date", today),
                             "null_mkt_rf": F.count_if(F.col("mkt_rf").isNull())},
        f"age_days <= {max_age} and null_mkt_rf = 0", WARN)])
    m = run_checks(macro, [Check(
        "macro_fresh", {"latest": F.max("date"), "age_days": _age("date", today),
                        "present": F.count("yield_curve")}, f"age_days <= {max_age} and present > 0", WARN)])
    return f.unionByName(m)


def serving_checks(recommendations: DataFrame, summaries: DataFrame, months: DataFrame,
                   registry: DataFrame, horizon: str = "1m") -> DataFrame:
    """The newest ranking is the deployed model's and ranked 1..n; its backtest is whole."""
    from factorloom.models.registry import newest_model

    newest = newest_model(registry, horizon).scalar()
    c = F.col
    last = recommendations.agg(F.max(F.struct("as_of", "scored_at", "model_version"))).scalar()
    ranking = recommendations.where((c("as_of") == last["as_of"]) & (c("model_version") == last["model_version"]))
    ranking = ranking.withColumn("_current", c("model_version") == newest)
    r = run_checks(ranking, [Check(
        "recommendations_current",
        {"rows": F.count(F.lit(1)), "ranks": F.countDistinct("rank"), "lo": F.min("rank"), "hi": F.max("rank"),
         "deployed_model": F.min("_current")},
        "deployed_model and ranks = rows and lo = 1 and hi = rows", WARN)])
    stored = months.where(c("model_version") == newest).groupBy("model_version").agg(F.count(F.lit(1)).alias("_stored"))
    own = summaries.where(c("model_version") == newest).join(stored, "model_version", "left")
    b = run_checks(own, [Check(
        "strategy_backtest_current", {"n_months": F.max("n_months"), "months_stored": F.max(F.coalesce("_stored", F.lit(0)))},
        "n_months = months_stored", WARN)])
    return r.unionByName(b)


def failed_blocking(results: DataFrame) -> DataFrame:
    return results.where("blocking and not passed")


def require(results: DataFrame) -> None:
    """Raise when a blocking check failed; the result has one row per check."""
    bad = [r["check"] for r in failed_blocking(results).select("check").collect()]
    if bad:
        raise ValueError(f"blocking checks failed: {bad}")


# ------------------------------------------------------------------ boundary schema of facts

# Patterns and allowed sets of the facts table.
TICKER_PATTERN = r"^[A-Z0-9.\-]+$"
CIK_PATTERN = r"^\d{10}$"

FACT_RULES: dict[str, Callable[[], Column]] = {
    "ticker_pattern": lambda: ~F.coalesce(F.col("ticker").rlike(TICKER_PATTERN), F.lit(False)),
    "cik_pattern": lambda: ~F.coalesce(F.col("cik").rlike(CIK_PATTERN), F.lit(False)),
    "concept_known": lambda: ~F.coalesce(F.col("concept").isin(CONCEPTS), F.lit(False)),
    "gaap_tag_present": lambda: F.col("gaap_tag").isNull(),
    "period_end_present": lambda: F.col("period_end").isNull(),
    "fiscal_period_known": lambda: F.col("fiscal_period").isNotNull()
    & ~F.col("fiscal_period").isin("Q1", "Q2", "Q3", "Q4"),
    "duration_known": lambda: ~F.coalesce(F.col("duration_days").isin(0, 91), F.lit(False)),
    "filed_date_present": lambda: F.col("filed_date").isNull(),
    "form_present": lambda: F.col("form").isNull(),
    "unit_present": lambda: F.col("unit").isNull(),
    "pit_no_lookahead": lambda: F.datediff("period_end", "filed_date") > params.LOOKAHEAD_TOLERANCE_DAYS,
}


def violation_counts(facts: DataFrame) -> DataFrame:
    """Violations per rule, all rules in one pass: rows (rule, violations)."""
    sums = facts.agg(*(F.count_if(rule()).alias(n) for n, rule in FACT_RULES.items()))
    cells = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in FACT_RULES)))
    return sums.select(cells.alias("c")).select("c.*")


def fact_measures(facts: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """The facts with exact columns and types, flags of values that have the wrong type, and the counts of all violations."""
    want = [f.name for f in FACTS.fields]
    problems = [f"missing column {c}" for c in want if c not in facts.columns]
    problems += [f"unexpected column {c}" for c in facts.columns if c not in want]
    if problems:
        raise ValueError("facts: " + "; ".join(problems))
    cast = {f.name: F.col(f.name).try_cast(f.dataType) for f in FACTS.fields}
    marked = facts.select(*(e.alias(c) for c, e in cast.items()),
                          *((F.col(c).isNotNull() & e.isNull()).alias(f"_lost_{c}") for c, e in cast.items()))
    counts = {f"type_{c}": F.count_if(F.col(f"_lost_{c}")) for c in want}
    return marked, counts | {f"rule_{n}": F.count_if(rule()) for n, rule in FACT_RULES.items()}


def fact_problems(got: dict) -> list[str]:
    """What the counts of :func:`fact_measures` say, all violations in one message."""
    found = [f"{got[f'type_{f.name}']} values of {f.name} have the wrong type" for f in FACTS.fields if got[f"type_{f.name}"]]
    found += [f"{n}: {got[f'rule_{n}']} rows" for n in FACT_RULES if got[f"rule_{n}"]]
    return ["facts: " + "; ".join(found)] if found else []


def validate_facts(facts: DataFrame) -> DataFrame:
    """Exact columns, coercible types and every rule, in one pass; raises with all violations at once."""
    marked, counts = fact_measures(facts)
    problems = fact_problems(marked.agg(*(e.alias(n) for n, e in counts.items())).first().asDict())
    if problems:
        raise ValueError(problems[0])
    return marked.select(*(f.name for f in FACTS.fields))


def schema_matches(df: DataFrame, schema: T.StructType) -> bool:
    return [(f.name, f.dataType) for f in df.schema.fields] == [(f.name, f.dataType) for f in schema.fields]
