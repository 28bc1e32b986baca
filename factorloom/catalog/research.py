"""Registered queries: evaluation, portfolios, backtests, models and trade plans."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from factorloom.catalog import views as v
from factorloom.catalog.base import query, r, rounded, rs
from factorloom.catalog.market import panel, panel_daily_table, panel_table
from factorloom.catalog.sqlparts import FUND_CTES, PANEL_CTES, PANEL_VIEWS, SUMMARY, OOS, daily_ctes, elastic_net_ctes, fold_jobs, recursive_sql, spearman_ctes, unpivot
from factorloom.catalog.views import with_views
from factorloom.functions.cross_section import row_numbers
from factorloom.models import elastic_net, folds, permutation, walkforward
from factorloom.models.training import cross_section_at, rank_cross_section
from factorloom.operators import backtest, evaluate, portfolio, rebalance, sketches
from factorloom.operators.attribution import FACTORS, coefficient_table, factor_attribution
from factorloom.operators.portfolio import Strategy
from factorloom.params import ELASTIC_NET, PortfolioParams, RebalanceParams, TuningParams, WalkForwardParams
from factorloom.session import settle
from factorloom.schema import EXPECTED_SIGNS, MACRO_FEATURES, MONTHLY_FEATURES, PANEL_COLUMNS

_P = {"pairs": "SELECT 'pred' AS signal, date, ticker, pred AS x, forward_return AS y FROM preds WHERE forward_return IS NOT NULL"}
_IC = {**_P, **spearman_ctes("pairs", "signal, date")}
_SIGNALS = [c for c in MONTHLY_FEATURES if c not in MACRO_FEATURES]


# --------------------------------------------------------------------------------- evaluation


@query("ic_by_date", with_views(f"SELECT signal, date, {r('ic', 'ic')} FROM ic", "preds", extra=_IC))
def ic_by_date(spark, sf):
    return rounded(evaluate.information_coefficient(v.preds(spark, sf), "pred"))


@query("ic_by_date_split", with_views(f"SELECT signal, date, {r('ic', 'ic')} FROM ic", "preds", extra=_IC))
def ic_by_date_split(spark, sf):
    """The form for cross-sections too wide for one task."""
    return rounded(evaluate.information_coefficient(v.preds(spark, sf), "pred", wide_groups=True))


@query("ic_sector_neutral", with_views(
    f"SELECT signal, date, {r('avg(ic)', 'ic')} FROM ic GROUP BY 1, 2", "preds", "sectors",
    extra={"pairs": """SELECT 'pred' AS signal, date, gics_sector, pred AS x, forward_return AS y FROM preds
  JOIN sectors USING (ticker) WHERE forward_return IS NOT NULL AND gics_sector IS NOT NULL""",
           **spearman_ctes("pairs", "signal, date, gics_sector")}))
def ic_sector_neutral(spark, sf):
    rows = v.preds(spark, sf).join(v.sectors(spark, sf), "ticker", "left")
    return rounded(evaluate.information_coefficient(rows, "pred", sector="gics_sector"))


_SUM_OUT = rs(["ic_mean", "ic_std", "ic_ir", "t_stat", "hit_rate"])


@query("ic_summary", with_views(f"SELECT signal, {_SUM_OUT}, n_months FROM (SELECT signal, {SUMMARY} FROM ic GROUP BY 1)",
                                "preds", extra=_IC))
def ic_summary(spark, sf):
    ic = evaluate.information_coefficient(v.preds(spark, sf), "pred")
    return rounded(evaluate.ic_summary(ic))


@query("cumulative_ic", with_views(
    f"SELECT signal, date, {r('sum(ic) OVER (ORDER BY date)', 'cum_ic')} FROM ic", "preds", extra=_IC))
def cumulative_ic(spark, sf):
    ic = evaluate.information_coefficient(v.preds(spark, sf), "pred")
    return rounded(evaluate.cumulative_ic(ic).drop("ic"))


_REPORT = {**PANEL_CTES, "pairs": unpivot("panel", _SIGNALS, "forward_return", "date"),
           **spearman_ctes("pairs", "signal, date")}


@query("signal_report", with_views(f"SELECT signal, {_SUM_OUT}, n_months FROM (SELECT signal, {SUMMARY} FROM ic GROUP BY 1)",
                                   *PANEL_VIEWS, extra=_REPORT))
def signal_report(spark, sf):
    return rounded(evaluate.signal_report(panel_table(spark, sf), _SIGNALS))


_EXPECT = " ".join(f"WHEN '{k}' THEN {s}" for k, s in EXPECTED_SIGNS.items())


@query("sign_check", with_views(f"""SELECT signal, {r('m', 'ic_mean')}, CASE signal {_EXPECT} END AS expected,
    CASE WHEN m > 0 THEN 1 ELSE -1 END AS actual_sign,
    CASE signal {_EXPECT} END = 0 OR CASE signal {_EXPECT} END = CASE WHEN m > 0 THEN 1 ELSE -1 END AS matches
  FROM (SELECT signal, avg(ic) AS m FROM ic GROUP BY 1)""", *PANEL_VIEWS, extra=_REPORT))
def sign_check(spark, sf):
    report = evaluate.signal_report(panel_table(spark, sf), _SIGNALS)
    return rounded(evaluate.sign_check(report).select("signal", "ic_mean", "expected", "actual_sign", "matches"))


_QR = {**_P, "placed": """SELECT *, row_number() OVER (PARTITION BY date ORDER BY x, ticker) AS rn,
    count(*) OVER (PARTITION BY date) AS n FROM pairs""",
       "per_date": """SELECT date, greatest(1, CAST(ceil((rn - 1) * 10 / (n - 1)) AS INTEGER)) AS q, avg(y) AS m
  FROM placed WHERE n >= 10 GROUP BY 1, 2""", "means": "SELECT q, avg(m) AS m FROM per_date GROUP BY 1"}
_QR_SQL = f"""SELECT 'pred' AS signal, CAST(q AS VARCHAR) AS quantile, {r('m', 'mean_fwd_return')} FROM means UNION ALL
  SELECT 'pred', 'top_minus_bottom', {r('max(CASE WHEN q = 10 THEN m END) - max(CASE WHEN q = 1 THEN m END)', 'mean_fwd_return')} FROM means"""


@query("quantile_returns", with_views(_QR_SQL, "preds", extra=_QR))
def quantile_returns(spark, sf):
    return rounded(evaluate.quantile_returns(v.preds(spark, sf), "pred"))


@query("quantile_returns_split", with_views(_QR_SQL, "preds", extra=_QR))
def quantile_returns_split(spark, sf):
    """The form for cross-sections too wide for one task."""
    return rounded(evaluate.quantile_returns(v.preds(spark, sf), "pred", wide_groups=True))


_H_SIG = ["rev_5d", "vol_21d", "range_21d", "amihud_21d"]
_H = {**FUND_CTES, **daily_ctes("bars_w"),
      "dates_d": "SELECT date, row_number() OVER (ORDER BY date) - 1 AS p FROM (SELECT DISTINCT date FROM panel_d)",
      "pairs": " UNION ALL ".join(
          f"SELECT '{h}d' AS horizon, '{s}' AS signal, date, {s} AS x, fwd_{h}d AS y FROM panel_d JOIN dates_d USING (date) "
          f"WHERE p % {h} = 0 AND {s} IS NOT NULL AND fwd_{h}d IS NOT NULL" for h in (5, 10, 30) for s in _H_SIG),
      **spearman_ctes("pairs", "horizon, signal, date")}


@query("ic_by_horizon", with_views(
    f"SELECT horizon, signal, {_SUM_OUT}, n_months FROM (SELECT horizon, signal, {SUMMARY} FROM ic GROUP BY 1, 2)",
    "bars_w", "facts", "sectors", extra=_H))
def ic_by_horizon(spark, sf):
    return rounded(evaluate.ic_by_horizon(panel_daily_table(spark, sf), _H_SIG, (5, 10, 30)))


_NAIVE = dict(_H, pairs=_H["pairs"].replace("p % 5 = 0 AND ", "").replace("p % 10 = 0 AND ", "").replace("p % 30 = 0 AND ", ""))


@query("ic_by_horizon_overlapping", with_views(
    f"SELECT horizon, signal, {_SUM_OUT}, n_months FROM (SELECT horizon, signal, {SUMMARY} FROM ic GROUP BY 1, 2)",
    "bars_w", "facts", "sectors", extra=_NAIVE))
def ic_by_horizon_overlapping(spark, sf):
    return rounded(evaluate.ic_by_horizon(panel_daily_table(spark, sf), _H_SIG, (5, 10, 30), overlapping=True))


@query("feature_coverage", with_views(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, {r(f'avg(CASE WHEN {c} IS NOT NULL THEN 1.0 ELSE 0.0 END)', 'coverage')} FROM panel "
    "WHERE date >= DATE '1997-01-01'" for c in PANEL_COLUMNS), *PANEL_VIEWS, extra=PANEL_CTES))
def feature_coverage(spark, sf):
    return rounded(evaluate.feature_coverage(panel_table(spark, sf), PANEL_COLUMNS, since="1997-01-01"))


@query("label_quantiles", with_views(
    f"""SELECT h AS "column", p AS prob, {r('q', 'value')} FROM (""" + " UNION ALL ".join(
        f"SELECT 'fwd_{h}d' AS h, {p} AS p, quantile_cont(fwd_{h}d, {p}) AS q FROM feat_d WHERE price IS NOT NULL"
        for h in (5, 10, 30) for p in (0.01, 0.25, 0.5, 0.75, 0.99)) + ")",
    "bars_w", extra=dict(list(daily_ctes("bars_w").items())[:4])))
def label_quantiles(spark, sf):
    from factorloom.plans.panel_daily import daily_returns, forward_labels

    rows = forward_labels(daily_returns(v.bars_w(spark, sf)), (5, 10, 30))
    return rounded(evaluate.label_quantiles(rows, (5, 10, 30)))


@query("sector_counts", with_views("SELECT gics_sector, count(*) AS n FROM sectors GROUP BY 1", "sectors"))
def sector_counts(spark, sf):
    return evaluate.value_counts(v.sectors(spark, sf), "gics_sector")


@query("distinct_counts", """SELECT 'l_suppkey' AS "column", count(DISTINCT l_suppkey) AS n_distinct FROM lineitem UNION ALL
  SELECT 'l_shipdate', count(DISTINCT l_shipdate) FROM lineitem UNION ALL
  SELECT 'l_returnflag', count(DISTINCT l_returnflag) FROM lineitem""")
def distinct_counts(spark, sf):
    return evaluate.distinct_counts(v.table(spark, sf, "lineitem"), ["l_suppkey", "l_shipdate", "l_returnflag"])


@query("sketched_distinct", """SELECT 'l_suppkey' AS "column", count(DISTINCT l_suppkey) AS n_distinct, true AS near FROM lineitem UNION ALL
  SELECT 'l_orderkey', count(DISTINCT l_orderkey), true FROM lineitem UNION ALL SELECT 'l_returnflag', count(DISTINCT l_returnflag), true FROM lineitem""")
def sketched_distinct(spark, sf):
    """Sketches per year of shipping are stored and merged; the estimates stand beside exact counts."""
    li, cols = v.table(spark, sf, "lineitem").withColumn("year", F.year("l_shipdate")), ["l_suppkey", "l_orderkey", "l_returnflag"]
    merged = sketches.merged_distinct(settle(sketches.distinct_sketches(li, cols, ["year"]), "sketches")).withColumnRenamed("n_distinct", "guess")
    near = F.abs(F.col("guess") / F.col("n_distinct") - 1) <= sketches.DISTINCT_ERROR
    return evaluate.distinct_counts(li, cols).join(merged, "column").select("column", "n_distinct", near.alias("near"))


@query("sketched_quantiles", """SELECT c AS "column", count(*) AS n, prob, true AS near FROM (
    SELECT 'l_extendedprice' AS c, l_extendedprice AS x FROM lineitem UNION ALL SELECT 'l_quantity', l_quantity FROM lineitem),
    (VALUES (0.01), (0.25), (0.5), (0.75), (0.99)) AS p(prob) WHERE x IS NOT NULL GROUP BY 1, 3""")
def sketched_quantiles(spark, sf):
    """Each merged estimate must stand at its share of the rows, within the error of the sketch."""
    li, cols = v.table(spark, sf, "lineitem").withColumn("year", F.year("l_shipdate")), ["l_extendedprice", "l_quantity"]
    stored = settle(sketches.quantile_sketches(li, cols, ["year"]), "sketches")
    merged = F.broadcast(sketches.merged_quantiles(stored, [0.01, 0.25, 0.5, 0.75, 0.99]))  # ten rows
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in cols)))
    rows = li.select(cells.alias("c")).select("c.*").where(F.col("x").isNotNull()).join(merged, "column")
    below, upto = F.avg((F.col("x") < F.col("value")).cast("double")), F.avg((F.col("x") <= F.col("value")).cast("double"))
    near = (below - sketches.RANK_ERROR <= F.col("prob")) & (F.col("prob") <= upto + sketches.RANK_ERROR)
    return rows.groupBy("column", "n", "prob").agg(near.alias("near"))


# --------------------------------------------------------------------- portfolio and backtest

_TOP = "SELECT * FROM preds QUALIFY row_number() OVER (PARTITION BY date ORDER BY pred DESC, ticker) <= 10"
_BASE = [Strategy("base", 10, 20, 0.08), Strategy("rebuild", 10, 10, 0.08), Strategy("wide", 15, 40, 0.08, 12.0)]


@query("topn_per_date", with_views("""SELECT date, ticker, pred, CAST(row_number() OVER (
  PARTITION BY date ORDER BY pred DESC, ticker) AS INTEGER) AS rank FROM preds
  QUALIFY row_number() OVER (PARTITION BY date ORDER BY pred DESC, ticker) <= 10""", "preds"))
def topn_per_date(spark, sf):
    return portfolio.top_n(v.preds(spark, sf), 10).select("date", "ticker", "pred", "rank")


@query("rank_all_split", with_views("""SELECT date, ticker, row_number() OVER (PARTITION BY date ORDER BY pred DESC, ticker) AS rank,
    count(*) OVER (PARTITION BY date) AS n FROM preds""", "preds"))
def rank_all_split(spark, sf):
    """Row numbers in the form for cross-sections too wide for one task."""
    out = row_numbers(v.preds(spark, sf), ["date"], "pred", "ticker", descending=True, out="rank", count="n", wide_groups=True)
    return out.select("date", "ticker", "rank", "n")


def _top_portfolio(spark, sf):
    p = v.preds(spark, sf).withColumn("model_version", F.lit("m"))
    live = backtest.realized_only(p)
    held = portfolio.top_n(live, 10).withColumns({"strategy": F.lit("top10")})
    w = portfolio.equal_weights(held, ["model_version", "strategy", "date"], 0.08)
    return live, w.select("model_version", "strategy", "date", "ticker", "weight")


_BT = {
    "live": "SELECT * FROM preds WHERE date IN (SELECT date FROM preds GROUP BY 1 HAVING count(forward_return) > 0)",
    "held": """SELECT date, ticker, forward_return, 1.0 / count(*) OVER (PARTITION BY date) AS weight FROM (
  SELECT * FROM live QUALIFY row_number() OVER (PARTITION BY date ORDER BY pred DESC, ticker) <= 10)""",
    "gross_r": "SELECT date, sum(weight * coalesce(forward_return, 0)) AS gross FROM held GROUP BY 1",
    "bench_r": "SELECT date, avg(forward_return) AS benchmark FROM live GROUP BY 1",
    "days": "SELECT date, row_number() OVER (ORDER BY date) AS i FROM (SELECT DISTINCT date FROM held)",
    "w_now": "SELECT i, ticker, weight FROM held JOIN days USING (date)",
    "turn": """SELECT i, CASE WHEN i = 1 THEN 0.5 ELSE sum(d) / 2 END AS turnover FROM (
  SELECT coalesce(a.i, b.i + 1) AS i, abs(coalesce(a.weight, 0) - coalesce(b.weight, 0)) AS d
  FROM w_now AS a FULL OUTER JOIN w_now AS b ON a.i = b.i + 1 AND a.ticker = b.ticker)
  WHERE i <= (SELECT max(i) FROM days) GROUP BY 1""",
    "bt": """SELECT last_day(date + 1) AS date, gross, turnover, turnover * 2 * 6.0 / 10000 AS cost,
  gross - turnover * 2 * 6.0 / 10000 AS net, benchmark FROM gross_r JOIN days USING (date) JOIN turn USING (i)
  LEFT JOIN bench_r USING (date)""",
}


@query("turnover", with_views(f"SELECT date, {r('turnover', 'turnover')} FROM days JOIN turn USING (i)", "preds", extra=_BT))
def turnover(spark, sf):
    return rounded(portfolio.turnover(_top_portfolio(spark, sf)[1]).select("date", "turnover"))


def _top_returns(spark, sf):
    from factorloom.functions.dates import next_month_end

    live, w = _top_portfolio(spark, sf)
    out = backtest.backtest_returns(w, live, [Strategy("top10", 10, 10)])
    return out.withColumn("date", next_month_end(F.col("date")))


@query("portfolio_returns", with_views(
    f"SELECT date, {rs(['gross', 'turnover', 'cost', 'net', 'benchmark'])} FROM bt", "preds", extra=_BT))
def portfolio_returns(spark, sf):
    return rounded(_top_returns(spark, sf).select("date", "gross", "turnover", "cost", "net", "benchmark"))


_DD = {**_BT, "eq": "SELECT date, net, product(1 + net) OVER (ORDER BY date) AS equity FROM bt",
       "dd": "SELECT *, equity / max(equity) OVER (ORDER BY date) - 1 AS drawdown FROM eq"}


@query("drawdown", with_views(f"SELECT date, {r('ln(equity)', 'log_equity')}, {r('drawdown', 'drawdown')} FROM dd", "preds", extra=_DD))
def drawdown(spark, sf):
    out = backtest.growth_and_drawdown(_top_returns(spark, sf), "net", ["model_version", "strategy"])
    return rounded(out.select("date", F.log("equity").alias("log_equity"), "drawdown"))


@query("performance_summary", with_views(f"""SELECT {rs(['ann_return', 'ann_vol', 'sharpe', 'sortino', 'max_drawdown', 'hit_rate'])}, n_months FROM (
  SELECT pow(product(1 + net), 12.0 / count(*)) - 1 AS ann_return, stddev_samp(net) * sqrt(12) AS ann_vol,
    avg(net) * 12 / (stddev_samp(net) * sqrt(12)) AS sharpe,
    avg(net) * 12 / (stddev_samp(CASE WHEN net < 0 THEN net END) * sqrt(12)) AS sortino,
    min(drawdown) AS max_drawdown, avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate, count(net) AS n_months FROM dd)""",
    "preds", extra=_DD))
def performance_summary(spark, sf):
    return rounded(backtest.performance_summary(_top_returns(spark, sf)).drop("model_version", "strategy"))


@query("factor_attribution_market", with_views(f"""SELECT {r('a', 'alpha_monthly')}, {r('pow(1 + a, 12) - 1', 'alpha_annual')}, {r('b', 'beta')},
    {r('r2', 'r_squared')}, n AS n_months FROM (
  SELECT regr_intercept(net - rf, mkt_rf) AS a, regr_slope(net - rf, mkt_rf) AS b, regr_r2(net - rf, mkt_rf) AS r2, count(*) AS n
  FROM bt JOIN ff_m ON date_trunc('month', bt.date) = date_trunc('month', ff_m.date))""", "preds", "ff_m", extra=_BT))
def factor_attribution_market(spark, sf):
    out = factor_attribution(_top_returns(spark, sf), v.ff_m(spark, sf), by=["strategy"], factor_cols=["mkt_rf"])
    return rounded(out.select("alpha_monthly", "alpha_annual", F.try_element_at("betas", F.lit("mkt_rf")).alias("beta"),
                              "r_squared", F.col("n_months").cast("bigint").alias("n_months")))


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def _chain(source: str) -> dict[str, str]:
    """CTEs of the hold-buffer rule: each date's lists of kept and bought names, chained by recursion."""
    sets = ", ".join(f"('{x.name}', {x.n_holdings}, {x.buffer}, {x.depth}, {x.max_weight}, {x.cost_bps})" for x in _BASE)
    return {
        "strat": f"SELECT * FROM (VALUES {sets}) AS s(strategy, n, buf, depth, cap, bps)",
        "rk": f"""SELECT date, ticker, forward_return, CAST(row_number() OVER (PARTITION BY date ORDER BY pred DESC, ticker) AS INTEGER) AS rank
  FROM {source} WHERE pred IS NOT NULL""",
        "day": "SELECT row_number() OVER (ORDER BY date) AS i, date, list(ticker ORDER BY rank) AS names FROM rk GROUP BY date",
        "chain": """SELECT strategy, n, buf, depth, i, date, CAST([] AS BIGINT[]) AS kept, names[1:n] AS bought FROM strat, day WHERE i = 1
  UNION ALL
  SELECT strategy, n, buf, depth, i, date, kept,
    list_filter(names[1:depth], lambda x: NOT list_contains(held, x))[1:n - len(kept)] AS bought
  FROM (SELECT strategy, n, buf, depth, i, date, names, held,
          list_filter(names[1:buf], lambda x: list_contains(held, x))[1:n] AS kept
        FROM (SELECT c.strategy, c.n, c.buf, c.depth, day.i, day.date, day.names, list_concat(c.kept, c.bought) AS held
              FROM chain AS c JOIN day ON day.i = c.i + 1))""",
        "book": """SELECT strategy, i, date, ticker, rank, action, forward_return FROM (
  SELECT strategy, i, date, unnest(kept) AS ticker, 'keep' AS action FROM chain
  UNION ALL SELECT strategy, i, date, unnest(bought), 'buy' FROM chain) JOIN rk USING (date, ticker)""",
    }


_CHAIN = _chain("preds")


@query("hold_buffer", recursive(with_views("SELECT 'model' AS model_version, strategy, date, ticker, rank, action FROM book", "preds", extra=_CHAIN)))
def hold_buffer(spark, sf):
    return portfolio.hold_buffer(v.preds(spark, sf), _BASE)


@query("hold_buffer_sells", recursive(with_views("""SELECT 'model' AS model_version, strategy, day.date AS date, ticker
  FROM book AS b JOIN day ON day.i = b.i + 1
  WHERE NOT EXISTS (SELECT 1 FROM book AS c WHERE c.strategy = b.strategy AND c.i = b.i + 1 AND c.ticker = b.ticker)
    AND EXISTS (SELECT 1 FROM rk WHERE rk.date = day.date AND rk.ticker = b.ticker)""", "preds", extra=_CHAIN)))
def hold_buffer_sells(spark, sf):
    p = v.preds(spark, sf)
    return portfolio.sells(portfolio.hold_buffer(p, _BASE), p)


_TERMS = ("alpha", *FACTORS)


def _regression(source: str) -> dict[str, str]:
    """CTEs of a seven-term least squares per strategy: every term in turn is made orthogonal to all
    others, one after another, which gives its coefficient and its standard error."""
    out = {"reg": f"""SELECT b.strategy, net - rf AS y, 1.0 AS alpha, {', '.join(FACTORS)} FROM {source} AS b
  JOIN ff_m ON date_trunc('month', b.date) = date_trunc('month', ff_m.date)"""}
    for term in _TERMS:
        order, last = [t for t in _TERMS if t != term] + [term], "reg"
        for k, x in enumerate(order):
            less = "".join(f" - e{i} * sum({x} * e{i}) OVER w / nullif(sum(e{i} * e{i}) OVER w, 0)" for i in range(k))
            out[f"gs_{term}_{k}"] = f"SELECT *, {x}{less} AS e{k} FROM {last} WINDOW w AS (PARTITION BY strategy)"
            last = f"gs_{term}_{k}"
        k = len(order)
        left = "sum(y * y)" + "".join(f" - pow(sum(y * e{i}), 2) / sum(e{i} * e{i})" for i in range(k))
        out[f"fit_{term}"] = f"""SELECT strategy, '{term}' AS name, sum(y * e{k - 1}) / sum(e{k - 1} * e{k - 1}) AS coef,
  sum(y * e{k - 1}) / sqrt(sum(e{k - 1} * e{k - 1})) / sqrt(({left}) / (count(*) - {k})) AS t_stat,
  1 - ({left}) / (count(*) * var_pop(y)) AS r_squared FROM {last} GROUP BY strategy"""
    return out


_LIVE = {"live": _BT["live"], **_chain("live"),
         "held3": """SELECT b.*, least(1.0 / count(*) OVER d, cap) AS raw, bps FROM book AS b JOIN strat USING (strategy)
  WINDOW d AS (PARTITION BY b.strategy, b.date)""",
         "w3": "SELECT *, raw / sum(raw) OVER (PARTITION BY strategy, date) AS weight FROM held3",
         "turn3": """SELECT strategy, i, CASE WHEN i = 1 THEN 0.5 ELSE sum(d) / 2 END AS turnover FROM (
  SELECT coalesce(a.strategy, b.strategy) AS strategy, coalesce(a.i, b.i + 1) AS i, abs(coalesce(a.weight, 0) - coalesce(b.weight, 0)) AS d
  FROM w3 AS a FULL OUTER JOIN w3 AS b ON a.strategy = b.strategy AND a.i = b.i + 1 AND a.ticker = b.ticker)
  WHERE i <= (SELECT max(i) FROM day) GROUP BY 1, 2""",
         "bt3": """SELECT strategy, last_day(date + 1) AS date, gross - turnover * 2 * bps / 10000 AS net FROM (
  SELECT strategy, i, date, bps, sum(weight * coalesce(forward_return, 0)) AS gross FROM w3 GROUP BY 1, 2, 3, 4) JOIN turn3 USING (strategy, i)""",
         "eq3": "SELECT *, product(1 + net) OVER (PARTITION BY strategy ORDER BY date) AS equity FROM bt3",
         "dd3": "SELECT *, equity / max(equity) OVER (PARTITION BY strategy ORDER BY date) - 1 AS drawdown FROM eq3",
         **_regression("bt3")}


@query("strategy_backtest", recursive(with_views(f"""SELECT 'model' AS model_version, strategy,
    {rs(['ann_return', 'ann_vol', 'sharpe', 'sortino', 'max_drawdown', 'hit_rate'])}, n_months,
    {r('coef', 'alpha_monthly')}, {r('t_stat', 'alpha_tstat')}, {r('r_squared', 'r_squared')} FROM (
  SELECT strategy, pow(product(1 + net), 12.0 / count(*)) - 1 AS ann_return, stddev_samp(net) * sqrt(12) AS ann_vol,
    avg(net) * 12 / (stddev_samp(net) * sqrt(12)) AS sharpe,
    avg(net) * 12 / (stddev_samp(CASE WHEN net < 0 THEN net END) * sqrt(12)) AS sortino,
    min(drawdown) AS max_drawdown, avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate, count(net) AS n_months
  FROM dd3 GROUP BY strategy) JOIN fit_alpha USING (strategy)""", "preds", "ff_m", extra=_LIVE)))
def strategy_backtest(spark, sf):
    res = backtest.run_strategy_backtest(v.preds(spark, sf), v.ff_m(spark, sf), _BASE, stored=True)
    return rounded(res.strategy.join(
        res.attribution.select("model_version", "strategy", "alpha_monthly", "alpha_tstat", "r_squared"), ["model_version", "strategy"]))


_TOP_REG = {**_BT, "bt1": "SELECT 'top10' AS strategy, * FROM bt", **_regression("bt1")}


@query("factor_attribution", with_views(
    "\nUNION ALL ".join(f"SELECT strategy, name, {r('coef', 'coef')}, {r('t_stat', 't_stat')} FROM fit_{t}" for t in _TERMS),
    "preds", "ff_m", extra=_TOP_REG))
def attribution(spark, sf):
    return rounded(coefficient_table(factor_attribution(_top_returns(spark, sf), v.ff_m(spark, sf))))


# ------------------------------------------------------------------------------------- models

_WF = WalkForwardParams(min_train_months=36, test_months=1, embargo_months=1)


@query("fold_table", with_views("""WITH cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM (SELECT DISTINCT date FROM close_m)),
  ks AS (SELECT range AS fold FROM range(0, 200))
  SELECT CAST(fold AS INTEGER) AS fold, t.date AS test_date, CAST(24 + fold * 3 AS INTEGER) AS train_end_pos
  FROM ks JOIN cal AS t ON t.pos >= 24 + fold * 3 + 1 AND t.pos < 24 + fold * 3 + 1 + 3""".replace("WITH cal", "SELECT * FROM (WITH cal") + ")", "close_m"))
def fold_table(spark, sf):
    return folds.fold_table(v.close_m(spark, sf), WalkForwardParams(24, 3, 1)).select("fold", "test_date", "train_end_pos")


_EN = {**PANEL_CTES, **elastic_net_ctes(fold_jobs(36, 0.001, 0.5)), "oos": OOS}
_OOS_IC = {"pairs": "SELECT 'pred' AS signal, date, round(pred, 9) AS x, forward_return AS y FROM oos WHERE forward_return IS NOT NULL",
           **spearman_ctes("pairs", "signal, date")}


def _oos(spark, sf):
    return elastic_net.walk_forward(panel_table(spark, sf), MONTHLY_FEATURES, params=_WF, stored=True)[0]


@query("elastic_net_oos", recursive_sql(with_views(
    f"SELECT date, ticker, fold::INT AS fold, {r('pred', 'pred')}, {r('forward_return', 'forward_return')} FROM oos", *PANEL_VIEWS, extra=_EN)))
def elastic_net_oos(spark, sf):
    return rounded(_oos(spark, sf).select("date", "ticker", "fold", "pred", "forward_return"))


_TUNED = {
    "grid": """SELECT * FROM (VALUES (0, 0.001, 0.5), (1, 0.001, 0.2), (2, 0.001, 0.8), (3, 0.0001, 0.5), (4, 0.0001, 0.2), (5, 0.0001, 0.8),
    (6, 0.01, 0.5), (7, 0.01, 0.2), (8, 0.01, 0.8)) AS g(param_id, alpha, l1_ratio)""",
    "inner_": """SELECT pos - 37 AS fold, i AS inner_fold, pos - 1 - 4 + i AS train_end_pos, pos - 1 - 3 + i AS val_pos
  FROM cal, range(0, 3) AS r(i) WHERE pos >= 37 AND (pos - 37) % 12 = 0 AND pos - 1 - 4 >= 24""",
}
_TUNE_EN = elastic_net_ctes("""SELECT fold * 1000 + inner_fold * 100 + param_id AS job, train_end_pos, alpha::DOUBLE AS alpha, l1_ratio::DOUBLE AS l1_ratio
  FROM inner_, grid""")
_TUNE_CTES = {**PANEL_CTES, "cal": _TUNE_EN["cal"], **_TUNED, **_TUNE_EN,
    "pairs": """SELECT inner_.fold, inner_fold, param_id, intercept + list_dot_product(x, b) AS x, forward_return AS y
  FROM inner_ JOIN grid ON true JOIN est ON job = fold * 1000 + inner_fold * 100 + param_id JOIN ep ON pos = val_pos WHERE forward_return IS NOT NULL""",
    **spearman_ctes("pairs", "fold, inner_fold, param_id"),
    "chosen": """SELECT fold AS tuned_at, arg_max(param_id, (inner_ic, -param_id)) AS param_id, max(inner_ic) AS inner_ic
  FROM (SELECT fold, param_id, round(avg(ic), 12) AS inner_ic FROM ic GROUP BY 1, 2) GROUP BY 1"""}
_FINAL = elastic_net_ctes("""SELECT pos - 37 AS job, pos - 1 AS train_end_pos, alpha::DOUBLE AS alpha, l1_ratio::DOUBLE AS l1_ratio, param_id, inner_ic
  FROM cal LEFT JOIN chosen ON tuned_at = (pos - 37) // 12 * 12 JOIN grid ON grid.param_id = coalesce(chosen.param_id, 0) WHERE pos >= 37""".replace(
    "param_id, inner_ic", "grid.param_id, inner_ic"))
_again = lambda q: re.sub(r"\b(jobs|moments|problem|descent|est)\b", r"\1_2", q)
_TUNE_CTES |= {f"{k}_2": _again(q) for k, q in _FINAL.items() if k not in ("cal", "ep")}


@query("elastic_net_tuned", recursive_sql(with_views(f"""SELECT job::INT AS fold, param_id::INT AS param_id, {r('inner_ic', 'inner_ic')}, alpha, l1_ratio,
    {r('intercept', 'intercept')}, i::INT AS feature, round(b[i + 1], 6) + 0.0 AS coef
  FROM jobs_2 JOIN est_2 USING (job), range(0, {len(MONTHLY_FEATURES)}) AS t(i)""", *PANEL_VIEWS, extra=_TUNE_CTES)).replace(
    "descent_2 AS MATERIALIZED", "descent_2 AS"))
def elastic_net_tuned(spark, sf):
    """Nested tuning: the parameters and inner IC each fold used, and its coefficients, one row a feature."""
    _, models = elastic_net.walk_forward(panel_table(spark, sf), MONTHLY_FEATURES, params=_WF, stored=True, spec=ELASTIC_NET,
                                         tuning=TuningParams())
    return rounded(models.select("fold", "param_id", "inner_ic", "alpha", "l1_ratio", "intercept", F.posexplode("coef").alias("feature", "coef")))


@query("elastic_net_ic", recursive_sql(with_views(f"SELECT signal, {_SUM_OUT}, n_months FROM (SELECT signal, {SUMMARY} FROM ic GROUP BY 1)",
                                                  *PANEL_VIEWS, extra={**_EN, **_OOS_IC})))
def elastic_net_ic(spark, sf):
    scored = _oos(spark, sf).withColumn("pred", F.round("pred", 9))
    return rounded(evaluate.ic_summary(evaluate.information_coefficient(scored, "pred")))


@query("gram_sums", with_views(
    f"""SELECT date, count(*) AS n, {r('sum(target)', 'sum_target')}, {r('sum(coalesce(roe, 0.5) * target)', 'roe_target')}
  FROM panel WHERE target IS NOT NULL GROUP BY 1""", *PANEL_VIEWS, extra=PANEL_CTES))
def gram_sums(spark, sf):
    sums = elastic_net.date_sums(panel_table(spark, sf), ["roe"], "target")
    return rounded(sums.select("date", F.col("g0").cast("bigint").alias("n"), F.col("g2").alias("sum_target"),
                               F.col("g4").alias("roe_target")))


def _gbt(spark, sf):
    spec = {"maxIter": 5, "stepSize": 0.1, "maxDepth": 3, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8",
            "minInstancesPerNode": 20}
    out, _ = walkforward.walk_forward_predict(panel_table(spark, sf), "boosted_trees", MONTHLY_FEATURES, spec=spec,
                                              params=WalkForwardParams(36, 24, 1), is_stored=True)
    return out.select("date", "ticker", "fold", "pred", "forward_return")


@query("gbt_oos")
def gbt_oos(spark, sf):
    return v.stored(spark, sf, "gbt_oos", _gbt)


@query("gbt_oos_rows", with_views(f"""SELECT date, ticker, ((pos - 37) // 24)::INT AS fold, {r('forward_return', 'forward_return')}, true AS scored
  FROM panel JOIN (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM (SELECT DISTINCT date FROM panel)) USING (date) WHERE pos >= 37""",
    *PANEL_VIEWS, extra=PANEL_CTES))
def gbt_oos_rows(spark, sf):
    """Which rows the tree model scored out of sample, in which fold: all names of the test dates."""
    out = v.stored(spark, sf, "gbt_oos", _gbt).withColumn("scored", F.col("pred").isNotNull() & ~F.isnan("pred"))
    return rounded(out.drop("pred"))


_A, _C = walkforward.permutation_constants(42)
_SHUFFLED = {
    "placed": "SELECT *, row_number() OVER (PARTITION BY date ORDER BY ticker) AS k FROM panel",
    "keyed": f"""SELECT date, k, ticker, target, ((u * u) % 2147483647 * u) % 2147483647 AS h
  FROM (SELECT *, (k * {_A}::BIGINT + date_diff('day', DATE '1970-01-01', date) * {_C}::BIGINT + {_C}) % 2147483647 AS u FROM placed)""",
    "drawn": "SELECT date, target, row_number() OVER (PARTITION BY date ORDER BY h, ticker) AS k FROM keyed",
    "shuffled": "SELECT p.* REPLACE (d.target AS target) FROM placed AS p JOIN drawn AS d USING (date, k)",
}


@query("shuffled_target", with_views(f"SELECT date, ticker, {r('target', 'target')} FROM shuffled", *PANEL_VIEWS, extra={**PANEL_CTES, **_SHUFFLED}))
def shuffled_target(spark, sf):
    return rounded(walkforward.shuffle_target(panel_table(spark, sf)).select("date", "ticker", "target"))


@query("leakage_ic", recursive_sql(with_views(f"""SELECT n_months = 0 OR abs(t_stat) < 2.0 AS passed, {r('t_stat', 't_stat')}, n_months
  FROM (SELECT {SUMMARY} FROM ic)""", *PANEL_VIEWS, extra={
      **PANEL_CTES, **_SHUFFLED, **elastic_net_ctes(fold_jobs(36, 0.001, 0.5), "shuffled"), "oos": OOS, **_OOS_IC})))
def leakage_ic(spark, sf):
    shuffled = walkforward.shuffle_target(panel_table(spark, sf))
    scored, _ = elastic_net.walk_forward(shuffled, MONTHLY_FEATURES, params=_WF)
    ic = evaluate.information_coefficient(scored.withColumn("pred", F.round("pred", 9)), "pred")
    return rounded(walkforward.leakage_passed(evaluate.ic_summary(ic)))


_SEEDS = (42, 43, 141)
_PERMS = {
    "with_target": "SELECT date, ticker, roe, target, row_number() OVER (PARTITION BY date ORDER BY ticker) AS k FROM panel WHERE target IS NOT NULL",
    "keyed_p": " UNION ALL ".join(f"""SELECT date, k, target, {n + 1} AS perm, ((u * u) % 2147483647 * u) % 2147483647 AS h
  FROM (SELECT *, (k * {a}::BIGINT + date_diff('day', DATE '1970-01-01', date) * {c}::BIGINT + {c}) % 2147483647 AS u FROM with_target)"""
                                  for n, (a, c) in enumerate(map(walkforward.permutation_constants, _SEEDS))),
    "drawn_p": "SELECT date, perm, target, row_number() OVER (PARTITION BY date, perm ORDER BY h, k) AS k FROM keyed_p"}


@query("permuted_sums", with_views(f"""SELECT date, perm::INT AS perm, {r('sum(coalesce(roe, 0.5) * d.target)', 'roe_target')}
  FROM with_target JOIN (SELECT * FROM drawn_p UNION ALL SELECT date, 0, target, k FROM with_target) AS d USING (date, k) GROUP BY 1, 2""",
    *PANEL_VIEWS, extra={**PANEL_CTES, **_PERMS}))
def permuted_sums(spark, sf):
    """Feature-target sums per date under three permutations and without one."""
    sums = permutation.permuted_sums(panel_table(spark, sf), ["roe"], "target", _SEEDS)
    return rounded(sums.select("date", "perm", F.col("sums")[0].alias("roe_target")))


def _permutation_ic(spark, sf):
    return permutation.permutation_ic(panel_table(spark, sf), MONTHLY_FEATURES, params=_WF)


@query("permutation_real_ic", recursive_sql(with_views(f"SELECT date, {r('ic', 'ic')} FROM ic", *PANEL_VIEWS, extra={**_EN, **_OOS_IC})))
def permutation_real_ic(spark, sf):
    """The series of the real target among the permuted ones."""
    return rounded(v.stored(spark, sf, "permutation_ic", _permutation_ic).where("perm = 0").select("date", "ic"))


@query("permutation_test")
def permutation_test(spark, sf):
    """Is the model's skill out of reach of 200 shuffled targets?"""
    return permutation.permutation_test(v.stored(spark, sf, "permutation_ic", _permutation_ic))


@query("shuffled_target_totals", with_views(
    f"SELECT date, count(*) AS n, count(target) AS n_target, {r('sum(target)', 'total')} FROM panel GROUP BY 1",
    *PANEL_VIEWS, extra=PANEL_CTES))
def shuffled_target_totals(spark, sf):
    out = walkforward.shuffle_target(panel_table(spark, sf))
    return rounded(out.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.count("target").alias("n_target"),
                                           F.sum("target").alias("total")))


@query("recommend_latest", with_views("""SELECT date, ticker, pred, row_number() OVER (ORDER BY pred DESC, ticker) AS rank
  FROM preds WHERE date = (SELECT max(date) FROM preds)""", "preds"))
def recommend_latest(spark, sf):
    cross = cross_section_at(v.preds(spark, sf))
    return rank_cross_section(cross).select("date", "ticker", "pred", "rank")


@query("newest_models", """SELECT o_orderpriority AS horizon, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS model_version FROM orders GROUP BY 1""")
def newest_models(spark, sf):
    from factorloom.models.registry import newest_models as newest

    registry = v.table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("horizon"), F.col("o_orderkey").alias("model_version"),
        F.col("o_orderdate").alias("created_at"))
    return newest(registry)


@query("oos_predictions_joined", with_views(
    f"""SELECT p.date, p.ticker, p.pred, {r('m.forward_return', 'forward_return')}, m.gics_sector
  FROM preds AS p LEFT JOIN raw_m AS m ON m.date = p.date AND m.ticker = p.ticker""", "preds", *PANEL_VIEWS, extra={
      k: q for k, q in PANEL_CTES.items() if k != "panel"}))
def oos_predictions_joined(spark, sf):
    from factorloom.models.registry import load_oos_predictions
    from factorloom.sinks.tables import prediction_rows

    stored = prediction_rows(v.preds(spark, sf), "m-1")
    return rounded(load_oos_predictions(stored, panel(spark, sf, normalized=False), "m-1"), 6, pred=9)


# --------------------------------------------------------------------------------- trade plans

_RB = RebalanceParams(portfolio=PortfolioParams(8, 20, 0.08), min_price=1000.0, min_trade=100.0)


def _accounts(spark, sf):
    """Customers as accounts: holdings from their orders, cash from their balance."""
    o, c = v.table(spark, sf, "orders"), v.table(spark, sf, "customer")
    n = v.table(spark, sf, "supplier").agg((F.count(F.lit(1)) + 3).alias("n")).scalar()
    positions = o.select(F.col("o_custkey").alias("account_id"), (F.col("o_orderkey") % n).alias("ticker"),
                         F.floor(F.col("o_totalprice") / 10000).cast("double").alias("shares"))
    cash = c.select(F.col("c_custkey").alias("account_id"), (F.greatest("c_acctbal", F.lit(0.0)) * 10).alias("cash"))
    scores = v.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("ticker"), ((F.col("s_suppkey") * 7919) % 1009).cast("double").alias("pred"))
    price = v.bars_d(spark, sf).groupBy("ticker").agg(F.max_by("close", "date").alias("price"))
    return positions, cash, scores, price


_PLAN = {
    "n_sup": "SELECT count(*) + 3 AS n FROM supplier",
    "held": """SELECT o_custkey AS account_id, o_orderkey % n AS ticker, sum(floor(o_totalprice / 10000)) AS shares
  FROM orders, n_sup GROUP BY 1, 2""",
    "money": "SELECT c_custkey AS account_id, greatest(c_acctbal, 0) * 10 AS cash FROM customer",
    "px": "SELECT ticker, arg_max(close, date) AS price FROM bars_d GROUP BY 1",
    "names": """SELECT s_suppkey AS ticker, CAST((s_suppkey * 7919) % 1009 AS DOUBLE) AS score, price,
    row_number() OVER (ORDER BY (s_suppkey * 7919) % 1009 DESC, s_suppkey) AS rank
  FROM supplier LEFT JOIN px ON px.ticker = s_suppkey""",
    "book": """SELECT h.*, n.rank, n.score, coalesce(n.price, p.price) AS price FROM held AS h
  LEFT JOIN names AS n USING (ticker) LEFT JOIN px AS p USING (ticker)""",
    # every account sees every name it may hold or buy, ranked among those
    "view_of": """SELECT a.account_id, n.ticker, n.rank, h.shares, row_number() OVER (
    PARTITION BY a.account_id ORDER BY n.rank) AS brank
  FROM (SELECT DISTINCT account_id FROM (SELECT account_id FROM held UNION ALL SELECT account_id FROM money)) AS a
  CROSS JOIN names AS n LEFT JOIN held AS h ON h.account_id = a.account_id AND h.ticker = n.ticker
  WHERE h.shares IS NOT NULL OR n.price >= 1000""",
    "kept": """SELECT account_id, ticker FROM view_of WHERE shares IS NOT NULL AND brank <= 20
  QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY brank) <= 8""",
    "n_kept": "SELECT account_id, count(*) AS k FROM kept GROUP BY 1",
    "bought": """SELECT x.account_id, x.ticker FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY brank) AS j
    FROM view_of WHERE shares IS NULL) AS x LEFT JOIN n_kept USING (account_id) WHERE j <= 8 - coalesce(k, 0)""",
    "sleeve": """SELECT account_id, coalesce(cash, 0) + coalesce(stock, 0) AS total FROM money FULL OUTER JOIN (
    SELECT account_id, sum(shares * price) AS stock FROM book WHERE rank IS NOT NULL GROUP BY 1) USING (account_id)""",
    "target": """SELECT account_id, CASE WHEN cnt > 0 THEN least(1.0 / cnt, 0.08) ELSE 0 END * total AS tv FROM sleeve LEFT JOIN (
    SELECT account_id, count(*) AS cnt FROM (SELECT * FROM kept UNION ALL SELECT * FROM bought) GROUP BY 1) USING (account_id)""",
    "rowset": """SELECT b.account_id, b.ticker, b.shares, b.rank, b.price, CASE WHEN b.rank IS NULL THEN 'review'
    WHEN k.ticker IS NOT NULL THEN 'keep' ELSE 'sell' END AS kind FROM book AS b LEFT JOIN kept AS k USING (account_id, ticker)
  UNION ALL SELECT x.account_id, x.ticker, 0, n.rank, n.price, 'buy' FROM bought AS x JOIN names AS n USING (ticker)""",
    "sized": """SELECT *, floor(tv / price) AS lots, floor(tv / price) - shares AS delta,
    CASE WHEN tv <> 0 THEN coalesce((shares * price - tv) / tv, 0) ELSE 0 END AS drift FROM rowset JOIN target USING (account_id)""",
    "acts": """SELECT *, CASE kind WHEN 'sell' THEN 'SELL' WHEN 'review' THEN 'REVIEW' WHEN 'buy' THEN 'BUY' ELSE
    CASE WHEN price IS NULL OR abs(drift) <= 0.25 OR abs(delta * price) < 100 THEN 'HOLD' WHEN delta < 0 THEN 'TRIM' ELSE 'ADD' END END AS action
  FROM sized WHERE NOT (kind = 'buy' AND lots * price < 100)""",
    "plan": """SELECT account_id, ticker, action, rank, shares AS current_shares, CASE action WHEN 'SELL' THEN -shares
    WHEN 'REVIEW' THEN 0 WHEN 'HOLD' THEN 0 WHEN 'BUY' THEN lots ELSE delta END AS trade_shares, price FROM acts""",
}


def _plan(spark, sf):
    pos, cash, scores, price = _accounts(spark, sf)
    return rebalance.plan_rebalance(pos, cash, scores, price, params=_RB), cash


@query("rebalance_plan", with_views("""SELECT account_id, ticker, action, CAST(rank AS INTEGER) AS rank, current_shares,
    trade_shares, trade_shares * price AS trade_value FROM plan""", "bars_d", extra=_PLAN))
def rebalance_plan(spark, sf):
    out, _ = _plan(spark, sf)
    return out.select("account_id", "ticker", "action", "rank", "current_shares", "trade_shares", "trade_value")


@query("rebalance_summary", with_views(f"""SELECT account_id, {r('cash', 'cash', 4)}, count(*) FILTER (action = 'SELL') AS n_sell,
    count(*) FILTER (action = 'BUY') AS n_buy, count(*) FILTER (action IN ('ADD', 'TRIM')) AS n_resize,
    count(*) FILTER (action = 'HOLD') AS n_hold, {r('coalesce(sum(abs(trade_shares * price)), 0) * 6.0 / 10000', 'est_cost', 4)},
    {r('cash - coalesce(sum(trade_shares * price), 0)', 'cash_after', 4)}
  FROM money LEFT JOIN plan USING (account_id) GROUP BY account_id, cash""", "bars_d", extra=_PLAN))
def rebalance_summary(spark, sf):
    out, cash = _plan(spark, sf)
    s = rebalance.plan_summary(out, cash, _RB)
    return rounded(s.select("account_id", "cash", "n_sell", "n_buy", "n_resize", "n_hold", "est_cost", "cash_after"), 4)
