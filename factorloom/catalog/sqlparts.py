"""SQL fragments shared by the oracle queries: features, panels and their ranks."""

from __future__ import annotations

from factorloom.catalog.base import pct_rank_sql
from factorloom.schema import CONCEPTS, DAILY_FEATURES, FLOW_CONCEPTS, MACRO_FEATURES, MONTHLY_FEATURES

_W4 = "OVER (PARTITION BY ticker ORDER BY period_end ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"
_LAG4 = "lag({c}, 4) OVER (PARTITION BY ticker ORDER BY period_end)"

FIRST = """SELECT ticker, concept, period_end,
  arg_min(value, filed_date) FILTER (WHERE value IS NOT NULL) AS value, min(filed_date) AS filed_date
  FROM facts GROUP BY 1, 2, 3"""

WIDE = "SELECT ticker, period_end, max(filed_date) AS availability_date, " + ", ".join(
    f"max(CASE WHEN concept = '{c}' THEN value END) AS {c}" for c in CONCEPTS) + " FROM first_rep GROUP BY 1, 2"

TTM = """SELECT *, {ttm}, revenue / nullif({lr}, 0) - 1 AS revenue_growth_yoy,
  assets / nullif({la}, 0) - 1 AS asset_growth_yoy FROM wide
  WHERE ticker IN (SELECT ticker FROM wide GROUP BY 1 HAVING count(revenue) > 0 AND count(equity) > 0)""".format(
    ttm=", ".join(f"CASE WHEN count({c}) {_W4} = 4 THEN sum({c}) {_W4} END AS {c}_ttm" for c in FLOW_CONCEPTS),
    lr=_LAG4.format(c="revenue"), la=_LAG4.format(c="assets"))

FUND = """SELECT t.ticker, period_end, availability_date, s.gics_sector, revenue_ttm, net_income_ttm,
  gross_profit_ttm, op_cashflow_ttm,
  CASE WHEN operating_income_ttm IS NOT NULL OR dna_ttm IS NOT NULL
    THEN coalesce(operating_income_ttm, 0) + coalesce(dna_ttm, 0) END AS ebitda_ttm,
  equity, assets, nullif(coalesce(debt_lt, 0) + coalesce(debt_cur, 0), 0) AS debt, cash, shares,
  net_income_ttm / nullif(equity, 0) AS roe, gross_profit_ttm / nullif(revenue_ttm, 0) AS gross_margin,
  net_income_ttm / nullif(revenue_ttm, 0) AS profit_margin,
  (net_income_ttm - op_cashflow_ttm) / nullif(assets, 0) AS accruals, revenue_growth_yoy, asset_growth_yoy
  FROM ttm AS t LEFT JOIN sectors AS s ON s.ticker = t.ticker"""

FUND_CTES = {"first_rep": FIRST, "wide": WIDE, "ttm": TTM, "fund": FUND,
             "fund_asof": """SELECT * FROM fund QUALIFY row_number() OVER (
  PARTITION BY ticker, availability_date ORDER BY period_end DESC) = 1"""}


def _frame(fn: str, c: str, lo: str, hi: str) -> str:
    return f"{fn}({c}) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {lo} AND {hi})"


def guarded(fn: str, c: str, lo: str, hi: str, need: int) -> str:
    return f"CASE WHEN {_frame('count', c, lo, hi)} >= {need} THEN {_frame(fn, c, lo, hi)} END"


def compound(lo: str, hi: str, need: int) -> str:
    return f"CASE WHEN {_frame('count', 'lr', lo, hi)} >= {need} THEN exp({_frame('sum', 'lr', lo, hi)}) - 1 END"


MONTHLY_CTES = {
    "ret_dates": "SELECT DISTINCT date FROM rets_m WHERE ret IS NOT NULL",
    "clean_m": """SELECT ticker, date, close, CASE WHEN ret BETWEEN -0.95 AND 3.0 THEN ret END AS ret
  FROM rets_m WHERE date IN (SELECT date FROM ret_dates)""",
    "feat_m": f"""SELECT ticker, date, close AS price, ret,
  {compound('12 PRECEDING', '2 PRECEDING', 11)} AS momentum_12_2,
  {compound('6 PRECEDING', '1 PRECEDING', 6)} AS momentum_6_1,
  {guarded('stddev_samp', 'ret', '11 PRECEDING', 'CURRENT ROW', 12)} AS volatility_12m,
  lead(ret) OVER (PARTITION BY ticker ORDER BY date) AS forward_return
  FROM (SELECT *, ln(1 + ret) AS lr FROM clean_m)""",
}

_VALUATION = """price * shares AS market_cap, net_income_ttm / nullif(price * shares, 0) AS earnings_yield,
  equity / nullif(price * shares, 0) AS book_to_price,
  ebitda_ttm / nullif(price * shares + coalesce(debt, 0) - coalesce(cash, 0), 0) AS ev_ebitda_inv,
  CASE WHEN price * shares > 0 THEN ln(price * shares) END AS size_log_mktcap"""

_FUND_COLS = """f.net_income_ttm, f.ebitda_ttm, f.equity, f.assets, f.debt, f.cash, f.shares, f.roe,
  f.gross_margin, f.profit_margin, f.accruals, f.revenue_growth_yoy, f.asset_growth_yoy"""

RAW_M_CTES = {
    "joined_m": f"""SELECT g.*, {_FUND_COLS}, f.availability_date, s.gics_sector
  FROM feat_m AS g ASOF LEFT JOIN fund_asof AS f ON g.ticker = f.ticker AND g.date >= f.availability_date
  LEFT JOIN (SELECT * FROM sectors WHERE gics_sector IS NOT NULL) AS s ON s.ticker = g.ticker""",
    "raw_m": f"""SELECT j.date, j.ticker, gics_sector, forward_return, {_VALUATION}, momentum_12_2, momentum_6_1,
  volatility_12m, roe, gross_margin, profit_margin, accruals, revenue_growth_yoy, asset_growth_yoy,
  {', '.join(MACRO_FEATURES)} FROM joined_m AS j LEFT JOIN macro_m AS m ON m.date = j.date""",
}

PANEL_M = {"panel": "SELECT date, ticker, gics_sector, forward_return, market_cap, " + ", ".join(
    f"{pct_rank_sql(c, 'date, gics_sector', 'gics_sector IS NOT NULL')} AS {c}" for c in MONTHLY_FEATURES)
    + f", {pct_rank_sql('forward_return', 'date, gics_sector', 'gics_sector IS NOT NULL')} AS target FROM raw_m"}

PANEL_VIEWS = ("close_m", "rets_m", "facts", "sectors", "macro_m")
PANEL_CTES = {**FUND_CTES, **MONTHLY_CTES, **RAW_M_CTES, **PANEL_M}
RAW_CTES = {**FUND_CTES, **MONTHLY_CTES, **RAW_M_CTES}


def daily_ctes(bars: str) -> dict[str, str]:
    """Dense-grid daily features over a bars view."""
    return {
        "grid_d": f"""SELECT a.ticker, b.date FROM (SELECT DISTINCT ticker FROM {bars}) AS a
  CROSS JOIN (SELECT DISTINCT date FROM {bars}) AS b""",
        "ret_d": f"""SELECT g.ticker, g.date, p.close, p.high, p.low, p.volume,
  p.close / lag(p.close) OVER (PARTITION BY g.ticker ORDER BY g.date) - 1 AS ret
  FROM grid_d AS g LEFT JOIN {bars} AS p ON p.ticker = g.ticker AND p.date = g.date""",
        "clean_d": """SELECT *, ln(1 + ret) AS lr, abs(ret) / nullif(close * volume, 0) AS illiq,
  (high - low) / nullif(close, 0) AS span
  FROM (SELECT * REPLACE (CASE WHEN ret BETWEEN -0.9 AND 2.0 THEN ret END AS ret) FROM ret_d)""",
        "feat_d": f"""SELECT ticker, date, close AS price, ret AS rev_1d,
  {compound('4 PRECEDING', 'CURRENT ROW', 5)} AS rev_5d,
  {compound('20 PRECEDING', 'CURRENT ROW', 21)} AS rev_21d,
  {compound('251 PRECEDING', '21 PRECEDING', 231)} AS mom_252_21,
  {guarded('stddev_samp', 'ret', '20 PRECEDING', 'CURRENT ROW', 21)} AS vol_21d,
  {guarded('stddev_samp', 'ret', '62 PRECEDING', 'CURRENT ROW', 63)} AS vol_63d,
  {guarded('avg', 'volume', '19 PRECEDING', 'CURRENT ROW', 20)}
    / nullif({guarded('avg', 'volume', '59 PRECEDING', 'CURRENT ROW', 60)}, 0) AS volume_surge,
  {guarded('avg', 'illiq', '20 PRECEDING', 'CURRENT ROW', 15)} * 1e6 AS amihud_21d,
  {guarded('avg', 'span', '20 PRECEDING', 'CURRENT ROW', 15)} AS range_21d,
  close / nullif({guarded('max', 'close', '251 PRECEDING', 'CURRENT ROW', 126)}, 0) AS dist_52w_high,
  {compound('1 FOLLOWING', '5 FOLLOWING', 5)} AS fwd_5d,
  {compound('1 FOLLOWING', '10 FOLLOWING', 10)} AS fwd_10d,
  {compound('1 FOLLOWING', '30 FOLLOWING', 30)} AS fwd_30d FROM clean_d""",
        "joined_d": f"""SELECT g.*, {_FUND_COLS}, s.gics_sector
  FROM (SELECT * FROM feat_d WHERE price IS NOT NULL) AS g
  ASOF LEFT JOIN fund_asof AS f ON g.ticker = f.ticker AND g.date >= f.availability_date
  LEFT JOIN (SELECT * FROM sectors WHERE gics_sector IS NOT NULL) AS s ON s.ticker = g.ticker""",
        "raw_d": f"SELECT *, {_VALUATION} FROM joined_d",
        "panel_d": "SELECT date, ticker, gics_sector, market_cap, fwd_5d, fwd_10d, fwd_30d, " + ", ".join(
            f"{pct_rank_sql(c, 'date, gics_sector', 'gics_sector IS NOT NULL')} AS {c}" for c in DAILY_FEATURES)
        + ", " + ", ".join(
            f"{pct_rank_sql(f'fwd_{h}d', 'date, gics_sector', 'gics_sector IS NOT NULL')} AS target_{h}d"
            for h in (5, 10, 30)) + " FROM raw_d",
    }


def spearman_ctes(pairs: str, by: str, name: str = "ic") -> dict[str, str]:
    """Per-group rank correlation of (x, y) over complete pairs, five at least."""
    ranks = lambda c: (f"rank() OVER (PARTITION BY {by} ORDER BY {c})"
                       f" + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2.0")
    return {
        f"{name}_ranks": f"""SELECT {by}, {ranks('x')} - (count(*) OVER (PARTITION BY {by}) + 1) / 2.0 AS rx,
  {ranks('y')} - (count(*) OVER (PARTITION BY {by}) + 1) / 2.0 AS ry FROM {pairs}""",
        name: f"""SELECT * FROM (SELECT {by}, CASE WHEN count(*) >= 5
  THEN sum(rx * ry) / nullif(sqrt(sum(rx * rx) * sum(ry * ry)), 0) END AS ic FROM {name}_ranks GROUP BY {by}) WHERE ic IS NOT NULL""",
    }


def unpivot(source: str, signals, target: str, keep: str) -> str:
    """Complete (signal, target) pairs as a union."""
    return " UNION ALL ".join(
        f"SELECT {keep}, '{s}' AS signal, {s} AS x, {target} AS y FROM {source} "
        f"WHERE {s} IS NOT NULL AND {target} IS NOT NULL" for s in signals)


SUMMARY = """avg(ic) AS ic_mean, stddev_samp(ic) AS ic_std, avg(ic) / nullif(stddev_samp(ic), 0) AS ic_ir,
  avg(ic) / nullif(stddev_samp(ic), 0) * sqrt(count(ic)) AS t_stat,
  avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate, count(ic) AS n_months"""


# ------------------------------------------------------------------- elastic nets, solved in SQL

_N = len(MONTHLY_FEATURES)
_AVG = lambda e: f"avg({e})"


def elastic_net_ctes(jobs: str, panel: str = "panel") -> dict[str, str]:
    """Coordinate descent for every row of ``jobs`` (job, train_end_pos, alpha, l1_ratio): CTE est (job, b, intercept).

    Centred second moments over the dates before train_end_pos; one pass over all coordinates is a
    step of a recursive query, which ends for a job when no coordinate moves any more.
    """
    x = [f"x[{i + 1}]" for i in range(_N)]
    moments = ", ".join("[" + ", ".join(f"avg({a} * {b}) - avg({a}) * avg({b})" for b in x) + "]" for a in x)
    rho = "(c[j[1]::INT] - list_dot_product(s[j[1]::INT], b) + s[j[1]::INT][j[1]::INT] * b[j[1]::INT])"
    step = (f"CASE WHEN s[j[1]::INT][j[1]::INT] > 0 THEN (greatest({rho} - l1, 0) + least({rho} + l1, 0)) / (s[j[1]::INT][j[1]::INT] + l2) "
            "ELSE b[j[1]::INT] END")
    turn = f"lambda b, j: list_concat(list_concat(b[:j[1]::INT - 1], [{step}]), b[j[1]::INT + 1:])"
    places = ", ".join(f"[{i + 1}.0::DOUBLE]" for i in range(_N))
    return {
        "cal": f"SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM (SELECT DISTINCT date FROM {panel})",
        "jobs": jobs,
        "ep": f"""SELECT date, ticker, forward_return, pos, [{', '.join(f'coalesce({f}, 0.5)' for f in MONTHLY_FEATURES)}]::DOUBLE[] AS x, target AS t
  FROM {panel} JOIN cal USING (date)""",
        "moments": f"""SELECT e AS train_end_pos, count(*) AS n, [{', '.join(map(_AVG, x))}] AS mx, avg(t) AS my, [{moments}] AS s,
  [{', '.join(f'avg({a} * t) - avg({a}) * avg(t)' for a in x)}] AS c
  FROM ep JOIN (SELECT DISTINCT train_end_pos AS e FROM jobs) ON pos < e WHERE t IS NOT NULL GROUP BY e""",
        "problem": "SELECT job, alpha * l1_ratio AS l1, alpha * (1 - l1_ratio) AS l2, mx, my, s, c FROM jobs JOIN moments USING (train_end_pos) WHERE n >= 20",
        "descent": f"""SELECT job, 0 AS it, list_transform(mx, lambda v: 0.0::DOUBLE) AS b, 1.0::DOUBLE AS moved FROM problem
  UNION ALL SELECT job, it + 1, nb, list_max(list_transform(nb, lambda v, i: abs(v - b[i]))) FROM (
    SELECT job, it, d.b, list_reduce([d.b, {places}], {turn}) AS nb FROM descent AS d JOIN problem USING (job) WHERE it < 5000 AND moved >= 1e-11)""",
        "est": "SELECT job, b, my - list_dot_product(mx, b) AS intercept FROM problem JOIN (SELECT job, arg_max(b, it) AS b FROM descent GROUP BY job) USING (job)",
    }


def recursive_sql(sql: str) -> str:
    """``sql`` with its first WITH allowing recursion; a recursive part can't be materialized."""
    return sql.replace("WITH ", "WITH RECURSIVE ", 1).replace("descent AS MATERIALIZED", "descent AS", 1)


def fold_jobs(least: int, alpha: float, l1_ratio: float) -> str:
    """One job a fold that tests one date after an embargo of one."""
    return (f"SELECT pos - {least + 1} AS job, pos - 1 AS train_end_pos, {alpha}::DOUBLE AS alpha, {l1_ratio}::DOUBLE AS l1_ratio "
            f"FROM cal WHERE pos >= {least + 1}")


OOS = """SELECT date, ticker, job AS fold, intercept + list_dot_product(x, b) AS pred, forward_return
  FROM ep JOIN jobs ON pos = train_end_pos + 1 JOIN est USING (job)"""
