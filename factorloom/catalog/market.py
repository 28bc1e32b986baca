"""Registered queries: prices, fundamentals and panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from factorloom.catalog import views as v
from factorloom.catalog.base import pct_rank_sql, query, r, rounded, rs
from factorloom.catalog.sqlparts import (
    FUND_CTES, MONTHLY_CTES, PANEL_CTES, PANEL_VIEWS, RAW_CTES, daily_ctes)
from factorloom.catalog.views import with_views
from factorloom.functions.cross_section import exact_quantiles, normalize, pct_rank
from factorloom.functions.scalars import with_valuation
from factorloom.functions.windows import mask_outside
from factorloom.operators import asof, fundamentals, prices, universe
from factorloom.operators.calendar import calendar, densify
from factorloom.plans.panel import assemble_panel, attach_fundamentals, monthly_grid, price_features
from factorloom.plans.panel_daily import assemble_panel_daily, daily_returns, forward_labels, technical_features
from factorloom.schema import DAILY_FEATURES, FUNDAMENTAL_COLUMNS, MACRO_FEATURES, MONTHLY_FEATURES, PANEL_COLUMNS


def fund(spark, sf):
    return fundamentals.derive_fundamental_features(v.facts(spark, sf), v.sectors(spark, sf))


def fund_table(spark, sf):
    return v.stored(spark, sf, "fundamental_features", fund)


def panel_table(spark, sf):
    return v.stored(spark, sf, "panel_monthly", panel)


def panel_daily_table(spark, sf):
    return v.stored(spark, sf, "panel_daily", panel_daily)


def panel(spark, sf, **kw):
    return assemble_panel(v.close_m(spark, sf), fund(spark, sf), v.macro_m(spark, sf), v.sectors(spark, sf),
                          price_calendar=v.sessions(spark, sf, "month"), **kw)


def panel_daily(spark, sf, **kw):
    return assemble_panel_daily(v.bars_w(spark, sf), fund(spark, sf), v.sectors(spark, sf),
                                price_calendar=v.sessions(spark, sf, "week"), **kw)


# ------------------------------------------------------------------------------------ prices


@query("monthly_close", with_views("SELECT ticker, date, close FROM close_m", "close_m"))
def monthly_close(spark, sf):
    return v.close_m(spark, sf)


@query("monthly_returns_masked", with_views(
    f"""SELECT ticker, date, close,
    {r('CASE WHEN ret BETWEEN -0.95 AND 3.0 THEN ret END', 'ret', 9)},
    CASE WHEN ret IS NOT NULL AND NOT (ret BETWEEN -0.95 AND 3.0) THEN 1 ELSE 0 END AS masked FROM rets_m""", "rets_m"))
def monthly_returns_masked(spark, sf):
    closes = v.closes(spark, sf)
    grid = densify(prices.simple_returns(closes).drop("pos"), calendar(closes))
    bounds = (-0.95, 3.0)
    out = grid.withColumn("masked", F.coalesce((~F.col("ret").between(*bounds)).cast("int"), F.lit(0)))
    ret = F.round(mask_outside(F.col("ret"), bounds), 9) + F.lit(0.0)
    return out.withColumn("ret", ret).drop("pos")


@query("masked_return_count", with_views(
    "SELECT count(*) AS n_masked FROM rets_m WHERE NOT (ret BETWEEN -0.95 AND 3.0)", "rets_m"))
def masked_return_count(spark, sf):
    return prices.count_masked(v.rets_m(spark, sf), (-0.95, 3.0))


@query("momentum_vol", with_views(
    f"SELECT ticker, date, {rs(['momentum_12_2', 'momentum_6_1', 'volatility_12m'])} FROM feat_m",
    "rets_m", extra=MONTHLY_CTES))
def momentum_vol(spark, sf):
    feats = price_features(monthly_grid(v.closes(spark, sf)))
    return rounded(feats.select("ticker", "date", "momentum_12_2", "momentum_6_1", "volatility_12m"))


@query("forward_return", with_views(
    f"SELECT ticker, date, {r('forward_return', 'forward_return')} FROM feat_m", "rets_m", extra=MONTHLY_CTES))
def forward_return(spark, sf):
    feats = price_features(monthly_grid(v.closes(spark, sf)))
    return rounded(feats.select("ticker", "date", "forward_return"))


_TECH = DAILY_FEATURES[:10]


@query("daily_features", with_views(
    f"SELECT ticker, date, {rs(_TECH)} FROM feat_d WHERE price IS NOT NULL", "bars_w", extra=dict(list(daily_ctes('bars_w').items())[:4])))
def daily_features(spark, sf):
    return rounded(technical_features(daily_returns(v.bars_w(spark, sf))).select("ticker", "date", *_TECH))


@query("daily_features_sparse", with_views(
    f"SELECT ticker, date, {rs(_TECH)} FROM feat_d WHERE price IS NOT NULL", "bars_d", extra=dict(list(daily_ctes('bars_d').items())[:4])))
def daily_features_sparse(spark, sf):
    return rounded(technical_features(daily_returns(v.bars_d(spark, sf), price_calendar=v.sessions(spark, sf, "day"))).select("ticker", "date", *_TECH))


@query("forward_h", with_views(
    f"SELECT ticker, date, {rs(['fwd_5d', 'fwd_10d', 'fwd_30d'])} FROM feat_d WHERE price IS NOT NULL",
    "bars_w", extra=dict(list(daily_ctes('bars_w').items())[:4])))
def forward_h(spark, sf):
    out = forward_labels(daily_returns(v.bars_w(spark, sf)), (5, 10, 30))
    return rounded(out.select("ticker", "date", "fwd_5d", "fwd_10d", "fwd_30d"))


@query("adv_liquidity", with_views(f"""SELECT ticker, {r('adv', 'adv', 2)}, adv >= 380000.0 AS is_liquid FROM (
  SELECT ticker, date, CASE WHEN count(dv) OVER w >= 30 THEN avg(dv) OVER w END AS adv
  FROM (SELECT g.ticker, g.date, p.close * p.volume AS dv FROM grid_d AS g
    LEFT JOIN bars_w AS p ON p.ticker = g.ticker AND p.date = g.date)
  WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))
  WHERE date = (SELECT max(date) FROM bars_w)""", "bars_w", extra=dict(list(daily_ctes('bars_w').items())[:1])))
def adv_liquidity(spark, sf):
    adv = prices.average_dollar_volume(v.bars_w(spark, sf))
    return rounded(adv.withColumn("is_liquid", F.col("adv") >= 380_000.0), 2)


@query("liquid_universe", with_views("""SELECT s.ticker, s.gics_sector FROM sectors AS s WHERE s.ticker IN (
  SELECT b.ticker FROM bars_w AS b JOIN (
    SELECT DISTINCT date FROM bars_w ORDER BY date DESC LIMIT 60) AS d ON d.date = b.date
  GROUP BY 1 HAVING count(b.close * b.volume) >= 30 AND avg(b.close * b.volume) >= 380000.0)""", "bars_w", "sectors"))
def liquid_universe(spark, sf):
    bars = v.bars_w(spark, sf)
    return prices.liquid(v.sectors(spark, sf), prices.average_dollar_volume(bars), 380_000.0)


@query("rebased_tickers", with_views(f"""SELECT ticker, {r('deviation', 'deviation')} FROM (
  SELECT n.ticker, median(abs(n.close * CASE WHEN n.ticker % 7 = 3 THEN 10 ELSE 1 END / nullif(o.close, 0) - 1)) AS deviation
  FROM close_m AS n JOIN close_m AS o ON o.ticker = n.ticker AND o.date = n.date
  WHERE n.date < DATE '2001-06-30' GROUP BY 1) WHERE deviation > 0.02""", "close_m"))
def rebased_tickers(spark, sf):
    stored = v.closes(spark, sf)
    fresh = stored.withColumn("close", F.col("close") * F.when(F.col("ticker") % 7 == 3, 10).otherwise(1))
    return rounded(prices.rebased_tickers(fresh, stored, "2001-06-30"))


@query("suspect_tickers", with_views(f"""SELECT ticker, count(*) AS n_moves, {r('min(ret)', 'worst')}, {r('max(ret)', 'best')}
  FROM rets_m WHERE ret > 1.0 OR ret < -0.75 GROUP BY 1""", "rets_m"))
def suspect_tickers(spark, sf):
    return rounded(prices.suspect_tickers(v.rets_m(spark, sf)))


@query("latest_close", with_views("""SELECT DISTINCT ON (ticker) ticker, close FROM bars_d
  WHERE date >= (SELECT max(date) FROM bars_d) - INTERVAL 10 DAYS ORDER BY ticker, date DESC""", "bars_d"))
def latest_close(spark, sf):
    return prices.latest_close(v.bars_d(spark, sf))


@query("coalesce_merge", """WITH o AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS d,
    max(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END) AS px, max(o_orderkey) AS k
    FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01' GROUP BY 1, 2),
  n AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS d, max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS px
    FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY 1, 2)
  SELECT coalesce(n.o_custkey, o.o_custkey) AS o_custkey, coalesce(n.d, o.d) AS d, coalesce(n.px, o.px) AS px, o.k AS k
  FROM o FULL OUTER JOIN n ON n.o_custkey = o.o_custkey AND n.d = o.d""")
def coalesce_merge(spark, sf):
    orders = v.table(spark, sf, "orders").withColumn("d", F.col("o_orderdate").cast("date"))
    old = orders.where("o_orderdate < timestamp_ntz'2000-01-01 00:00:00'").groupBy("o_custkey", "d").agg(
        F.max(F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))).alias("px"), F.max("o_orderkey").alias("k"))
    new = orders.where("o_orderdate >= timestamp_ntz'1997-01-01 00:00:00'").groupBy("o_custkey", "d").agg(
        F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("px"))
    return prices.coalesce_merge(old, new, ["o_custkey", "d"])


@query("append_keep_last", """SELECT o_custkey, o_orderpriority,
    coalesce(max(CASE WHEN late THEN o_totalprice END), max(CASE WHEN NOT late THEN o_totalprice END)) AS px
  FROM (SELECT o_custkey, o_orderpriority, o_totalprice, o_orderdate >= TIMESTAMP '1998-01-01' AS late FROM orders)
  GROUP BY 1, 2""")
def append_keep_last(spark, sf):
    o = v.table(spark, sf, "orders")
    part = lambda p: o.where(p).groupBy("o_custkey", "o_orderpriority").agg(F.max("o_totalprice").alias("px"))
    cut = "timestamp_ntz'1998-01-01 00:00:00'"
    return prices.append_keep_last([part(f"o_orderdate < {cut}"), part(f"o_orderdate >= {cut}")],
                                   ["o_custkey", "o_orderpriority"])


@query("replace_history", with_views("""SELECT ticker, date, close, FALSE AS fresh FROM close_m
  WHERE ticker % 4 <> 1 UNION ALL SELECT ticker, date, close * 2, TRUE FROM close_m WHERE ticker % 4 = 1""", "close_m"))
def replace_history(spark, sf):
    stored = v.closes(spark, sf).withColumn("fresh", F.lit(False))
    fresh = stored.where("ticker % 4 = 1").withColumns({"close": F.col("close") * 2, "fresh": F.lit(True)})
    return prices.replace_history(stored, fresh)


@query("prices_wide", with_views(f"""SELECT date, {', '.join(r(f"avg(CASE WHEN gics_sector = 'S{i}' THEN close END)", f'S{i}') for i in range(5))}
  FROM close_m JOIN sectors USING (ticker) WHERE gics_sector IS NOT NULL GROUP BY date""", "close_m", "sectors"))
def prices_wide(spark, sf):
    c = v.closes(spark, sf).join(v.sectors(spark, sf), "ticker").where(F.col("gics_sector").isNotNull())
    index = c.groupBy("date", F.col("gics_sector").alias("ticker")).agg(F.avg("close").alias("close"))
    return rounded(prices.to_wide(index, [f"S{i}" for i in range(5)]))


@query("bars_from_wide", f"""WITH b AS (SELECT CAST(l_shipdate AS DATE) AS date, l_returnflag AS ticker, max(l_extendedprice) AS high,
    min(l_extendedprice) AS low, max(CASE WHEN l_linestatus = 'O' THEN l_extendedprice END) AS close, sum(l_quantity) AS volume
  FROM lineitem GROUP BY 1, 2) SELECT date, ticker, high, low, close, volume FROM b WHERE close IS NOT NULL""")
def bars_from_wide(spark, sf):
    li = v.table(spark, sf, "lineitem")
    flags = ["A", "N", "R"]
    on = lambda f, c: F.when(F.col("l_returnflag") == f, c)
    price = F.col("l_extendedprice")
    wide_bars = li.groupBy(F.col("l_shipdate").cast("date").alias("date")).agg(*(
        x for f in flags for x in (
            F.max(on(f, price)).alias(f"high_{f}"), F.min(on(f, price)).alias(f"low_{f}"),
            F.max(on(f, F.when(F.col("l_linestatus") == "O", price))).alias(f"close_{f}"),
            F.sum(on(f, F.col("l_quantity"))).alias(f"volume_{f}"))))
    return prices.bars_from_wide(wide_bars, flags, fields=("high", "low", "close", "volume"))


@query("valid_prices", """SELECT o_custkey AS ticker, CAST(o_orderdate AS DATE) AS date, max(o_totalprice - 100000) AS close
  FROM orders GROUP BY 1, 2 HAVING max(o_totalprice - 100000) > 0""")
def valid_prices(spark, sf):
    o = v.table(spark, sf, "orders")
    rows = o.groupBy(F.col("o_custkey").alias("ticker"), F.col("o_orderdate").cast("date").alias("date")).agg(
        F.max(F.col("o_totalprice") - 100000).alias("close"))
    return prices.valid_prices(rows)


@query("incremental_start", """SELECT d AS last_stored, least(
    CAST(date_trunc('month', d - 1) - INTERVAL 1 MONTH AS DATE), CAST(DATE '2001-12-01' - 105 AS DATE)) AS start_date
  FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)""")
def incremental_start(spark, sf):
    from factorloom.functions.dates import incremental_start as start

    days = v.table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("last_stored")).distinct()
    return days.withColumn("start_date", start(F.col("last_stored"), F.lit("2001-12-01").cast("date")))


@query("calendar_arithmetic", """SELECT d, last_day(d) AS month_end, last_day(d + 1) AS next_month_end,
    CAST(date_trunc('month', d - 1) AS DATE) AS month_begin, CAST(date_trunc('quarter', d) AS DATE) AS quarter_start,
    CASE WHEN date_diff('day', CAST(date_trunc('quarter', d) - INTERVAL 1 DAY AS DATE), d)
           < date_diff('day', d, CAST(date_trunc('quarter', d) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE))
         THEN CAST(date_trunc('quarter', d) - INTERVAL 1 DAY AS DATE)
         ELSE CAST(date_trunc('quarter', d) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) END AS nearest_quarter_end,
    CASE WHEN month(d) IN (3, 6, 9, 12) THEN 'Q' || quarter(d) END AS label
  FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem)""")
def calendar_arithmetic(spark, sf):
    from factorloom.functions import dates as D

    d = F.col("d")
    days = v.table(spark, sf, "lineitem").select(F.col("l_shipdate").cast("date").alias("d")).distinct()
    return days.select("d", D.month_end(d).alias("month_end"), D.next_month_end(d).alias("next_month_end"),
                       D.month_begin_back(d, 1).alias("month_begin"), D.quarter_start(d).alias("quarter_start"),
                       D.nearest_quarter_end(d).alias("nearest_quarter_end"), D.quarter_label(d).alias("label"))


@query("every_kth_session", with_views("""SELECT b.ticker, b.date FROM bars_w AS b JOIN (
    SELECT date, row_number() OVER (ORDER BY date) - 1 AS p FROM (SELECT DISTINCT date FROM bars_w WHERE date >= DATE '1998-01-01'))
    AS d ON d.date = b.date WHERE d.p % 5 = 0""", "bars_w"))
def every_kth_session(spark, sf):
    from factorloom.operators.calendar import every_kth

    return every_kth(v.bars_w(spark, sf), 5, since="1998-01-01").select("ticker", "date")


# ------------------------------------------------------------------------------ fundamentals


@query("first_reported", with_views(
    "SELECT ticker, concept, period_end, value, filed_date FROM first_rep",
    "facts", extra={"first_rep": FUND_CTES["first_rep"]}))
def first_reported(spark, sf):
    return fundamentals.first_reported(v.facts(spark, sf))


@query("asof_version", with_views("""SELECT ticker, concept, period_end, arg_max(value, filed_date) AS value,
    max(filed_date) AS filed_date FROM facts WHERE filed_date <= DATE '1998-08-15' AND value IS NOT NULL GROUP BY 1, 2, 3""", "facts"))
def asof_version(spark, sf):
    known = v.facts(spark, sf).where(F.col("value").isNotNull())
    return asof.as_known_on(known, ["ticker", "concept", "period_end"], "1998-08-15")


_KNOWN = """SELECT ticker, greatest(period_end, filed_date) AS t, max(row(period_end, filed_date, value)) OVER (
    PARTITION BY ticker ORDER BY greatest(period_end, filed_date)) AS best FROM facts WHERE concept = 'revenue' AND value IS NOT NULL"""
_KNOWN_SQL = with_views("""SELECT l_orderkey, l_linenumber, l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS known_on,
    best[1] AS period_end, best[2] AS filed_date, round(best[3], 2) + 0.0 AS value
  FROM lineitem ASOF LEFT JOIN (SELECT DISTINCT * FROM known) AS k ON l_suppkey = k.ticker AND CAST(l_shipdate AS DATE) >= k.t""",
                        "facts", extra={"known": _KNOWN})


def _known_per_row(spark, sf, bucket=None):
    """The newest revenue that was public on each line item's own day."""
    lines = v.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("ticker"), "l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("known_on"))
    revenue = v.facts(spark, sf).where("concept = 'revenue' AND value IS NOT NULL").drop("concept")
    return rounded(asof.asof_known(lines, revenue, ["ticker"], "known_on", bucket=bucket), 2)


@query("asof_known", _KNOWN_SQL)
def asof_known(spark, sf):
    return _known_per_row(spark, sf)


@query("asof_known_bucketed", _KNOWN_SQL)
def asof_known_bucketed(spark, sf):
    return _known_per_row(spark, sf, "year")


@query("asof_restated", with_views("""SELECT f.ticker, f.period_end, f.known_on, r.filed_date, round(r.value, 5) + 0.0 AS value
  FROM (SELECT ticker, period_end, CAST(period_end + CAST(ticker % 300 AS INTEGER) AS DATE) AS known_on
        FROM (SELECT DISTINCT ticker, period_end FROM facts)) AS f
  ASOF LEFT JOIN (SELECT * FROM facts WHERE concept = 'net_income') AS r
  ON f.ticker = r.ticker AND f.period_end = r.period_end AND f.known_on >= r.filed_date""", "facts"))
def asof_restated(spark, sf):
    """One quarter's figure as it stood on a day that differs from row to row."""
    facts = v.facts(spark, sf)
    asked = facts.select("ticker", "period_end").distinct().withColumn("known_on", F.expr("date_add(period_end, cast(ticker % 300 as int))"))
    income = facts.where("concept = 'net_income'").drop("concept")
    return rounded(asof.asof_join(asked, income, ["ticker", "period_end"], "known_on", "filed_date"), 5)


_RATIOS = ["roe", "gross_margin", "profit_margin", "accruals", "revenue_growth_yoy", "asset_growth_yoy"]
_LEVELS = [c for c in FUNDAMENTAL_COLUMNS if c not in _RATIOS + ["ticker", "period_end", "availability_date", "gics_sector"]]


@query("ttm_yoy", with_views(
    f"""SELECT ticker, period_end, availability_date, gics_sector, {rs(_RATIOS)}, {rs(_LEVELS, 4)} FROM fund""",
    "facts", "sectors", extra=FUND_CTES))
def ttm_yoy(spark, sf):
    return rounded(fund(spark, sf), 6, **{c: 4 for c in _LEVELS})


@query("revenue_equity_gate", with_views("""SELECT ticker FROM facts GROUP BY 1
  HAVING count(CASE WHEN concept = 'revenue' THEN value END) > 0 AND count(CASE WHEN concept = 'equity' THEN value END) > 0""", "facts"))
def revenue_equity_gate(spark, sf):
    return prices.has_data(v.facts(spark, sf), {
        "has_revenue": "concept = 'revenue' and value is not null", "has_equity": "concept = 'equity' and value is not null"})


@query("filing_lags", with_views("""SELECT quantile_cont(lag, 0.5) AS median_lag, CAST(max(lag) AS DOUBLE) AS max_lag
  FROM (SELECT CAST(date_diff('day', period_end, availability_date) AS DOUBLE) AS lag FROM fund)""",
    "facts", "sectors", extra=FUND_CTES))
def filing_lags(spark, sf):
    return fundamentals.filing_lags(fund_table(spark, sf))


@query("quarters_per_ticker", with_views("SELECT ticker, count(DISTINCT period_end) AS n_quarters FROM fund GROUP BY 1",
                                         "facts", "sectors", extra=FUND_CTES))
def quarters_per_ticker(spark, sf):
    return fundamentals.quarters_per_ticker(fund_table(spark, sf))


_AS_KNOWN = ["roe", "gross_margin", "profit_margin", "accruals", "revenue_growth_yoy", "asset_growth_yoy"]


@query("asof_fundamentals", with_views(
    f"SELECT ticker, date, availability_date, {rs(_AS_KNOWN)}, {rs(['equity', 'shares', 'net_income_ttm'], 4)} FROM joined_m",
    *PANEL_VIEWS, extra=RAW_CTES))
def asof_fundamentals(spark, sf):
    grid = monthly_grid(v.closes(spark, sf))
    out = attach_fundamentals(grid, fund_table(spark, sf)).select(
        "ticker", "date", "availability_date", *_AS_KNOWN, "equity", "shares", "net_income_ttm")
    return rounded(out, 6, equity=4, shares=4, net_income_ttm=4)


@query("asof_fundamentals_bucketed", with_views(
    f"SELECT ticker, date, availability_date, {rs(_AS_KNOWN)}, {rs(['equity', 'shares', 'net_income_ttm'], 4)} FROM joined_m",
    *PANEL_VIEWS, extra=RAW_CTES))
def asof_fundamentals_bucketed(spark, sf):
    """The same join from two tables laid out by ticker: nothing is shuffled."""
    return rounded(bucketed_fundamentals(spark, sf), 6, equity=4, shares=4, net_income_ttm=4)


def bucketed_fundamentals(spark, sf):
    from factorloom.plans.panel import FUNDAMENTAL_INPUTS
    from factorloom.sinks.bucketed import write_bucketed

    grid = monthly_grid(v.closes(spark, sf)).select("ticker", "date")
    known = fund_table(spark, sf).select("ticker", "availability_date", "period_end", *FUNDAMENTAL_INPUTS)
    left = spark.table(write_bucketed(grid, "ticker", ["date"], buckets=16))
    right = spark.table(write_bucketed(known, "ticker", ["availability_date"], buckets=16))
    out = asof.asof_join_colocated(left, right, "ticker", "date", "availability_date", tie="period_end")
    return out.select("ticker", "date", "availability_date", *_AS_KNOWN, "equity", "shares", "net_income_ttm")


@query("asof_events", """SELECT p.event_id, p.user_id, p.ts, v.event_id AS view_id, v.value AS view_value
  FROM (SELECT * FROM events WHERE event_type = 'purchase') AS p
  ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view'
    QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) = 1) AS v
  ON p.user_id = v.user_id AND p.ts >= v.ts""")
def asof_events(spark, sf):
    """Last view before each purchase. One user may hold most events, so tasks are cut by day."""
    e = v.table(spark, sf, "events")
    seen = e.where("event_type = 'view'").select(
        "user_id", F.col("ts").alias("view_ts"), F.col("event_id").alias("view_id"), F.col("value").alias("view_value"))
    bought = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    out = asof.asof_join(bought, seen, ["user_id"], "ts", "view_ts", tie="view_id", bucket="day")
    return out.select("event_id", "user_id", "ts", "view_id", "view_value")


_VALUE = ["earnings_yield", "book_to_price", "ev_ebitda_inv", "size_log_mktcap"]


@query("valuation_ratios", with_views(
    f"SELECT ticker, date, {r('market_cap', 'market_cap', 0)}, {rs(_VALUE)} FROM raw_m", *PANEL_VIEWS, extra=RAW_CTES))
def valuation_ratios(spark, sf):
    grid = monthly_grid(v.closes(spark, sf)).withColumnRenamed("close", "price")
    out = with_valuation(attach_fundamentals(grid, fund_table(spark, sf)))
    return rounded(out.select("ticker", "date", "market_cap", *_VALUE), 6, market_cap=0)


# ------------------------------------------------------------------------------------ panels


@query("macro_broadcast", with_views(
    f"SELECT c.ticker, c.date, {rs(MACRO_FEATURES, 7)} FROM close_m AS c LEFT JOIN macro_m AS m ON m.date = c.date",
    "close_m", "macro_m"))
def macro_broadcast(spark, sf):
    out = v.closes(spark, sf).join(F.broadcast(v.macro_m(spark, sf)), "date", "left")
    return rounded(out.select("ticker", "date", *MACRO_FEATURES), 7)


@query("sector_pct_rank", with_views(
    f"""SELECT ticker, date, gics_sector, {r(pct_rank_sql('close', 'date, gics_sector', 'gics_sector IS NOT NULL'), 'rank_in_sector')},
    {r(pct_rank_sql('close', 'date'), 'rank_in_date')} FROM close_m LEFT JOIN sectors USING (ticker)""", "close_m", "sectors"))
def sector_pct_rank(spark, sf):
    rows = v.closes(spark, sf).join(v.sectors(spark, sf), "ticker", "left")
    kw = dict(keys=("date", "ticker"))
    out = pct_rank(rows, ["close"], ["date", "gics_sector"], names={"close": "rank_in_sector"}, **kw)
    out = pct_rank(out, ["close"], ["date"], names={"close": "rank_in_date"}, **kw)
    return rounded(out.drop("close"))


_Z = """SELECT ticker, date, {z} FROM (
  SELECT *, avg(w) OVER g AS m, stddev_samp(w) OVER g AS s FROM (
    SELECT ticker, date, {by}, least(greatest(close, q[1]), q[2]) AS w
    FROM rows JOIN (SELECT {by}, quantile_cont(close, [0.01, 0.99]) AS q FROM rows GROUP BY {by}) AS b USING ({by}))
  WINDOW g AS (PARTITION BY {by}))"""
_ZS = {"rows": "SELECT ticker, date, close, gics_sector FROM close_m JOIN sectors USING (ticker) WHERE gics_sector IS NOT NULL"}
_ZCOL = r("CASE WHEN coalesce(s, 0) < 1e-12 THEN 0 ELSE (w - m) / s END", "close")


@query("sector_zscore", with_views(_Z.format(z=_ZCOL, by="date, gics_sector"), "close_m", "sectors", extra=_ZS))
def sector_zscore(spark, sf):
    rows = v.closes(spark, sf).join(v.sectors(spark, sf), "ticker").where(F.col("gics_sector").isNotNull())
    out = normalize(rows, ["close"], scheme="zscore")
    return rounded(out.select("ticker", "date", "close"))


@query("date_zscore_split", with_views(_Z.format(z=_ZCOL, by="date"), "close_m", "sectors", extra=_ZS))
def date_zscore_split(spark, sf):
    """The form for cross-sections too wide for one task."""
    rows = v.closes(spark, sf).join(v.sectors(spark, sf), "ticker").where(F.col("gics_sector").isNotNull())
    out = normalize(rows, ["close"], scheme="zscore", sector_neutral=False, wide_groups=True)
    return rounded(out.select("ticker", "date", "close"))


@query("pct_rank_split", with_views(
    f"""SELECT ticker, date, {r(pct_rank_sql('close', 'date, gics_sector', 'gics_sector IS NOT NULL'), 'close')},
    {r(pct_rank_sql('ret', 'date, gics_sector', 'gics_sector IS NOT NULL'), 'ret')}
    FROM rets_m LEFT JOIN sectors USING (ticker) WHERE close IS NOT NULL""", "rets_m", "sectors"))
def pct_rank_split(spark, sf):
    """The form for cross-sections too wide for one task."""
    rows = v.rets_m(spark, sf).join(v.sectors(spark, sf), "ticker", "left")
    out = pct_rank(rows, ["close", "ret"], ["date", "gics_sector"], keys=("date", "ticker"), wide_groups=True)
    return rounded(out.select("ticker", "date", "close", "ret"))


@query("order_price_quantiles", f"""SELECT o_orderpriority, 'o_totalprice' AS "column", prob,
    {r("CASE prob WHEN 0.01 THEN q[1] WHEN 0.25 THEN q[2] WHEN 0.5 THEN q[3] ELSE q[4] END", 'value', 4)}
  FROM (SELECT o_orderpriority, quantile_cont(o_totalprice, [0.01, 0.25, 0.5, 0.99]) AS q FROM orders GROUP BY 1)
  CROSS JOIN (VALUES (0.01), (0.25), (0.5), (0.99)) AS p(prob)""")
def order_price_quantiles(spark, sf):
    out = exact_quantiles(v.table(spark, sf, "orders"), ["o_totalprice"], [0.01, 0.25, 0.5, 0.99], ["o_orderpriority"])
    return rounded(out, 4)


_RAW_OUT = [c for c in PANEL_COLUMNS if c not in ("date", "ticker", "gics_sector", "market_cap", "target", *MACRO_FEATURES)]


@query("panel_monthly_raw", with_views(
    f"SELECT date, ticker, gics_sector, {r('market_cap', 'market_cap', 0)}, {rs(_RAW_OUT)}, {rs(MACRO_FEATURES, 7)} FROM raw_m",
    *PANEL_VIEWS, extra=RAW_CTES))
def panel_monthly_raw(spark, sf):
    out = panel(spark, sf, normalized=False)
    return rounded(out, 6, market_cap=0, **{c: 7 for c in MACRO_FEATURES})


@query("panel_monthly", with_views(
    f"""SELECT date, ticker, gics_sector, {r('forward_return', 'forward_return')}, {r('market_cap', 'market_cap', 0)},
    {rs(MONTHLY_FEATURES + ['target'])} FROM panel""", *PANEL_VIEWS, extra=PANEL_CTES))
def panel_monthly(spark, sf):
    return rounded(panel(spark, sf), 6, market_cap=0)


_D_OUT = DAILY_FEATURES + ["fwd_5d", "fwd_10d", "fwd_30d", "target_5d", "target_10d", "target_30d"]


@query("panel_daily", with_views(
    f"SELECT date, ticker, gics_sector, {r('market_cap', 'market_cap', 0)}, {rs(_D_OUT)} FROM panel_d",
    "bars_w", "facts", "sectors", extra={**FUND_CTES, **daily_ctes("bars_w")}))
def panel_daily_query(spark, sf):
    return rounded(panel_daily(spark, sf), 6, market_cap=0)


@query("panel_slice", with_views(
    f"SELECT date, ticker, {rs(['roe', 'target'])} FROM panel WHERE date BETWEEN DATE '1998-01-01' AND DATE '1999-12-31'",
    *PANEL_VIEWS, extra=PANEL_CTES))
def panel_slice(spark, sf):
    from factorloom.sources.tables import load_panel

    return rounded(load_panel(panel_table(spark, sf), "1998-01-01", "1999-12-31", ["date", "ticker", "roe", "target"]))


@query("usable_rows", with_views(
    "SELECT date, ticker FROM panel WHERE target IS NOT NULL AND roe IS NOT NULL AND book_to_price IS NOT NULL",
    *PANEL_VIEWS, extra=PANEL_CTES))
def usable_rows(spark, sf):
    from factorloom.operators.evaluate import usable_rows as usable

    return usable(panel_table(spark, sf), ["roe", "book_to_price"]).select("date", "ticker")


# ---------------------------------------------------------------------------------- universe

_TOY_RANGES = [(1, 10, "tiny"), (5, 20, "small"), (18, 35, "medium"), (30, 45, "large")]


@query("range_map_sector", """WITH ranges(lo, hi, label, prio) AS (VALUES (1, 10, 'tiny', 0), (5, 20, 'small', 1),
    (18, 35, 'medium', 2), (30, 45, 'large', 3))
  SELECT p_partkey, p_size, arg_min(label, prio) AS gics_sector FROM part LEFT JOIN ranges ON p_size BETWEEN lo AND hi
  GROUP BY 1, 2""")
def range_map_sector(spark, sf):
    return universe.map_sectors(v.table(spark, sf, "part").select("p_partkey", "p_size"), "p_size", _TOY_RANGES)


@query("range_join", """WITH ranges AS (SELECT o_custkey AS lo, o_custkey + o_orderkey % 97 - 3 AS hi, o_orderkey AS rank, o_orderpriority AS label FROM orders),
  matched AS (SELECT k, min(rank) AS rank FROM (SELECT DISTINCT l_partkey AS k FROM lineitem) JOIN ranges ON k BETWEEN lo AND hi GROUP BY k)
  SELECT l_orderkey, l_linenumber, l_partkey, label FROM lineitem LEFT JOIN matched ON k = l_partkey LEFT JOIN ranges USING (rank)""")
def range_join(spark, sf):
    """Line items by the first of many overlapping ranges, one range an order."""
    from factorloom.operators.ranges import first_match

    o = v.table(spark, sf, "orders")
    ranges = o.select(F.col("o_custkey").alias("lo"), (F.col("o_custkey") + F.col("o_orderkey") % 97 - 3).alias("hi"),
                      F.col("o_orderkey").alias("rank"), F.col("o_orderpriority").alias("label"))
    rows = v.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return first_match(rows, "l_partkey", ranges)


def _sic_values():
    return ", ".join(f"({i}, {lo}, {hi}, '{s}')" for i, (lo, hi, s) in enumerate(universe.SIC_RANGES))


_VENDOR = " ".join(f"WHEN '{k}' THEN '{s}'" for k, s in universe.VENDOR_SECTORS.items())


@query("resolve_sectors", f"""WITH u AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL
      ELSE CAST((p_partkey * 37) % 11000 AS VARCHAR) END AS sic,
    CASE p_partkey % 3 WHEN 0 THEN 'Technology' WHEN 1 THEN 'Healthcare' ELSE 'Unknown' END AS vendor_sector FROM part),
  ranges(prio, lo, hi, label) AS (VALUES {_sic_values()}),
  m AS (SELECT p_partkey, arg_min(label, prio) AS s FROM u JOIN ranges ON CAST(sic AS INTEGER) BETWEEN lo AND hi GROUP BY 1)
  SELECT u.p_partkey, sic, vendor_sector, coalesce(m.s, CASE vendor_sector {_VENDOR} END) AS gics_sector,
    CASE WHEN m.s IS NOT NULL THEN 'sec_sic' WHEN vendor_sector IN ('Technology', 'Healthcare') THEN 'vendor' END AS sector_source
  FROM u LEFT JOIN m ON m.p_partkey = u.p_partkey""")
def resolve_sectors(spark, sf):
    k = F.col("p_partkey")
    u = v.table(spark, sf, "part").select(
        "p_partkey", F.when(k % 5 != 0, ((k * 37) % 11000).cast("string")).alias("sic"),
        F.when(k % 3 == 0, "Technology").when(k % 3 == 1, "Healthcare").otherwise("Unknown").alias("vendor_sector"))
    return universe.resolve_sectors(u)


@query("remap_sectors", f"""WITH u AS (SELECT s_suppkey AS ticker, CASE WHEN s_suppkey % 4 <> 0
      THEN CAST((s_suppkey * 97) % 10000 AS VARCHAR) END AS sic, 'Old' AS gics_sector FROM supplier),
  ranges(prio, lo, hi, label) AS (VALUES {_sic_values()}),
  m AS (SELECT ticker, arg_min(label, prio) AS s FROM u JOIN ranges ON CAST(sic AS INTEGER) BETWEEN lo AND hi GROUP BY 1)
  SELECT u.ticker, sic, CASE WHEN sic IS NULL THEN gics_sector ELSE m.s END AS gics_sector
  FROM u LEFT JOIN m ON m.ticker = u.ticker""")
def remap_sectors(spark, sf):
    k = F.col("s_suppkey")
    u = v.table(spark, sf, "supplier").select(
        k.alias("ticker"), F.when(k % 4 != 0, ((k * 97) % 10000).cast("string")).alias("sic"),
        F.lit("Old").alias("gics_sector"))
    return universe.remap_sectors(u)


_LETTERS = "substr('ABCDEFGHIJ', CAST({k} // 1000 % 10 AS INTEGER) + 1, 1) || substr('KLMNOPQRST', CAST({k} // 100 % 10 AS INTEGER) + 1, 1)" \
           " || substr('UVWXYZABCD', CAST({k} // 10 % 10 AS INTEGER) + 1, 1)"


@query("security_master", f"""WITH a AS (SELECT {_LETTERS.format(k='p_partkey')} AS t, p_name || CASE WHEN p_size % 9 = 0 THEN ' Warrants' ELSE '' END AS name,
    'NASDAQ' AS exchange, p_size % 11 = 0 AS drop_it, 0 AS src FROM part),
  b AS (SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'BRK.B' ELSE {_LETTERS.format(k='s_suppkey')} || s_suppkey % 7 END AS t,
    s_name AS name, 'N' AS exchange, FALSE AS drop_it, 1 AS src FROM supplier),
  u AS (SELECT replace(upper(trim(t)), '.', '-') AS ticker, name, exchange, src FROM (SELECT * FROM a UNION ALL SELECT * FROM b)
    WHERE NOT drop_it)
  SELECT ticker, x.name AS name, x.exchange AS exchange FROM (
    SELECT ticker, min({{'src': src, 'name': name, 'exchange': exchange}}) AS x FROM u
    WHERE regexp_full_match(ticker, '[A-Z]{{1,5}}(-[A-Z])?')
      AND NOT regexp_matches(name, '(Warrants?|Units?|Rights?|Preferred|Depositary|Notes?|Debentures?)', 'i') GROUP BY 1)""")
def security_master(spark, sf):
    def letters(k):
        pick = lambda s, d: F.substring(F.lit(s), (F.floor(F.col(k) / d) % 10).cast("int") + 1, 1)
        return F.concat(pick("ABCDEFGHIJ", 1000), pick("KLMNOPQRST", 100), pick("UVWXYZABCD", 10))

    part, sup = v.table(spark, sf, "part"), v.table(spark, sf, "supplier")
    a = part.select(F.lower(letters("p_partkey")).alias("ticker"),
                    F.concat("p_name", F.when(F.col("p_size") % 9 == 0, " Warrants").otherwise("")).alias("name"),
                    F.lit("NASDAQ").alias("exchange"),
                    F.when(F.col("p_size") % 11 == 0, "Y").otherwise("N").alias("test_issue"))
    k = F.col("s_suppkey")
    b = sup.select(F.when(k % 3 == 0, "BRK.B").otherwise(F.concat(letters("s_suppkey"), (k % 7).cast("string"))).alias("ticker"),
                   F.col("s_name").alias("name"), F.lit("N").alias("exchange"))
    return universe.security_master(a, b)


@query("active_flags", with_views("""SELECT s_suppkey AS ticker, s_suppkey IN (
    SELECT ticker FROM bars_d WHERE date >= DATE '2001-06-01' GROUP BY 1 HAVING sum(volume) >= 500) AS is_active FROM supplier""", "bars_d"))
def active_flags(spark, sf):
    u = v.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("ticker"), F.lit(True).alias("is_active"))
    active = v.bars_d(spark, sf).where("date >= '2001-06-01'").groupBy("ticker").agg(F.sum("volume").alias("q")).where("q >= 500")
    return universe.set_active(u, active, 0.0)


@query("missing_keys", """SELECT c_custkey FROM customer WHERE c_custkey NOT IN (
  SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def missing_keys(spark, sf):
    have = v.table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return universe.key_difference(v.table(spark, sf, "customer"), have, ["c_custkey"])
