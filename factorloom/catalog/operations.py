"""Registered queries: stored tables read back, deployed models, serving checks and trade lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from factorloom.catalog import views as v
from factorloom.catalog.base import query, r, rounded, rs
from factorloom.catalog.market import fund_table, panel_table
from factorloom.catalog.research import _BASE, _LIVE, _PLAN, _RB, _accounts, recursive
from factorloom.catalog.sqlparts import FUND_CTES, PANEL_CTES, PANEL_VIEWS, spearman_ctes
from factorloom.catalog.views import with_views
from factorloom.functions import scalars
from factorloom.models import registry as models
from factorloom.models.training import latest_recommendations, train_and_deploy
from factorloom.operators import backtest, quality, rebalance
from factorloom.params import ELASTIC_NET, WalkForwardParams
from factorloom.schema import MONTHLY_FEATURES, PANEL_COLUMNS
from factorloom.session import scratch_dir
from factorloom.sinks import tables as sink
from factorloom.sources import files
from factorloom.sources.tables import Warehouse

# ---------------------------------------------------------------------------- stored tables


@query("stored_panel", with_views(f"""SELECT date, ticker, gics_sector, {rs([c for c in PANEL_COLUMNS if c not in ('date', 'ticker', 'gics_sector')])}
  FROM panel WHERE date BETWEEN DATE '1996-01-01' AND DATE '1997-06-30'""", *PANEL_VIEWS, extra=PANEL_CTES))
def stored_panel(spark, sf):
    """The panel through its guarded writer and back by a range of dates."""
    base = scratch_dir(spark, "warehouse")
    sink.write_panel(panel_table(spark, sf), f"{base}/panel_monthly")
    return rounded(Warehouse(spark, base).panel("1996-01-01", "1997-06-30").select(*PANEL_COLUMNS))


@query("stored_features", with_views(f"SELECT ticker, period_end, availability_date, gics_sector, {rs(['roe', 'gross_margin'])}, {rs(['equity'], 4)} FROM fund",
                                     "facts", "sectors", extra=FUND_CTES))
def stored_features(spark, sf):
    """Quarterly features are written twice; the second load of a third of the names replaces equal keys."""
    base, features = scratch_dir(spark, "warehouse"), fund_table(spark, sf)
    sink.write_fundamental_features(spark, f"{base}/fundamental_features", features.withColumn("roe", F.when(F.col("ticker") % 3 > 0, F.col("roe"))))
    sink.write_fundamental_features(spark, f"{base}/fundamental_features", features.where("ticker % 3 = 0"))
    out = Warehouse(spark, base).fundamental_features()
    return rounded(out.select("ticker", "period_end", "availability_date", "gics_sector", "roe", "gross_margin", "equity"), 6, equity=4)


@query("stored_series", with_views(f"""SELECT m.date, {rs(['yield_curve', 'vix', 'credit_spread'])}, {r('mkt_rf', 'mkt')}, {r('hml', 'hml')}
  FROM macro_m AS m LEFT JOIN ff_m AS f ON f.date = m.date""", "macro_m", "ff_m"))
def stored_series(spark, sf):
    """Macro series under their old name and factors under library names, stored and read."""
    base = scratch_dir(spark, "warehouse")
    sink.write_macro(spark, f"{base}/macro", v.macro_m(spark, sf).withColumnRenamed("credit_spread", "hy_spread"))
    sink.write_factors(spark, f"{base}/ff_factors", v.ff_m(spark, sf).withColumnsRenamed({"mkt_rf": "Mkt-RF", "hml": "HML"}))
    wh = Warehouse(spark, base)
    factors = wh.ff_factors(library_names=True).select("date", F.col("Mkt-RF").alias("mkt"), F.col("HML").alias("hml"))
    return rounded(wh.macro().join(factors, "date", "left"))


@query("stored_sectors", """SELECT c_custkey AS ticker, CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_mktsegment END AS gics_sector FROM customer WHERE c_acctbal > 0""")
def stored_sectors(spark, sf):
    """Active names with their sector; a refresh of names keeps sectors, junk labels are nulls."""
    path = f"{scratch_dir(spark, 'warehouse')}"
    c = v.table(spark, sf, "customer")
    label = F.when(F.col("c_mktsegment") == "MACHINERY", "nan").otherwise(F.col("c_mktsegment"))
    rows = c.select(F.col("c_custkey").alias("ticker"), F.col("c_name").alias("name"), label.alias("gics_sector"), (F.col("c_acctbal") > 0).alias("is_active"))
    sink.write_universe(spark, f"{path}/universe", rows)
    sink.write_universe(spark, f"{path}/universe", rows.select("ticker", F.upper("name").alias("name")))
    return Warehouse(spark, path).sectors()


@query("listing_files", """SELECT 'T' || c_custkey AS ticker, c_name AS name, 'NASDAQ' AS exchange, CASE WHEN c_custkey % 9 = 0 THEN 'Y' ELSE 'N' END AS test_issue,
    CASE WHEN c_custkey % 4 = 0 THEN 'Y' ELSE 'N' END AS etf FROM customer""")
def listing_files(spark, sf):
    """A listing lands as pipe-delimited files with a footer, and is read."""
    path, k = scratch_dir(spark, "listing"), F.col("c_custkey")
    yes = lambda c: F.when(c, "Y").otherwise("N")
    rows = v.table(spark, sf, "customer").select(
        F.concat(F.lit("T"), k.cast("string")).alias("Symbol"), F.col("c_name").alias("Security Name"), yes(k % 9 == 0).alias("Test Issue"), yes(k % 4 == 0).alias("ETF"))
    footer = spark.range(1).select(F.lit(f"{files.LISTING_FOOTER}: now").alias("Symbol"), *(F.lit(None).cast("string").alias(c) for c in rows.columns[1:]))
    rows.unionByName(footer).write.option("header", True).option("sep", "|").csv(path)
    return files.read_listing(spark, path, "nasdaq")


@query("stored_backtest", recursive(with_views(f"""SELECT strategy, min(date) AS first_month, max(date) AS last_month, count(*)::INT AS n_months,
    {r('avg(turnover)', 'avg_turnover')}, count(*) AS months_stored FROM (
    SELECT strategy, last_day(date + 1) AS date, turnover FROM turn3 JOIN day USING (i)) GROUP BY 1""", "preds", extra=_LIVE)))
def stored_backtest(spark, sf):
    """Months first, summary last; a second run replaces the first."""
    base, res = scratch_dir(spark, "backtest"), backtest.run_strategy_backtest(v.preds(spark, sf), None, _BASE, stored=True)
    for bps in (1.0, 2.0):
        sink.write_backtest(res, f"{base}/summary", f"{base}/months", {"commission_bps": bps})
    months = spark.read.parquet(f"{base}/months").groupBy("strategy").agg(F.count(F.lit(1)).alias("months_stored"))
    summary = spark.read.parquet(f"{base}/summary").where("commission_bps = 2.0")
    return rounded(summary.join(months, "strategy").select("strategy", "first_month", "last_month", "n_months", "avg_turnover", "months_stored"))


# --------------------------------------------------------------------------- models and checks

_VERSIONS = """SELECT o_orderpriority || '-' || o_orderstatus || '-' || strftime(o_orderdate, '%Y%m%d%H%M%S') AS version, count(*) AS n FROM orders GROUP BY 1"""


@query("version_stamps", _VERSIONS)
def version_stamps(spark, sf):
    o = v.table(spark, sf, "orders")
    stamp = scalars.version_stamp(F.col("o_orderpriority"), F.col("o_orderstatus"), F.col("o_orderdate").cast("timestamp"))
    return o.groupBy(stamp.alias("version")).agg(F.count(F.lit(1)).alias("n"))


def _registry(spark, sf):
    """Three versions of two horizons; 'm-2' is the newest for one month."""
    o = v.table(spark, sf, "orders").agg(F.max("o_orderdate").cast("timestamp").alias("t"))
    cells = F.explode(F.array(*(F.struct(F.lit(m).alias("model_version"), F.lit(h).alias("horizon"), F.expr(f"t - interval {k} days").alias("created_at"))
                                for m, h, k in (("m-1", "1m", 5), ("m-2", "1m", 1), ("m-3", "5d", 0)))))
    return o.select(cells.alias("c")).select("c.*")


def _predictions(spark, sf):
    """Scores of two models; those of the older one point the other way."""
    p = v.preds(spark, sf)
    return sink.prediction_rows(p, "m-2").unionByName(sink.prediction_rows(p.withColumn("pred", -F.col("pred")), "m-1"))


@query("dq_predictions", with_views("""SELECT 'predictions_row_count' AS "check", 2 * (SELECT count(*) FROM preds) >= 1000 AS passed
  UNION ALL SELECT 'predictions_ic_positive', avg(ic) > 0 FROM ic""", "preds", extra={
      "pairs": "SELECT 'score' AS signal, date, pred AS x, forward_return AS y FROM preds WHERE forward_return IS NOT NULL", **spearman_ctes("pairs", "signal, date")}))
def dq_predictions(spark, sf):
    out = quality.prediction_checks(_predictions(spark, sf), v.preds(spark, sf), _registry(spark, sf), min_rows=1000)
    return out.select("check", "passed")


@query("dq_serving", with_views("""SELECT 'recommendations_current' AS "check", count(*) > 0 AS passed FROM preds
  UNION ALL SELECT 'strategy_backtest_current', false""", "preds"))
def dq_serving(spark, sf):
    """The newest ranking is the newest model's and whole; of its backtest one month is missing."""
    from factorloom.models.training import cross_section_at, rank_cross_section

    base = scratch_dir(spark, "serving")
    ranked = rank_cross_section(cross_section_at(v.preds(spark, sf)))
    sink.write_recommendations(ranked.withColumn("pred", -F.col("pred")), f"{base}/recommendations", "m-1")
    sink.write_recommendations(ranked, f"{base}/recommendations", "m-2")
    preds = v.preds(spark, sf).withColumn("model_version", F.lit("m-2"))
    res = backtest.run_strategy_backtest(preds, None, _BASE[:1])
    sink.write_backtest(res, f"{base}/summary", f"{base}/months", {})
    months = spark.read.parquet(f"{base}/months")
    short = months.where(F.col("month") < months.agg(F.max("month")).scalar())
    out = quality.serving_checks(spark.read.parquet(f"{base}/recommendations"), spark.read.parquet(f"{base}/summary"), short, _registry(spark, sf))
    return out.select("check", "passed")


_FEW = ["momentum_12_2", "roe", "book_to_price"]


@query("deployed_model", with_views(f"""SELECT 'elasticnet' AS model_name, '1m' AS horizon, (SELECT min(date)::VARCHAR FROM panel WHERE target IS NOT NULL) AS train_start,
    (SELECT max(date)::VARCHAR FROM panel WHERE target IS NOT NULL) AS train_end, (SELECT count(target) FROM panel) AS n_train_rows,
    date, ticker, true AS scored, (SELECT count(*) FROM panel WHERE date = (SELECT max(date) FROM panel)) AS n_ranked
  FROM panel WHERE date = (SELECT max(date) FROM panel)""", *PANEL_VIEWS, extra=PANEL_CTES))
def deployed_model(spark, sf):
    """Panel -> walk-forward -> stored model -> loaded by 'latest' -> scores of the newest date, ranked 1..n."""
    store = models.ModelStore(spark, scratch_dir(spark, "models"))
    panel = panel_table(spark, sf)
    train_and_deploy(panel, _FEW, model_name="elasticnet", spec={k: x[0] for k, x in ELASTIC_NET.items()}, store=store,
                     params=WalkForwardParams(36, 24, 1))
    ranked, m = latest_recommendations(panel, store)
    facts = {"model_name": m.model_name, "horizon": m.horizon, "train_start": m.train_start, "train_end": m.train_end}
    out = ranked.withColumns({k: F.lit(x) for k, x in facts.items()} | {"n_train_rows": F.lit(m.n_train_rows).cast("long"), "scored": F.col("pred").isNotNull()})
    return out.withColumn("n_ranked", ranked.agg(F.max("rank")).scalar().cast("long")).select(
        "model_name", "horizon", "train_start", "train_end", "n_train_rows", "date", "ticker", "scored", "n_ranked")


# --------------------------------------------------------------------------------- trade lists

_ORDERED = """SELECT *, row_number() OVER (ORDER BY account_id, CASE action WHEN 'SELL' THEN 0 WHEN 'TRIM' THEN 1 WHEN 'BUY' THEN 2 WHEN 'ADD' THEN 3
    WHEN 'HOLD' THEN 4 ELSE 5 END, rank NULLS LAST, ticker) AS place FROM plan"""


def _whole_plan(spark, sf):
    pos, cash, scores, price = _accounts(spark, sf)
    return rebalance.plan_rebalance(pos, cash, scores, price, params=_RB)


@query("trade_list", with_views("""SELECT account_id, ticker, action, CAST(rank AS INTEGER) AS rank, trade_shares FROM plan
  WHERE action IN ('SELL', 'TRIM', 'BUY', 'ADD')""", "bars_d", extra=_PLAN))
def trade_list(spark, sf):
    """Trades as CSV, a folder an account, read back."""
    path = scratch_dir(spark, "trades")
    sink.write_trades_csv(_whole_plan(spark, sf), path)
    kinds = "ticker long, action string, rank int, trade_shares double, account_id long"
    names = sink.read_trades_csv(spark, path, rebalance.PLAN_COLUMNS)
    return names.select(*(F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in kinds.split(", ")))


@query("ordered_plan", with_views(f"SELECT place, account_id, ticker, action FROM ({_ORDERED})", "bars_d", extra=_PLAN))
def ordered_plan(spark, sf):
    """The presentation order as numbers."""
    from factorloom.functions.cross_section import ranged

    shown = rebalance.order_plan(_whole_plan(spark, sf)).select("account_id", "ticker", "action", F.monotonically_increasing_id().alias("at"))
    numbered = ranged(shown.withColumn("g", F.lit(0)), ["g"], [F.col("at")], F.lit(1))
    return numbered.select((F.col("_before") + 1).alias("place"), "account_id", "ticker", "action")


@query("plan_values", with_views(f"""SELECT account_id, ticker, {r('price + 1e-6', 'price', 3)}, {r('trade_shares + current_shares', 'target_shares')},
    {r('current_shares * price + 1e-6', 'current_value', 3)} FROM plan""", "bars_d", extra=_PLAN))
def plan_values(spark, sf):
    off = lambda c: (F.col(c) + 1e-6).alias(c)  # noqa: E731  off the ties that the order of a sum decides
    out = _whole_plan(spark, sf).select("account_id", "ticker", off("price"), "target_shares", off("current_value"))
    return rounded(out, 6, price=3, current_value=3)


@query("joined_factors", with_views(f"SELECT date, {rs(['mkt_rf', 'hml', 'mom'])} FROM (SELECT date, mkt_rf, hml, CASE WHEN month(date) > 2 THEN mom END AS mom FROM ff_m) "
                                    "WHERE date BETWEEN DATE '1994-01-01' AND DATE '1996-12-31'", "ff_m"))
def joined_factors(spark, sf):
    """Five factors with momentum attached where it is known, within dates."""
    f = v.ff_m(spark, sf)
    return rounded(files.join_factors(f.select("date", "mkt_rf", "hml"), f.where(F.month("date") > 2).select("date", "mom"), "1994-01-01", "1996-12-31"))


@query("macro_files", """SELECT last_day(CAST(o_orderdate AS DATE)) AS date, max(o_totalprice) AS long_rate FROM orders
  GROUP BY 1 HAVING count(*) % 5 <> 0 UNION ALL SELECT last_day(CAST(o_orderdate AS DATE)), NULL FROM orders GROUP BY 1 HAVING count(*) % 5 = 0""")
def macro_files(spark, sf):
    """A two-column series lands as CSV, some months marked by a dot, and is read."""
    path = scratch_dir(spark, "series")
    o = v.table(spark, sf, "orders").groupBy(F.last_day(F.col("o_orderdate").cast("date")).alias("DATE")).agg(
        F.when(F.count(F.lit(1)) % 5 == 0, ".").otherwise(F.max("o_totalprice").cast("string")).alias("RATE"))
    o.write.option("header", True).csv(path)
    return files.read_macro_series(spark, path, "long_rate")


_REASON = """CASE WHEN kind = 'sell' THEN 'model rank ' || rank || ' is below the last rank kept (20)'
    WHEN kind = 'review' THEN 'no score from the model; untouched' WHEN kind = 'buy' AND price IS NULL THEN 'model rank ' || rank || '; no price to size the order with'
    WHEN kind = 'buy' THEN 'new position, model rank ' || rank WHEN price IS NULL THEN 'no price; size unchanged'
    WHEN action = 'HOLD' THEN 'kept, model rank ' || rank || ', off target by ' || printf('%+.0f%%', drift * 100)
    ELSE 'resized, model rank ' || rank || ', off target by ' || printf('%+.0f%%', drift * 100) || ' (band 25%)' END"""


@query("plan_reasons", with_views(f"""SELECT account_id, ticker, {_REASON} AS reason, {r('score', 'score')}, {r('tv + 1e-6', 'target_value', 3)}
  FROM acts LEFT JOIN (SELECT ticker, score FROM names) USING (ticker)""", "bars_d", extra=_PLAN))
def plan_reasons(spark, sf):
    """Why each line of the plan is there, its score and the value aimed at."""
    value = (F.col("target_value") + 1e-6).alias("target_value")  # off the ties that the order of a sum decides
    return rounded(_whole_plan(spark, sf).select("account_id", "ticker", "reason", "score", value), 6, target_value=3)


@query("rebalance_totals", with_views(f"""SELECT account_id, {r('cash + stock', 'sleeve_value', 1)}, {r('tpn', 'target_per_name', 1)},
    {r('CASE WHEN cash + stock <> 0 THEN traded / (2 * (cash + stock)) ELSE 0 END', 'turnover')}
  FROM (SELECT account_id, cash, coalesce(sum(CASE WHEN action <> 'REVIEW' THEN current_shares * price END), 0) AS stock,
      coalesce(sum(abs(trade_shares * price)), 0) AS traded, coalesce(max(tv), 0) AS tpn
    FROM money LEFT JOIN (SELECT plan.*, tv FROM plan LEFT JOIN target USING (account_id)) USING (account_id) GROUP BY account_id, cash)""", "bars_d", extra=_PLAN))
def rebalance_totals(spark, sf):
    """Sleeve, value per name and turnover of each account."""
    cash = _accounts(spark, sf)[1]
    out = rebalance.plan_summary(_whole_plan(spark, sf), cash, _RB)
    return rounded(out.select("account_id", "sleeve_value", "target_per_name", "turnover"), 1, turnover=6)
