import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorloom.functions.scalars import nans_to_nulls
from factorloom.operators import backtest, portfolio, rebalance
from factorloom.operators.attribution import factor_attribution
from factorloom.operators.portfolio import Strategy
from factorloom.params import PortfolioParams, RebalanceParams


def months(n):
    return [d.date() for d in pd.date_range("2010-01-31", periods=n, freq="ME")]


@pytest.fixture(scope="module")
def preds_pdf():
    rng = np.random.default_rng(9)
    rows = []
    for i, d in enumerate(months(30)):
        for t in range(60):
            rows.append((d, f"T{t:02d}", float(rng.normal()) if rng.random() > 0.05 else None,
                         None if i == 29 else float(rng.normal(0.01, 0.05))))
    return pd.DataFrame(rows, columns=["date", "ticker", "pred", "forward_return"])


@pytest.fixture(scope="module")
def preds(spark, preds_pdf):
    df = spark.createDataFrame(preds_pdf, "date date, ticker string, pred double, forward_return double")
    return nans_to_nulls(df)  # pandas marks missing numbers as NaN


def chain(pdf, n, buffer):
    """Names held per date, chained one date at a time."""
    held, out = [], {}
    for d, g in pdf.dropna(subset=["pred"]).groupby("date"):
        order = list(g.sort_values(["pred", "ticker"], ascending=[False, True]).ticker)
        place = {t: i + 1 for i, t in enumerate(order)}
        stay = [t for t in order if t in held and place[t] <= buffer][:n]
        fill = [t for t in order if t not in held][:n - len(stay)]
        held = stay + fill
        out[d] = set(held)
    return out


@pytest.mark.parametrize("n,buffer", [(5, 5), (5, 15), (10, 40)])
def test_hold_buffer_matches_chain(spark, preds, preds_pdf, n, buffer):
    got = portfolio.hold_buffer(preds, [Strategy("s", n, buffer)]).toPandas().groupby("date").ticker.agg(set).to_dict()
    assert got == chain(preds_pdf, n, buffer)


def test_small_buffer_example(spark):
    d = months(2)
    names = [f"R{i}" for i in range(1, 11)]
    rows = [(d[0], t, float(t in ("R4", "R7", "R9"))) for t in names] + [(d[1], t, 100.0 - i) for i, t in enumerate(names)]
    df = spark.createDataFrame(rows, "date date, ticker string, pred double")
    held = portfolio.hold_buffer(df, [Strategy("s", 3, 8)])
    last = {(r.ticker, r.action) for r in held.where(F.col("date") == F.lit(d[1])).collect()}
    assert last == {("R4", "keep"), ("R7", "keep"), ("R1", "buy")}
    assert [r.ticker for r in portfolio.sells(held, df).collect()] == ["R9"]


def test_backtest_relations(spark, preds):
    plain, calm = Strategy("plain", 10, 10), Strategy("calm", 10, 40)
    costly = Strategy("costly", 10, 10, cost_bps=60.0)
    res = backtest.run_strategy_backtest(preds, None, [plain, calm, costly])
    r = res.returns.toPandas()
    assert r.groupby("strategy").date.count().eq(29).all()          # the live month is no period
    assert r.date.min() == months(30)[1]                             # realisation month
    first = r.sort_values("date").groupby("strategy").turnover.first()
    assert (first == 0.5).all()
    t = r.groupby("strategy").turnover.mean()
    assert t["calm"] < t["plain"]
    assert r[r.strategy == "costly"].cost.sum() == pytest.approx(10 * r[r.strategy == "plain"].cost.sum())
    w = res.holdings.groupBy("strategy", "date").agg(F.sum("weight").alias("w")).toPandas()
    assert np.allclose(w.w, 1.0)


def test_performance_summary_by_hand(spark):
    r = [0.1, -0.2, 0.05, -0.05, 0.3]
    df = spark.createDataFrame([("s", d, x) for d, x in zip(months(5), r)], "strategy string, date date, net double")
    got = backtest.performance_summary(df, "net", ["strategy"]).first()
    s = pd.Series(r)
    eq = (1 + s).cumprod()
    assert got.ann_return == pytest.approx(eq.iloc[-1] ** (12 / 5) - 1)
    assert got.sharpe == pytest.approx(s.mean() * 12 / (s.std() * 12 ** 0.5))
    assert got.sortino == pytest.approx(s.mean() * 12 / (s[s < 0].std() * 12 ** 0.5))
    assert got.max_drawdown == pytest.approx((eq / eq.cummax() - 1).min()) and got.hit_rate == 0.6
    loss_first = df.withColumn("net", F.when(F.col("net") == 0.1, -0.5).otherwise(0.01))
    assert backtest.performance_summary(loss_first, "net", ["strategy"]).first().max_drawdown == 0.0


def test_attribution_matches_lstsq(spark):
    rng = np.random.default_rng(0)
    n, cols = 61, ["mkt_rf", "smb", "hml", "rmw", "cma", "mom"]
    x = rng.normal(0, 0.03, (n, 6))
    y = 0.002 + x @ [1.0, 0.5, -0.2, 0, 0.1, 0.3] + rng.normal(0, 0.01, n)
    fac = pd.DataFrame(x, columns=cols).assign(rf=0.001, date=months(n))
    ret = pd.concat([pd.DataFrame({"strategy": "a", "date": months(n), "net": y + 0.001}),
                     pd.DataFrame({"strategy": "market", "date": months(n), "net": x[:, 0] + 0.001}),
                     pd.DataFrame({"strategy": "short", "date": months(5), "net": 0.0})])
    got = {r.strategy: r for r in factor_attribution(spark.createDataFrame(ret), spark.createDataFrame(fac)).collect()}
    X = np.column_stack([np.ones(n), x])
    b, *_ = np.linalg.lstsq(X, y, rcond=None)
    res = y - X @ b
    se = np.sqrt(np.diag(res @ res / (n - 7) * np.linalg.inv(X.T @ X)))
    a = got["a"]
    np.testing.assert_allclose([a.alpha_monthly, *(a.betas[c] for c in cols)], b, atol=1e-9)
    np.testing.assert_allclose([a.alpha_tstat, *(a.beta_tstats[c] for c in cols)], b / se, rtol=1e-6)
    assert a.r_squared == pytest.approx(1 - res @ res / ((y - y.mean()) ** 2).sum())
    assert got["market"].betas["mkt_rf"] == pytest.approx(1.0) and abs(got["market"].alpha_monthly) < 1e-9
    assert got["short"].error and got["short"].alpha_monthly is None


@pytest.fixture(scope="module")
def plan(spark):
    names = [f"N{i:02d}" for i in range(1, 41)]
    scores = spark.createDataFrame([(t, 100.0 - i, "S") for i, t in enumerate(names)], "ticker string, pred double, gics_sector string")
    price = {t: 50.0 for t in names} | {"N03": 2.0, "N05": None, "ETF": 30.0}
    prices = spark.createDataFrame(list(price.items()), "ticker string, price double")
    pos = [("a", "N01", 10.0), ("a", "N09", 100.0), ("a", "N35", 5.0), ("a", "ETF", 7.0), ("a", "N05", 3.0), ("b", "N02", 1.0)]
    positions = spark.createDataFrame(pos, "account_id string, ticker string, shares double")
    cash = spark.createDataFrame([("a", 1000.0), ("b", 10_000.0), ("c", 5000.0)], "account_id string, cash double")
    p = RebalanceParams(portfolio=PortfolioParams(4, 12, 0.5))
    out = rebalance.plan_rebalance(positions, cash, scores, prices, params=p)
    return {(r.account_id, r.ticker): r for r in out.collect()}, rebalance.plan_summary(out, cash, p).collect()


def test_rebalance_actions(plan):
    rows, summary = plan
    act = {k: r.action for k, r in rows.items()}
    assert act["a", "N35"] == "SELL" and act["a", "ETF"] == "REVIEW" and act["a", "N05"] == "HOLD"
    assert act["a", "N09"] == "TRIM" and act["a", "N01"] == "ADD"
    assert "no price" in rows["a", "N05"].reason
    assert act["a", "N02"] == "BUY" and ("a", "N03") not in act      # below the price floor
    assert sum(a == "BUY" for (acc, _), a in act.items() if acc == "c") == 4
    assert rows["c", "N01"].trade_shares == 25.0                      # 5000 / 4 names / 50
    s = {r.account_id: r for r in summary}
    assert s["a"].sleeve_value == pytest.approx(1000 + 10 * 50 + 100 * 50 + 5 * 50)
    assert s["c"].cash_after == pytest.approx(5000 - 4 * 25 * 50) and s["c"].n_buy == 4


def test_trade_list_is_one_file_an_account_dealt_over_tasks(spark, tmp_path):
    from factorloom.operators.rebalance import PLAN_COLUMNS
    from factorloom.sinks.tables import read_trades_csv, write_trades_csv

    given = {"account_id": "id % 40", "ticker": "concat('T', id)", "action": "IF(id % 5 = 0, 'HOLD', 'BUY')", "trade_shares": "CAST(id AS DOUBLE)"}
    plan = spark.range(0, 400, 1, 6).selectExpr(*(f"{given.get(c, 'CAST(NULL AS DOUBLE)')} AS {c}" for c in PLAN_COLUMNS))
    write_trades_csv(plan, str(tmp_path / "t"))
    files = sorted((tmp_path / "t").rglob("*.csv"))
    # accounts 0, 5, ... hold only
    assert len(files) == 32 == len({f.parent for f in files})
    assert len({f.name.split("-")[1] for f in files}) > 4  # tasks
    back = read_trades_csv(spark, str(tmp_path / "t"), PLAN_COLUMNS)
    got = {(int(r.account_id), r.ticker, float(r.trade_shares)) for r in back.collect()}
    assert got == {(i % 40, f"T{i}", float(i)) for i in range(400) if i % 5}


def test_trade_list_on_a_disk_is_what_spark_writes_and_reads(spark, tmp_path):
    import csv

    from factorloom.sinks.tables import read_trades_csv, write_trades_csv

    odd = [None, "", " a ", 'q"u,o\\te', "a=b/c%41:d'{x}[y]?#^*", "tab\there", "line\nbreak", "\\", "."]
    rows = [(a, "BUY" if j % 4 else "HOLD", t, float(j)) for i, a in enumerate(odd) for j, t in enumerate([*odd[i:], *odd, "é ü"])]
    plan = spark.createDataFrame(rows, "account_id string, action string, ticker string, trade_shares double").repartition(5)
    columns = ["account_id", "action", "ticker", "trade_shares"]
    (tmp_path / "t" / "account_id=old").mkdir(parents=True)  # replaced
    write_trades_csv(plan, str(tmp_path / "t"))
    plan.where("action = 'BUY'").write.partitionBy("account_id").option("header", True).csv(str(tmp_path / "want"))
    folders = lambda d: {f.parent.name for f in (tmp_path / d).rglob("*.csv")}
    assert folders("t") == folders("want") == {d.name for d in (tmp_path / "t").iterdir() if d.is_dir()}
    assert (tmp_path / "t" / "_SUCCESS").exists()
    # Hadoop's local file system, which starts processes for each file, made none of them
    assert not list((tmp_path / "t").rglob("account_id=*/.*"))
    want = spark.read.schema("action string, ticker string, trade_shares string, account_id string").option("header", True).csv(str(tmp_path / "want"))
    got = read_trades_csv(spark, (tmp_path / "t").as_uri(), columns)
    key = lambda r: [(v is None, v or "") for v in r]
    assert got.columns == want.columns and sorted(got.collect(), key=key) == sorted(want.collect(), key=key)
    lines = lambda d: sorted(x for f in (tmp_path / d).rglob("*.csv") for x in csv.reader(f.open(newline=""), escapechar="\\"))
    assert [x for x in lines("t") if x[0] == "BUY"] == [x for x in lines("want") if x[0] == "BUY"]
    with pytest.raises(Exception, match="columns of"):
        read_trades_csv(spark, str(tmp_path / "t"), ["account_id", "ticker", "action", "trade_shares"]).collect()
    write_trades_csv(plan.where("action = 'HOLD'"), str(tmp_path / "t"))
    assert read_trades_csv(spark, str(tmp_path / "t"), columns).count() == 0
