import datetime as dt
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorloom import schema
from factorloom.operators import prices, quality, universe
from factorloom.params import DailyPanelParams, PanelParams
from factorloom.plans.dataset import build_dataset
from factorloom.plans.panel import assemble_panel
from factorloom.plans.panel_daily import assemble_panel_daily, daily_returns, forward_labels
from factorloom.functions.dates import incremental_start
from factorloom.sinks import tables as sink
from factorloom.sources import files
from factorloom.sources.tables import Warehouse

TICKERS = [f"T{i:02d}" for i in range(12)]


@pytest.fixture(scope="module")
def bars_pdf():
    rng = np.random.default_rng(7)
    d = pd.bdate_range("2020-01-01", periods=340)
    parts = []
    for t in TICKERS:
        close = 50 * np.exp(np.cumsum(rng.normal(0, 0.02, len(d))))
        parts.append(pd.DataFrame({"ticker": t, "date": d.date, "open": close, "high": close * 1.01, "low": close * 0.99,
                                   "close": close, "volume": rng.uniform(1e5, 2e5, len(d))}))
    return pd.concat(parts, ignore_index=True)


@pytest.fixture(scope="module")
def fund(spark):
    rows = [(t, dt.date(2020, 3, 31), dt.date(2020, 5, 10), "x", *[float(i + j + 1) for j in range(16)]) for i, t in enumerate(TICKERS)]
    return spark.createDataFrame(rows, schema.FUNDAMENTALS)


@pytest.fixture(scope="module")
def sectors(spark):
    return spark.createDataFrame([(t, "A" if i % 2 else "B") for i, t in enumerate(TICKERS)], "ticker string, gics_sector string")


def macro(spark):
    return spark.createDataFrame([(d.date(), 1.0, 2.0, 3.0) for d in pd.date_range("2020-01-31", periods=16, freq="ME")], schema.MACRO)


def test_daily_labels_align_and_bad_prints_void_them(spark, bars_pdf):
    bad = bars_pdf.copy()
    d = sorted(bad.date.unique())
    bad.loc[(bad.ticker == "T00") & (bad.date == d[100]), "close"] *= 50
    rows = forward_labels(daily_returns(spark.createDataFrame(bad)), (5,)).toPandas().set_index(["ticker", "date"]).fwd_5d
    c = bars_pdf.set_index(["ticker", "date"]).close
    assert rows["T01", d[10]] == pytest.approx(c["T01", d[15]] / c["T01", d[10]] - 1)
    assert all(pd.isna(rows["T00", d[k]]) for k in (95, 96, 99)) and not pd.isna(rows["T00", d[101]])
    assert pd.isna(rows["T01", d[-3]])


def test_daily_panel_shape_and_no_lookahead(spark, bars_pdf, fund, sectors):
    p = DailyPanelParams(horizons=(5, 10))
    out = assemble_panel_daily(spark.createDataFrame(bars_pdf), fund, sectors, params=p)
    assert out.columns == ["date", "ticker", "gics_sector", "market_cap", *schema.DAILY_FEATURES, "fwd_5d", "fwd_10d", "target_5d", "target_10d"]
    cut = sorted(bars_pdf.date.unique())[250]
    future = bars_pdf.copy()
    future.loc[future.date > cut, ["close", "high", "low", "volume"]] *= 3
    cols = ["ticker", "date", *schema.DAILY_FEATURES]
    at = lambda pdf: assemble_panel_daily(spark.createDataFrame(pdf), fund, sectors, params=p).where(
        F.col("date") == F.lit(cut)).select(*cols).toPandas().sort_values("ticker").reset_index(drop=True)
    pd.testing.assert_frame_equal(at(bars_pdf), at(future))
    thin = assemble_panel_daily(spark.createDataFrame(bars_pdf), fund, sectors, params=p, since="2021-01-01", every=5)
    full = {(r.ticker, r.date): r.vol_63d for r in out.select("ticker", "date", "vol_63d").collect()}
    rows = thin.select("ticker", "date", "vol_63d").collect()
    assert rows and all(full[r.ticker, r.date] == r.vol_63d for r in rows)


@pytest.mark.parametrize("wide", [False, True])
def test_monthly_panel_contract(spark, bars_pdf, fund, sectors, wide):
    closes = prices.monthly_close(spark.createDataFrame(bars_pdf))
    panel = assemble_panel(closes, fund, macro(spark), sectors, wide_groups=wide)
    assert panel.columns == schema.PANEL_COLUMNS
    pdf = panel.toPandas()
    assert len(pdf) == 12 * 15 and pdf.target.dropna().between(0, 1).all()
    early = pdf[pdf.date < dt.date(2020, 5, 1)]
    assert early.roe.isna().all() and early.momentum_12_2.isna().all()
    assert pdf[pdf.date == dt.date(2020, 5, 31)].roe.notna().all()          # public from 10 May on
    assert pdf.vix.dropna().round(9).isin([round((6 + 1) / 12, 9)]).all()   # constant: average-tie rank


def test_zscore_scheme_and_wide_groups_agree(spark, bars_pdf, fund, sectors):
    closes = prices.monthly_close(spark.createDataFrame(bars_pdf))
    get = lambda wide: assemble_panel(closes, fund, macro(spark), sectors, params=PanelParams(scheme="zscore"), wide_groups=wide).toPandas(
        ).sort_values(["date", "ticker"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(get(False), get(True), check_exact=False, atol=1e-9)


def test_masking_keeps_bounds(spark):
    df = spark.createDataFrame([(x,) for x in (-0.99, -0.95, 0.1, 3.0, 160.0, None)], "ret double")
    kept = [r.ret for r in prices.masked_returns(df, (-0.95, 3.0)).collect()]
    assert kept == [None, -0.95, 0.1, 3.0, None, None]
    assert prices.count_masked(df, (-0.95, 3.0)).first()[0] == 2


def test_incremental_start_covers_both_windows(spark):
    df = spark.createDataFrame([(dt.date(2026, 9, 30), dt.date(2026, 10, 5)), (dt.date(2026, 3, 31), dt.date(2026, 10, 5)), (None, dt.date(2026, 10, 5))],
                               "last date, today date")
    got = [r[0] for r in df.select(incremental_start(F.col("last"), F.col("today"))).collect()]
    assert got == [dt.date(2026, 6, 22), dt.date(2026, 2, 1), dt.date(2000, 1, 1)]


def test_versioned_upserts(spark, tmp_path):
    path = str(tmp_path / "t")
    mk = lambda rows, s: spark.createDataFrame(rows, s)
    sink.upsert_table(spark, path, mk([("a", "Ann", "X"), ("b", "Bob", None)], "ticker string, name string, gics_sector string"), ["ticker"])
    sink.write_universe(spark, path, mk([("a", "Ann2"), ("c", "Cat")], "ticker string, name string"))
    rows = {r.ticker: (r.name, r.gics_sector) for r in sink.read_table(spark, path).collect()}
    assert rows == {"a": ("Ann2", "X"), "b": ("Bob", None), "c": ("Cat", None)}   # the sector survives a listing refresh
    keys_only = sink.upsert(sink.read_table(spark, path), mk([("a",), ("d",)], "ticker string"), ["ticker"])
    assert {(r.ticker, r.name) for r in keys_only.collect()} == {("a", "Ann2"), ("b", "Bob"), ("c", "Cat"), ("d", None)}


def test_slices_and_guards(spark, tmp_path, bars_pdf, fund, sectors):
    ranked = spark.createDataFrame([(dt.date(2024, 1, 31), "a", 2.0, 1), (dt.date(2024, 1, 31), "b", 1.0, 2)], "date date, ticker string, pred double, rank int")
    path = str(tmp_path / "rec")
    sink.write_recommendations(ranked, path, "m1")
    sink.write_recommendations(ranked.limit(1), path, "m2")
    sink.write_recommendations(ranked.where("ticker = 'a'"), path, "m1")          # a dropped name must not linger
    assert spark.read.parquet(path).groupBy("model_version").count().orderBy("model_version").collect() == [("m1", 1), ("m2", 1)]
    closes = prices.monthly_close(spark.createDataFrame(bars_pdf))
    panel = assemble_panel(closes, fund, macro(spark), sectors)
    sink.write_panel(panel, str(tmp_path / "w" / "panel_monthly"))
    wh = Warehouse(spark, str(tmp_path / "w"))
    part = wh.panel("2020-06-01", "2020-12-31", ["date", "ticker", "roe"])
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "year" in plan and part.count() == 12 * 7
    no_sector = assemble_panel(closes, fund, macro(spark), sectors.where("ticker = 'T00'"))
    with pytest.raises(ValueError, match="panel not written"):
        sink.write_panel(no_sector, str(tmp_path / "w" / "panel_monthly"))
    with pytest.raises(ValueError, match="lacks columns"):
        sink.write_panel(panel.drop("roe"), str(tmp_path / "x"))
    u = spark.createDataFrame([(t, True) for t in TICKERS], "ticker string, is_active boolean")
    with pytest.raises(ValueError, match="active set not changed"):
        universe.set_active(u, u.where("ticker < 'T03'"))


def test_stats_json(spark):
    df = spark.createDataFrame([("m", float("nan"), 1.5)], "k string, a double, b double")
    assert json.loads(sink.stats_json(df, ["a", "b"], "s").first().s) == {"a": None, "b": 1.5}


def test_position_exports(spark, tmp_path):
    (tmp_path / "one.csv").write_text('"Positions for account XX-1"\n\n"Symbol","Description","Quantity","Market Value","Cost Basis"\n'
                                      '"brk.b","B","1,200","$5,000.00","$1,000.50"\n"BRK.B","B","3","$9","--"\n"Cash & Cash Investments","--","--","$250.75","--"\n'
                                      '"Account Total","--","--","$9,999.00","--"\n')
    (tmp_path / "two.csv").write_text("Ticker,Shares\nAAA,(5)\nBBB,7.5\n")
    (tmp_path / "bad.csv").write_text("name,amount\nx,1\n")
    rows = {(r.account_id, r.ticker): (r.shares, r.cost_basis) for r in files.read_positions(spark, str(tmp_path)).collect()}
    assert rows == {("one", "BRK-B"): (1203.0, 1000.5), ("one", "$CASH"): (250.75, None), ("two", "BBB"): (7.5, None)}
    docs = files.read_documents(spark, str(tmp_path)).select(F.regexp_extract("file", r"([^/]+)\.csv$", 1).alias("account_id"), "value")
    assert [r[0] for r in files.unreadable_accounts(files.lines_of(docs)).collect()] == ["bad"]


def test_factor_file_keeps_only_the_first_block(spark, tmp_path):
    (tmp_path / "f.csv").write_text("Created 2020\n\n,Mkt-RF,RF\n202001,1.50,0.10\n202002,-2.00,0.10\n\n  Annual\n2020,9,9\n")
    rows = files.read_factor_file(spark, str(tmp_path / "f.csv"), ["mkt_rf", "rf"]).orderBy("date").collect()
    assert [(r.date, r.mkt_rf, r.rf) for r in rows] == [(dt.date(2020, 1, 31), 0.015, 0.001), (dt.date(2020, 2, 29), -0.02, 0.001)]


def test_filing_documents_priority(spark, tmp_path):
    rec = lambda v: [{"start": "2022-01-01", "end": "2022-03-31", "val": v, "filed": "2022-05-01", "form": "10-Q"}]
    doc = {"cik": 12, "facts": {"us-gaap": {"Revenues": {"units": {"USD": rec(1.0)}}, "SalesRevenueNet": {"units": {"USD": rec(2.0)}},
                                            "Assets": {"units": {"USD": [{"end": "2022-03-31", "val": 7, "filed": "2022-05-01", "form": "10-Q"}]}}},
                                "dei": {"EntityCommonStockSharesOutstanding": {"units": {"shares": [{"end": "2022-04-10", "val": 5, "filed": "2022-05-01", "form": "10-Q"}]}}}}}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    tickers = spark.createDataFrame([("AAA", "0000000012")], "ticker string, cik string")
    from factorloom.operators.facts import extract_facts
    facts = quality.validate_facts(extract_facts(files.read_filings(spark, str(tmp_path), tickers)))
    rows = {r.concept: (r.gaap_tag, r.value, r.duration_days, r.fiscal_period) for r in facts.collect()}
    assert rows == {"revenue": ("Revenues", 1.0, 91, "Q1"), "assets": ("Assets", 7.0, 0, "Q1"),
                    "shares": ("EntityCommonStockSharesOutstanding", 5.0, 0, "Q1")}


def test_sector_sources(spark):
    df = spark.createDataFrame([("1311", None), ("2834", None), ("3674", "Energy"), ("", "Technology"), ("abc", "nope"), (None, None)],
                               "sic string, vendor_sector string")
    got = [(r.gics_sector, r.sector_source) for r in universe.resolve_sectors(df).collect()]
    assert got == [("Energy", "sec_sic"), ("Health Care", "sec_sic"), ("Information Technology", "sec_sic"),
                   ("Information Technology", "vendor"), (None, None), (None, None)]


def test_build_dataset_full_then_incremental(spark, bars_pdf, tmp_path):
    listing = spark.createDataFrame([(t, f"{t} Inc", "N") for t in TICKERS], "ticker string, name string, exchange string")
    split = bars_pdf[bars_pdf.date < dt.date(2020, 12, 15)]
    root = str(tmp_path / "wh")
    build_dataset(spark, root, listing=listing, bars=spark.createDataFrame(split), filings=None)
    later = bars_pdf[bars_pdf.date >= dt.date(2020, 9, 1)].copy()
    later.loc[later.ticker == "T03", "close"] *= 10                      # re-based history
    whole = bars_pdf.copy()
    whole.loc[whole.ticker == "T03", "close"] *= 10
    wh = build_dataset(spark, root, listing=listing, bars=spark.createDataFrame(later), filings=None,
                       full_bars=spark.createDataFrame(whole), incremental=True)
    want = prices.monthly_close(spark.createDataFrame(whole)).toPandas().set_index(["ticker", "date"]).close.sort_index()
    got = wh.prices().toPandas().set_index(["ticker", "date"]).close.sort_index()
    pd.testing.assert_series_equal(got, want)
    assert wh.table("universe").where("is_active").count() == 12


def test_checks_report_and_require(spark):
    u = spark.createDataFrame([("a", True, "X"), ("b", True, None), ("c", False, "X")], "ticker string, is_active boolean, gics_sector string")
    res = quality.universe_checks(u, 1, 10, 0.9, 1)
    rows = {r["check"]: r for r in res.collect()}
    assert rows["universe_active_band"].passed and not rows["universe_sector_coverage"].passed
    assert rows["universe_sector_coverage"].metadata["with_sector"] == "1"
    with pytest.raises(ValueError, match="universe_sector_coverage"):
        quality.require(res)


def test_serving_checks(spark):
    now = dt.datetime(2024, 2, 1)
    reg = spark.createDataFrame([("1m", "m1", "2024-01-01"), ("1m", "m2", "2024-02-01")], "horizon string, model_version string, created_at string")
    rec = lambda v, ranks: spark.createDataFrame([(dt.date(2024, 1, 31), v, r, f"t{i}", None, 1.0, now) for i, r in enumerate(ranks)], schema.RECOMMENDATIONS)
    summ = spark.createDataFrame([("m2", 2)], "model_version string, n_months int")
    months = spark.createDataFrame([("m2", 1), ("m2", 2)], "model_version string, month int")
    ok = lambda *a: {r["check"]: r.passed for r in quality.serving_checks(*a).collect()}
    assert ok(rec("m2", [1, 2, 3]), summ, months, reg) == {"recommendations_current": True, "strategy_backtest_current": True}
    assert ok(rec("m1", [1, 2, 3]), summ, months.limit(1), reg) == {"recommendations_current": False, "strategy_backtest_current": False}
    assert not ok(rec("m2", [1, 2, 2]), summ, months, reg)["recommendations_current"]
