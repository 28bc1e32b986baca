import datetime as dt
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorloom.operators import backtest
from factorloom.operators.portfolio import Strategy, top_n
from factorloom.operators.prices import monthly_close
from factorloom.sinks import tables as sink
from factorloom.streaming.incremental import file_stream, ingest_facts, ingest_prices

FACT = "ticker string, concept string, period_end date, filed_date date, value double"


def bars(spark, rows):
    return spark.createDataFrame(rows, "ticker string, date date, close double")


def test_price_stream_replaces_rebased_history(spark, tmp_path):
    days = [d.date() for d in pd.bdate_range("2020-01-01", "2020-06-30")]
    old = [("OK", d, 10.0 + i) for i, d in enumerate(days)] + [("SPLIT", d, 100.0 + i) for i, d in enumerate(days)]
    new_days = [d.date() for d in pd.bdate_range("2020-05-01", "2020-07-31")]
    whole = {("SPLIT", d): (100.0 + i) / 10 for i, d in enumerate(days + [x for x in new_days if x > days[-1]])}
    fresh = [("OK", d, 10.0 + (days + new_days).index(d) if d in days else 500.0) for d in new_days]
    fresh += [("SPLIT", d, whole["SPLIT", d]) for d in new_days]
    landed, target = str(tmp_path / "in"), str(tmp_path / "prices")
    schema = "ticker string, date date, close double"
    bars(spark, old).coalesce(1).write.parquet(landed)
    history = lambda moved: bars(spark, [(t, d, c) for (t, d), c in whole.items()]).join(moved, "ticker", "left_semi")
    run = lambda: ingest_prices(file_stream(spark, landed, bars(spark, []).schema), target, str(tmp_path / "ck"), full_history=history)
    run()
    bars(spark, fresh).coalesce(1).write.mode("append").parquet(landed)
    run()
    run()                                                    # nothing new: nothing changes
    got = {(r.ticker, r.date): r.close for r in sink.read_table(spark, target).collect()}
    assert len(got) == 14 and got["SPLIT", dt.date(2020, 1, 31)] == pytest.approx(whole["SPLIT", dt.date(2020, 1, 31)])
    assert got["OK", dt.date(2020, 1, 31)] == 10.0 + 22 and got["OK", dt.date(2020, 7, 31)] == 500.0
    assert schema


def test_fact_stream_is_idempotent_and_keeps_restatements(spark, tmp_path):
    q = dt.date(2020, 3, 31)
    one = [("A", "revenue", q, dt.date(2020, 5, 1), 1.0)]
    two = one + [("A", "revenue", q, dt.date(2021, 5, 1), 2.0)]
    landed, target = str(tmp_path / "in"), str(tmp_path / "facts")
    for i, rows in enumerate((one, two)):
        spark.createDataFrame(rows, FACT).coalesce(1).write.mode("append").parquet(landed)
        ingest_facts(file_stream(spark, landed, spark.createDataFrame([], FACT).schema), target, str(tmp_path / f"ck{i}"))
    rows = sorted((r.filed_date, r.value) for r in sink.read_table(spark, target).collect())
    assert rows == [(dt.date(2020, 5, 1), 1.0), (dt.date(2021, 5, 1), 2.0)]


def test_backtest_snapshot(spark, tmp_path):
    d = [x.date() for x in pd.date_range("2020-01-31", periods=6, freq="ME")]
    rows = [("m1", day, f"t{k}", float(k), 0.01 * k - 0.02) for day in d for k in range(6)]
    preds = spark.createDataFrame(rows, "model_version string, date date, ticker string, pred double, forward_return double")
    res = backtest.run_strategy_backtest(preds, None, [Strategy("base", 2, 4)])
    a, b = str(tmp_path / "summary"), str(tmp_path / "months")
    sink.write_backtest(res, a, b, {"n_holdings": 2, "buffer_rank": 4})
    sink.write_backtest(res, a, b, {"n_holdings": 2, "buffer_rank": 4})
    row = spark.read.parquet(a).collect()
    assert len(row) == 1 and row[0].n_months == 6 == spark.read.parquet(b).count()
    stats = json.loads(row[0].strategy_stats)
    assert stats["n_months"] == 6 and stats["sortino"] is None and row[0].first_month == dt.date(2020, 2, 29)


def test_holdings_snapshots(spark, tmp_path):
    pos = spark.createDataFrame([("a", "X", 5.0, 10.0), ("a", "$CASH", 7.0, None), ("b", "Y", 1.0, None)],
                                "account_id string, ticker string, shares double, cost_basis double")
    path = str(tmp_path / "holdings")
    sink.write_holdings(pos, path, "2024-01-31")
    sink.write_holdings(pos.where("account_id = 'b'"), path, "2024-02-29")
    sink.write_holdings(pos, path, "2024-02-29")
    stocks, cash = sink.latest_holdings(spark.read.parquet(path))
    assert sorted((r.account_id, r.ticker, r.shares) for r in stocks.collect()) == [("a", "X", 5.0), ("b", "Y", 1.0)]
    assert {r.account_id: r.cash for r in cash.collect()} == {"a": 7.0, "b": 0.0}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_keep_their_shape(spark):
    """Top-k is cut before the shuffle; closes need no sort; filters reach the scan."""
    sf = "/root/testdata/sf0.001"
    from factorloom.catalog import views as v
    from factorloom.plans.panel import monthly_grid, price_features

    li = spark.read.parquet(f"{sf}/lineitem.parquet").select(
        F.col("l_shipdate").cast("date").alias("date"), F.col("l_suppkey").alias("ticker"), F.col("l_tax").alias("pred"))
    assert "WindowGroupLimit" in plan_of(top_n(li, 5))
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    from factorloom.sources.tables import load_panel
    scan = plan_of(load_panel(orders.withColumnRenamed("o_orderkey", "k").where("k > 5"), columns=["k"]))
    assert "PushedFilters: [IsNotNull(o_orderkey), GreaterThan(o_orderkey,5)]" in scan and "o_totalprice" not in scan
    assert "Sort" not in plan_of(monthly_close(v.bars_d(spark, sf))).replace("SortAggregate", "Sort")
    for df in (price_features(monthly_grid(v.close_m(spark, sf))),):
        assert "CartesianProduct" not in plan_of(df)


def test_late_bars_do_not_replace_a_later_close(spark, tmp_path):
    landed, target = str(tmp_path / "in"), str(tmp_path / "prices")
    for rows in ([("A", dt.date(2020, 1, 31), 100.0), ("A", dt.date(2019, 5, 3), 1.0)], [("A", dt.date(2020, 1, 15), 50.0)],
                 [("A", dt.date(2020, 1, 31), 101.0), ("B", dt.date(2020, 1, 2), 7.0)]):
        bars(spark, rows).coalesce(1).write.mode("append").parquet(landed)
        ingest_prices(file_stream(spark, landed, bars(spark, []).schema, max_files=1), target, str(tmp_path / "ck"),
                      full_history=lambda moved: bars(spark, []).join(moved, "ticker", "left_semi"))
    got = {(r.ticker, r.date): r.close for r in sink.read_table(spark, target).collect()}
    assert got == {("A", dt.date(2020, 1, 31)): 101.0, ("A", dt.date(2019, 5, 31)): 1.0, ("B", dt.date(2020, 1, 31)): 7.0}


@pytest.mark.parametrize("max_files", [1, 10])
def test_disagreeing_facts_do_not_depend_on_batches(spark, tmp_path, max_files):
    q, landed, target = dt.date(2020, 3, 31), str(tmp_path / "in"), str(tmp_path / "facts")
    for value in (2.0, 1.0):
        spark.createDataFrame([("A", "revenue", q, dt.date(2020, 5, 1), value)], FACT).coalesce(1).write.mode("append").parquet(landed)
    ingest_facts(file_stream(spark, landed, spark.createDataFrame([], FACT).schema, max_files=max_files), target, str(tmp_path / "ck"))
    assert [r.value for r in sink.read_table(spark, target).collect()] == [2.0]


def files_by_year(path):
    return {y.name: sorted(f.name for f in y.glob("*.parquet")) for y in path.glob("year=*")}


def test_upsert_writes_only_the_years_it_touches(spark, tmp_path):
    path = tmp_path / "t"
    mk = lambda rows: sink.year_of(spark.createDataFrame(rows, "ticker string, date date, close double"))
    sink.upsert_table(spark, str(path), mk([("A", dt.date(y, 1, 31), float(y)) for y in (2018, 2019, 2020)]), ["ticker", "date"], ["year"])
    before = files_by_year(path)
    sink.upsert_table(spark, str(path), mk([("A", dt.date(2019, 1, 31), 1.0), ("B", dt.date(2021, 1, 31), 2.0)]), ["ticker", "date"], ["year"])
    after = files_by_year(path)
    assert {y for y in after if after[y] == before.get(y)} == {"year=2018", "year=2020"} and set(after) == set(before) | {"year=2021"}
    got = {(r.ticker, r.date.year): r.close for r in sink.read_table(spark, str(path)).collect()}
    assert got == {("A", 2018): 2018.0, ("A", 2019): 1.0, ("A", 2020): 2020.0, ("B", 2021): 2.0}
    scan = plan_of(sink.read_table(spark, str(path)).where("year = 2019"))
    assert "PartitionFilters: [isnotnull(year" in scan


def test_rebased_history_may_leave_a_year_empty(spark, tmp_path):
    path = str(tmp_path / "t")
    mk = lambda rows: sink.year_of(spark.createDataFrame(rows, "ticker string, date date, close double"))
    both = mk([("A", dt.date(2019, 1, 31), 1.0), ("B", dt.date(2020, 1, 31), 2.0), ("B", dt.date(2018, 1, 31), 3.0)])
    sink.upsert_table(spark, path, both, ["ticker", "date"], ["year"])
    new = mk([("B", dt.date(2020, 1, 31), 5.0)])
    drop = lambda stored, rows: stored.where("ticker != 'B'").unionByName(rows)
    sink.fold_into(spark, path, new, drop, ["year"], ["ticker"], both.where("ticker = 'B'"))
    assert sorted(tuple(r)[::2] for r in sink.read_table(spark, path).select("ticker", "date", "close").collect()) == [("A", 1.0), ("B", 5.0)]


def test_new_columns_reach_every_partition(spark, tmp_path):
    path = str(tmp_path / "t")
    mk = lambda rows, s: sink.year_of(spark.createDataFrame(rows, s))
    sink.upsert_table(spark, path, mk([("A", dt.date(2019, 1, 31), 1.0), ("A", dt.date(2020, 1, 31), 2.0)], "ticker string, date date, close double"), ["ticker", "date"], ["year"])
    sink.upsert_table(spark, path, mk([("A", dt.date(2020, 1, 31), 7)], "ticker string, date date, volume long"), ["ticker", "date"], ["year"])
    got = {r.date.year: (r.close, r.volume) for r in sink.read_table(spark, path).collect()}
    assert got == {2019: (1.0, None), 2020: (2.0, 7)}


def counted(spark, df):
    """``df`` through a step that counts its rows, whatever runs it."""
    rows = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            rows.add(len(b))
            yield b

    return df.mapInPandas(run, df.schema), rows


def test_guards_measure_inside_the_write(spark, tmp_path):
    """The source is computed once, and a refused batch leaves the table and its files as they were."""
    path = str(tmp_path / "t")
    guard = sink.Guard({"n": F.count(F.lit(1)), "bad": F.count_if(F.col("x") < 0)}, lambda g: [f"{g['bad']} of {g['n']}"] if g["bad"] else [])
    good, seen = counted(spark, spark.range(40).select(F.col("id").cast("double").alias("x")))
    sink.write_table(good, path, guard=guard)
    assert seen.value == 40 == sink.read_table(spark, path).count()
    files = sorted(p.name for p in (tmp_path / "t").iterdir())
    bad, seen = counted(spark, spark.range(30).select((F.col("id") - 2).cast("double").alias("x")))
    with pytest.raises(ValueError, match="2 of 30"):
        sink.write_table(bad, path, guard=guard)
    assert seen.value == 30 and sorted(p.name for p in (tmp_path / "t").iterdir()) == files
    sink.write_table(good.limit(0), path, guard=guard)
    assert sink.read_table(spark, path).count() == 0


def test_bad_facts_never_reach_the_table(spark, tmp_path):
    from factorloom.schema import FACTS

    def rows(*over):
        base = {"ticker": "AAA", "cik": "0000000001", "concept": "revenue", "gaap_tag": "Revenues", "period_end": "2020-03-31", "fiscal_period": "Q1",
                "duration_days": "91", "filed_date": "2020-05-01", "form": "10-Q", "value": "1.5", "unit": "USD"}
        data = [[{**base, **o}.get(f.name) for f in FACTS.fields] for o in over]
        return spark.createDataFrame(data, ", ".join(f"{f.name} string" for f in FACTS.fields))

    path = str(tmp_path / "facts")
    good, seen = counted(spark, rows({}, {"filed_date": "2021-05-01", "value": "2.5"}))
    sink.write_facts(spark, path, good)
    assert seen.value == 2
    with pytest.raises(ValueError, match="1 values of value have the wrong type; cik_pattern: 1 rows"):
        sink.write_facts(spark, path, rows({"filed_date": "2022-01-01"}, {"cik": "12"}, {"value": "many"}))
    assert sorted(r.value for r in sink.read_table(spark, path).collect()) == [1.5, 2.5]


def test_upsert_resolves_repeated_and_null_keys(spark):
    mk = lambda rows: spark.createDataFrame(rows, "k string, x double, y double")
    stored = mk([("a", 1.0, 1.0), (None, 2.0, 2.0)])
    got = sink.upsert(stored, mk([("a", 5.0, 0.0), ("a", 6.0, 0.0), (None, 7.0, 0.0)]), ["k"]).collect()
    assert sorted(((r.k or "", r.x, r.y) for r in got)) == [("", 7.0, 0.0), ("a", 6.0, 0.0)]
    part = sink.upsert(stored, mk([("a", 5.0, 0.0), (None, 7.0, 0.0), ("n", 8.0, 0.0)]).select("k", "x"), ["k"]).collect()
    assert sorted((r.k or "", r.x, r.y) for r in part if r.k != "n") == [("", 7.0, 2.0), ("a", 5.0, 1.0)] and len(part) == 3


def test_a_key_of_filings_costs_few_round_trips_to_the_store():
    import datetime as dt
    from types import SimpleNamespace

    import pandas as pd

    from factorloom.streaming.filings import FilingState, quarter_last_day

    calls, kept = [], {}

    class Store:
        def __init__(self, name):
            self.name = name

        def containsKey(self, at):
            calls.append(at)
            return (self.name, at) in kept

        def getValue(self, at):
            calls.append(at)
            return kept.get((self.name, at))

        def updateValue(self, at, value):
            calls.append(at)
            kept[self.name, at] = value

    days = lambda d: (d - dt.date(1970, 1, 1)).days
    rows = []
    for q in range(8000, 8028):  # seven years of three-month values, each filed three times
        end = quarter_last_day(q)
        rows += [(days(end) + lag, days(end), days(dt.date(q // 4, 1, 1)), 91, float(q + lag // 90), "10-Q", [float(days(end)), 0.0]) for lag in (30, 60, 90)]
    frame = pd.DataFrame(rows, columns=["filed", "qend", "fy", "days", "val", "form", "ord"])
    names = SimpleNamespace(names=["ticker", "concept", "period_end", "filed_date", "value", "form", "gone"])
    once = []
    for parts in ([frame], [frame.iloc[1::2], frame.iloc[::2]]):  # the same records in one call, then in two
        kept.clear()
        table = {}
        for part in parts:
            calls.clear()
            state = FilingState(["ticker", "concept"], names)
            state.init(SimpleNamespace(getMapState=lambda name, *_: Store(name)))
            for out in state.handleInputRows((1, "revenue"), iter([part]), None):
                for r in out.itertuples(index=False):
                    table.pop((r.period_end, r.filed_date), None) if r.gone else table.update({(r.period_end, r.filed_date): (r.value, r.form)})
            assert len(calls) <= 40  # a map by single quarters and days takes hundreds
        once.append(table)
    assert once[0] == once[1] and len(once[0]) >= 28
