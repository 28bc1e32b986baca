import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorloom.functions import cross_section as xs
from factorloom.functions.scalars import nans_to_nulls
from factorloom.operators.asof import asof_join
from factorloom.operators.calendar import calendar, densify, with_position
from factorloom.operators.evaluate import information_coefficient, quantile_returns
from factorloom.functions.windows import Positional


def frame(spark, pdf, schema):
    """pandas marks missing numbers as NaN; the library's contract is NULL."""
    return nans_to_nulls(spark.createDataFrame(pdf, schema))


def days(n, start=dt.date(2020, 1, 1)):
    return [start + dt.timedelta(days=i) for i in range(n)]


@pytest.fixture(scope="module")
def sparse(spark):
    rng = np.random.default_rng(5)
    rows = [(t, d, float(rng.normal())) for t in "abcd" for d in days(120) if rng.random() < 0.85]
    return pd.DataFrame(rows, columns=["ticker", "date", "x"])


def test_range_frames_equal_dense_pandas(spark, sparse):
    wide = sparse.pivot(index="date", columns="ticker", values="x").sort_index()
    df = spark.createDataFrame(sparse)
    p = Positional()
    placed = p.centred(p.with_long_max(with_position(df, calendar(df)), "x", 40, "max40", 20), "x")
    got = placed.withColumns({
        "prev": p.previous("x"), "next": p.following("x"), "std5": p.rolling_std("x", 5),
        "mean7": p.rolling_mean("x", 7, 5), "mean45": p.rolling_mean("x", 45, 30), "std50": p.rolling_std("x", 50, 35),
        "mom": p.compound("x", -12, -2), "long": p.compound("x", -50, -3), "fwd": p.compound("x", 1, 4),
    }).toPandas()
    want = {
        "prev": wide.shift(1), "next": wide.shift(-1), "std5": wide.rolling(5).std(),
        "mean7": wide.rolling(7, min_periods=5).mean(), "max40": wide.rolling(40, min_periods=20).max(),
        "mean45": wide.rolling(45, min_periods=30).mean(), "std50": wide.rolling(50, min_periods=35).std(),
        "mom": np.expm1(wide.shift(2).rolling(11).sum()), "long": np.expm1(wide.shift(3).rolling(48).sum()),
        "fwd": np.expm1(wide.rolling(4).sum().shift(-4)),
    }
    for name, frame in want.items():
        for r in got.itertuples():
            a, b = getattr(r, name), frame.at[r.date, r.ticker]
            assert (pd.isna(a) and pd.isna(b)) or a == pytest.approx(b, abs=1e-9), (name, r)


def test_long_frames_keep_digits_of_a_high_level(spark):
    """Values near 1e9 that differ by thousandths, for two years of days."""
    rng = np.random.default_rng(9)
    rows = [(t, d, 1e9 + i * 7e8 + float(rng.normal()) / 1000) for i, t in enumerate("ab") for d in days(500)]
    pdf = pd.DataFrame(rows, columns=["ticker", "date", "x"])
    df, p = spark.createDataFrame(pdf), Positional()
    placed = p.centred(with_position(df, calendar(df)), "x")
    got = placed.withColumns({"std": p.rolling_std("x", 63), "mean": p.rolling_mean("x", 60)}).toPandas()
    for t, part in got.sort_values("date").groupby("ticker"):
        exact = pdf[pdf.ticker == t].x.reset_index(drop=True) - (1e9 + 7e8 * (t == "b"))
        assert np.allclose(part["std"].dropna().to_numpy(), exact.rolling(63).std().dropna().to_numpy(), rtol=1e-6)
        assert np.allclose(part["mean"].dropna().to_numpy() - (1e9 + 7e8 * (t == "b")), exact.rolling(60).mean().dropna().to_numpy(), atol=3e-7)


@pytest.mark.parametrize(("n", "least"), [(33, 1), (60, 20), (119, 119), (200, 50)])
def test_long_maximum_equals_pandas(spark, sparse, n, least):
    wide = sparse.pivot(index="date", columns="ticker", values="x").sort_index()
    df, p = spark.createDataFrame(sparse), Positional()
    got = p.with_long_max(with_position(df, calendar(df)), "x", n, "most", least).toPandas()
    want = wide.rolling(n, min_periods=least).max()
    assert len(got) == len(sparse)
    for r in got.itertuples():
        b = want.at[r.date, r.ticker]
        assert (pd.isna(r.most) and pd.isna(b)) or r.most == b


def test_daily_features_re_read_no_long_frame(spark):
    import re

    from factorloom.plans.panel_daily import technical_features

    df = spark.createDataFrame([("a", 1, 1.0, 1.0, 1.0, 1.0, 0.1)], "ticker string, pos int, close double, high double, low double, volume double, ret double")
    plan = technical_features(df)._jdf.queryExecution().executedPlan().toString()
    frames = re.findall(r"specifiedwindowframe\((\w+), ([^,]+), ([^)]+)\)", plan)
    assert frames and all(lo.startswith("unbounded") or abs(int(lo)) <= 32 for _, lo, _ in frames)


def test_densify_fills_every_cell_once(spark, sparse):
    df = spark.createDataFrame(sparse)
    cal = calendar(df.where("date > '2020-01-10'"))
    grid = densify(df, cal).toPandas()
    assert len(grid) == 4 * cal.count() and not grid.duplicated(["ticker", "date"]).any()
    want = sparse[sparse.date > dt.date(2020, 1, 10)].set_index(["ticker", "date"]).x
    got = grid.dropna(subset=["x"]).set_index(["ticker", "date"]).x
    pd.testing.assert_series_equal(got.sort_index(), want.sort_index())


def test_densify_keeps_a_ticker_with_only_dropped_dates(spark):
    d = days(4)
    df = spark.createDataFrame([("a", d[0], 1.0), ("a", d[2], 2.0), ("b", d[0], 3.0)], "ticker string, date date, x double")
    cal = calendar(df.where(F.col("date") > F.lit(d[0])))
    rows = densify(df, cal).collect()
    assert sorted((r.ticker, r.x) for r in rows) == [("a", 2.0), ("b", None)]


def test_future_does_not_change_past_features(spark, sparse):
    cut = dt.date(2020, 3, 1)
    moved = sparse.assign(x=[x * 9 if d > cut else x for d, x in zip(sparse.date, sparse.x)])
    p = Positional()

    def feats(pdf):
        df = spark.createDataFrame(pdf)
        out = with_position(df, calendar(df)).withColumns({"a": p.compound("x", -12, -2), "b": p.rolling_std("x", 9)})
        return out.where(F.col("date") <= F.lit(cut)).select("ticker", "date", "a", "b").toPandas().sort_values(
            ["ticker", "date"]).reset_index(drop=True)

    pd.testing.assert_frame_equal(feats(sparse), feats(moved))


@pytest.fixture(scope="module")
def groups(spark):
    rng = random.Random(3)
    rows = []
    for i in range(900):
        g = rng.choice(["p", "p", "p", "q", "r", None])
        x = rng.choice([None, 0.0, -0.0, 1.0, 1.0, 2.5, rng.gauss(0, 1), -1e9, 1e-12])
        rows.append((i, g, x, rng.choice([1.0, rng.random()])))
    return pd.DataFrame(rows, columns=["id", "g", "x", "y"])


@pytest.mark.parametrize("wide", [False, True])
def test_pct_rank_matches_pandas(spark, groups, wide):
    df = frame(spark, groups, "id int, g string, x double, y double")
    got = xs.pct_rank(df, ["x", "y"], ["g"], keys=["id"], wide_groups=wide).toPandas().set_index("id").sort_index()
    want = groups.set_index("id").groupby("g")[["x", "y"]].rank(pct=True)
    for c in ("x", "y"):
        np.testing.assert_allclose(got[c].to_numpy(float), want[c].reindex(got.index).to_numpy(float))


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("descending", [False, True])
def test_row_numbers_matches_pandas(spark, groups, wide, descending):
    pdf = groups.dropna(subset=["g", "x"])
    df = spark.createDataFrame(pdf, "id int, g string, x double, y double")
    got = xs.row_numbers(df, ["g"], "x", "id", descending=descending, out="k", count="n", wide_groups=wide).toPandas()
    want = pdf.assign(x=pdf.x + 0.0).sort_values(["x", "id"], ascending=[not descending, True])
    want["k"] = want.groupby("g").cumcount() + 1
    pd.testing.assert_series_equal(got.set_index("id").k.sort_index().astype(int), want.set_index("id").k.sort_index(), check_dtype=False, check_index_type=False)
    assert (got.groupby("g").n.first() == pdf.groupby("g").size()).all()


def test_exact_quantiles_match_pandas(spark, groups):
    df = frame(spark, groups, "id int, g string, x double, y double")
    got = xs.exact_quantiles(df, ["x", "y"], [0.01, 0.5, 0.9], ["g"]).toPandas().set_index(["g", "column", "prob"]).value
    for g, part in groups.dropna(subset=["g"]).groupby("g"):
        for c in ("x", "y"):
            for p in (0.01, 0.5, 0.9):
                assert got[(g, c, p)] == pytest.approx(part[c].quantile(p))


@pytest.mark.parametrize("wide", [False, True])
def test_zscore_matches_pandas(spark, groups, wide):
    pdf = groups.assign(c=3.0)
    df = frame(spark, pdf, "id int, g string, x double, y double, c double")
    got = xs.zscore(df, ["y", "c"], ["g"], keys=["id"], winsorize_pct=0.05, wide_groups=wide).toPandas().set_index("id").sort_index()

    def z(s):
        s = s.clip(s.quantile(0.05), s.quantile(0.95))
        return (s - s.mean()) / s.std() if s.std() > 1e-12 else s * 0

    want = pdf.set_index("id").groupby("g")[["y", "c"]].transform(z).reindex(got.index)
    np.testing.assert_allclose(got[["y", "c"]].to_numpy(float), want.to_numpy(float), atol=1e-9)


def test_hot_group_and_hot_value_stay_exact(spark):
    """A third of all rows share one group, and most of them one value."""
    df = spark.range(30_000).select(
        "id", F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 50).alias("g"),
        F.when(F.col("id") % 4 != 0, F.lit(7.0)).otherwise((F.col("id") * 37 % 1001).cast("double")).alias("x"))
    narrow = xs.pct_rank(df, ["x"], ["g"], keys=["id"])
    split = xs.pct_rank(df, ["x"], ["g"], keys=["id"], wide_groups=True)
    assert narrow.exceptAll(split).count() == 0 and split.count() == 30_000
    a = xs.row_numbers(df, ["g"], "x", "id", out="k")
    b = xs.row_numbers(df, ["g"], "x", "id", out="k", wide_groups=True)
    assert a.select("id", "k").exceptAll(b.select("id", "k")).count() == 0


@pytest.mark.parametrize("bucket", [None, "day"])
def test_asof_join_matches_merge_asof(spark, bucket):
    rng = np.random.default_rng(1)
    t0 = pd.Timestamp("2024-01-01")
    left = pd.DataFrame({"k": rng.integers(0, 3, 300), "t": t0 + pd.to_timedelta(rng.integers(0, 5 * 86400, 300), "s"), "i": range(300)})
    right = pd.DataFrame({"k": rng.integers(0, 2, 60), "s": t0 + pd.to_timedelta(rng.integers(0, 5 * 86400, 60), "s"), "v": range(60)})
    right = pd.concat([right, right.assign(v=right.v + 1000)])  # ties: the larger v must win
    left.loc[:20, "t"] = right.s.iloc[:21].to_numpy()           # inclusive
    got = asof_join(spark.createDataFrame(left), spark.createDataFrame(right), ["k"], "t", "s", tie="v", bucket=bucket)
    got = got.toPandas().set_index("i").v.sort_index()
    best = right.sort_values("v").drop_duplicates(["k", "s"], keep="last")
    want = pd.merge_asof(left.sort_values("t"), best.sort_values("s"), left_on="t", right_on="s", by="k").set_index("i").v.sort_index()
    np.testing.assert_array_equal(got.to_numpy(float), want.to_numpy(float))


@pytest.mark.parametrize("wide", [False, True])
def test_ic_is_spearman_on_complete_pairs(spark, wide):
    rng = np.random.default_rng(2)
    rows = []
    for i, d in enumerate(days(8)):
        n = 4 if i == 0 else 30
        for t in range(n):
            x = 1.0 if i == 1 else float(np.round(rng.normal(), 1))
            rows.append((d, f"t{t}", x if rng.random() > 0.1 else None, float(rng.normal())))
    pdf = pd.DataFrame(rows, columns=["date", "ticker", "x", "forward_return"])
    got = information_coefficient(frame(spark, pdf, "date date, ticker string, x double, forward_return double"),
                                  "x", wide_groups=wide).toPandas().set_index("date").ic.sort_index()
    assert list(got.index) == days(8)[2:]  # four pairs and a constant signal drop out
    for d, ic in got.items():
        sub = pdf[(pdf.date == d)].dropna()
        assert ic == pytest.approx(sub.x.rank().corr(sub.forward_return.rank()))


@pytest.mark.parametrize("wide", [False, True])
def test_quantile_returns_match_qcut(spark, wide):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame([(d, t, float(rng.integers(0, 9)), float(rng.normal())) for d in days(3) for t in range(23)],
                       columns=["date", "ticker", "s", "forward_return"])
    got = quantile_returns(spark.createDataFrame(pdf), "s", n_quantiles=5, wide_groups=wide).toPandas().set_index("quantile").mean_fwd_return
    q = pdf.sort_values("ticker").groupby("date", group_keys=False)["s"].transform(
        lambda s: pd.qcut(s.rank(method="first"), 5, labels=False) + 1)
    means = pdf.assign(q=q).groupby(["date", "q"]).forward_return.mean().groupby("q").mean()
    for k, m in means.items():
        assert got[str(k)] == pytest.approx(m)
    assert got["top_minus_bottom"] == pytest.approx(means[5] - means[1])


def odd_values(spark):
    """NaN, infinities, a hot value, a narrow band of large numbers and names with one long prefix."""
    nan, inf = float("nan"), float("inf")
    groups = {"odd": [nan, inf, -inf, 1.0, None, -2.0, 0.0, inf, 1e-300], "hot": [5.0] * 60 + [4.0, 6.0],
              "band": [1.7e9 + k / 7 for k in range(50)] + [1.7e9]}
    rows = [(g, f"a_very_long_shared_prefix_{g}_{k:03d}", x) for g, xs_ in groups.items() for k, x in enumerate(xs_)]
    return spark.createDataFrame(rows + [(None, "n", 1.0)], "g string, id string, x double"), groups


@pytest.mark.parametrize("wide", [False, True])
def test_rank_forms_define_odd_values_alike(spark, wide):
    df, groups = odd_values(spark)
    got = {r.id: r.r for r in xs.pct_rank(df, ["x"], ["g"], keys=["id"], wide_groups=wide, names={"x": "r"}).collect()}
    for g, values in groups.items():
        want = pd.Series(values, dtype=float).rank(pct=True)
        have = [got[f"a_very_long_shared_prefix_{g}_{k:03d}"] for k in range(len(values))]
        assert [None if pd.isna(w) else round(w, 12) for w in want] == [None if h is None else round(h, 12) for h in have]
    assert got["n"] is None
    known = df.where("g is not null and x is not null and not isnan(x)")
    rows = xs.row_numbers(known, ["g"], "x", "id", out="k", count="n", wide_groups=wide).collect()
    for g in groups:
        own = sorted(((r.x, r.id), r.k, r.n) for r in rows if r.g == g)
        assert [k for _, k, _ in own] == list(range(1, len(own) + 1)) and {n for _, _, n in own} == {len(own)}


@pytest.mark.parametrize("by", [["date", "sector"], ["date"]])
def test_ranks_by_frames_equal_the_window_form(spark, by):
    rng = random.Random(8)
    value = lambda: rng.choice([None, float("nan"), float("inf"), -float("inf"), *[float(rng.randrange(6)) for _ in range(8)]])
    rows = [(rng.choice([*days(4), None]), f"T{i}", rng.choice(["a", "b", None]), value(), value(), rng.choice([None, 3])) for i in range(200)]
    df = spark.createDataFrame(rows, "date date, ticker string, sector string, x double, y double, n int")
    names = {"y": "y_rank"}
    window = xs.pct_rank(df, ["x", "y"], by, keys=["date", "ticker"], names=names)
    frames = xs.pct_rank_frames(df, ["x", "y"], by, frame=["date"], names=names)
    key = lambda d: {r.ticker: (r.date, r.sector, r.x, r.y_rank, r.n, str(r.y)) for r in d.collect()}
    assert key(window) == key(frames) and frames.columns == window.columns
    assert xs.pct_rank_frames(df.limit(0), ["x"], by, frame=["date"]).count() == 0


def test_frames_and_views_derive_their_input_once(spark, tmp_path):
    from pyspark.sql import functions as F

    from factorloom.catalog import views
    from factorloom.operators import fundamentals

    df = spark.range(40).select(F.date_add(F.lit(days(1)[0]), (F.col("id") % 3).cast("int")).alias("date"), F.col("id").cast("double").alias("x"))
    plan = xs.pct_rank_frames(df, ["x"], ["date"], frame=["date"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (") == 1  # a union of rows with and without a date read it twice

    lines = [(1, k % 3, days(9)[k], 10.0 + k, 2.0, 0.05) for k in range(9)]
    spark.createDataFrame(lines, "l_suppkey long, l_linenumber int, l_shipdate date, l_extendedprice double, l_quantity double, l_discount double").write.parquet(
        f"{tmp_path}/lineitem.parquet")
    for query in (fundamentals.first_reported(views.facts(spark, str(tmp_path))), views.bars_d(spark, str(tmp_path))):
        plan = query._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in plan  # one shuffle, whose parts no bytes merge


def test_frame_correlations_equal_window_ones_without_a_row_per_pair(spark):
    from factorloom.operators import evaluate

    nan = float("nan")
    rows = [("d1", float(i % 4), None if i == 3 else nan if i == 5 else float(-i), float((i * 3) % 7)) for i in range(20)]
    rows += [(None, float(i), 1.0, float(i % 3)) for i in range(8)] + [("d2", float(i), float(i), float(i)) for i in range(4)]
    panel = spark.createDataFrame(rows, "date string, a double, b double, y double")
    got = evaluate.information_coefficient(panel, ["a", "b"], target="y")
    want = evaluate.spearman(evaluate._pairs(panel, ["a", "b"], "y", ["date"]), ["signal", "date"])
    key = lambda df: sorted((r.signal, str(r.date), round(r.ic, 12)) for r in df.collect())
    assert got.columns == want.columns and key(got) == key(want) and len(key(got)) == 3
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
