import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorloom.models import elastic_net as en
from factorloom.models import folds, walkforward
from factorloom.models.grid import default_params, param_grid
from factorloom.models.pipelines import boosted_trees, elastic_net, label_std
from factorloom.models.registry import Manifest, ModelStore, score
from factorloom.models.training import latest_recommendations, train_and_deploy
from factorloom.operators.evaluate import ic_summary, information_coefficient
from factorloom.params import TuningParams, WalkForwardParams

FEATS = ["f0", "f1", "f2"]


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(11)
    parts = []
    for d in pd.date_range("2010-01-31", periods=44, freq="ME"):
        x = rng.random((50, 3))
        fwd = 0.05 * x[:, 0] + rng.normal(0, 0.02, 50)
        part = pd.DataFrame(x, columns=FEATS).assign(date=d.date(), ticker=[f"t{i:02d}" for i in range(50)], forward_return=fwd)
        part["target"] = part.forward_return.rank(pct=True)
        part.loc[rng.random(50) < 0.1, "f1"] = np.nan
        part["f2"] = np.nan if d.year == 2010 else part.f2
        parts.append(part)
    pdf = pd.concat(parts)
    pdf.loc[pdf.date == pdf.date.max(), ["forward_return", "target"]] = np.nan
    df = spark.createDataFrame(pdf)
    from factorloom.functions.scalars import nans_to_nulls
    from factorloom.session import settle
    return settle(nans_to_nulls(df))


def test_grid():
    spec = {"a": [1, 2], "b": 3, "c": ["x", "y"]}
    assert len(param_grid(spec)) == 4 and default_params(spec) == {"a": 1, "b": 3, "c": "x"}
    assert param_grid({"b": 3}) == [{"b": 3}]


def test_folds_respect_embargo(spark, panel):
    t = folds.fold_table(panel, WalkForwardParams(36, 1, 1)).toPandas()
    assert len(t) == 44 - 37 and (t.pos - t.train_end_pos == 1).all() and t.fold.tolist() == list(range(7))
    b = folds.fold_bounds(folds.fold_table(panel, WalkForwardParams(12, 5, 2)), panel).toPandas().sort_values("fold")
    assert (b.test_first > b.train_last).all() and b.n_train.diff().dropna().eq(5).all()


def penalised_loss(b, x, y, alpha, l1):
    r = y - y.mean() - (x - x.mean(0)) @ b
    return r @ r / (2 * len(y)) + alpha * l1 * np.abs(b).sum() + alpha * (1 - l1) / 2 * b @ b


def test_coordinate_descent_is_optimal():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 5))
    y = x @ [0.5, 0, -0.3, 0, 0.01] + rng.normal(size=200)
    xc, yc = x - x.mean(0), y - y.mean()
    s, sy = np.stack([xc.T @ xc / 200] * 2), np.stack([xc.T @ yc / 200] * 2)
    out = en.coordinate_descent(s, sy.copy(), np.array([0.1, 0.01]), np.array([0.5, 0.9]))
    for b, a, l in zip(out, (0.1, 0.01), (0.5, 0.9)):
        best = penalised_loss(b, x, y, a, l)
        for _ in range(300):
            assert penalised_loss(b + rng.normal(0, 0.01, 5), x, y, a, l) >= best - 1e-12


def test_one_pass_walk_forward_equals_fitting_each_fold(spark, panel):
    wf = WalkForwardParams(40, 1, 1)
    spec = {"alpha": 0.001, "l1_ratio": 0.5}
    fast, models = en.walk_forward(panel, FEATS, params=wf, spec=spec, stored=True)
    slow, _ = walkforward.walk_forward_predict(panel, "elasticnet", FEATS, spec=spec, params=wf)
    a = fast.select("date", "ticker", "pred").toPandas().set_index(["date", "ticker"]).pred.sort_index()
    b = slow.select("date", "ticker", "pred").toPandas().set_index(["date", "ticker"]).pred.sort_index()
    assert len(a) == 150 and a.index.equals(b.index)
    np.testing.assert_allclose(a, b, atol=1e-5)
    assert models.count() == 3


def test_tuned_scores_have_skill_and_shuffled_do_not(spark, panel):
    wf = WalkForwardParams(30, 1, 1)
    scored, models = en.walk_forward(panel, FEATS, params=wf, tuning=TuningParams(retune_every=6), stored=True)
    assert ic_summary(information_coefficient(scored, "pred")).first().ic_mean > 0.3
    m = models.toPandas()
    assert m.inner_ic.notna().all() and m.groupby(m.fold // 6).param_id.nunique().eq(1).all()


def test_shuffled_target_keeps_values_per_date_and_loses_the_signal(spark, panel):
    shuffled = walkforward.shuffle_target(panel)
    per_date = lambda df: {r.date: sorted(x for x in r.t if x is not None) for r in df.groupBy("date").agg(F.collect_list("target").alias("t")).collect()}
    assert shuffled.count() == panel.count() and per_date(shuffled) == per_date(panel)
    before = ic_summary(information_coefficient(panel, "target")).first()
    after = ic_summary(information_coefficient(shuffled, "target")).first()
    assert before.ic_mean == pytest.approx(1.0) and abs(after.t_stat) < 3 and abs(after.ic_mean) < 0.1


def test_leakage_gate(spark):
    gate = lambda rows: walkforward.leakage_passed(spark.createDataFrame(rows, "t_stat double, n_months bigint")).first().passed
    assert gate([]) and gate([(1.5, 60)]) and gate([(-1.9, 60)])
    assert not gate([(2.5, 60)]) and not gate([(None, 1)])


def test_store_round_trip_guard_and_ranking(spark, panel, tmp_path):
    store = ModelStore(spark, str(tmp_path / "models"))
    spec = {"maxIter": 3, "maxDepth": 2, "stepSize": 0.3, "minInstancesPerNode": 5}
    res = train_and_deploy(panel, FEATS, model_name="boosted_trees", spec=spec, store=store, params=WalkForwardParams(41, 1, 1))
    assert res.summary["ic_mean"] > 0 and res.manifest.feature_list == FEATS
    model, manifest = store.load("1m")
    assert manifest.model_version == res.manifest.model_version and manifest.hyperparams["maxDepth"] == 2
    with pytest.raises(ValueError, match="skew"):
        score(model, manifest, panel.drop("f1"))
    ranked, _ = latest_recommendations(panel.repartition(7), store)
    rows = ranked.orderBy("rank").toPandas()
    assert rows["rank"].tolist() == list(range(1, 51))
    order = rows.sort_values(["pred", "ticker"], ascending=[False, True]).ticker.tolist()
    assert rows.ticker.tolist() == order
    with pytest.raises(FileNotFoundError):
        store.load("5d")
    with pytest.raises(ValueError, match="no panel rows"):
        latest_recommendations(panel, store, asof="1999-01-31")
    older = Manifest("old", "m", "1m", FEATS, {}, "rank", "target", "", "", 1, {}, "", "2000-01-01")
    store.save(model, older)
    assert store.manifest("1m").model_version == res.manifest.model_version


def test_all_null_feature_stays_in_the_vector(spark, panel):
    early = panel.where("year(date) = 2010")
    model = boosted_trees(FEATS, {"maxIter": 1, "maxDepth": 1}).fit(early)
    assert model.transform(early).select(F.size(F.expr("array(_features)"))).first()[0] == 1
    lin = elastic_net(FEATS, 0.001, 0.5, label_std(early)).fit(early)
    assert len(lin.stages[-1].coefficients) == 3


def test_permutations_share_moments_and_tell_skill_from_luck(spark):
    import numpy as np
    import pandas as pd

    from factorloom.models import elastic_net, permutation
    from factorloom.operators.evaluate import information_coefficient
    from factorloom.params import WalkForwardParams

    rng, rows = np.random.default_rng(2), []
    for m in range(18):
        day = (pd.Timestamp("2020-01-31") + pd.offsets.MonthEnd(m)).date()
        for k in range(30):
            x, y = rng.random(), rng.random()
            rows.append((day, f"T{k:02d}", x, y, None if k == 3 else x + 0.3 * rng.random(), x + rng.normal(), float(rng.normal())))
    panel = spark.createDataFrame(rows, "date date, ticker string, a double, b double, target double, forward_return double, luck double")
    wf = WalkForwardParams(8, 1, 1)
    ic = permutation.permutation_ic(panel, ["a", "b"], permutations=30, params=wf).cache()
    scored, _ = elastic_net.walk_forward(panel, ["a", "b"], params=wf)
    want = {r.date: r.ic for r in information_coefficient(scored, "pred").collect()}
    got = {r.date: r.ic for r in ic.where("perm = 0").collect()}
    assert got.keys() == want.keys() and all(abs(got[d] - want[d]) < 1e-9 for d in want)
    row = permutation.permutation_test(ic).first()
    # a chance fit may point along the one feature that matters, so a few permutations come near
    assert row.n_permutations == 30 and row.n_reached <= 2 and row.p_value == pytest.approx((row.n_reached + 1) / 31)
    luck = panel.drop("forward_return").withColumnRenamed("luck", "forward_return")
    assert permutation.permutation_test(permutation.permutation_ic(luck, ["a", "b"], permutations=30, params=wf)).first().p_value > 0.05


def test_permuted_places_are_permutations_without_a_pattern():
    import numpy as np

    from factorloom.models.permutation import permuted_places

    fixed, follow = [], []
    for seed in range(42, 242):
        p = permuted_places(500, 18_000, seed)
        assert sorted(p) == list(range(500))
        fixed.append(int((p == np.arange(500)).sum()))
        follow.append(int((np.diff(p) == 1).sum()))
    assert abs(np.mean(fixed) - 1) < 0.3 and abs(np.mean(follow) - 1) < 0.3


def test_permutation_blocks_give_the_same_series(spark, monkeypatch):
    """A task holds a block of permutations, not all of a date."""
    from factorloom.models import permutation

    assert [(b.start, b.stop) for b in permutation._blocks(permutation.BLOCK_CELLS // 2, 5)] == [(0, 2), (2, 4), (4, 5)]
    rows = [(f"2020-01-{d + 1:02d}", i, float((i * 7 + d) % 11), float((i * 5 + d) % 13)) for d in range(4) for i in range(12)]
    panel = spark.createDataFrame(rows, "date string, ticker long, a double, target double").withColumn("date", F.to_date("date"))
    whole = {(r.date, r.perm): list(r.sums) for r in permutation.permuted_sums(panel, ["a"], "target", [1, 2, 3]).collect()}
    monkeypatch.setattr(permutation, "BLOCK_CELLS", 24)
    assert permutation._blocks(12, 4) == [slice(0, 2), slice(2, 4)]
    parts = {(r.date, r.perm): list(r.sums) for r in permutation.permuted_sums(panel, ["a"], "target", [1, 2, 3]).collect()}
    assert len(whole) == 16 and parts == whole
