"""Models, splitters and searches against optimality conditions and direct NumPy computation."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fathomic.operators import decomposition, ensemble, feature_selection, linear, metrics, model_selection, trees
from fathomic.plans import stats

COLS = ["x0", "x1", "x2"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 3)) + [1, 0, -1]
    y = x @ [2.0, -1.0, 0.0] + 0.5 + 0.1 * rng.normal(size=90)
    c = (x[:, 0] + 0.3 * rng.normal(size=90) > 1).astype(int)
    pdf = pd.DataFrame(x, columns=COLS).assign(y=y, c=c, id=rng.permutation(90) * 3, g=np.arange(90) % 9)
    return spark.createDataFrame(pdf).coalesce(2).cache(), pdf


def r2(model, df, y):
    return metrics.r2_score(model.predict(df), y, "prediction")


def ids(df):
    return set(df.select("id").toPandas()["id"])


def test_row_places_of_a_wide_table(spark):
    """Places are 0 to n - 1 in id order whatever columns are read beside the id."""
    df = spark.range(0, 60_000, 1, 6).select(F.xxhash64("id").alias("id"), F.col("id").alias("v"), F.md5(F.col("id").cast("string")).alias("s"))
    got = model_selection.numbered(df, "id").select("id", "v", "__at").toPandas().sort_values("id")
    assert (got["__at"].to_numpy() == np.arange(60_000)).all()
    texts = model_selection.numbered(df, "s").select("s", "v", "__at").toPandas().sort_values("s")
    assert (texts["__at"].to_numpy() == np.arange(60_000)).all()
    folds = list(model_selection.TimeSeriesSplit(3).split(df, "id"))
    assert [(a.agg(F.count("v")).first()[0], b.agg(F.count("v")).first()[0]) for a, b in folds] == [(15_000 * k, 15_000) for k in (1, 2, 3)]


def test_range_numbers(spark):
    df = spark.createDataFrame([(None,), (1.0,), (1.0,), (float("nan"),), (-5.0,), (7.0,)], "v double")
    got = df.select("v", stats.range_of(df, "v").alias("k")).toPandas()
    order = got.assign(at=[-1 if r is None else 99 if r != r else r for r in [x[0] for x in df.collect()]]).sort_values("at").k.tolist()
    assert order == sorted(order)
    empty = df.where("false")
    assert empty.select(stats.range_of(empty, "v")).count() == 0
    same = spark.range(500).select(F.lit(3).alias("v"))
    assert same.select(stats.range_of(same, "v").alias("k")).distinct().count() == 1


def test_curve_areas_of_many_scores(spark):
    df = spark.range(0, 40_000, 1, 6).select(F.rand(4).alias("s"), "id").withColumn("t", (F.col("s") + F.rand(9) > 1).cast("int")).cache()
    pdf = df.toPandas()
    rank = pdf.s.rank().to_numpy()
    pos = pdf.t.to_numpy() == 1
    want = (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    curve = metrics.roc_curve(df, "t", "s").toPandas().sort_values("threshold", ascending=False)
    assert np.isclose(np.trapezoid(curve.tpr, curve.fpr), want) and (np.diff(curve.tpr) >= 0).all() and len(curve) == 40_001


def test_elastic_net_is_optimal(data):
    df, pdf = data
    x, y = pdf[COLS].to_numpy(), pdf["y"].to_numpy()
    m = linear.ElasticNet(0.2, 0.4).fit(df, COLS, "y")
    rest = y - y.mean() - (x - x.mean(0)) @ m.coef_
    slope = (x - x.mean(0)).T @ rest / len(x) - 0.2 * 0.6 * m.coef_
    on = m.coef_ != 0
    assert np.allclose(slope[on], 0.08 * np.sign(m.coef_[on]), atol=1e-6) and (np.abs(slope[~on]) <= 0.08 + 1e-9).all()


def test_bayesian_ridge(data):
    df, pdf = data
    x, y = pdf[COLS].to_numpy(), pdf["y"].to_numpy()
    m = linear.BayesianRidge().fit(df, COLS, "y")
    g = (x - x.mean(0)).T @ (x - x.mean(0))
    assert np.allclose(m.coef_, np.linalg.solve(g + m.lambda_ / m.alpha_ * np.eye(3), (x - x.mean(0)).T @ (y - y.mean())))
    assert np.allclose(m.sigma_, np.linalg.inv(m.lambda_ * np.eye(3) + m.alpha_ * g)) and math.isclose(1 / math.sqrt(m.alpha_), 0.1, rel_tol=0.25)


def test_robust_regressions(spark, data):
    _, pdf = data
    bad = pdf.assign(y=np.where(np.arange(90) < 9, pdf.y + 60, pdf.y))
    df = spark.createDataFrame(bad).coalesce(2).cache()
    huber = linear.HuberRegressor().fit(df, COLS, "y")
    ransac = linear.RANSACRegressor(residual_threshold=1.0).fit(df, COLS, "y", "id")
    clean = linear.LinearRegression().fit(df.where(F.col("y") < 30), COLS, "y")
    assert np.allclose(huber.coef_, [2, -1, 0], atol=0.1)
    assert huber.outliers(df, "y").where("outlier and y > 30").count() == 9
    assert np.allclose(ransac.coef_, clean.coef_) and ransac.n_inliers_ == 81
    rng = np.random.RandomState(0)
    assert all(len({*linear.places_drawn(rng, 7, 5)}) == 5 for _ in range(50)) and sorted(linear.places_drawn(rng, 4, 4)) == [0, 1, 2, 3]
    with pytest.raises(ValueError):
        linear.places_drawn(rng, 2, 3)


def test_support_vectors_are_optimal(data):
    df, pdf = data
    z = np.c_[pdf[COLS].to_numpy(), np.ones(90)]
    svr = linear.LinearSVR(epsilon=0.05).fit(df, COLS, "y")
    w, e = np.r_[svr.coef_, svr.intercept_], None
    e = z @ w - pdf["y"].to_numpy()
    assert np.abs(w + 2 * z.T @ (np.sign(e) * np.maximum(0, np.abs(e) - 0.05))).max() < 1e-2
    svc = linear.LinearSVC().fit(df, COLS, "c")
    w, s = np.r_[svc.coef_[0], svc.intercept_[0]], 2 * pdf["c"].to_numpy() - 1
    assert np.abs(w - 2 * z.T @ (s * np.maximum(0, 1 - s * (z @ w)))).max() < 1e-2


def test_gradient_steps(data):
    """With one batch an epoch is one step of plain gradient descent."""
    df, pdf = data
    x, y = pdf[COLS].to_numpy(), pdf["y"].to_numpy()
    m = linear.MBSGDRegressor(batches=1, max_iter=4, eta0=0.05, alpha=0.1, tol=0.0).fit(df, COLS, "y")
    w, b = np.zeros(3), 0.0
    for _ in range(4):
        e = x @ w + b - y
        w, b = w * (1 - 0.05 * 0.1) - 0.05 * x.T @ e / 90, b - 0.05 * e.mean()
    assert np.allclose(m.coef_, w) and math.isclose(m.intercept_, b)
    k = linear.MBSGDClassifier(loss="log", batches=2, max_iter=15, eta0=0.5).fit(df, COLS, "c")
    assert k.predict(df).where("prediction = c").count() > 75


def test_projections_and_shrinkage(data):
    df, pdf = data
    x = pdf[COLS].to_numpy()
    for kind in (decomposition.GaussianRandomProjection, decomposition.SparseRandomProjection):
        m = kind(n_components=2).fit(df, COLS)
        got = m.transform(df).toPandas().sort_values("id")
        assert np.allclose(got[["pc0", "pc1"]], x[np.argsort(pdf["id"])] @ m.components_.T)
    s = np.cov(x.T, bias=True)
    mu, xc = np.trace(s) / 3, x - x.mean(0)
    delta = ((s - mu * np.eye(3)) ** 2).sum() / 3
    beta = sum(((np.outer(r, r) - s) ** 2).sum() for r in xc) / 90**2 / 3
    assert math.isclose(decomposition.LedoitWolf().fit(df, COLS).shrinkage_, min(beta, delta) / delta, rel_tol=1e-9)


def test_selectors(data):
    df, _ = data
    _, p = feature_selection.f_classif(df, COLS, "c")
    assert (feature_selection.SelectFpr(alpha=0.3).fit(df, COLS, "c").support_ == (p < 0.3)).all()
    assert (feature_selection.SelectFwe(alpha=0.3).fit(df, COLS, "c").support_ == (p < 0.1)).all()
    ranked = np.sort(p)
    last = max((v for k, v in enumerate(ranked) if v <= 0.3 * (k + 1) / 3), default=-1)
    assert (feature_selection.SelectFdr(alpha=0.3).fit(df, COLS, "c").support_ == (p <= last)).all()
    cv = model_selection.KFold(3)
    assert feature_selection.RFECV(linear.Ridge(), r2, cv).fit(df, COLS, "y", "id").support_[:2].all()
    for way in ("forward", "backward"):
        found = feature_selection.SequentialFeatureSelector(linear.Ridge(), r2, cv, 2, direction=way).fit(df, COLS, "y", "id")
        assert found.support_.tolist() == [True, True, False]
    info = feature_selection.mutual_info_regression(df, COLS, "y", "id")
    assert info[0] > info[1] > info[2] >= 0


def test_left_out_rows_and_groups(data):
    df, pdf = data
    few = df.where("id < 12")
    parts = [(ids(a), ids(b)) for a, b in model_selection.LeavePOut(2).split(few, "id")]
    assert [b for _, b in parts] == [set(x) for x in itertools.combinations((0, 3, 6, 9), 2)] and all(a == {0, 3, 6, 9} - b for a, b in parts)
    assert model_selection.LeaveOneGroupOut().get_n_splits(df, "g") == 9 and model_selection.LeavePGroupsOut(2).get_n_splits(df, "g") == 36
    a, b = next(model_selection.LeavePGroupsOut(2).split(df, "id", None, "g"))
    assert ids(b) == set(pdf.id[pdf.g < 2]) and ids(a) == set(pdf.id[pdf.g >= 2])
    own = df.withColumn("fold", F.when(F.col("g") < 3, -1).otherwise(F.col("g") % 2))
    assert model_selection.PredefinedSplit().get_n_splits(own) == 2
    assert [ids(b) for _, b in model_selection.PredefinedSplit().split(own, "id")] == [set(pdf.id[(pdf.g >= 3) & (pdf.g % 2 == k)]) for k in (0, 1)]


def test_shuffled_splits(data):
    df, pdf = data
    order, rng = np.sort(pdf.id), np.random.RandomState(2)
    for a, b in model_selection.ShuffleSplit(2, 0.2, None, 2).split(df, "id"):
        place = rng.permutation(90)
        assert ids(b) == set(order[place[:18]]) and ids(a) == set(order[place[18:]])
    a, b = model_selection.train_test_split(df, "id", 0.2, None, 1, True, "c")
    assert abs(b.where("c = 1").count() - 0.2 * pdf.c.sum()) <= 1 and ids(a) | ids(b) == set(pdf.id) and not ids(a) & ids(b)
    a, b = next(model_selection.GroupShuffleSplit(1, 3, None, 0).split(df, "id", None, "g"))
    assert b.select("g").distinct().count() == 3 and a.select("g").distinct().count() == 6 and a.count() + b.count() == 90
    repeated = [ids(b) for _, b in model_selection.RepeatedKFold(2, 2, 0).split(df, "id")]
    assert len(repeated) == 4 and repeated[0] | repeated[1] == repeated[2] | repeated[3] == set(pdf.id) and repeated[0] not in repeated[2:]
    folds = model_selection.StratifiedGroupKFold(3).folds(df, "id", "c", "g").toPandas().merge(pdf[["id", "g", "c"]], on="id")
    assert (folds.groupby("g").fold.nunique() == 1).all() and folds.fold.value_counts().tolist() == [30, 30, 30]


def test_searches_and_curves(data):
    df, _ = data
    grid = {"alpha": [0.01, 10.0, 1e3, 1e5]}
    half = model_selection.HalvingGridSearchCV(linear.Ridge(), grid, r2, 2, factor=2, min_resources=30).fit(df, COLS, "y", "id")
    assert half.best_params_ == {"alpha": 0.01} and [len(r["params"]) for _, r in half.history_] == [4, 2]
    drawn = model_selection.RandomizedSearchCV(linear.Ridge(), grid, r2, 2, n_iter=3).fit(df, COLS, "y", "id")
    assert len({p["alpha"] for p in drawn.cv_results_["params"]}) == 3
    rows, train, test = model_selection.learning_curve(linear.Ridge(), df, COLS, "y", "id", r2, (0.5, 1.0), 2)
    assert rows.tolist() == [22, 45] and train.shape == test.shape == (2, 2) and test.min() > 0.9
    train, test = model_selection.validation_curve(linear.Ridge(), df, COLS, "y", "id", r2, "alpha", [0.01, 1e5], 2)
    assert (test[0] > test[1]).all() and train.shape == (2, 2)
    own, scores, p = model_selection.permutation_test_score(linear.Ridge(), df, COLS, "y", "id", r2, 2, 3)
    assert own > 0.9 and scores.max() < 0.5 and p == 0.25


def test_classifiers_on_top(data):
    df, _ = data
    stack = ensemble.StackingClassifier([("a", linear.LogisticRegression(max_iter=15)), ("b", linear.RidgeClassifier())], linear.RidgeClassifier(), 2).fit(df, COLS, "c", "id")
    assert stack.predict(df).where("prediction = c").count() > 75
    boosted = trees.HistGradientBoostingClassifier(6, 0.3, 3, min_samples_leaf=5).fit(df, COLS, "c")
    p = boosted.predict_proba(df).toPandas()
    assert boosted.predict(df).where("prediction = c").count() > 78 and np.allclose(p.p0 + p.p1, 1)


def test_shuffle_split_has_no_bound_on_its_rows(data, monkeypatch):
    """The sides are those of NumPy's permutation, beyond the bound of other shuffles as well."""
    df, pdf = data
    monkeypatch.setattr(model_selection, "MOST_SHUFFLED", 10)
    ids, n = np.sort(pdf.id.to_numpy()), len(pdf)
    rng = np.random.RandomState(5)
    for a, b in model_selection.ShuffleSplit(2, 0.25, None, 5).split(df, "id"):
        order = rng.permutation(n)
        test = -(-n // 4)
        assert sorted(r.id for r in b.collect()) == sorted(ids[order[:test]]) and sorted(r.id for r in a.collect()) == sorted(ids[order[test:]])
        assert a.columns == df.columns


def test_mutual_info_has_no_bound_on_its_rows(spark):
    """21,000 rows in few distinct classes; the sorted search gives the distances of all pairs, ties included."""
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=300), 1)
    for k in (1, 3, 7):
        assert np.array_equal(feature_selection.nearest_in_line(x, k), np.partition(np.abs(x[:, None] - x), k, axis=1)[:, k])
    r = np.nextafter(feature_selection.nearest_in_line(x + rng.normal(size=300), 3), 0)
    assert np.array_equal(feature_selection.inside(x, r), (np.abs(x[:, None] - x) <= r[:, None]).sum(1))
    n = 21_000
    y = np.arange(n) % 2
    pdf = pd.DataFrame({"id": np.arange(n), "y": y, "a": rng.normal(size=n) + 3 * y, "b": rng.normal(size=n)})
    got = feature_selection.mutual_info_classif(spark.createDataFrame(pdf), ["a", "b"], "y", "id")
    t = np.linspace(-9, 12, 20_001)
    f, g = np.exp(-(t**2) / 2), np.exp(-((t - 3) ** 2) / 2)
    h = (f + g) / 2
    want = ((f * np.log(f / h) + g * np.log(g / h)) / 2).sum() / f.sum()
    assert abs(got[0] - want) < 0.02 and got[1] < 0.01
    small = pdf.head(400).assign(c=lambda d: d.a * 2 + rng.normal(size=400))
    assert feature_selection.mutual_info_regression(spark.createDataFrame(small), ["a", "b"], "c", "id")[0] > 1
