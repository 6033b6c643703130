"""Options of estimators and searches against direct NumPy computation."""

import math
import warnings

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fathomic.operators import cluster, linear, metrics, mixture, model_selection, neighbors, trees

COLS = ["x0", "x1", "x2"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(80, 3)) * [1, 2, 0.5] + 1
    y = x @ [1.0, -0.5, 2.0] + 0.3 * rng.normal(size=80)
    z = x @ [0.2, 1.5, 0.0] + 2 * rng.normal(size=80)
    c = (y > np.median(y)).astype(int)
    pdf = pd.DataFrame(x, columns=COLS).assign(y=y, z=z, c=c, w=rng.integers(1, 4, 80).astype(float), id=np.arange(80))
    return spark.createDataFrame(pdf).coalesce(2).cache(), pdf


def left_out(x, y, alpha):
    """Residuals of ridge models that did not see the row."""
    out = []
    for i in range(len(x)):
        a, t = np.delete(x, i, 0), np.delete(y, i)
        m, k = a.mean(0), t.mean()
        w = np.linalg.solve((a - m).T @ (a - m) + alpha * np.eye(3), (a - m).T @ (t - k))
        out.append(y[i] - k - (x[i] - m) @ w)
    return np.array(out)


def test_ridge_cv_leaving_one_out(data):
    df, pdf = data
    x, alphas = pdf[COLS].to_numpy(), [0.1, 5.0, 80.0]
    errors = {t: np.array([left_out(x, pdf[t].to_numpy(), a) ** 2 for a in alphas]) for t in ("y", "z")}
    own = linear.RidgeCV(alphas, alpha_per_target=True).fit(df, COLS, ["y", "z"])
    assert np.allclose(own.alpha_, [alphas[errors[t].mean(1).argmin()] for t in ("y", "z")]) and own.coef_.shape == (2, 3)
    both = linear.RidgeCV(alphas).fit(df, COLS, ["y", "z"])
    assert both.alpha_ == alphas[(errors["y"].mean(1) + errors["z"].mean(1)).argmin()]
    kept = linear.RidgeCV(alphas, store_cv_results=True).fit(df, COLS, "y")
    got = kept.cv_results(df).orderBy("id").toPandas()["cv_results"].tolist()
    assert np.allclose(np.array(got).T, errors["y"])
    judged = linear.RidgeCV(alphas, scoring=lambda d, t, p: -metrics.mean_absolute_error(d, t, p).first()[0]).fit(df, COLS, "z")
    assert judged.alpha_ == alphas[np.sqrt(errors["z"]).mean(1).argmin()]
    assert math.isclose(judged.best_score_, -np.sqrt(errors["z"]).mean(1).min())


def test_ridge_cv_by_folds(data):
    df, _ = data
    alphas = [0.1, 5.0, 80.0, 1e4]
    fast = linear.RidgeCV(alphas, cv=4).fit(df, COLS, "z", id_col="id")
    search = model_selection.GridSearchCV(linear.Ridge(), {"alpha": alphas}, "r2", 4).fit(df, COLS, "z", "id")
    assert fast.alpha_ == search.best_params_["alpha"] and math.isclose(fast.best_score_, search.best_score_)
    assert np.allclose(fast.coef_, search.best_estimator_.coef_)
    for bad in (dict(cv=4, alpha_per_target=True), dict(alphas=[0.0])):
        with pytest.raises(ValueError):
            linear.RidgeCV(**bad).fit(df, COLS, "z", id_col="id")


def test_ridge_classifier_with_positive_weights(data):
    df, _ = data
    m = linear.RidgeClassifier(positive=True).fit(df, ["x0", "x1", "x2"], "c")
    assert (m.coef_ >= 0).all() and m.coef_[0, 1] == 0
    with pytest.raises(ValueError):
        linear.RidgeClassifier(solver="none").fit(df, COLS, "c")


def test_huber_goes_on_from_its_solution(data):
    df, _ = data
    first = linear.HuberRegressor(warm_start=True).fit(df, COLS, "z")
    again = first.fit(df, COLS, "z")
    assert again.n_iter_ < first.n_iter_ and np.allclose(first.coef_, again.coef_, atol=1e-4)


@pytest.fixture(scope="module")
def spoiled(spark, data):
    _, pdf = data
    return spark.createDataFrame(pdf.assign(y=np.where(pdf.id % 8 == 3, 50.0, pdf.y))).coalesce(2).cache()


def test_ransac_over_another_estimator(spoiled):
    clean = linear.Ridge(0.01).fit(spoiled.where("id % 8 <> 3"), COLS, "y")
    m = linear.RANSACRegressor(linear.Ridge(0.01), 8, 1.5, batch=4).fit(spoiled, COLS, "y", "id")
    assert isinstance(m.estimator_, linear.Ridge) and m.n_inliers_ == 70
    assert m.inliers(spoiled, "y").where("inlier and y = 50").count() == 0
    assert np.allclose(m.coef_, clean.coef_) and m.predict(spoiled).count() == 80
    with pytest.raises(ValueError):
        linear.RANSACRegressor(linear.Ridge()).fit(spoiled, COLS, "y", "id")


def test_ransac_stops_and_skips(spoiled):
    early = linear.RANSACRegressor(residual_threshold=1.5, stop_n_inliers=2).fit(spoiled, COLS, "y", "id")
    assert early.n_trials_ == 1
    share = linear.RANSACRegressor(min_samples=0.1, residual_threshold=1.5, loss=lambda y, p: F.abs(y - p) * 2).fit(spoiled, COLS, "y", "id")
    assert share.n_inliers_ <= 70
    seen = []
    strict = linear.RANSACRegressor(residual_threshold=1.5, is_data_valid=lambda x, y: y.max() < 40, is_model_valid=lambda m, x, y: seen.append(y.max()) or True).fit(spoiled, COLS, "y", "id")
    assert max(seen) < 40 and strict.n_inliers_ == 70
    with pytest.raises(ValueError):
        linear.RANSACRegressor(residual_threshold=1.5, is_data_valid=lambda x, y: False, max_skips=5).fit(spoiled, COLS, "y", "id")


def test_neighbour_votes(spark):
    rows = [(0, [0.0], "b", 1), (1, [1.0], "a", 2), (2, [2.0], "b", 2), (3, [5.0], "c", None)]
    df = spark.createDataFrame(rows, "id long, v array<double>, s string, n int")
    asked = spark.createDataFrame([(9, [0.4])], "id long, v array<double>")
    one = neighbors.KNeighborsClassifier(3).fit(df, "id", "v", "s")
    assert one.predict(asked, "id", "v").collect()[0] == (9, "b")
    assert {r.label: round(r.probability, 6) for r in one.predict_proba(asked, "id", "v").collect()} == {"a": 0.333333, "b": 0.666667}
    near = neighbors.KNeighborsClassifier(3, weights=lambda d: F.exp(-3 * d)).fit(df, "id", "v", ["s", "n"])
    assert near.predict(asked, "id", "v").collect()[0].asDict() == {"query": 9, "prediction_s": "b", "prediction_n": 1}
    both = near.predict_proba(asked, "id", "v").collect()
    w = np.exp([-1.2, -1.8, -4.8])
    assert {(r.output, r.label): round(r.probability, 6) for r in both} == {
        ("s", "b"): round((w[0] + w[2]) / w.sum(), 6), ("s", "a"): round(w[1] / w.sum(), 6), ("n", "1"): round(w[0] / w.sum(), 6), ("n", "2"): round((w[1] + w[2]) / w.sum(), 6)}
    none = neighbors.KNeighborsClassifier(4, weights=lambda d: d * 0).fit(df, "id", "v", "s")
    assert none.predict(asked, "id", "v").collect()[0] == (9, "a")
    assert neighbors.KNeighborsRegressor(2, weights=lambda d: 1 + d * 0).fit(df, "id", "v", "n").predict(asked, "id", "v").first()[1] == 1.5


def test_seeds_of_few_distinct_rows(spark):
    df = spark.range(3000).select((F.col("id") % 3 * 10.0).alias("a"), F.lit(1.0).alias("b"))
    m = cluster.KMeans(3, algorithm="elkan").fit(df, ["a", "b"])
    assert sorted(m.cluster_centers_[:, 0]) == [0, 10, 20] and m.inertia_ == 0
    assert cluster.KMeans(4).fit(df, ["a", "b"]).inertia_ == 0
    far = df.union(spark.createDataFrame([(1e6, 1.0)], "a double, b double"))
    assert 1e6 in cluster.KMeans(4).fit(far, ["a", "b"]).cluster_centers_[:, 0]
    with pytest.raises(ValueError):
        cluster.KMeans(2, algorithm="full").fit(df, ["a", "b"])


def test_left_out_scores_of_forests(data):
    df, pdf = data
    m = trees.RandomForestRegressor(12, 4, oob_score=True).fit(df, COLS, "y")
    x = pdf[[*COLS, "y"]].to_numpy()
    out = np.array([m._weights(x, t) == 0 for t in range(12)])
    p = np.array([t.predict(x[:, :3]) for t in m.trees_])
    has = out.any(0)
    mean = (p * out).sum(0)[has] / out.sum(0)[has]
    y = pdf.y.to_numpy()[has]
    assert math.isclose(m.oob_score_, 1 - ((y - mean) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert 0.7 < trees.RandomForestClassifier(12, 4, oob_score=True).fit(df, COLS, "c").oob_score_ <= 1
    with pytest.raises(ValueError):
        trees.RandomForestRegressor(2, 2, bootstrap=False, oob_score=True).fit(df, COLS, "y")


def test_mixtures_go_on(data):
    df, _ = data
    first = mixture.GaussianMixture(2, max_iter=3, tol=0.0, warm_start=True).fit(df, COLS)
    again = first.fit(df, COLS)
    assert again.lower_bound_ > first.lower_bound_
    assert math.isclose(again.lower_bound_, mixture.GaussianMixture(2, max_iter=6, tol=0.0).fit(df, COLS).lower_bound_, rel_tol=1e-9)


def test_several_scorers(data):
    df, pdf = data
    got = model_selection.cross_validate(linear.Ridge(), df, COLS, "y", "id", ["r2", "neg_mean_squared_error"], 3, train_score=True, n_jobs=3)
    one = model_selection.cross_val_score(linear.Ridge(), df, COLS, "y", "id", "r2", 3)
    assert np.allclose(got["test_r2"], one) and (got["test_neg_mean_squared_error"] < 0).all() and (got["fit_time"] > 0).all() and len(got["train_r2"]) == 3
    grid = {"alpha": [0.1, 1e4]}
    search = model_selection.GridSearchCV(linear.Ridge(), grid, {"a": "r2", "b": "neg_mean_absolute_error"}, 2, refit="b", return_train_score=True).fit(df, COLS, "y", "id")
    assert search.best_params_ == {"alpha": 0.1} and {"mean_test_a", "rank_test_b", "split1_test_a", "mean_train_b", "std_fit_time"} <= set(search.cv_results_)
    assert model_selection.GridSearchCV(linear.Ridge(), grid, ["r2"], 2, refit=lambda res: 1).fit(df, COLS, "y", "id").best_params_ == {"alpha": 1e4}
    assert not hasattr(model_selection.GridSearchCV(linear.Ridge(), grid, "r2", 2, refit=False).fit(df, COLS, "y", "id"), "best_estimator_")
    with pytest.raises(ValueError):
        model_selection.GridSearchCV(linear.Ridge(), grid, ["r2", "accuracy"], 2).fit(df, COLS, "y", "id")
    model = linear.LogisticRegression(max_iter=20).fit(df, COLS, "c")
    p = model.predict_proba(df).orderBy("id").toPandas()["probability"].str[1].to_numpy()
    assert math.isclose(model_selection.SCORERS["neg_log_loss"](model, df, "c"), np.log(np.where(pdf.c == 1, p, 1 - p)).mean(), rel_tol=1e-9)
    assert model_selection.SCORERS["roc_auc"](model, df, "c") > 0.9 and model_selection.SCORERS["f1_macro"](model, df, "c") > 0.8
    assert set(model_selection.check_scoring("accuracy")) == {"score"}
    with pytest.raises(ValueError):
        model_selection.check_scoring("nothing")


def test_failing_fits(data):
    df, _ = data
    grid = {"solver": ["auto", "none"]}
    with warnings.catch_warnings(record=True) as told:
        warnings.simplefilter("always")
        found = model_selection.GridSearchCV(linear.Ridge(), grid, "r2", 2, error_score=-9.0).fit(df, COLS, "y", "id")
    assert found.cv_results_["mean_test_score"][1] == -9 and found.best_params_ == {"solver": "auto"} and any("fit failed" in str(w.message) for w in told)
    with pytest.raises(ValueError):
        model_selection.GridSearchCV(linear.Ridge(), grid, "r2", 2, error_score="raise").fit(df, COLS, "y", "id")
