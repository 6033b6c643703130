"""Estimators against closed forms and direct NumPy computation."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fathomic.functions import solve, special
from fathomic.operators import cluster, decomposition, density, ensemble, feature_selection, linear, manifold, metrics, mixture, model_selection, naive_bayes, neighbors, preprocessing, timeseries, trees
from fathomic.plans import stats
from fathomic.sources import frame, model_files
from fathomic.streaming import incremental

COLS = ["x0", "x1", "x2"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 3)) + 1
    y = x @ [1.5, -2.0, 0.0] + 3 + 0.1 * rng.normal(size=120)
    c = (x[:, 0] > 1).astype(int) + (x[:, 1] > 1.5)
    pdf = pd.DataFrame(x, columns=COLS).assign(y=y, c=c, b=(c > 0).astype(int), id=np.arange(120), g=np.arange(120) % 7)
    return spark.createDataFrame(pdf).coalesce(2).cache(), pdf


def test_special_functions():
    assert math.isclose(float(special.digamma(1.0)), -0.5772156649015329, rel_tol=1e-10)
    assert math.isclose(special.chi2_sf(5.0, 3), 0.17179714429673, rel_tol=1e-9)
    assert math.isclose(special.f_sf(3.5, 2, 20), 0.04973502207611, rel_tol=1e-9)
    assert math.isclose(special.norm_ppf(0.75), 0.6744897501960817, rel_tol=1e-12)


def test_constant_column_scales_to_zero(spark):
    df = spark.createDataFrame(pd.DataFrame({"x": [2.0, 2.0, 2.0], "y": [1.0, 2.0, 4.0]}))
    got = preprocessing.StandardScaler().fit(df, ["x", "y"]).transform(df).toPandas()
    assert (got.x == 0).all() and math.isclose(got.y.std(ddof=0), 1)
    assert (preprocessing.MinMaxScaler(1.0, 2.0).fit(df, ["x"]).transform(df).toPandas().x == 1).all()
    back = preprocessing.RobustScaler().fit(df, ["y"])
    assert np.allclose(back.inverse_transform(back.transform(df)).toPandas().y, [1, 2, 4])


def test_bad_values_are_refused(spark):
    df = spark.createDataFrame(pd.DataFrame({"x": [1.0, float("nan")]}))
    with pytest.raises(ValueError):
        preprocessing.StandardScaler().fit(df, ["x"])
    with pytest.raises(ValueError):
        linear.LinearRegression().expression() if hasattr(linear.LinearRegression(), "cols") else preprocessing.StandardScaler().transform(df)


def test_linear_models(data):
    df, pdf = data
    x, y = pdf[COLS].to_numpy(), pdf["y"].to_numpy()
    m = linear.LinearRegression().fit(df, COLS, "y")
    want = np.linalg.lstsq(np.c_[x, np.ones(len(x))], y, rcond=None)[0]
    assert np.allclose([*m.coef_, m.intercept_], want, atol=1e-8)
    xc, yc = x - x.mean(0), y - y.mean()
    assert np.allclose(linear.Ridge(5.0).fit(df, COLS, "y").coef_, np.linalg.solve(xc.T @ xc + 5 * np.eye(3), xc.T @ yc))
    cv, errors = linear.RidgeCV((0.1, 10.0)).fit(df, COLS, "y"), []
    for a in (0.1, 10.0):
        e = []
        for i in range(len(x)):
            k = np.arange(len(x)) != i
            z, t = x[k] - x[k].mean(0), y[k] - y[k].mean()
            w = np.linalg.solve(z.T @ z + a * np.eye(3), z.T @ t)
            e.append((y[i] - y[k].mean() - (x[i] - x[k].mean(0)) @ w) ** 2)
        errors.append(np.mean(e))
    assert np.allclose(cv.cv_errors_, errors)
    lasso = linear.Lasso(0.3).fit(df, COLS, "y")
    grad = xc.T @ (yc - xc @ lasso.coef_) / len(x)
    assert lasso.coef_[2] == 0 and np.allclose(np.abs(grad[lasso.coef_ != 0]), 0.3, atol=1e-6)
    assert (linear.Ridge(positive=True).fit(df, COLS, "y").coef_ >= 0).all()
    logistic = linear.LogisticRegression(max_iter=60).fit(df, COLS, "b")
    p = logistic.predict_proba(df).select(F.sum(F.col("probability")[1]), F.sum("b")).first()
    assert math.isclose(p[0], p[1], rel_tol=1e-3)  # free intercept: sums agree


def test_decompositions(data):
    df, pdf = data
    x = pdf[COLS].to_numpy()
    s = np.linalg.svd(x - x.mean(0), compute_uv=False)
    m = decomposition.PCA(2).fit(df, COLS)
    assert np.allclose(m.explained_variance_, s[:2] ** 2 / (len(x) - 1))
    whole = decomposition.PCA(3).fit(df, COLS)
    back = whole.inverse_transform(whole.transform(df)).toPandas()
    assert np.allclose(back[[f"inv_{c}" for c in COLS]], back[COLS])
    assert np.allclose(decomposition.TruncatedSVD(2).fit(df, COLS).singular_values_, np.linalg.svd(x, compute_uv=False)[:2])
    assert np.allclose(decomposition.IncrementalPCA(3).fit(df, COLS, "id").singular_values_, s)
    assert np.allclose(decomposition.EmpiricalCovariance().fit(df, COLS).covariance_, np.cov(x.T, bias=True))
    assert 0 <= decomposition.LedoitWolf().fit(df, COLS).shrinkage_ <= 1


def test_neighbours_and_density(spark, data):
    df, pdf = data
    x = pdf[COLS].to_numpy()
    v = df.select("id", "y", "c", F.array(*COLS).alias("v"))
    for metric in ("euclidean", "manhattan", "chebyshev", "cosine"):
        d = neighbors.pair_distances(x, x, metric, 2)
        got = neighbors.NearestNeighbors(3, metric=metric, block_rows=50).fit(v, "id", "v").kneighbors().toPandas()
        for i in range(0, 120, 17):
            e = d[i].copy()
            e[i] = np.inf
            assert got[got["query"] == i].sort_values("rank").neighbor.tolist() == np.lexsort((np.arange(120), e))[:3].tolist()
    d = neighbors.pair_distances(x, x, "euclidean", 2)
    assert neighbors.NearestNeighbors(radius=0.8).fit(v, "id", "v").radius_neighbors().count() == (d <= 0.8).sum() - 120
    kde = density.KernelDensity(0.7).fit(v, "id", "v").score_samples(v, "id", "v").toPandas().sort_values("query").log_density
    assert np.allclose(kde, np.log(np.exp(-0.5 * (d / 0.7) ** 2).mean(1)) - 1.5 * math.log(2 * math.pi) - 3 * math.log(0.7))
    k = np.exp(-0.5 * d**2)
    dual = np.linalg.solve(k + np.eye(120), pdf["y"])
    assert np.allclose(density.KernelRidge(1.0, "rbf", 0.5).fit(df, COLS, "y", "id").predict(df).toPandas().sort_values("id").prediction, k @ dual)


def test_clusters(spark):
    rng = np.random.default_rng(0)
    x = np.r_[rng.normal(0, 0.2, (30, 2)), rng.normal(3, 0.2, (30, 2)), [[9.0, -9.0]]]
    df = spark.createDataFrame(pd.DataFrame({"id": range(61), "x0": x[:, 0], "x1": x[:, 1], "v": x.tolist()})).coalesce(1)
    truth = [0] * 30 + [1] * 30 + [-1]
    got = cluster.DBSCAN(0.6, 4).fit_predict(df, "id", "v").toPandas().sort_values("id").label.tolist()
    assert got == truth
    h = cluster.HDBSCAN(5).fit(df, ["x0", "x1"], "id")
    assert len(set(h.labels_[:30])) == len(set(h.labels_[30:60])) == 1 and h.labels_[-1] == -1
    a = cluster.AgglomerativeClustering(3).fit(df, ["x0", "x1"], "id")
    assert sorted(np.bincount(a.labels_)) == [1, 30, 30]
    m = cluster.KMeans(2, x[[0, 40]]).fit(df.where("id < 60"), ["x0", "x1"])
    assert np.allclose(m.cluster_centers_, [x[:30].mean(0), x[30:60].mean(0)])
    g = mixture.GaussianMixture(2, means_init=x[[0, 40]]).fit(df.where("id < 60"), ["x0", "x1"])
    assert np.allclose(g.means_, [x[:30].mean(0), x[30:60].mean(0)], atol=1e-6) and math.isclose(g.weights_.sum(), 1, abs_tol=1e-9)
    s = manifold.SpectralClustering(n_clusters=2).fit_predict(df.where("id < 60"), ["x0", "x1"], "id").toPandas().sort_values("id").cluster
    assert s[:30].nunique() == s[30:].nunique() == 1


def test_dbscan_follows_a_chain_of_shuffled_ids(spark):
    ids = np.random.default_rng(4).permutation(400)
    rows = [(int(i), [float(k)]) for k, i in enumerate(ids)] + [(1000, [-50.0])]
    got = cluster.DBSCAN(3.5, 4).fit_predict(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v").toPandas()
    assert set(got[got.id < 400].label) == {0} and got[got.id == 1000].label.tolist() == [-1]


def test_trees_and_shap(data):
    df, pdf = data
    m = trees.HistGradientBoostingRegressor(10, max_depth=3, min_samples_leaf=5).fit(df, COLS, "y")
    p = m.predict(df).toPandas()
    assert ((p.y - p.prediction) ** 2).sum() < 0.3 * ((p.y - p.y.mean()) ** 2).sum()
    s = m.shap_values(df).toPandas()
    assert np.allclose(s[[f"shap_{c}" for c in COLS]].sum(1) + m.expected_value(), p.prediction)
    tree, x = m.trees_[0], pdf[COLS].to_numpy()[5]

    def value(known, node=0):
        f = tree.feature[node]
        if f < 0:
            return tree.value[node]
        if f in known:
            return value(known, tree.left[node] if x[f] <= tree.threshold[node] else tree.right[node])
        return sum(tree.cover[k] / tree.cover[node] * value(known, k) for k in (tree.left[node], tree.right[node]))

    want = np.zeros(3)
    for order in itertools.permutations(range(3)):
        seen = set()
        for f in order:
            want[f] += (value(seen | {f}) - value(seen)) / 6
            seen = seen | {f}
    assert np.allclose(trees.tree_shap(tree, x[None], 3, None)[0], want)
    forest = trees.RandomForestClassifier(5, 5).fit(df, COLS, "c")
    assert forest.predict(df).where("prediction = c").count() > 100


def test_metrics_edge_cases(spark):
    df = spark.createDataFrame([(0, 0, 0.1), (0, 0, 0.5), (1, 0, 0.5), (1, 0, 0.9)], "y int, p int, s double")
    assert metrics.precision_recall_f1(df, "y", "p", "binary", zero_division=1.0).first().precision == 1.0
    assert metrics.roc_auc_score(df, "y", "s") == 0.875
    with pytest.raises(ValueError):
        metrics.roc_auc_score(df.where("y = 1"), "y", "s")
    flat = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "y double, p double")
    assert metrics.r2_score(flat, "y", "p") == 1.0
    assert metrics.r2_score(flat.withColumn("p", F.lit(2.0)), "y", "p") == 0.0


def test_feature_selection(data):
    df, pdf = data
    f, p = feature_selection.f_classif(df, COLS, "b")
    groups = [pdf[pdf.b == k][COLS].to_numpy() for k in (0, 1)]
    n, mean = 120, pdf[COLS].to_numpy().mean(0)
    between = sum(len(g) * (g.mean(0) - mean) ** 2 for g in groups)
    within = sum(((g - g.mean(0)) ** 2).sum(0) for g in groups)
    assert np.allclose(f, between / (within / (n - 2))) and ((p >= 0) & (p <= 1)).all()
    assert feature_selection.k_best(np.array([1.0, 1.0, 1.0]), 1).tolist() == [False, False, True]
    assert feature_selection.top_percentile(np.array([1.0, 1.0, 1.0, 0.0]), 50).sum() == 2
    assert feature_selection.RFE(linear.Ridge(), 2).fit(df, COLS, "y").get_feature_names_out() == ["x0", "x1"]
    kept = feature_selection.SelectFromModel(linear.Ridge()).fit(df, COLS, "y")
    assert kept.inverse_transform(kept.transform(df)).columns == COLS


def test_splits(data):
    df, pdf = data
    fold = model_selection.KFold(7).folds(df, "id").toPandas().sort_values("id").fold.tolist()
    assert fold == [k for k in range(7) for _ in range(18 if k == 0 else 17)]
    order = np.arange(120)
    np.random.RandomState(4).shuffle(order)
    got = model_selection.KFold(4, True, 4).folds(df, "id").toPandas()
    assert set(got[got.fold == 0]["id"]) == set(order[:30])
    for shuffle in (False, True):
        strata = model_selection.StratifiedKFold(4, shuffle, 4 if shuffle else None).folds(df, "id", "c").toPandas().merge(pdf[["id", "c"]], on="id")
        spread = strata.groupby(["c", "fold"]).size().unstack(fill_value=0)
        assert len(strata) == len(pdf) and (spread.max(1) - spread.min(1) <= 1).all()
    groups = model_selection.GroupKFold(3).folds(df, "id", None, "g").toPandas().merge(pdf[["id", "g"]], on="id")
    assert (groups.groupby("g").fold.nunique() == 1).all()
    assert [(a.count(), b.count()) for a, b in model_selection.TimeSeriesSplit(3, gap=2).split(df, "id")] == [(28, 30), (58, 30), (88, 30)]
    assert list(model_selection.ParameterGrid({"b": [1, 2], "a": [3]})) == [{"a": 3, "b": 1}, {"a": 3, "b": 2}]
    assert model_selection.rank_scores(np.array([0.5, np.nan, 0.9, 0.5])).tolist() == [2, 4, 1, 2]


def test_composition(data):
    df, _ = data
    r2 = lambda m, d, y: metrics.r2_score(m.predict(d), y, "prediction")
    search = model_selection.GridSearchCV(linear.Ridge(), {"alpha": [0.1, 1e5]}, r2, 2).fit(df, COLS, "y", "id")
    assert search.best_params_ == {"alpha": 0.1}
    stack = ensemble.StackingRegressor([("a", linear.Ridge()), ("b", linear.LinearRegression())], linear.Ridge(), 2).fit(df, COLS, "y", "id")
    assert r2(stack, df, "y") > 0.9
    vote = ensemble.VotingClassifier([("a", linear.RidgeClassifier()), ("b", naive_bayes.GaussianNB())]).fit(df, COLS, "b")
    assert vote.predict(df).where("prediction = b").count() > 90


def test_series():
    rng = np.random.default_rng(1)
    y = np.zeros(300)
    for k in range(1, 300):
        y[k] = 0.6 * y[k - 1] + rng.normal()
    m = timeseries.ARIMA((1, 0, 0)).fit_series(y)
    direct = -0.5 * (np.log(2 * np.pi * m.sigma2_) * 300 - np.log(1 - m.ar_[0] ** 2) + ((1 - m.ar_[0] ** 2) * y[0] ** 2 + ((y[1:] - m.ar_[0] * y[:-1]) ** 2).sum()) / m.sigma2_)
    assert math.isclose(m.llf_, direct, rel_tol=1e-8)
    assert all(timeseries.log_likelihood(y, [m.ar_[0] + e], []) <= m.llf_ for e in (-0.02, 0.02))  # the maximum
    assert np.allclose(m.forecast(2), [m.ar_[0] * y[-1], m.ar_[0] ** 2 * y[-1]])


def test_gram_through_arrow(data):
    df, pdf = data
    wide = df.select(*[(F.col("x0") * k + F.col("x1")).alias(f"w{k}") for k in range(20)])
    x = np.c_[np.ones(120), np.column_stack([pdf.x0 * k + pdf.x1 for k in range(20)])]
    assert np.allclose(stats.gram(wide, wide.columns), x.T @ x)


def test_model_files_and_frames(data, tmp_path):
    df, _ = data
    model = linear.Ridge(2.0).fit(df, COLS, "y")
    model_files.save(model, str(tmp_path / "m"))
    again = model_files.load(str(tmp_path / "m"))
    assert np.allclose(again.coef_, model.coef_) and again.cols == COLS
    forest = trees.RandomForestRegressor(2, 3).fit(df, COLS, "y")
    model_files.save(forest, str(tmp_path / "f"))
    assert model_files.load(str(tmp_path / "f")).predict(df).count() == 120
    kept = frame.take_columns(df, COLS, [True, False, True], ["id"])
    assert frame.restore_columns(kept, COLS, [True, False, True]).columns == COLS
    assert frame.drop_rows(df, df.where("id < 20")).count() == 100


def test_stream(spark, data, tmp_path):
    df, _ = data
    df.select(*COLS).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.select(*COLS).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query, state = incremental.partial_fit_stream(stream, decomposition.IncrementalPCA(3), COLS, str(tmp_path / "check"))
    query.awaitTermination(120)
    assert state["model"].n_samples_seen_ == 120
    assert np.allclose(state["model"].singular_values_, decomposition.PCA(3).fit(df, COLS).singular_values_)


def test_solvers():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(30, 4))
    w, _ = solve.lbfgs(lambda v: (float(((a @ v - 1) ** 2).sum()), 2 * a.T @ (a @ v - 1)), np.zeros(4))
    assert np.allclose(w, np.linalg.lstsq(a, np.ones(30), rcond=None)[0], atol=1e-6)


def test_exact_quantiles_of_odd_columns(spark):
    from fathomic.plans.stats import exact_quantiles

    rng = np.random.default_rng(5)
    x = np.column_stack([rng.normal(size=1001), np.repeat([1.0, 2.0, 7.0], [900, 100, 1]), np.full(1001, 3.5), np.exp(rng.normal(size=1001) * 40), rng.choice([-1.7e308, 1.7e308, 0.0], 1001)])
    cols = [f"c{k}" for k in range(5)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=cols))
    shares = [0.0, 0.25, 0.5, 0.333, 0.9, 1.0]
    got = exact_quantiles(df, cols[:4], shares)
    assert np.allclose(got, np.quantile(x[:, :4], shares, axis=0).T, rtol=1e-12)
    assert np.allclose(exact_quantiles(df, cols[4:], [0.0, 1.0]), [[-1.7e308, 1.7e308]])
    with pytest.raises(ValueError):
        exact_quantiles(df.withColumn("c0", F.lit(None).cast("double")), ["c0"], [0.5])
