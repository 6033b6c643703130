"""Layouts and mixtures of two far groups, and the choice of an ARIMA order."""

import numpy as np
import pandas as pd
import pytest

from fathomic.functions import layout
from fathomic.operators import cluster, density, manifold, mixture, neighbors, timeseries

COLS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame(rng.normal(size=(60, 3)) + np.where(np.arange(60) < 30, 0, 9)[:, None], columns=COLS).assign(id=np.arange(60))
    return spark.createDataFrame(pdf).coalesce(2).cache(), pdf


def told_apart(frame, names):
    """Every row's nearest other row lies in its own group, and the groups' centers are further apart than their spread."""
    x = frame.toPandas().sort_values("id")[names].to_numpy()
    d = np.linalg.norm(x[:, None] - x[None], axis=2) + np.diag([np.inf] * 60)
    own = (d.argmin(1) < 30) == (np.arange(60) < 30)
    apart = np.linalg.norm(x[:30].mean(0) - x[30:].mean(0)) > max(x[:30].std(), x[30:].std())
    return np.isfinite(x).all() and own.all() and apart


def test_tsne(blobs):
    df, _ = blobs
    assert told_apart(manifold.TSNE(perplexity=8).fit_transform(df, COLS, "id"), ["t0", "t1"])


def test_umap(blobs):
    df, _ = blobs
    assert told_apart(manifold.UMAP(n_neighbors=8).fit_transform(df, COLS, "id"), ["u0", "u1"])


def test_spectral_embedding(blobs):
    """The first axis is the eigenvector that splits the graph's weakest cut."""
    df, _ = blobs
    got = manifold.SpectralEmbedding(1, "rbf", 0.02).fit_transform(df, COLS, "id").toPandas().sort_values("id")["e0"].to_numpy()
    assert len(set(np.sign(got[:30]))) == 1 and len(set(np.sign(got[30:]))) == 1 and got[0] * got[30] < 0


def test_bayesian_mixture_empties_what_it_does_not_need(blobs):
    df, pdf = blobs
    m = mixture.BayesianGaussianMixture(2, max_iter=200).fit(df, COLS)
    x = pdf[COLS].to_numpy()
    order = np.argsort(m.means_[:, 0])
    assert np.allclose(m.means_[order], [x[:30].mean(0), x[30:].mean(0)], atol=0.25) and np.allclose(m.weights_, 0.5, atol=0.05)
    labels = m.predict(df).orderBy("id").toPandas()["component"].to_numpy()
    assert len(set(labels[:30])) == len(set(labels[30:])) == 1 and labels[0] != labels[30]


def test_auto_arima_takes_the_least_aicc(spark):
    rng = np.random.default_rng(4)
    y = np.zeros(120)
    for k in range(1, 120):
        y[k] = 0.8 * y[k - 1] + rng.normal()
    df = spark.createDataFrame(pd.DataFrame({"s": "x", "t": np.arange(120), "y": y}))
    got = timeseries.AutoARIMA(0, 1, 1).select(df, "s", "t", "y").first()
    tried = {(p, q): timeseries.ARIMA((p, 0, q)).fit_series(y).aicc_ for p in (0, 1) for q in (0, 1)}
    assert (got.p, got.q) == min(tried, key=tried.get) and got.p == 1 and np.isclose(got.aicc, min(tried.values()))


def test_kernel_ridge_takes_more_rows_than_a_matrix_may_have(spark):
    """The conjugate gradients give the direct solve's coefficients, also with weights, and no bound on the rows holds."""
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame(rng.normal(size=(700, 3)), columns=COLS).assign(id=rng.permutation(700), y=rng.normal(size=700), w=rng.uniform(0.5, 2, 700))
    df, x = spark.createDataFrame(pdf), pdf.sort_values("id")
    for kernel, gamma in (("rbf", None), ("linear", None), ("laplacian", 0.7)):
        k = density.kernel_matrix(x[COLS].to_numpy(), x[COLS].to_numpy(), kernel, gamma, 3, 1)
        got = density.KernelRidge(0.5, kernel, gamma, most_rows=100).fit(df, COLS, "y", "id", "w")
        want = np.linalg.solve(k + 0.5 * np.diag(1 / x.w), x.y)
        assert np.allclose(got.dual_[:, 0], want, atol=1e-7)
        assert np.allclose(got.predict(df).toPandas().sort_values("id").prediction, k @ want, atol=1e-7)


def dense_axes(a, count):
    """Least eigenvectors of the normalised Laplacian of a whole matrix, scaled by the roots of the degrees."""
    a = a - np.diag(np.diag(a))
    root = np.sqrt(a.sum(1))
    v = np.linalg.eigh(np.eye(len(a)) - a / np.outer(root, root))[1][:, :count] / root[:, None]
    return v * np.sign(v[np.abs(v).argmax(0), np.arange(count)])


@pytest.fixture(scope="module")
def three(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 3)) + np.array([0, 2.5, 6])[np.arange(400) % 3, None] * [1, 0.5, -1]
    return spark.createDataFrame(pd.DataFrame(x, columns=COLS).assign(id=np.arange(400))).repartition(3), x


def test_spectral_clustering_has_no_bound_on_its_rows(three):
    df, x = three
    model = manifold.SpectralClustering(n_clusters=3, gamma=0.4, most_rows=50)
    ids, got = model._vectors(df, COLS, "id", 3)
    assert list(ids) == list(range(400)) and np.allclose(got, dense_axes(density.kernel_matrix(x, x, "rbf", 0.4, 3, 1), 3), atol=1e-8)
    label = model.fit_predict(df, COLS, "id").toPandas().sort_values("id")["cluster"].to_numpy()
    assert len({(a, b) for a, b in zip(label, np.arange(400) % 3)}) < 9 and np.bincount(label).min() > 100


def test_spectral_embedding_by_neighbors_has_no_bound_on_its_rows(three):
    df, x = three
    d = np.linalg.norm(x[:, None] - x[None], axis=2) + np.diag([np.inf] * 400)
    a = np.zeros((400, 400))
    a[np.arange(400)[:, None], np.argsort(d, axis=1, kind="stable")[:, :39]] = 1
    got = manifold.SpectralEmbedding(2, most_rows=50).fit_transform(df, COLS, "id").toPandas().sort_values("id")[["e0", "e1"]].to_numpy()
    assert np.allclose(got, dense_axes((a + a.T) / 2, 3)[:, 1:], atol=1e-8)


@pytest.mark.parametrize("kind", ["spread", "grid", "copies", "shifted", "far"])
def test_mutual_neighbors_compute_few_distances(kind, monkeypatch):
    """Affinities are those of all distances, bit for bit, also where distances tie; only pairs in doubt get a
    distance, which are few unless many distances tie or far rows widen the bounds."""
    rng = np.random.default_rng(11)
    x = {
        "spread": rng.normal(size=(900, 4)), "grid": rng.integers(0, 4, (900, 3)).astype(float), "copies": np.repeat(rng.normal(size=(90, 3)), 10, 0),
        "shifted": 1e7 + rng.normal(size=(900, 2)), "far": np.concatenate([rng.normal(size=(898, 2)), [[1e9, 0], [0, -1e9]]]),
    }[kind]
    d = manifold.pair_distances(x, x, "euclidean", 2)
    order = np.argsort(d + np.diag([np.inf] * 900), axis=1, kind="stable")
    last = order[:, 88]
    far = d[np.arange(900), last]
    want = np.zeros((900, 900))
    want[np.arange(900)[:, None], order[:, :89]] = 0.5
    want += want.T
    given, listed = [], manifold.listed_distances
    monkeypatch.setattr(manifold, "listed_distances", lambda a, b, metric: given.append(len(a)) or listed(a, b, metric))
    monkeypatch.setattr(manifold, "pair_distances", None)
    tile, *held = manifold.mutual_neighbors(x, far, last.astype(float))
    got = tile(slice(0, 900), slice(0, 900), x, *held)
    np.fill_diagonal(got, 0)
    assert np.array_equal(got, want)
    assert kind in ("grid", "copies", "far") or sum(given) < 20 * 900


def test_tsne_has_no_bound_on_its_rows(spark, three):
    """Neighbour probabilities and forces are those of the definition, for any number of rows."""
    df, x = three
    model = manifold.TSNE(perplexity=12, max_iter=300, most_rows=50)
    i, j, p = model.neighbor_probabilities(spark, x)
    d = np.linalg.norm(x[:, None] - x[None], axis=2) + np.diag([np.inf] * 400)
    near = np.argsort(d, axis=1, kind="stable")[:, :37]
    got = np.zeros((400, 400))
    got[i, j] = p
    mask = np.zeros((400, 400), bool)
    mask[np.arange(400)[:, None], near] = True
    assert np.isclose(got.sum(), 1) and np.array_equal(got, got.T) and np.array_equal(got > 0, mask | mask.T)
    y = np.random.default_rng(1).normal(size=(400, 2)) * 3
    num = 1 / (1 + ((y[:, None] - y[None]) ** 2).sum(2)) - np.eye(400)
    want = 4 * (((12 * got - num / num.sum()) * num)[:, :, None] * (y[:, None] - y[None])).sum(1)
    grad = model._sparse_forces(i, j, p, layout.Repulsion())(y, 12.0)[0]
    direct = model._sparse_forces(i, j, p, lambda y: manifold.exact_repulsion(spark, y))(y, 12.0)[0]
    assert np.allclose(direct, want, atol=1e-12) and np.linalg.norm(grad - want) < 1e-3 * np.linalg.norm(want)
    out = model.fit_transform(df, COLS, "id").toPandas()
    assert sorted(out.id) == list(range(400)) and np.isfinite(out[["t0", "t1"]].to_numpy()).all()


def prim(d):
    """Sorted weights of a matrix's minimum spanning tree."""
    inside, best, out = {0}, d[0].copy(), []
    while len(inside) < len(d):
        best[list(inside)] = np.inf
        k = int(best.argmin())
        out.append(best[k])
        inside.add(k)
        best = np.minimum(best, d[k])
    return np.sort(out)


def test_spanning_tree_of_clusters_with_copies(spark):
    """Whole clusters of more than 16 rows, and many copies of one row, must search beyond their nearest rows."""
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=(120, 2)), rng.normal(size=(90, 2)) + 30, np.full((60, 2), 7.0), rng.normal(size=(3, 2)) * 200])
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    tree = cluster.minimum_tree(spark, x, "euclidean")
    assert np.allclose(tree[:, 2], prim(d)) and np.allclose(d[tree[:, 0].astype(int), tree[:, 1].astype(int)], tree[:, 2])
    core = np.sort(d, axis=1)[:, 4]
    w = np.maximum(np.maximum(d, core), core[:, None])
    assert np.allclose(cluster.minimum_tree(spark, x, "euclidean", 2, core)[:, 2], prim(w))


class Here:
    """Passes in this process, so that distances can be counted."""

    def __init__(self, spark, *arrays):
        self.arrays = arrays

    def __enter__(self):
        return self

    def __exit__(self, *_):
        pass

    def run(self, f, width, rows, *more, most=2048):
        return np.concatenate([np.reshape(f(i, min(i + 500, rows), *self.arrays, *more), (-1, width)) for i in range(0, rows, 500)])


@pytest.mark.parametrize("copies", [1, 25])
def test_hdbscan_computes_few_distances(copies, monkeypatch):
    """Nearest rows and the tree are those of all distances, of which most are left out by bounds."""
    n, count = 6000, [0]
    rng = np.random.default_rng(12)
    x = rng.permutation(np.repeat(rng.normal(size=(n // copies, 3)), copies, 0))
    x[x[:, 0] > 0.7] += 40
    d = neighbors.pair_distances(x, x, "euclidean", 2)
    np.fill_diagonal(d, np.inf)
    order = np.argsort(d, axis=1, kind="stable")[:, :16]
    core = np.take_along_axis(d, order, 1)[:, 8]
    for name, many in (("pair_distances", lambda a, b: len(a) * len(b)), ("listed_distances", lambda a, b: len(a))):
        plain = getattr(neighbors, name)

        def counted(a, b, *more, plain=plain, many=many):
            count[0] += many(a, b)
            return plain(a, b, *more)

        for module in (neighbors, cluster):
            monkeypatch.setattr(module, name, counted, raising=False)
    for module in (neighbors, cluster):
        monkeypatch.setattr(module, "Passes", Here)
    at, dist = neighbors.nearest_rows(None, x, 16)
    assert np.array_equal(at, order) and np.array_equal(dist, np.take_along_axis(d, order, 1))
    assert count[0] < n * n // 3
    for lows in (None, core):
        tree = cluster.minimum_tree(None, x, "euclidean", 2, lows, (at, dist))
        w = d if lows is None else np.maximum(np.maximum(d, core), core[:, None])
        i, j = tree[:, :2].astype(int).T
        assert np.array_equal(tree[:, 2], w[i, j]) and np.array_equal(tree[:, 2], prim(w))


def test_single_linkage_of_25000_rows(spark):
    """Beyond the 20,000 rows of one matrix of distances: two lines of rows far apart, and one row between."""
    n = 25_001
    pdf = pd.DataFrame({"id": np.arange(n), "a": np.where(np.arange(n) < 12_000, 0.0, 50_000.0) + np.arange(n) * 0.7})
    pdf.loc[n - 1, "a"] = 30_000.0
    made = cluster.AgglomerativeClustering(3).fit(spark.createDataFrame(pdf), ["a"], "id")
    assert sorted(np.bincount(made.labels_)) == [1, 12_000, 13_000] and len(set(made.labels_[:12_000])) == 1


def test_hdbscan_of_21000_rows(spark):
    """Beyond the 20,000 rows that the driver took: two dense groups and a far row."""
    rng = np.random.default_rng(10)
    x = np.concatenate([rng.normal(size=(10_000, 2)), rng.normal(size=(11_000, 2)) + 40, [[500.0, 500.0]]])
    made = cluster.HDBSCAN(200).fit(spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]).assign(id=np.arange(21_001))), ["a", "b"], "id")
    assert made.labels_[-1] == -1 and len(made.medoids_) == len(set(made.labels_) - {-1})
    first, second = set(made.labels_[:10_000]) - {-1}, set(made.labels_[10_000:-1]) - {-1}
    assert first and second and not first & second


def test_dbscan_emits_no_pairs(spark, monkeypatch):
    """2,000 rows that are all near each other have four million pairs; cells give a few numbers a row instead."""
    rows = [(i, [0.001 * (i % 50)]) for i in range(2000)] + [(5000 + i, [10.0 + i]) for i in range(3)] + [(9000, [10.4])]
    given, blocks = [], cluster.block_cells

    def counted(left, right, scan, schema):
        out = blocks(left, right, scan, schema)
        given.append(out.count())
        return out

    monkeypatch.setattr(cluster, "block_cells", counted)
    got = cluster.DBSCAN(0.7, 3, block_rows=500).fit_predict(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v").toPandas().set_index("id")
    assert max(given) <= 12 * len(rows)
    assert set(got.label[:2000].loc[list(range(2000))]) == {0} and got.core.loc[list(range(2000))].all()
    assert got.label.loc[[5000, 5001, 5002, 9000]].tolist() == [1, 1, -1, 1] and got.core.loc[[5000, 5001, 5002, 9000]].tolist() == [False, False, False, True]


def test_umap_has_no_bound_on_its_rows(spark, three):
    """The graph is the fuzzy union of the definition, and rows beyond 20,000 are laid out and transformed."""
    df, x = three
    i, j, w = manifold.UMAP(n_neighbors=8)._edges(spark, x)
    d = np.linalg.norm(x[:, None] - x[None], axis=2) + np.diag([np.inf] * 400)
    near = np.argsort(d, axis=1, kind="stable")[:, :7]
    dist = np.take_along_axis(d, near, 1)
    rho, s = manifold.smooth_knn(dist)
    a = np.zeros((400, 400))
    a[np.arange(400)[:, None], near] = np.exp(-np.maximum(dist - rho[:, None], 0) / s[:, None])
    got = np.zeros((400, 400))
    got[i, j] = w
    assert np.allclose(got, a + a.T - a * a.T, atol=1e-12)
    many = spark.createDataFrame(pd.DataFrame(np.random.default_rng(3).normal(size=(20_500, 3)), columns=COLS).assign(id=np.arange(20_500)))
    model = manifold.UMAP(n_neighbors=4, n_epochs=3)
    assert model.fit_transform(many, COLS, "id").select("id").distinct().count() == 20_500
    assert model.transform(many.where("id < 30"), "id").count() == 30


def test_umap_starts_from_eigenvectors_at_any_size(spark, monkeypatch):
    """4,500 rows, more than a dense solve took: the layout starts from the graph's eigenvectors, as for fewer rows."""
    rng = np.random.default_rng(12)
    x = np.sort(rng.uniform(0, 4, size=4500))[:, None] * [1.0, 0.3, -0.2] + rng.normal(size=(4500, 3)) * 0.4
    df, begun = spark.createDataFrame(pd.DataFrame(x, columns=COLS).assign(id=np.arange(4500))), []
    monkeypatch.setattr(manifold.UMAP, "_layout", lambda self, y, *rest: begun.append(y) or y)
    model = manifold.UMAP()
    model.fit_transform(df, COLS, "id")
    i, j, w = model._edges(spark, x)
    a = np.zeros((4500, 4500))
    a[i, j] = w
    root = np.sqrt(a.sum(1))
    scaled = begun[0] * root[:, None]
    for k in range(2):
        u = scaled[:, k] / np.linalg.norm(scaled[:, k])
        rest = (a @ (u / root)) / root - (u @ ((a @ (u / root)) / root)) * u
        assert np.linalg.norm(rest) < 1e-3
