"""Clustering: k-means by broadcast centers, density clusters by range joins and graph rounds."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vec
from ..plans.graph import components, cut
from ..plans.pairs import Passes, strips, tiles
from ..plans.stats import check_finite, moments, sweep
from ..sources.frame import to_numpy
from .base import Estimator, by_rows
from .neighbors import BLOCK, FIRST, block_cells, bounded_squares, close_pairs, nearest_rows, pair_distances


@dataclass
class KMeans(Estimator):
    """Lloyd's rounds, one sweep each.  ``elkan`` names the same rounds: its bounds save distances on one host and
    change no result, but would have to travel with every row here.

    Seeds come from all rows: five rounds draw about twice as many rows as clusters in proportion to their squared
    distance from the seeds so far, and the drawn rows, weighted by the rows nearest to them, are seeded by k-means++."""

    n_clusters: int = 8
    init: str | np.ndarray = "k-means++"
    n_init: int | str = "auto"
    max_iter: int = 300
    tol: float = 1e-4
    random_state: int = 0
    algorithm: str = "lloyd"

    def _start(self, df: DataFrame, cols: Sequence[str], rng: np.random.Generator, n: int) -> np.ndarray:
        if not isinstance(self.init, str):
            return np.asarray(self.init, float).copy()
        if self.init not in ("k-means++", "random"):
            raise ValueError(f"unknown init {self.init!r}")
        k, d = self.n_clusters, len(cols)

        def drawn(source: DataFrame, chance: Column) -> np.ndarray:
            rows = source.where(F.rand(int(rng.integers(1 << 30))) < chance).select(*cols).toArrow()
            x = np.column_stack([c.to_numpy().astype(float) for c in rows.columns]) if rows.num_rows else np.empty((0, d))
            return x[np.lexsort(x.T[::-1])]

        if self.init == "random":
            x = np.empty((0, d))
            while len(x) < k:
                x = drawn(df, F.lit(min(1.0, (2 * k + 20) / n)))
            return x[rng.choice(len(x), k, replace=False)]
        seeds = np.empty((0, d))
        while not len(seeds):
            seeds = drawn(df, F.lit(min(1.0, 20 / n)))[:1]
        for _ in range(5):
            far = sweep(df, cols, lambda x: np.array([pair_distances(x, seeds, "sqeuclidean", 2).min(1).sum()]), 1)[0]
            if far <= 0:
                break
            held = by_rows(df, cols, lambda x: pair_distances(x, seeds, "sqeuclidean", 2).min(1), "__far")
            seeds = np.unique(np.concatenate([seeds, drawn(held, F.col("__far") * float(2 * k / far))]), axis=0)

        def nearest(x: np.ndarray) -> np.ndarray:
            return np.bincount(pair_distances(x, seeds, "sqeuclidean", 2).argmin(1), minlength=len(seeds)).astype(float)

        return self._weighted_seeds(seeds, sweep(df, cols, nearest, len(seeds)), rng)

    def _weighted_seeds(self, x: np.ndarray, weight: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """k-means++ with a few tries a center over weighted points; with fewer points than clusters some repeat."""
        centers = [x[rng.choice(len(x), p=weight / weight.sum())]]
        near = ((x - centers[0]) ** 2).sum(1)
        for _ in range(1, self.n_clusters):
            mass = near * weight
            tries = rng.choice(len(x), 2 + int(math.log(self.n_clusters)), p=mass / mass.sum()) if mass.sum() > 0 else rng.integers(len(x), size=1)
            options = [np.minimum(near, ((x - x[t]) ** 2).sum(1)) for t in tries]
            best = int(np.argmin([(o * weight).sum() for o in options]))
            centers.append(x[tries[best]])
            near = options[best]
        return np.array(centers)

    def fit(self, df: DataFrame, cols: Sequence[str]) -> KMeans:
        made = self._begin(cols)
        n = check_finite(df, cols)
        if self.n_clusters > n:
            raise ValueError("fewer rows than clusters")
        if self.algorithm not in ("lloyd", "elkan"):
            raise ValueError(f"unknown algorithm {self.algorithm!r}")
        d, k = len(cols), self.n_clusters
        stop = self.tol * moments(df, cols)["var"].mean()
        held = df.select(*cols).persist()
        best = None
        runs = (1 if not isinstance(self.init, str) or self.init == "k-means++" else 10) if self.n_init == "auto" else self.n_init

        def step(x: np.ndarray, c: np.ndarray) -> np.ndarray:
            dist = pair_distances(x, c, "sqeuclidean", 2)
            own = dist.argmin(1)
            out = np.zeros((k, d + 2))
            np.add.at(out, own, np.concatenate([x, np.ones((len(x), 1)), dist.min(1)[:, None]], 1))
            return out

        try:
            for run in range(runs):
                c = self._start(held, cols, np.random.default_rng(self.random_state + run), n)
                for it in range(self.max_iter):
                    s = sweep(held, cols, lambda x: step(x, c), k * (d + 2)).reshape(k, d + 2)
                    new = np.where(s[:, d : d + 1] > 0, s[:, :d] / np.maximum(s[:, d : d + 1], 1), c)
                    for j in np.flatnonzero(s[:, d] == 0):  # the farthest row starts an empty cluster anew
                        far = held.select(*cols, self._squared(cols, new).alias("__d")).orderBy(F.desc("__d"), *cols).first()
                        new[j] = [far[x] for x in cols]
                    moved = ((new - c) ** 2).sum()
                    c = new
                    if moved <= stop:
                        break
                s = sweep(held, cols, lambda x: step(x, c), k * (d + 2)).reshape(k, d + 2)
                if best is None or s[:, -1].sum() < best[0]:
                    best = (float(s[:, -1].sum()), c, it + 1)
        finally:
            held.unpersist()
        made.inertia_, made.cluster_centers_, made.n_iter_ = best
        return made

    @staticmethod
    def _squared(cols: Sequence[str], centers: np.ndarray) -> Column:
        parts = [vec.total([(F.col(c).cast("double") - float(m)) * (F.col(c).cast("double") - float(m)) for c, m in zip(cols, row)]) for row in centers]
        return F.least(*parts) if len(parts) > 1 else parts[0]

    def predict(self, df: DataFrame, out: str = "cluster") -> DataFrame:
        self._fitted()
        names = [f"__c{k}" for k in range(len(self.cluster_centers_))]
        held = df.withColumns({n: self._squared(self.cols, row[None]) for n, row in zip(names, self.cluster_centers_)})
        return held.withColumn(out, vec.argbest([F.col(n) for n in names], list(range(len(names))), lowest=True)).drop(*names)

    def transform(self, df: DataFrame, prefix: str = "distance") -> DataFrame:
        return df.withColumns({f"{prefix}{k}": F.sqrt(self._squared(self.cols, row[None])) for k, row in enumerate(self.cluster_centers_)})


@dataclass
class DBSCAN:
    """Core mask, components of core-core pairs within ``eps``; a border row joins the cluster with the smallest number
    among its core neighbours (clusters numbered by smallest core id).

    Pairs are compared in salted blocks three times, and none leaves its block: blocks give numbers of neighbours, then
    the edges of a spanning forest of their core rows, then the least cluster number near their border rows."""

    eps: float = 0.5
    min_samples: int = 5
    metric: str = "euclidean"
    block_rows: int = 4096

    def fit_predict(self, df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
        """``(id, label, core)``; label -1 is noise."""
        if self.metric not in vec.METRICS:
            raise ValueError(f"unknown metric {self.metric!r}")
        rows = cut(df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")))  # read in each pass
        counts = self._blocks(rows, rows, _counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))  # a row's own place counts
        marked = cut(rows.join(counts, "id", "left").select("id", "v", (F.coalesce("n", F.lit(1)) >= self.min_samples).alias("core")))
        core, rest = marked.where("core").select("id", "v"), marked.where("not core").select("id", "v")
        roots = components(self._blocks(core, core, _forest, "a long, b long"))
        labeled = core.select("id", "v").join(roots.withColumnRenamed("node", "id"), "id", "left").select("id", "v", F.coalesce("root", "id").alias("root"))
        # cluster numbers: one row a cluster
        numbered = labeled.select("root").distinct().withColumn("label", (F.row_number().over(Window.orderBy("root")) - 1).cast("int"))
        cores = cut(labeled.join(numbered, "root").select("id", "v", "label"))
        border = self._blocks(cores, rest, _least_label, "id long, near int").groupBy("id").agg(F.min("near").alias("near"))
        out = rest.select("id").join(border, "id", "left").select("id", F.coalesce("near", F.lit(-1)).alias("label"), F.lit(False).alias("core"))
        return cores.select("id", "label", F.lit(True).alias("core")).unionAll(out)

    def _blocks(self, rows: DataFrame, queries: DataFrame, scan: Callable, schema: str) -> DataFrame:
        """``scan(row ids, row labels, query ids, near)`` for each cell of one block of rows and one of queries; ``near``
        gives the place of the first of a few queries and their mask of rows within ``eps``."""
        eps, metric = self.eps, self.metric
        rb, qb = (max(1, -(-side.count() // self.block_rows)) for side in (rows, queries))
        salt = lambda k: F.pmod(F.xxhash64("id"), F.lit(k)).cast("int")
        label = "label" if "label" in rows.columns else F.lit(0).alias("label")
        left = rows.select(salt(rb).alias("r"), F.explode(F.sequence(F.lit(0), F.lit(qb - 1))).alias("q"), "id", "v", label)
        right = queries.select(F.explode(F.sequence(F.lit(0), F.lit(rb - 1))).alias("r"), salt(qb).alias("q"), "id", "v", F.lit(0).alias("label"))

        def cell(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(a) or not len(b):
                return scan(np.empty(0, np.int64), np.empty(0, int), np.empty(0, np.int64), iter(()))
            x, y = np.array(a["v"].tolist(), float), np.array(b["v"].tolist(), float)
            near = ((s, pair_distances(y[s : s + 256], x, metric, 2) <= eps) for s in range(0, len(y), 256))
            return scan(a["id"].to_numpy(), a["label"].to_numpy(), b["id"].to_numpy(), near)

        return block_cells(left, right, cell, schema)


def _counts(rows: np.ndarray, label: np.ndarray, queries: np.ndarray, near: Iterator) -> pd.DataFrame:
    """Rows near each query; a query counts itself, whatever its distance to itself (NaN) may be."""
    n = np.zeros(len(queries), np.int64)
    for s, mask in near:
        n[s : s + len(mask)] = (mask | (queries[s : s + len(mask), None] == rows)).sum(1)
    return pd.DataFrame({"id": queries, "n": n})


def _forest(rows: np.ndarray, label: np.ndarray, queries: np.ndarray, near: Iterator) -> pd.DataFrame:
    """Ties of each query and row with the smallest id of its component of the cell's pairs."""
    ids, place = np.unique(np.concatenate([rows, queries]), return_inverse=True)
    of, own, root = place[: len(rows)], place[len(rows) :], np.arange(len(ids))
    for s, mask in near:
        i, j = np.nonzero(mask)
        i, j = own[s + i], of[j]
        while len(i):
            a, b = root[i], root[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := root[root], root):
                root = up
    tied = np.flatnonzero(root != np.arange(len(ids)))
    return pd.DataFrame({"a": ids[tied], "b": ids[root[tied]]})


def _least_label(rows: np.ndarray, label: np.ndarray, queries: np.ndarray, near: Iterator) -> pd.DataFrame:
    """The smallest label near each query that is near any row."""
    none = np.iinfo(np.int32).max
    best = np.full(len(queries), none, np.int32)
    for s, mask in near:
        best[s : s + len(mask)] = np.where(mask, label, none).min(1)
    return pd.DataFrame({"id": queries[best < none], "near": best[best < none]})


def _nearest_outside(x: np.ndarray, lows: np.ndarray, label: np.ndarray, own: np.ndarray, left: np.ndarray, right: np.ndarray, metric: str, p: float) -> np.ndarray:
    """Place and weight of the least edge, the lowest place of several, from each of the rows ``own`` to one of another
    label.  Distances are computed where ``left @ right`` (:func:`bounded_squares`) is not beyond the least so far."""

    def weights(r: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
        return np.maximum(np.maximum(d, lows[c]), lows[own[r]])

    every = np.arange(len(own))
    d = weights(every[:, None], np.arange(min(FIRST, len(x))), pair_distances(x[own], x[:FIRST], metric, p))
    d[label[own][:, None] == label[:FIRST]] = np.inf
    to = d.argmin(1)
    best = d[every, to]
    for s in range(FIRST, len(x), BLOCK):
        limit = np.where(lows[own] < best, best if metric == "sqeuclidean" else best**2, -np.inf)
        mask = left @ right[:, s : s + BLOCK] <= limit[:, None]
        mask &= label[own][:, None] != label[s : s + BLOCK]
        r, c, d = close_pairs(mask, x[own], x[s : s + BLOCK], metric, p)
        d = weights(r, c + s, d)
        less = d < best[r]
        r, c, d = r[less], c[less] + s, d[less]
        order = np.lexsort((c, d, r))
        order = order[np.r_[True, r[order][1:] != r[order][:-1]]] if len(order) else order
        to[r[order]], best[r[order]] = c[order], d[order]
    return np.stack([to, best], 1)


def minimum_tree(spark: SparkSession, x: np.ndarray, metric: str, p: float = 2.0, core: np.ndarray | None = None, near: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Minimum spanning tree of all rows (rows a, b, weight by rising weight), a weight being the distance or the largest
    of it and both rows' ``core``.

    Borůvka's rounds: each component but the largest takes its least edge to another one.  A row's 16 nearest rows
    (``near``) settle most; rows that have none outside their component and could still be nearest are compared
    with all rows, on the executors, and keep what they find until it joins their component."""
    n = len(x)
    at, dist = nearest_rows(spark, x, 16, metric, p) if near is None else near
    weight = dist if core is None else np.maximum(np.maximum(dist, core[at]), core[:, None])
    bound = np.full(n, np.inf) if at.shape[1] >= n - 1 else dist[:, -1] if core is None else np.maximum(dist[:, -1], core)
    label, out = np.arange(n), []
    found, found_at = np.full(n, np.inf), np.full(n, -1)
    lows = np.zeros(n) if core is None else core

    def search(i: int, j: int, x: np.ndarray, lows: np.ndarray, rows: np.ndarray, label: np.ndarray) -> np.ndarray:
        got = np.empty((j - i, 2))
        low = bounded_squares(x, x[rows[i:j]], metric, p)
        if low is not None:
            for s in range(0, j - i, 128):
                part = slice(s, min(s + 128, j - i))
                got[part] = _nearest_outside(x, lows, label, rows[i:j][part], low[0][part], low[1], metric, p)
            return got
        for part in strips(i, j, n):
            own = rows[part]
            d = np.concatenate([pair_distances(x[own], x[s : s + 512], metric, p) for s in range(0, n, 512)], 1)
            d = np.maximum(np.maximum(d, lows), lows[own, None])
            d[label[own][:, None] == label] = np.inf
            best = d.argmin(1)
            got[part.start - i : part.stop - i] = np.stack([best, d[np.arange(len(d)), best]], 1)
        return got

    with Passes(spark, x, lows) as passes:
        while len(out) < n - 1:
            sizes = np.bincount(label, minlength=n)
            small = label != sizes.argmax()
            first = np.where(label[at] != label[:, None], weight, np.inf)
            pick = first.argmin(1)
            best, to = first[np.arange(n), pick], at[np.arange(n), pick]
            held = (found_at >= 0) & (label[found_at] != label)
            best, to = np.where(held, found, best), np.where(held, found_at, to)
            least = np.full(n, np.inf)
            np.minimum.at(least, label, best)
            np.minimum.at(least, label[to], best)
            rows = np.flatnonzero(small & ~held & (best > bound) & (bound < least[label]))
            if len(rows):
                got = passes.run(search, 2, len(rows), rows, label)
                found_at[rows], found[rows] = got[:, 0].astype(int), got[:, 1]
                best[rows], to[rows] = found[rows], found_at[rows]
            # the least edge of each component but the largest; a merged pair's second edge falls to the union below
            lo, hi = np.minimum(np.arange(n), to), np.maximum(np.arange(n), to)
            edge = np.flatnonzero(np.isfinite(best))
            ends = np.concatenate([label[edge], label[to[edge]]])
            edge = np.concatenate([edge, edge])
            order = np.lexsort((hi[edge], lo[edge], best[edge], ends))
            ends, edge = ends[order], edge[order]
            chosen = edge[np.r_[True, ends[1:] != ends[:-1]] & (ends != sizes.argmax())]
            parent = np.arange(n)

            def top(k: int) -> int:
                while parent[k] != k:
                    parent[k] = parent[parent[k]]
                    k = parent[k]
                return k

            for k in chosen[np.lexsort((hi[chosen], lo[chosen], best[chosen]))]:
                i, j = top(label[k]), top(label[to[k]])
                if i != j:
                    parent[max(i, j)] = min(i, j)
                    out.append((lo[k], hi[k], best[k]))
            while not np.array_equal(up := parent[parent], parent):
                parent = up
            label = parent[label]
    tree = np.array(out, float).reshape(-1, 3)
    return tree[np.lexsort((tree[:, 1], tree[:, 0], tree[:, 2]))]


def single_linkage(tree: np.ndarray, n: int) -> np.ndarray:
    """Merge rows (left, right, distance, size) by ascending distance; new clusters from n on."""
    parent, size = list(range(2 * n - 1)), [1] * n + [0] * (n - 1)

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for k, (a, b, d) in enumerate(tree[np.argsort(tree[:, 2], kind="stable")]):
        i, j = sorted((top(int(a)), top(int(b))))
        parent[i] = parent[j] = n + k
        size[n + k] = size[i] + size[j]
        out.append((i, j, d, size[n + k]))
    return np.array(out, float).reshape(-1, 4)


@dataclass
class AgglomerativeClustering:
    """Single linkage.  The driver holds the rows, their nearest rows and the merges; distances of all pairs are
    compared on the executors."""

    n_clusters: int = 2
    metric: str = "euclidean"
    linkage: str = "single"

    def fit(self, df: DataFrame, cols: Sequence[str], id_col: str) -> AgglomerativeClustering:
        if self.linkage != "single":
            raise ValueError("only single linkage is supported")
        made = AgglomerativeClustering(self.n_clusters, self.metric, self.linkage)
        x = to_numpy(df, cols, id_col, None)
        n = len(x)
        merges = single_linkage(minimum_tree(df.sparkSession, x, self.metric), n)
        made.children_, made.distances_, made.n_leaves_ = merges[:, :2].astype(int), merges[:, 2], n
        label = np.arange(2 * n - 1)
        for k, (i, j) in reversed(list(enumerate(made.children_))):
            if k < n - self.n_clusters:
                label[i] = label[j] = label[n + k]
        made.labels_ = np.unique(label[:n], return_inverse=True)[1]
        return made


def condense(merges: np.ndarray, n: int, least: int) -> list[tuple[int, int, float, int]]:
    """Rows (cluster, child, lambda, size): points that leave a cluster and clusters that split off."""
    out, name, following = [], {2 * n - 2: n}, n + 1
    size = lambda i: 1 if i < n else int(merges[i - n, 3])

    def points(i: int) -> list[int]:
        found, stack = [], [i]
        while stack:
            k = stack.pop()
            if k < n:
                found.append(k)
            else:
                stack += [int(merges[k - n, 0]), int(merges[k - n, 1])]
        return found

    stack = [2 * n - 2]
    while stack:
        i = stack.pop()
        a, b, d = int(merges[i - n, 0]), int(merges[i - n, 1]), merges[i - n, 2]
        lam = 1 / d if d > 0 else math.inf
        big = [k for k in (a, b) if size(k) >= least]
        for k in (a, b):
            if len(big) == 2:
                name[k] = following
                out.append((name[i], following, lam, size(k)))
                following += 1
            elif k in big:
                name[k] = name[i]
            else:
                out += [(name[i], q, lam, 1) for q in points(k)]
                continue
            if k >= n:
                stack.append(k)
            else:
                out.append((name[k], k, math.inf, 1))
    return out


@dataclass
class HDBSCAN:
    """Mutual-reachability tree, condensed hierarchy, excess-of-mass or leaf selection.

    Core distances and the tree come from passes over all pairs on the executors; the driver holds the rows, their
    nearest rows and the hierarchy."""

    min_cluster_size: int = 5
    min_samples: int | None = None
    cluster_selection_epsilon: float = 0.0
    max_cluster_size: int | None = None
    metric: str = "euclidean"
    p: float = 2.0
    alpha: float = 1.0
    cluster_selection_method: str = "eom"
    allow_single_cluster: bool = False

    def fit(self, df: DataFrame, cols: Sequence[str], id_col: str) -> HDBSCAN:
        made = HDBSCAN(**{k: getattr(self, k) for k in self.__dataclass_fields__})
        x, spark = to_numpy(df, cols, id_col, None), df.sparkSession
        n, k = len(x), self.min_samples or self.min_cluster_size
        near = nearest_rows(spark, x, max(16, k - 1), self.metric, self.p)
        core = near[1][:, min(k, n) - 2] if min(k, n) > 1 else np.zeros(n)
        scaled = self.alpha != 1 and self.metric != "cosine"
        tree = minimum_tree(spark, x / self.alpha if scaled else x, self.metric, self.p, core, None if scaled else near)
        merges = single_linkage(tree, n)
        rows = condense(merges, n, self.min_cluster_size)
        made.condensed_ = rows
        birth = {n: 0.0} | {c: lam for _, c, lam, _ in rows if c >= n}
        parent = {c: p for p, c, _, _ in rows if c >= n}
        stable = dict.fromkeys(birth, 0.0)
        for p, _, lam, s in rows:
            stable[p] += (lam - birth[p]) * s if math.isfinite(lam) else 0.0 if birth[p] == lam else s * 1e12
        sizes = {n: n} | {c: s for _, c, _, s in rows if c >= n}
        kids: dict[int, list[int]] = {}
        for c, p in parent.items():
            kids.setdefault(p, []).append(c)
        chosen: set[int] = set()
        usable = [c for c in sorted(birth, reverse=True) if c != n or self.allow_single_cluster]
        if self.cluster_selection_method == "leaf":
            chosen = {c for c in usable if c not in kids} or ({n} if self.allow_single_cluster else set())
        else:
            worth = dict(stable)
            for c in usable:
                below = sum(worth[q] for q in kids.get(c, []))
                too_big = self.max_cluster_size is not None and sizes[c] > self.max_cluster_size
                if kids.get(c) and (worth[c] < below or too_big):
                    worth[c] = below
                else:
                    stack = list(kids.get(c, []))
                    while stack:
                        q = stack.pop()
                        chosen.discard(q)
                        stack += kids.get(q, [])
                    chosen.add(c)
        if self.cluster_selection_epsilon > 0:
            merged = set()
            for c in chosen:
                while c != n and (1 / birth[c] if birth[c] else math.inf) < self.cluster_selection_epsilon and parent[c] != n:
                    c = parent[c]
                merged.add(c)
            chosen = {c for c in merged if not any(self._within(c, o, parent) for o in merged if o != c)}
        number = {c: i for i, c in enumerate(sorted(chosen))}
        label, lam_of = np.full(n, -1), np.zeros(n)
        owner: dict[int, int] = {}
        for c in sorted(birth):  # parents have lower numbers
            owner[c] = number[c] if c in number else owner.get(parent.get(c), -1)
        for p, c, lam, _ in rows:
            if c < n:
                lam_of[c], label[c] = lam, owner[p]
        made.labels_ = label
        most = np.zeros(len(number))
        np.maximum.at(most, label[label >= 0], lam_of[label >= 0])
        top = dict(enumerate(most))
        made.probabilities_ = np.array([0.0 if i < 0 else 1.0 if top[i] == 0 or not math.isfinite(lam_of[q]) else min(lam_of[q], top[i]) / top[i] for q, i in enumerate(label)])
        death = dict.fromkeys(birth, 0.0)
        for p, _, lam, _ in rows:
            death[p] = max(death[p], lam)
        for c in sorted(parent, reverse=True):
            death[parent[c]] = max(death[parent[c]], death[c])
        outlier = np.zeros(n)
        for p, c, lam, _ in rows:
            if c < n and death[p] and math.isfinite(lam):
                outlier[c] = (death[p] - lam) / death[p] if math.isfinite(death[p]) else 1.0
        made.outlier_scores_ = outlier
        made.centroids_ = np.array([np.average(x[label == i], axis=0, weights=made.probabilities_[label == i]) for i in number.values()])
        made.medoids_ = np.array([self._medoid(spark, x[label == i]) for i in number.values()])
        return made

    def _medoid(self, spark: SparkSession, x: np.ndarray) -> np.ndarray:
        """The row with the least sum of distances to all others."""
        n, metric, p = len(x), self.metric, self.p

        def sums(i: int, j: int, x: np.ndarray) -> np.ndarray:
            out = np.zeros(j - i)
            for rows, others in tiles(i, j, n):
                out[rows.start - i : rows.stop - i] += pair_distances(x[rows], x[others], metric, p).sum(1)
            return out

        if n <= 2048:  # too few for a job; the same sums
            return x[sums(0, n, x).argmin()]
        with Passes(spark, x) as passes:
            return x[passes.run(sums, 1, n)[:, 0].argmin()]

    @staticmethod
    def _within(c: int, other: int, parent: dict[int, int]) -> bool:
        while c in parent:
            c = parent[c]
            if c == other:
                return True
        return False
