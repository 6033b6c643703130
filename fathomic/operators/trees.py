"""Tree ensembles from level-wise histograms, tree inference, path-dependent SHAP values.

A level of all open nodes is grown from one sweep: every task bins its rows, walks
them down the trees so far and adds their gradients into (node, feature, bin)
histograms; these are added up and searched for their best cut on the executors, by
node and feature, so one row of each pair reaches the driver.  Growth is deterministic.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vec
from ..plans.graph import cut
from ..plans.stats import check_finite, sweep
from .base import Estimator, by_rows


@dataclass
class Tree:
    """Node arrays; ``feature`` -1 marks a leaf; a row goes left if ``x <= threshold``."""

    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list = field(default_factory=list)
    cover: list[float] = field(default_factory=list)

    def add(self, value, cover: float) -> int:
        for a, v in ((self.feature, -1), (self.threshold, 0.0), (self.left, -1), (self.right, -1), (self.value, value), (self.cover, cover)):
            a.append(v)
        return len(self.feature) - 1

    def apply(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), int)
        f, t, a, b = map(np.asarray, (self.feature, self.threshold, self.left, self.right))
        while (open_ := f[at] >= 0).any():
            go = np.flatnonzero(open_)
            node = at[go]
            at[go] = np.where(x[go, f[node]] <= t[node], a[node], b[node])
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.asarray(self.value, float)[self.apply(x)]

    def expression(self, cols: Sequence[str], k: int | None = None, node: int = 0) -> Column:
        """Nested CASE over the columns, inside generated code."""
        if self.feature[node] < 0:
            v = self.value[node]
            return F.lit(float(v if k is None else v[k]))
        go = F.col(cols[self.feature[node]]).cast("double") <= float(self.threshold[node])
        return F.when(go, self.expression(cols, k, self.left[node])).otherwise(self.expression(cols, k, self.right[node]))


def bin_edges(df: DataFrame, cols: Sequence[str], bins: int) -> list[np.ndarray]:
    """At most ``bins - 1`` cuts a column: midpoints of its values when few, else quantiles."""
    at = [k / bins for k in range(1, bins)]
    row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), at, 10_000).alias(f"q{k}") for k, c in enumerate(cols)]).first()
    counts = df.agg(*[F.approx_count_distinct(c).alias(f"n{k}") for k, c in enumerate(cols)]).first()
    out = []
    for k, c in enumerate(cols):
        if counts[f"n{k}"] <= 2 * bins:
            values = [r[0] for r in df.select(F.col(c).cast("double").alias("v")).distinct().orderBy("v").limit(4 * bins).collect()]
            mid = (np.array(values[1:]) + np.array(values[:-1])) / 2
            if len(mid) < bins:
                out.append(mid)
                continue
        out.append(np.unique(row[f"q{k}"]))
    return out


def best_cuts(df: DataFrame, names: Sequence[str], part, slots: int, shape: tuple[int, int, int], judge) -> dict[tuple[int, int], tuple]:
    """``(slot, feature) -> (score, bin, statistics left of the cut, of all rows)`` from histograms: ``part(x)`` gives
    those of a batch, ``slots`` times ``shape`` = (features, bins, width); ``judge(feature, left, whole)`` scores cuts."""
    d, bins, width = shape

    def run(batches):
        total = np.zeros((slots, d, bins, width))
        for batch in batches:
            if batch.num_rows:
                total += part(np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]))
        slot, feature = np.nonzero(total[..., 0].sum(2) > 0)
        hist = total[slot, feature].reshape(-1)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(slot) + 1, dtype=np.int32) * (bins * width)), pa.array(hist))
        yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(feature.astype(np.int32)), lists], ["slot", "feature", "hist"])

    def choose(key, table):
        h = pc.list_flatten(table.column("hist")).to_numpy().reshape(-1, bins, width).sum(0)
        whole, left = h.sum(0), np.cumsum(h, axis=0)[:-1]
        score = judge(key[1].as_py(), left, whole)
        c = int(score.argmax())
        return pa.table({"slot": [key[0].as_py()], "feature": [key[1].as_py()], "score": [float(score[c])], "cut": [c], "left": [left[c].tolist()], "whole": [whole.tolist()]}, schema=pa.schema([("slot", pa.int32()), ("feature", pa.int32()), ("score", pa.float64()), ("cut", pa.int32()), ("left", pa.list_(pa.float64())), ("whole", pa.list_(pa.float64()))]))

    held = df.select(*[F.col(c).cast("double") for c in names]).mapInArrow(run, "slot int, feature int, hist array<double>")
    told = held.groupBy("slot", "feature").applyInArrow(choose, "slot int, feature int, score double, cut int, left array<double>, whole array<double>").toArrow().to_pylist()
    return {(r["slot"], r["feature"]): (r["score"], r["cut"], np.array(r["left"]), np.array(r["whole"])) for r in told}


def grow(df: DataFrame, cols: Sequence[str], others: Sequence[str], edges: list[np.ndarray], stats, width: int, gain, leaf, depth: int, least: float, features: int | None = None, rng: np.random.Generator | None = None, trees: int = 1) -> list[Tree]:
    """Grow ``trees`` trees side by side.  ``stats(x, o)`` gives per tree a matrix of ``width`` statistics a
    row (the first one its weight); ``gain(s)`` scores a statistics vector, ``leaf(s)`` its value."""
    d, bins = len(cols), max(len(e) for e in edges) + 1
    made = [Tree() for _ in range(trees)]
    open_: list[list[int]] = []

    def binned(x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)])

    def judge(f: int, left: np.ndarray, whole: np.ndarray) -> np.ndarray:
        right = whole - left
        score = np.where((left[:, 0] >= least) & (right[:, 0] >= least), gain(left) + gain(right) - gain(whole[None]), -np.inf)
        score[np.arange(bins - 1) >= len(edges[f])] = -np.inf
        return score

    for level in range(max(depth, 1)):
        slots = [(t, n) for t in range(trees) for n in (open_[t] if level else [0])]
        if not slots:
            break
        place = {s: k for k, s in enumerate(slots)}

        def part(x: np.ndarray) -> np.ndarray:
            b, out = binned(x[:, :d]), np.zeros((len(slots), d, bins, width))
            for t in range(trees):
                node = made[t].apply(x[:, :d]) if level else np.zeros(len(x), int)
                slot = np.array([place.get((t, int(n)), -1) for n in range(int(node.max(initial=0)) + 1)])[node] if len(node) else node
                inside = slot >= 0
                s = stats(x[:, :d], x[:, d:], t)[inside]
                for f in range(d):
                    cell = slot[inside] * bins + b[inside, f]
                    for w in range(width):
                        out[:, f, :, w] += np.bincount(cell, s[:, w], len(slots) * bins).reshape(len(slots), bins)
            return out

        found = best_cuts(df, [*cols, *others], part, len(slots), (d, bins, width), judge)
        nxt: list[list[int]] = [[] for _ in range(trees)]
        for k, (t, node) in enumerate(slots):
            whole = found[k, 0][3] if (k, 0) in found else np.zeros(width)
            if not level:
                made[t].add(leaf(whole), whole[0])
            if level >= depth or whole[0] < 2 * least:
                continue
            keep = range(d) if features is None or features >= d else sorted(rng.choice(d, features, replace=False))
            f = max(keep, key=lambda f: (found[k, f][0], -f))
            best, c, left, _ = found[k, f]
            right = whole - left
            if best <= 1e-12:
                continue
            tree = made[t]
            tree.feature[node], tree.threshold[node] = int(f), float(edges[f][c])
            tree.left[node], tree.right[node] = tree.add(leaf(left), left[0]), tree.add(leaf(right), right[0])
            nxt[t] += [tree.left[node], tree.right[node]]
        open_ = nxt
    return made


class Ensemble(Estimator):
    trees_: list[Tree]

    def shap_values(self, df: DataFrame, prefix: str = "shap_", output: int | None = None) -> DataFrame:
        """One column a feature; their sum plus ``expected_value`` is the prediction (raw score)."""
        trees, scale, d = self.trees_, self._tree_scale(), len(self.cols)
        f = lambda x: sum(scale[k] * tree_shap(t, x, d, output) for k, t in enumerate(trees))
        return by_rows(df, self.cols, f, [f"{prefix}{c}" for c in self.cols])

    def expected_value(self, output: int | None = None) -> float:
        return float(self._base(output) + sum(s * expected(t, output) for s, t in zip(self._tree_scale(), self.trees_)))

    def _tree_scale(self) -> list[float]:
        return [1 / len(self.trees_)] * len(self.trees_)

    def _base(self, output: int | None) -> float:
        return 0.0


def expected(tree: Tree, output: int | None) -> float:
    v = np.asarray(tree.value, float)
    v = v if output is None or v.ndim == 1 else v[:, output]
    leaf = np.asarray(tree.feature) < 0
    c = np.asarray(tree.cover)
    return float((v[leaf] * c[leaf]).sum() / c[0])


def tree_shap(tree: Tree, x: np.ndarray, d: int, output: int | None) -> np.ndarray:
    """Exact path-dependent Shapley values of one tree.

    Per leaf, the game over the distinct features of its path is a product: a known
    feature contributes whether the row follows the path (0 or 1), an unknown one the
    share of cover.  The Shapley weights of products come from polynomial division."""
    out = np.zeros((len(x), d))
    stack = [(0, {}, np.ones((len(x), 0)))]
    while stack:
        node, path, _ = stack.pop()
        if tree.feature[node] < 0:
            v = tree.value[node]
            v = float(v if output is None or np.ndim(v) == 0 else v[output])
            m = len(path)
            if not m or v == 0:
                continue
            keys = list(path)
            z = np.array([path[k][0] for k in keys])
            o = np.column_stack([path[k][1] for k in keys]).astype(float)
            # coefficients of prod(z_i + o_i t): subsets by size
            poly = np.zeros((len(x), m + 1))
            poly[:, 0] = 1
            for i in range(m):
                poly[:, 1:] = poly[:, 1:] * z[i] + poly[:, :-1] * o[:, i : i + 1]
                poly[:, 0] *= z[i]
            w = np.array([math.factorial(s) * math.factorial(m - s - 1) / math.factorial(m) for s in range(m)])
            for i in range(m):
                rest = np.zeros((len(x), m))
                rest[:, 0] = poly[:, 0] / z[i]
                for s in range(1, m):
                    rest[:, s] = (poly[:, s] - o[:, i] * rest[:, s - 1]) / z[i]
                out[:, keys[i]] += v * (o[:, i] - z[i]) * (rest @ w)
            continue
        f = tree.feature[node]
        go = x[:, f] <= tree.threshold[node]
        for child, follows in ((tree.left[node], go), (tree.right[node], ~go)):
            if tree.cover[child] <= 0:
                continue
            share, before = path.get(f, (1.0, np.ones(len(x), bool)))
            stack.append((child, path | {f: (share * tree.cover[child] / tree.cover[node], before & follows)}, _))
    return out


@dataclass
class RandomForestRegressor(Ensemble):
    n_estimators: int = 50
    max_depth: int = 10
    n_bins: int = 32
    max_features: float | str | None = 1.0
    bootstrap: bool = True
    min_samples_leaf: int = 1
    random_state: int = 0
    batch: int = 10
    oob_score: bool = False

    def _features(self, d: int) -> int:
        m = self.max_features
        return d if m is None else max(1, int(math.sqrt(d))) if m == "sqrt" else max(1, int(math.log2(d))) if m == "log2" else max(1, int(m * d)) if isinstance(m, float) else int(m)

    def _weights(self, x: np.ndarray, t: int) -> np.ndarray:
        """Poisson bootstrap weights from a seeded hash of the row: the same row has the same weight on any task."""
        if not self.bootstrap:
            return np.ones(len(x))
        h = np.zeros(len(x), np.uint64)
        for c in x.T:
            h = (h ^ np.ascontiguousarray(c, float).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        h = (h + np.uint64((self.random_state * 1000003 + t * 7919 + 1) & 0xFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(31)
        u = (h >> np.uint64(11)).astype(float) / 2**53
        return np.searchsorted(np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)]), u).astype(float)

    def _grow(self, df: DataFrame, cols: Sequence[str], others: list[str], targets, width: int, gain, leaf):
        made = self._begin(cols)
        check_finite(df, cols)
        edges = bin_edges(df, cols, self.n_bins)
        held = df.select(*cols, *others).persist()
        rng = np.random.default_rng(self.random_state)
        made.trees_ = []
        try:
            for first in range(0, self.n_estimators, self.batch):
                size = min(self.batch, self.n_estimators - first)
                stats = lambda x, o, t: (w := self._weights(np.concatenate([x, o], 1), first + t))[:, None] * np.concatenate([np.ones((len(x), 1)), targets(o)], 1)
                made.trees_ += grow(held, cols, others, edges, stats, width + 1, gain, leaf, self.max_depth, self.min_samples_leaf, self._features(len(cols)), rng, size)
            if self.oob_score:
                made._score_left_out(held, others)
        finally:
            held.unpersist()
        made.feature_importances_ = importances(made.trees_, len(cols), gain_of=self._impurity)
        return made

    def _left_out(self, x: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
        """Mean prediction of each row by the trees that drew it with weight zero, for the rows that have any."""
        total, seen = 0.0, np.zeros(len(x))
        for t, tree in enumerate(self.trees_):
            out = self._weights(x, t) == 0
            p = np.asarray(tree.predict(x[:, :d]), float)
            total = total + (p.T * out).T
            seen += out
        has = seen > 0
        return (total[has].T / seen[has]).T, has

    def _score_left_out(self, held: DataFrame, others: list[str]) -> None:
        if not self.bootstrap:
            raise ValueError("left-out scores need bootstrap")
        self.oob_score_ = self._left_out_score(held, others)

    def _left_out_score(self, held: DataFrame, others: list[str]) -> float:
        """R2 over the rows that at least one tree left out."""
        d = len(self.cols)
        center = held.agg(F.avg(others[0])).first()[0]

        def part(x: np.ndarray) -> np.ndarray:
            p, has = self._left_out(x, d)
            y = x[has, d] - center
            return np.array([len(y), ((y + center - p) ** 2).sum(), y.sum(), (y * y).sum()])

        n, rest, total, square = sweep(held, [*self.cols, *others], part, 4)
        return float(1 - rest / (square - total**2 / n)) if n and square > total**2 / n else float("nan")

    @staticmethod
    def _impurity(value, cover: float) -> float:
        return cover * float(np.sum(np.square(value)))

    def fit(self, df: DataFrame, cols: Sequence[str], y: str) -> RandomForestRegressor:
        gain = lambda s: np.divide(s[..., 1] ** 2, s[..., 0], out=np.zeros(s.shape[:-1]), where=s[..., 0] > 0)
        return self._grow(df, cols, [y], lambda o: o[:, :1], 1, gain, lambda s: float(s[1] / s[0]) if s[0] else 0.0)

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        trees = self.trees_
        return by_rows(df, self.cols, lambda x: sum(t.predict(x) for t in trees) / len(trees), out)


def importances(trees: list[Tree], d: int, gain_of) -> np.ndarray:
    """Mean decrease of impurity, scaled to sum one."""
    total = np.zeros(d)
    for t in trees:
        own = np.zeros(d)
        for n, f in enumerate(t.feature):
            if f >= 0:
                own[f] += gain_of(t.value[t.left[n]], t.cover[t.left[n]]) + gain_of(t.value[t.right[n]], t.cover[t.right[n]]) - gain_of(t.value[n], t.cover[n])
        total += own / own.sum() if own.sum() > 0 else 0
    return total / total.sum() if total.sum() else total


@dataclass
class RandomForestClassifier(RandomForestRegressor):
    max_features: float | str | None = "sqrt"

    def fit(self, df: DataFrame, cols: Sequence[str], label: str) -> RandomForestClassifier:
        from .linear import _classes

        classes = _classes(df, label)
        held = df.withColumn("__y", F.coalesce(*[F.when(F.col(label) == F.lit(c), float(i)) for i, c in enumerate(classes)]))
        gain = lambda s: np.divide((s[..., 1:] ** 2).sum(-1), s[..., 0], out=np.zeros(s.shape[:-1]), where=s[..., 0] > 0)
        made = self._grow(held, cols, ["__y"], lambda o: (o[:, :1] == np.arange(len(classes))).astype(float), len(classes), gain, lambda s: (s[1:] / s[0]).tolist() if s[0] else [1 / len(classes)] * len(classes))
        made.classes_ = classes
        return made

    def _left_out_score(self, held: DataFrame, others: list[str]) -> float:
        """Accuracy over the rows that at least one tree left out."""
        d = len(self.cols)

        def part(x: np.ndarray) -> np.ndarray:
            p, has = self._left_out(x, d)
            return np.array([has.sum(), (p.reshape(has.sum(), -1).argmax(1) == x[has, d]).sum() if has.any() else 0])

        n, right = sweep(held, [*self.cols, *others], part, 2)
        return float(right / n) if n else float("nan")

    def predict_proba(self, df: DataFrame, prefix: str = "p") -> DataFrame:
        trees = self.trees_
        return by_rows(df, self.cols, lambda x: sum(t.predict(x) for t in trees) / len(trees), [f"{prefix}{k}" for k in range(len(self.classes_))])

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        names = [f"__p{k}" for k in range(len(self.classes_))]
        return self.predict_proba(df, "__p").withColumn(out, vec.argbest([F.col(n) for n in names], self.classes_)).drop(*names)


@dataclass
class HistGradientBoostingRegressor(Ensemble):
    max_iter: int = 100
    learning_rate: float = 0.1
    max_depth: int = 6
    max_bins: int = 64
    min_samples_leaf: int = 20
    l2_regularization: float = 0.0

    def _boost(self, df: DataFrame, cols: Sequence[str], y: str, outputs: int, slopes, base: np.ndarray):
        made = self._begin(cols)
        edges = bin_edges(df, cols, self.max_bins)
        raws = [f"__raw{k}" for k in range(outputs)]
        held = df.select(*cols, y, *[F.lit(float(b)).alias(c) for b, c in zip(base, raws)]).persist()
        made.trees_, made.base_ = [], base
        lam, lr, d, first = self.l2_regularization, self.learning_rate, len(cols), held
        gain = lambda s: s[..., 1] ** 2 / (s[..., 2] + lam + 1e-15)
        leaf = lambda s: float(-lr * s[1] / (s[2] + lam + 1e-15))

        def raised(x: np.ndarray, raw: np.ndarray, trees: list[Tree]) -> np.ndarray:
            raw = raw.copy()
            for k, t in enumerate(trees):
                raw[:, k % outputs] += t.predict(x)
            return raw

        seen = 0  # trees whose values are in the raw columns
        try:
            for _ in range(self.max_iter):
                if len(made.trees_) - seen >= 10 * outputs:
                    new, seen = made.trees_[seen:], len(made.trees_)
                    held = cut(by_rows(held, [*cols, *raws], lambda x, new=new: raised(x[:, :d], x[:, d:], new), raws))
                sofar = made.trees_[seen:]

                def stats(x: np.ndarray, o: np.ndarray, t: int) -> np.ndarray:
                    g, h = slopes(raised(x, o[:, 1:], sofar), o[:, 0], t)
                    return np.column_stack([np.ones(len(x)), g, h])

                made.trees_ += grow(held, cols, [y, *raws], edges, stats, 3, gain, leaf, self.max_depth, self.min_samples_leaf, trees=outputs)
        finally:
            first.unpersist()
        return made

    def _raw(self, x: np.ndarray, trees: list[Tree]) -> np.ndarray:
        raw = np.tile(self.base_, (len(x), 1))
        for k, t in enumerate(trees):
            raw[:, k % len(self.base_)] += t.predict(x)
        return raw

    def fit(self, df: DataFrame, cols: Sequence[str], y: str) -> HistGradientBoostingRegressor:
        check_finite(df, [*cols, y])
        mean = df.agg(F.avg(y)).first()[0]
        return self._boost(df, cols, y, 1, lambda raw, t, k: (raw[:, 0] - t, np.ones(len(t))), np.array([mean]))

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        made = self
        return by_rows(df, self.cols, lambda x: made._raw(x, made.trees_)[:, 0], out)

    def _tree_scale(self) -> list[float]:
        return [1.0] * len(self.trees_)

    def _base(self, output: int | None) -> float:
        return float(self.base_[output or 0])


@dataclass
class HistGradientBoostingClassifier(HistGradientBoostingRegressor):
    def fit(self, df: DataFrame, cols: Sequence[str], label: str) -> HistGradientBoostingClassifier:
        from .linear import _classes

        check_finite(df, cols)
        classes = _classes(df, label)
        held = df.withColumn("__y", F.coalesce(*[F.when(F.col(label) == F.lit(c), float(i)) for i, c in enumerate(classes)]))
        counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
        share = np.array([counts[c] for c in classes], float) / sum(counts.values())
        if len(classes) == 2:

            def slopes(raw, t, k):
                p = 1 / (1 + np.exp(-raw[:, 0]))
                return p - t, p * (1 - p)

            made = self._boost(held, cols, "__y", 1, slopes, np.array([math.log(share[1] / share[0])]))
        else:

            def slopes(raw, t, k):
                p = np.exp(raw - raw.max(1, keepdims=True))
                p = p[:, k] / p.sum(1)
                return p - (t == k), p * (1 - p)

            logs = np.log(share)
            made = self._boost(held, cols, "__y", len(classes), slopes, logs - logs.mean())
        made.classes_ = classes
        return made

    def predict_proba(self, df: DataFrame, prefix: str = "p") -> DataFrame:
        made = self

        def f(x: np.ndarray) -> np.ndarray:
            raw = made._raw(x, made.trees_)
            if raw.shape[1] == 1:
                p = 1 / (1 + np.exp(-raw[:, 0]))
                return np.column_stack([1 - p, p])
            p = np.exp(raw - raw.max(1, keepdims=True))
            return p / p.sum(1, keepdims=True)

        return by_rows(df, self.cols, f, [f"{prefix}{k}" for k in range(len(self.classes_))])

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        names = [f"__p{k}" for k in range(len(self.classes_))]
        return self.predict_proba(df, "__p").withColumn(out, vec.argbest([F.col(n) for n in names], self.classes_)).drop(*names)


@dataclass
class ForestInference(Ensemble):
    """Trees given as node arrays (for instance from another library); small trees become CASE
    expressions, larger forests run on Arrow batches."""

    trees: list[dict] = field(default_factory=list)
    classes: list | None = None
    expression_nodes: int = 400

    def load(self, cols: Sequence[str]) -> ForestInference:
        made = self._begin(cols)
        made.trees_ = []
        for t in self.trees:
            n = len(t["feature"])
            made.trees_.append(Tree([int(f) if f >= 0 else -1 for f in t["feature"]], list(map(float, t["threshold"])), list(t["left"]), list(t["right"]), [np.asarray(v, float).tolist() for v in t["value"]], list(map(float, t.get("cover", [1.0] * n)))))
        return made

    def predict_proba(self, df: DataFrame, prefix: str = "p") -> DataFrame:
        trees, k = self.trees_, len(self.classes or [0])
        names = [f"{prefix}{i}" for i in range(k)]
        if sum(len(t.feature) for t in trees) <= self.expression_nodes:
            return df.withColumns({n: vec.total([t.expression(self.cols, i if self.classes else None) for t in trees]) / len(trees) for i, n in enumerate(names)})
        return by_rows(df, self.cols, lambda x: sum(t.predict(x).reshape(len(x), -1) for t in trees) / len(trees), names)

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        held = self.predict_proba(df, "__p")
        names = [c for c in held.columns if c.startswith("__p")]
        if self.classes is None:
            return held.withColumnRenamed("__p0", out)
        return held.withColumn(out, vec.argbest([F.col(n) for n in names], self.classes)).drop(*names)
