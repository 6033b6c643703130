"""Score functions and selectors: grouped sums over the rows, choices over d numbers."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import chi2_sf, digamma, f_sf
from ..plans.pairs import TILE, Passes, strips
from ..plans.stats import centered, class_sums, gram, long_form
from ..sources.frame import restore_columns, take_columns, to_numpy
from .base import Estimator


def f_classif(df: DataFrame, cols: Sequence[str], label: str) -> tuple[np.ndarray, np.ndarray]:
    """One-way ANOVA F and p per column, from class sums of values shifted by the means."""
    means = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{k}") for k, c in enumerate(cols)]).first()
    held = df.select(label, *[(F.col(c).cast("double") - float(m)).alias(c) for c, m in zip(cols, means)])
    _, n, (s1, s2) = class_sums(held, cols, label, None, (1, 2))
    total, k = n.sum(), len(n)
    between = (s1**2 / n[:, None]).sum(0) - s1.sum(0) ** 2 / total
    within = s2.sum(0) - s1.sum(0) ** 2 / total - between
    with np.errstate(divide="ignore", invalid="ignore"):
        f = (between / (k - 1)) / (within / (total - k))
    return f, np.array([f_sf(v, k - 1, total - k) for v in f])


def f_oneway(groups: Sequence[DataFrame], cols: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    both = None
    for k, g in enumerate(groups):
        part = g.select(F.lit(k).alias("__g"), *cols)
        both = part if both is None else both.unionByName(part)
    return f_classif(both, cols, "__g")


def chi2(df: DataFrame, cols: Sequence[str], label: str) -> tuple[np.ndarray, np.ndarray]:
    """Chi-squared of non-negative columns against class shares; 0/0 stays NaN."""
    if df.where(" or ".join(f"`{c}` < 0" for c in cols)).limit(1).count():
        raise ValueError("features must not be negative")
    _, n, (seen,) = class_sums(df, cols, label)
    expected = np.outer(n / n.sum(), seen.sum(0))
    with np.errstate(divide="ignore", invalid="ignore"):
        x = ((seen - expected) ** 2 / expected).sum(0)
    return x, np.array([chi2_sf(v, len(n) - 1) for v in x])


def r_regression(df: DataFrame, cols: Sequence[str], y: str, center: bool = True, force_finite: bool = True) -> np.ndarray:
    c = centered(df, [*cols, y])[2] if center else gram(df, [*cols, y])[1:, 1:]
    with np.errstate(divide="ignore", invalid="ignore"):
        r = c[:-1, -1] / np.sqrt(np.diag(c)[:-1] * c[-1, -1])
    return np.where(np.isnan(r), 0.0, r) if force_finite else r


def f_regression(df: DataFrame, cols: Sequence[str], y: str, center: bool = True, force_finite: bool = True) -> tuple[np.ndarray, np.ndarray]:
    r, n = r_regression(df, cols, y, center, force_finite), df.count()
    dof = n - (2 if center else 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        f = r**2 / (1 - r**2) * dof
    p = np.array([f_sf(v, 1, dof) for v in f])
    if force_finite:
        top = np.isinf(f)
        f, p = np.where(top, np.finfo(float).max, f), np.where(top, 0.0, p)
        f, p = np.where(np.isnan(f), 0.0, f), np.where(np.isnan(p), 1.0, p)
    return f, p


def mutual_info_discrete(df: DataFrame, cols: Sequence[str], label: str) -> np.ndarray:
    """Plug-in mutual information of discrete columns with a discrete label (natural logs)."""
    cells = long_form(df, cols, [label]).groupBy("feature", "value", label).agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    row, col, all_ = (F.sum("n").over(Window.partitionBy("feature", *k)) for k in (["value"], [label], []))
    parts = cells.select("feature", (n / all_ * F.log(n * all_ / (row * col))).alias("i"))
    got = {r.feature: r.i for r in parts.groupBy("feature").agg(F.sum("i").alias("i")).collect()}
    return np.array([max(0.0, got[k]) for k in range(len(cols))])


def nearest_in_line(x: np.ndarray, k: int) -> np.ndarray:
    """Distance of each number to its k-th nearest other one: in sorted order it is at most k places away."""
    order = np.argsort(x, kind="stable")
    v, out = x[order], np.empty(len(x))
    around = np.arange(-k, k + 1)
    step = max(1, TILE // len(around))
    for s in range(0, len(v), step):
        at = np.arange(s, min(s + step, len(v)))[:, None] + around
        d = np.where((at >= 0) & (at < len(v)), np.abs(v[np.clip(at, 0, len(v) - 1)] - v[s : s + len(at), None]), np.inf)
        out[order[s : s + len(at)]] = np.partition(d, k, axis=1)[:, k]
    return out


def inside(x: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """How many numbers, each one itself included, lie within each one's radius.  Differences are compared with the radius,
    as they were when it was found: ``x + radius`` may round to a number just outside."""
    v = np.sort(x)

    def first(holds) -> np.ndarray:
        low, high = np.zeros(len(x), int), np.full(len(x), len(x))
        while (going := low < high).any():
            middle = (low + high) // 2
            met = holds(v[np.minimum(middle, len(x) - 1)])
            low, high = np.where(going & ~met, middle + 1, low), np.where(going & met, middle, high)
        return low

    return first(lambda w: w - x > radius) - first(lambda w: x - w <= radius)


def _mutual_info(df: DataFrame, cols: Sequence[str], y: str, discrete: bool, k: int, seed: int, id_col: str) -> np.ndarray:
    """k-nearest-neighbour estimators.  The driver and each worker hold the columns; with a discrete target a task sorts
    one feature within each class, with a continuous one tasks take ranges of rows against all rows."""
    both = to_numpy(df, [*cols, y], id_col, None)
    n, target = len(both), both[:, -1]
    rng = np.random.RandomState(seed)
    scaled = np.empty((len(cols), n))
    for f, c in enumerate(both[:, :-1].T):
        s = c.std()
        c = c / s if s else c
        scaled[f] = c + 1e-10 * max(1, np.abs(c).mean()) * rng.standard_normal(len(c))
    if not discrete:
        target = target / target.std() if target.std() else target
        target = target + 1e-10 * max(1, np.abs(target).mean()) * rng.standard_normal(len(target))

    def by_class(at: int, _: int, x: np.ndarray, t: np.ndarray) -> np.ndarray:
        x, (radius, size, near) = x[at], np.zeros((3, n))
        for m in np.split(np.argsort(t, kind="stable"), np.flatnonzero(np.diff(np.sort(t))) + 1):
            if len(m) > 1:
                near[m] = kk = min(k, len(m) - 1)
                radius[m] = np.nextafter(nearest_in_line(x[m], kk), 0)
            size[m] = len(m)
        use = size > 1
        return digamma(use.sum()) + digamma(near[use]).mean() - digamma(size[use]).mean() - digamma(inside(x[use], radius[use])).mean()

    def radii(i: int, j: int, x: np.ndarray, t: np.ndarray) -> np.ndarray:
        out = np.empty((j - i, len(x)))
        for rows in strips(i, j, n):
            gap = np.abs(t[rows, None] - t)
            for f in range(len(x)):
                d = np.maximum(np.abs(x[f, rows, None] - x[f]), gap)
                out[rows.start - i : rows.stop - i, f] = np.nextafter(np.partition(d, k, axis=1)[:, k], 0)
        return out

    with Passes(df.sparkSession, scaled, np.ascontiguousarray(target)) as passes:
        if discrete:
            got = passes.run(by_class, 1, len(cols), most=1)[:, 0]
        else:
            radius = passes.run(radii, len(cols), n).T
            got = np.array([digamma(n) + digamma(k) - digamma(inside(x, r)).mean() - digamma(inside(target, r)).mean() for x, r in zip(scaled, radius)])
    return np.maximum(0.0, got.astype(float))


def mutual_info_classif(df: DataFrame, cols: Sequence[str], label: str, id_col: str, n_neighbors: int = 3, random_state: int = 0) -> np.ndarray:
    return _mutual_info(df, cols, label, True, n_neighbors, random_state, id_col)


def mutual_info_regression(df: DataFrame, cols: Sequence[str], y: str, id_col: str, n_neighbors: int = 3, random_state: int = 0) -> np.ndarray:
    return _mutual_info(df, cols, y, False, n_neighbors, random_state, id_col)


class Selector(Estimator):
    support_: np.ndarray

    def get_support(self, indices: bool = False) -> np.ndarray:
        self._fitted()
        return np.flatnonzero(self.support_) if indices else self.support_

    def get_feature_names_out(self) -> list[str]:
        return [c for c, m in zip(self.cols, self.support_) if m]

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        return take_columns(df, self.cols, self.get_support(), keep)

    def inverse_transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        return restore_columns(df, self.cols, self.get_support(), keep)


@dataclass
class VarianceThreshold(Selector):
    """NaN and null are skipped; with threshold 0 a column must also have a range."""

    threshold: float = 0.0

    def fit(self, df: DataFrame, cols: Sequence[str]) -> VarianceThreshold:
        made = self._begin(cols)
        x = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in cols}
        row = df.agg(*[f(x[c]).alias(f"{n}{k}") for k, c in enumerate(cols) for n, f in (("v", F.var_pop), ("a", F.min), ("b", F.max))]).first()
        v = np.array([row[f"v{k}"] if row[f"v{k}"] is not None else np.nan for k in range(len(cols))], float)
        if self.threshold == 0:
            v = np.fmin(v, np.array([(row[f"b{k}"] - row[f"a{k}"]) if row[f"a{k}"] is not None else np.nan for k in range(len(cols))], float))
        made.variances_, made.support_ = v, v > self.threshold
        if not made.support_.any():
            raise ValueError("no column meets the threshold")
        return made


def k_best(scores: np.ndarray, k: int) -> np.ndarray:
    """The k best scores, NaN worst, ties to the higher position."""
    s = np.where(np.isnan(scores), np.finfo(float).min, scores)
    out = np.zeros(len(s), bool)
    out[np.argsort(s, kind="stable")[len(s) - k :]] = True
    return out


def top_percentile(scores: np.ndarray, percentile: float) -> np.ndarray:
    if percentile in (0, 100):
        return np.full(len(scores), percentile == 100)
    s = np.where(np.isnan(scores), np.finfo(float).min, scores)
    edge = np.percentile(s, 100 - percentile)
    out = s > edge
    room = int(len(s) * percentile / 100) - out.sum()
    out[np.flatnonzero(s == edge)[: max(room, 0)]] = True
    return out


def benjamini_hochberg(p: np.ndarray, alpha: float) -> np.ndarray:
    order = np.sort(p)
    good = order[order <= alpha / len(p) * np.arange(1, len(p) + 1)]
    return p <= good.max() if len(good) else np.zeros(len(p), bool)


@dataclass
class GenericUnivariateSelect(Selector):
    score_func: Callable = f_classif
    mode: str = "percentile"
    param: float | str = 1e-5

    def fit(self, df: DataFrame, cols: Sequence[str], y: str) -> GenericUnivariateSelect:
        made = self._begin(cols)
        got = self.score_func(df, cols, y)
        made.scores_, made.pvalues_ = got if isinstance(got, tuple) else (got, None)
        s, p = made.scores_, made.pvalues_
        if self.mode == "k_best":
            k = len(cols) if self.param == "all" else int(self.param)
            if not 0 <= k <= len(cols):
                raise ValueError("k is out of range")
            made.support_ = k_best(s, k)
        elif self.mode == "percentile":
            made.support_ = top_percentile(s, self.param)
        elif self.mode == "fpr":
            made.support_ = p < self.param
        elif self.mode == "fwe":
            made.support_ = p < self.param / len(p)
        elif self.mode == "fdr":
            made.support_ = benjamini_hochberg(p, self.param)
        else:
            raise ValueError(f"unknown mode {self.mode!r}")
        return made


def SelectKBest(score_func=f_classif, k: int | str = 10) -> GenericUnivariateSelect:
    return GenericUnivariateSelect(score_func, "k_best", k)


def SelectPercentile(score_func=f_classif, percentile: float = 10) -> GenericUnivariateSelect:
    return GenericUnivariateSelect(score_func, "percentile", percentile)


def SelectFpr(score_func=f_classif, alpha: float = 0.05) -> GenericUnivariateSelect:
    return GenericUnivariateSelect(score_func, "fpr", alpha)


def SelectFdr(score_func=f_classif, alpha: float = 0.05) -> GenericUnivariateSelect:
    return GenericUnivariateSelect(score_func, "fdr", alpha)


def SelectFwe(score_func=f_classif, alpha: float = 0.05) -> GenericUnivariateSelect:
    return GenericUnivariateSelect(score_func, "fwe", alpha)


def importance_of(model) -> np.ndarray:
    """Size of each feature in a fitted model (norm over outputs)."""
    if hasattr(model, "feature_importances_"):
        return np.asarray(model.feature_importances_)
    coef = np.asarray(model.coef_)
    return np.abs(coef) if coef.ndim == 1 else np.abs(coef).sum(0)


@dataclass
class SelectFromModel(Selector):
    estimator: object = None
    threshold: str | float | None = None
    max_features: int | None = None

    def fit(self, df: DataFrame, cols: Sequence[str], y: str) -> SelectFromModel:
        made = self._begin(cols)
        made.estimator_ = self.estimator.fit(df, cols, y)
        v = importance_of(made.estimator_)
        t = self.threshold
        if t is None:
            sparse = type(self.estimator).__name__ in ("Lasso",) or getattr(self.estimator, "penalty", None) == "l1"
            t = 1e-5 if sparse else "mean"
        if isinstance(t, str):
            scale, _, name = t.rpartition("*")
            t = (float(scale) if scale else 1.0) * {"mean": v.mean(), "median": np.median(v)}[name.strip()]
        made.threshold_ = float(t)
        keep = np.ones(len(v), bool)
        if self.max_features is not None:
            keep[:] = False
            keep[np.argsort(-v, kind="stable")[: self.max_features]] = True
        made.support_ = keep & (v >= t)
        return made


@dataclass
class RFE(Selector):
    """Repeated fits, dropping the columns of smallest squared weight."""

    estimator: object = None
    n_features_to_select: int | float | None = None
    step: int | float = 1

    def fit(self, df: DataFrame, cols: Sequence[str], y: str) -> RFE:
        made = self._begin(cols)
        d = len(cols)
        goal = d // 2 if self.n_features_to_select is None else max(1, int(self.n_features_to_select * d)) if isinstance(self.n_features_to_select, float) else self.n_features_to_select
        step = max(1, int(self.step * d)) if isinstance(self.step, float) else self.step
        keep, rank = np.ones(d, bool), np.ones(d, int)
        while keep.sum() > goal:
            own = np.flatnonzero(keep)
            model = self.estimator.fit(df, [cols[k] for k in own], y)
            weight = np.asarray(getattr(model, "feature_importances_", None) if hasattr(model, "feature_importances_") else model.coef_) ** 2
            weight = weight if weight.ndim == 1 else weight.sum(0)
            gone = own[np.argsort(weight, kind="stable")[: min(step, keep.sum() - goal)]]
            keep[gone] = False
            rank[~keep] += 1
        made.support_, made.ranking_, made.n_features_ = keep, rank, int(keep.sum())
        made.estimator_ = self.estimator.fit(df, made.get_feature_names_out(), y)
        return made


@dataclass
class RFECV(Selector):
    estimator: object = None
    score: Callable = None
    cv: object = None
    step: int = 1
    min_features_to_select: int = 1

    def fit(self, df: DataFrame, cols: Sequence[str], y: str, id_col: str) -> RFECV:
        """``score(model, df, y) -> float``; higher is better, ties go to fewer columns."""
        made = self._begin(cols)
        sizes = sorted({max(self.min_features_to_select, len(cols) - k * self.step) for k in range(len(cols))})
        table = []
        for train, test in self.cv.split(df, id_col, y):
            row = []
            for s in sizes:
                r = RFE(self.estimator, s, self.step).fit(train, cols, y)
                row.append(self.score(r.estimator_, test, y))
            table.append(row)
        made.cv_results_ = {"n_features": sizes, "mean_test_score": np.mean(table, 0), "std_test_score": np.std(table, 0)}
        best = sizes[int(np.argmax(np.mean(table, 0)))]
        final = RFE(self.estimator, best, self.step).fit(df, cols, y)
        made.support_, made.ranking_, made.n_features_, made.estimator_ = final.support_, final.ranking_, best, final.estimator_
        return made


@dataclass
class SequentialFeatureSelector(Selector):
    estimator: object = None
    score: Callable = None
    cv: object = None
    n_features_to_select: int | str = "auto"
    tol: float | None = None
    direction: str = "forward"

    def fit(self, df: DataFrame, cols: Sequence[str], y: str, id_col: str) -> SequentialFeatureSelector:
        made = self._begin(cols)
        d, forward = len(cols), self.direction == "forward"
        goal = (d if forward else 1) if self.n_features_to_select == "auto" and self.tol is not None else d // 2 if self.n_features_to_select == "auto" else self.n_features_to_select
        folds = [(a.persist(), b.persist()) for a, b in self.cv.split(df, id_col, y)]
        mask, old = np.full(d, not forward), -math.inf
        try:
            for _ in range(goal if forward else d - goal):
                tried = {}
                for k in np.flatnonzero(mask != forward):
                    now = mask.copy()
                    now[k] = forward
                    names = [c for c, m in zip(cols, now) if m]
                    tried[int(k)] = float(np.mean([self.score(self.estimator.fit(a, names, y), b, y) for a, b in folds]))
                best = max(tried, key=lambda k: (tried[k], -k))
                if self.tol is not None and self.n_features_to_select == "auto" and tried[best] - old < self.tol:
                    break
                mask[best], old = forward, tried[best]
        finally:
            for a, b in folds:
                a.unpersist()
                b.unpersist()
        made.support_ = mask
        return made
