"""Linear models: one Gram aggregate and a small solve, or a few gradient sweeps."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import solve, vec
from ..plans.stats import centered, check_finite, gram, sweep
from .base import Estimator, by_rows, put
from .model_selection import check_cv, numbered


class Linear(Estimator):
    coef_: np.ndarray
    intercept_: float

    def expression(self) -> Column:
        self._fitted()
        return vec.linear(self.cols, self.coef_, self.intercept_)

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        return df.withColumn(out, self.expression())


def _moments(df: DataFrame, cols: Sequence[str], y: Sequence[str], weight: str | None, intercept: bool):
    """``(weight sum, x means, y means, Gram, cross products, y squares)``, centered if there is an intercept."""
    d = len(cols)
    check_finite(df, [*cols, *y, *([weight] if weight else [])])
    if intercept:
        n, mean, c = centered(df, [*cols, *y], weight)
    else:
        g = gram(df, [*cols, *y], None, weight)
        n, mean, c = g[0, 0], np.zeros(d + len(y)), g[1:, 1:]
    return n, mean[:d], mean[d:], c[:d, :d], c[:d, d:], np.diag(c)[d:]


@dataclass
class LinearRegression(Linear):
    fit_intercept: bool = True

    def fit(self, df: DataFrame, cols: Sequence[str], y: str, weight: str | None = None) -> LinearRegression:
        made = self._begin(cols)
        _, mx, my, g, r, _ = _moments(df, cols, [y], weight, self.fit_intercept)
        made.coef_ = solve.pseudo_solve(g, r[:, 0])
        made.intercept_ = float(my[0] - mx @ made.coef_)
        return made


@dataclass
class Ridge(Linear):
    """Every solver name of the common interface leads to the same exact minimiser."""

    alpha: float | Sequence[float] = 1.0
    fit_intercept: bool = True
    positive: bool = False
    solver: str = "auto"

    SOLVERS = ("auto", "svd", "cholesky", "lsqr", "sparse_cg", "sag", "saga", "lbfgs")

    def fit(self, df: DataFrame, cols: Sequence[str], y: str | Sequence[str], weight: str | None = None) -> Ridge:
        if self.solver not in self.SOLVERS:
            raise ValueError(f"unknown solver {self.solver!r}")
        if np.min(self.alpha) < 0:
            raise ValueError("alpha must not be negative")
        made = self._begin(cols)
        targets = [y] if isinstance(y, str) else list(y)
        _, mx, my, g, r, _ = _moments(df, cols, targets, weight, self.fit_intercept)
        alphas = np.broadcast_to(np.asarray(self.alpha, float), len(targets))
        one = lambda a, b: solve.nnls(g + a * np.eye(len(g)), b) if self.positive else np.linalg.solve(g + a * np.eye(len(g)), b) if a > 0 else solve.pseudo_solve(g, b)
        w = np.array([one(a, r[:, k]) for k, a in enumerate(alphas)])
        c = my - w @ mx
        made.coef_, made.intercept_ = (w[0], float(c[0])) if isinstance(y, str) else (w, c)
        return made

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        return _predict_all(self, df, out)


@dataclass
class RidgeCV(Linear):
    """Choice of alpha, for one target or several.

    Without ``cv`` by leaving out one row, in closed form: one Gram pass and one residual pass for all alphas.
    With ``cv`` (a number of folds or a splitter; needs ``id_col``) by one Gram pass and one scoring pass a fold,
    again for all alphas together.  ``scoring(df, y, prediction) -> float`` judges predictions instead of the
    squared error (leaving one out) or R2 (folds), larger being better; it runs once an alpha and target.
    ``alpha_per_target`` (only without ``cv``) chooses for each target alone."""

    alphas: Sequence[float] = (0.1, 1.0, 10.0)
    fit_intercept: bool = True
    scoring: Callable | None = None
    cv: object = None
    alpha_per_target: bool = False
    store_cv_results: bool = False

    def fit(self, df: DataFrame, cols: Sequence[str], y: str | Sequence[str], weight: str | None = None, id_col: str | None = None) -> RidgeCV:
        if np.min(self.alphas) <= 0:
            raise ValueError("alphas must be positive")
        if self.cv is not None and (self.alpha_per_target or self.store_cv_results):
            raise ValueError("alpha_per_target and store_cv_results need cv=None")
        if self.cv is not None and id_col is None:
            raise ValueError("folds need id_col")
        made = self._begin(cols)
        targets = [y] if isinstance(y, str) else list(y)
        alphas = np.asarray(self.alphas, float)
        n, mx, my, g, r, _ = _moments(df, cols, targets, weight, self.fit_intercept)
        inverse, vector, coefs = _ridge_path(g, r, alphas)
        made.loo_ = {"targets": targets, "weight": weight, "mx": mx, "my": my, "vector": vector, "inverse": inverse, "coefs": coefs, "shift": 1 / n if self.fit_intercept else 0.0}
        scores = made._left_out(df, n) if self.cv is None else made._folds(df, targets, weight, id_col)
        if self.cv is None and self.scoring is None:
            made.cv_errors_ = -(scores[:, 0] if isinstance(y, str) else scores)
        own = self.alpha_per_target and len(targets) > 1
        best = scores.argmax(0) if own else np.full(len(targets), int(scores.mean(1).argmax()))
        w = coefs[best, :, np.arange(len(targets))]
        c = my - w @ mx
        made.alpha_ = alphas[best] if own else float(alphas[best[0]])
        made.best_score_ = scores[best, np.arange(len(targets))] if own else float(scores[best[0]].mean())
        made.coef_, made.intercept_ = (w[0], float(c[0])) if isinstance(y, str) else (w, c)
        if not self.store_cv_results:
            del made.loo_
        return made

    def _rest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Left-out residuals (rows x alphas x targets) of rows of features, targets and weight, and the weights."""
        h = self.loo_
        d, k = len(h["mx"]), len(h["my"])
        w = x[:, d + k] if h["weight"] else np.ones(len(x))
        z, t = x[:, :d] - h["mx"], x[:, d : d + k] - h["my"]
        # weighted rows: leverage scales with the weight
        leverage = w[:, None] * ((z @ h["vector"]) ** 2 @ h["inverse"].T + h["shift"])
        return (t[:, None, :] - np.einsum("nd,adk->nak", z, h["coefs"])) / (1 - leverage)[:, :, None], w

    def _inputs(self) -> list[str]:
        return [*self.cols, *self.loo_["targets"], *([self.loo_["weight"]] if self.loo_["weight"] else [])]

    def _left_out(self, df: DataFrame, n: float) -> np.ndarray:
        shape = (len(self.alphas), len(self.loo_["targets"]))

        def part(x: np.ndarray) -> np.ndarray:
            e, w = self._rest(x)
            return np.einsum("n,nak->ak", w, e * e).ravel()

        if self.scoring is None:
            return -sweep(df, self._inputs(), part, shape[0] * shape[1]).reshape(shape) / n
        out = np.empty(shape)
        names = [f"__e{j}" for j in range(out.size)]
        held = by_rows(df, self._inputs(), lambda x: self._rest(x)[0].reshape(len(x), -1), names)
        for j, name in enumerate(names):
            target = self.loo_["targets"][j % shape[1]]
            out.flat[j] = self.scoring(held.withColumn("__p", F.col(target) - F.col(name)), target, "__p")
        return out

    def _folds(self, df: DataFrame, targets: list[str], weight: str | None, id_col: str) -> np.ndarray:
        alphas, out = np.asarray(self.alphas, float), []
        for train, test in check_cv(self.cv).split(df, id_col, targets[0]):
            _, mx, my, g, r, _ = _moments(train, self.cols, targets, weight, self.fit_intercept)
            coefs = _ridge_path(g, r, alphas)[2]
            predicted = [[vec.linear(self.cols, w, float(m - w @ mx)) for w, m in zip(c.T, my)] for c in coefs]
            if self.scoring is None:
                errors = [F.sum((F.col(t) - p) * (F.col(t) - p)) for row in predicted for t, p in zip(targets, row)]
                row = test.agg(*errors, *[F.var_pop(t) * F.count(t) for t in targets]).first()
                out.append(1 - np.array(row[: -len(targets)], float).reshape(len(alphas), -1) / np.array(row[-len(targets) :], float))
            else:
                out.append([[self.scoring(test.withColumn("__p", p), t, "__p") for t, p in zip(targets, row)] for row in predicted])
        return np.mean(out, 0)

    def cv_results(self, df: DataFrame, out: str = "cv_results") -> DataFrame:
        """The training rows with their squared left-out errors, one value an alpha (by target for several)."""
        if not hasattr(self, "loo_"):
            raise ValueError("store_cv_results was not set")
        k, a = len(self.loo_["targets"]), len(self.alphas)
        names = [f"__e{j}" for j in range(a * k)]
        held = by_rows(df, self._inputs(), lambda x: self._rest(x)[0].reshape(len(x), -1) ** 2, names)
        lists = [F.array(*[F.col(names[i * k + j]) for i in range(a)]) for j in range(k)]
        return held.withColumn(out, lists[0] if k == 1 else F.array(*lists)).drop(*names)

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        return _predict_all(self, df, out)


def _ridge_path(g: np.ndarray, r: np.ndarray, alphas: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inverse penalised eigenvalues (alphas x features), eigenvectors, and weights (alphas x features x targets)."""
    value, vector = np.linalg.eigh(g)
    inverse = 1 / (np.maximum(value, 0)[None, :] + alphas[:, None])
    return inverse, vector, np.einsum("fe,ae,ek->afk", vector, inverse, vector.T @ r)


def _predict_all(model, df: DataFrame, out: str) -> DataFrame:
    if model.coef_.ndim == 1:
        return df.withColumn(out, model.expression())
    return df.withColumn(out, F.array(*[vec.linear(model.cols, w, b) for w, b in zip(model.coef_, model.intercept_)]))


class LinearClassifier(Estimator):
    """One decision value a class (one in all for two classes); label by the largest or the sign."""

    classes_: list
    coef_: np.ndarray
    intercept_: np.ndarray

    def decisions(self) -> list[Column]:
        self._fitted()
        return [vec.linear(self.cols, w, b) for w, b in zip(self.coef_, self.intercept_)]

    def decision_function(self, df: DataFrame, out: str = "decision") -> DataFrame:
        d = self.decisions()
        return df.withColumn(out, d[0] if len(d) == 1 else F.array(*d))

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        d = self.decisions()
        if len(d) == 1:
            return df.withColumn(out, F.when(d[0] > 0, F.lit(self.classes_[1])).otherwise(F.lit(self.classes_[0])))
        names = [f"__d{k}" for k in range(len(d))]
        return put(df, dict(zip(names, d))).withColumn(out, vec.argbest([F.col(n) for n in names], self.classes_)).drop(*names)


def _classes(df: DataFrame, label: str) -> list:
    rows = df.select(label).distinct().orderBy(label).limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("more than 10,000 classes")
    if len(rows) < 2:
        raise ValueError("at least two classes are needed")
    return [r[0] for r in rows]


def _signs(df: DataFrame, label: str, classes: list) -> tuple[DataFrame, list[str]]:
    """One column of +1 and -1 per one-versus-rest problem."""
    own = classes[1:] if len(classes) == 2 else classes
    names = [f"__y{k}" for k in range(len(own))]
    return put(df, {n: F.when(F.col(label) == F.lit(c), 1.0).otherwise(-1.0) for n, c in zip(names, own)}), names


@dataclass
class RidgeClassifier(LinearClassifier):
    alpha: float = 1.0
    fit_intercept: bool = True
    class_weight: dict | str | None = None
    positive: bool = False
    solver: str = "auto"

    def fit(self, df: DataFrame, cols: Sequence[str], label: str, weight: str | None = None) -> RidgeClassifier:
        made = self._begin(cols)
        made.classes_ = _classes(df, label)
        held, ys = _signs(df, label, made.classes_)
        if self.class_weight is not None:
            table = self.class_weight
            if table == "balanced":
                counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
                table = {c: sum(counts.values()) / (len(counts) * n) for c, n in counts.items()}
            own = F.coalesce(*[F.when(F.col(label) == F.lit(c), float(v)) for c, v in table.items()], F.lit(1.0))
            held = held.withColumn("__cw", own * (F.lit(1.0) if weight is None else F.col(weight)))
            weight = "__cw"
        fitted = Ridge(self.alpha, self.fit_intercept, self.positive, self.solver).fit(held, cols, ys, weight)
        made.coef_, made.intercept_ = fitted.coef_, fitted.intercept_
        return made


@dataclass
class BayesianRidge(Linear):
    """Evidence maximisation over the spectrum of one Gram matrix."""

    max_iter: int = 300
    tol: float = 1e-3
    alpha_1: float = 1e-6
    alpha_2: float = 1e-6
    lambda_1: float = 1e-6
    lambda_2: float = 1e-6
    fit_intercept: bool = True

    def fit(self, df: DataFrame, cols: Sequence[str], y: str, weight: str | None = None) -> BayesianRidge:
        made = self._begin(cols)
        n, mx, my, g, r, yy = _moments(df, cols, [y], weight, self.fit_intercept)
        value, vector = np.linalg.eigh(g)
        value = np.maximum(value, 0)
        turned = vector.T @ r[:, 0]
        eps = np.finfo(float).eps
        alpha, lam = 1 / (yy[0] / n + eps), 1.0

        def posterior() -> tuple[np.ndarray, float]:
            w = vector @ (turned / (value + lam / alpha))
            return w, max(yy[0] - 2 * w @ r[:, 0] + w @ g @ w, 0.0)

        old = None
        for k in range(self.max_iter):
            w, rss = posterior()
            gamma = (alpha * value / (lam + alpha * value)).sum()
            lam = (gamma + 2 * self.lambda_1) / (w @ w + 2 * self.lambda_2)
            alpha = (n - gamma + 2 * self.alpha_1) / (rss + 2 * self.alpha_2)
            if old is not None and np.abs(old - w).sum() < self.tol:
                break
            old = w
        made.n_iter_ = k + 1
        made.coef_, _ = posterior()
        made.alpha_, made.lambda_ = float(alpha), float(lam)
        made.sigma_ = (vector / (lam + alpha * value)) @ vector.T
        made.x_mean_ = mx
        made.intercept_ = float(my[0] - mx @ made.coef_)
        return made

    def predict_std(self, df: DataFrame, out: str = "std") -> DataFrame:
        z = [F.col(c).cast("double") - float(m) for c, m in zip(self.cols, self.x_mean_)]
        square = vec.total([z[i] * z[j] * float(self.sigma_[i, j]) for i in range(len(z)) for j in range(len(z))])
        return df.withColumn(out, F.sqrt(square + 1 / self.alpha_))


@dataclass
class ElasticNet(Linear):
    alpha: float = 1.0
    l1_ratio: float = 0.5
    fit_intercept: bool = True
    max_iter: int = 10_000
    tol: float = 1e-10

    def fit(self, df: DataFrame, cols: Sequence[str], y: str, weight: str | None = None) -> ElasticNet:
        made = self._begin(cols)
        n, mx, my, g, r, _ = _moments(df, cols, [y], weight, self.fit_intercept)
        made.coef_, made.n_iter_ = solve.coordinate_descent(g / n, r[:, 0] / n, self.alpha * self.l1_ratio, self.alpha * (1 - self.l1_ratio), self.max_iter, self.tol)
        made.intercept_ = float(my[0] - mx @ made.coef_)
        return made


@dataclass
class Lasso(ElasticNet):
    l1_ratio: float = 1.0


def _minimise(df: DataFrame, columns: Sequence[str], part: Callable[[np.ndarray, np.ndarray], tuple[float, np.ndarray]], penalty: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, rounds: int, tol: float) -> tuple[np.ndarray, int]:
    """L-BFGS whose every evaluation is one Arrow sweep over the cached feature columns."""
    held = df.select(*columns).persist()

    def objective(w: np.ndarray) -> tuple[float, np.ndarray]:
        both = sweep(held, columns, lambda x: np.concatenate([[(v := part(x, w))[0]], v[1]]), len(w) + 1)
        loss, slope = penalty(w)
        return both[0] + loss, both[1:] + slope

    try:
        return solve.lbfgs(objective, start, rounds, tol)
    finally:
        held.unpersist()


@dataclass
class LogisticRegression(LinearClassifier):
    """Multinomial logistic loss over n rows plus |w|^2 / (2 C n), intercepts free."""

    C: float = 1.0
    fit_intercept: bool = True
    max_iter: int = 200
    tol: float = 1e-7

    def fit(self, df: DataFrame, cols: Sequence[str], label: str, weight: str | None = None) -> LogisticRegression:
        made = self._begin(cols)
        n = check_finite(df, cols)
        made.classes_ = _classes(df, label)
        k, d = len(made.classes_), len(cols)
        code = F.coalesce(*[F.when(F.col(label) == F.lit(c), float(i)) for i, c in enumerate(made.classes_)])
        held = df.withColumn("__y", code)
        bias = float(self.fit_intercept)

        def part(x: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
            m = w.reshape(k, d + 1)
            z = np.concatenate([x[:, :d], np.full((len(x), 1), bias)], 1)
            u = x[:, d + 1] if weight else np.ones(len(x))
            s = z @ m.T
            norm = solve.logsumexp(s, 1)
            own = x[:, d].astype(int)
            p = np.exp(s - norm[:, None])
            p[np.arange(len(x)), own] -= 1
            return float((u * (norm - s[np.arange(len(x)), own])).sum()) / n, ((p * u[:, None]).T @ z).ravel() / n

        def penalty(w: np.ndarray) -> tuple[float, np.ndarray]:
            m = w.reshape(k, d + 1).copy()
            m[:, -1] = 0
            return float((m**2).sum()) / (2 * self.C * n), m.ravel() / (self.C * n)

        w, made.n_iter_ = _minimise(held, [*cols, "__y", *([weight] if weight else [])], part, penalty, np.zeros(k * (d + 1)), self.max_iter, self.tol)
        m = w.reshape(k, d + 1)
        made.scores_coef_, made.scores_bias_ = m[:, :-1], m[:, -1] * bias
        if k == 2:
            made.coef_, made.intercept_ = (m[1:] - m[:1])[:, :-1], (m[1:] - m[:1])[:, -1] * bias
        else:
            made.coef_, made.intercept_ = made.scores_coef_, made.scores_bias_
        return made

    def predict_proba(self, df: DataFrame, out: str = "probability") -> DataFrame:
        names = [f"__s{k}" for k in range(len(self.classes_))]
        scores = {n: vec.linear(self.cols, w, b) for n, w, b in zip(names, self.scores_coef_, self.scores_bias_)}
        return put(df, scores).withColumn(out, F.array(*vec.softmax([F.col(n) for n in names]))).drop(*names)


def _svm(df, cols, target, C, scaling, intercept, loss, slope, rounds, tol, weight=None):
    """Primal fit with a penalised synthetic intercept column."""
    d = len(cols)

    def part(x: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.concatenate([x[:, :d], np.full((len(x), 1), scaling if intercept else 0.0)], 1)
        s, y = z @ w, x[:, d]
        u = C * (x[:, d + 1] if weight else np.ones(len(x)))
        return float((u * loss(s, y)).sum()), z.T @ (u * slope(s, y))

    w, n = _minimise(df, [*cols, target, *([weight] if weight else [])], part, lambda w: (0.5 * float(w @ w), w), np.zeros(d + 1), rounds, tol)
    return w[:-1], float(w[-1] * scaling * intercept), n


@dataclass
class LinearSVC(LinearClassifier):
    C: float = 1.0
    fit_intercept: bool = True
    intercept_scaling: float = 1.0
    max_iter: int = 500
    tol: float = 1e-6

    def fit(self, df: DataFrame, cols: Sequence[str], label: str, weight: str | None = None) -> LinearSVC:
        made = self._begin(cols)
        check_finite(df, cols)
        made.classes_ = _classes(df, label)
        held, ys = _signs(df, label, made.classes_)
        loss = lambda s, y: np.maximum(0, 1 - y * s) ** 2
        slope = lambda s, y: -2 * y * np.maximum(0, 1 - y * s)
        found = [_svm(held, cols, y, self.C, self.intercept_scaling, self.fit_intercept, loss, slope, self.max_iter, self.tol, weight) for y in ys]
        made.coef_, made.intercept_ = np.array([f[0] for f in found]), np.array([f[1] for f in found])
        return made


@dataclass
class LinearSVR(Linear):
    """Squared epsilon-insensitive loss."""

    C: float = 1.0
    epsilon: float = 0.0
    fit_intercept: bool = True
    intercept_scaling: float = 1.0
    max_iter: int = 500
    tol: float = 1e-6

    def fit(self, df: DataFrame, cols: Sequence[str], y: str, weight: str | None = None) -> LinearSVR:
        made = self._begin(cols)
        check_finite(df, [*cols, y])
        over = lambda s, t: np.maximum(0, np.abs(s - t) - self.epsilon)
        made.coef_, made.intercept_, made.n_iter_ = _svm(df, cols, y, self.C, self.intercept_scaling, self.fit_intercept, lambda s, t: over(s, t) ** 2, lambda s, t: 2 * np.sign(s - t) * over(s, t), self.max_iter, self.tol, weight)
        return made


@dataclass
class HuberRegressor(Linear):
    """Joint minimum over coefficients, intercept and scale of the concomitant Huber loss."""

    epsilon: float = 1.35
    alpha: float = 1e-4
    fit_intercept: bool = True
    max_iter: int = 300
    tol: float = 1e-5
    warm_start: bool = False

    def fit(self, df: DataFrame, cols: Sequence[str], y: str, weight: str | None = None) -> HuberRegressor:
        """With ``warm_start`` a fitted regressor starts from its own solution."""
        if self.epsilon < 1:
            raise ValueError("epsilon must be at least 1")
        made = self._begin(cols)
        check_finite(df, [*cols, y])
        d, eps = len(cols), self.epsilon
        if self.warm_start and hasattr(self, "scale_") and self.cols == list(cols):
            first = np.concatenate([self.coef_, [self.intercept_, math.log(self.scale_)]])
        else:
            start = LinearRegression(self.fit_intercept).fit(df, cols, y, weight)
            spread = sweep(df, [*cols, y], lambda x: np.array([((x[:, d] - x[:, :d] @ start.coef_ - start.intercept_) ** 2).sum(), len(x)]), 2)
            first = np.concatenate([start.coef_, [start.intercept_, 0.5 * math.log(max(spread[0] / spread[1], 1e-12))]])

        def part(x: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
            # the scale is positive through its logarithm
            sigma = math.exp(w[-1])
            u = x[:, d + 1] if weight else np.ones(len(x))
            e = x[:, d] - x[:, :d] @ w[:d] - w[d] * self.fit_intercept
            z = e / sigma
            far = np.abs(z) > eps
            h = np.where(far, 2 * eps * np.abs(z) - eps**2, z * z)
            g = np.where(far, 2 * eps * np.sign(z), 2 * z)
            slope = np.empty(d + 2)
            slope[:d] = -(x[:, :d].T @ (u * g))
            slope[d] = -(u * g).sum() * self.fit_intercept
            slope[-1] = (u * (sigma + sigma * h - e * g)).sum()
            return float((u * (sigma + h * sigma)).sum()), slope

        def penalty(w: np.ndarray) -> tuple[float, np.ndarray]:
            g = np.zeros_like(w)
            g[:d] = 2 * self.alpha * w[:d]
            return self.alpha * float(w[:d] @ w[:d]), g

        w, made.n_iter_ = _minimise(df, [*cols, y, *([weight] if weight else [])], part, penalty, first, self.max_iter, self.tol)
        made.coef_, made.intercept_, made.scale_ = w[:d], float(w[d] * self.fit_intercept), math.exp(w[-1])
        return made

    def outliers(self, df: DataFrame, y: str, out: str = "outlier") -> DataFrame:
        return df.withColumn(out, F.abs(F.col(y) - self.expression()) > self.scale_ * self.epsilon)


def places_drawn(rng: np.random.RandomState, n: int, m: int) -> list[int]:
    """``m`` different places below ``n``, all sets equally likely, without a list of ``n`` (Floyd's draw)."""
    if m > n:
        raise ValueError("fewer rows than a sample needs")
    held: dict[int, None] = {}
    for top in range(n - m, n):
        at = int(rng.randint(0, top + 1, dtype=np.int64))
        held[top if at in held else at] = None
    return list(held)


@dataclass
class RANSACRegressor(Linear):
    """Consensus over subsets drawn on the driver; one aggregate judges a whole batch of trials.

    ``estimator`` is any regressor with ``fit(df, cols, y)`` and ``predict(df, out)`` (least squares if None; others
    need ``min_samples``, a count or a share of the rows); ``loss`` a name or a function of the target's and the
    prediction's column.  ``is_data_valid(x, y)`` and ``is_model_valid(model, x, y)`` see the drawn rows; refused
    trials count as skips, as do those with fewer inliers than the best, and more than ``max_skips`` end the search.
    Of equal inlier counts the larger R2 over the inliers wins.  ``stop_n_inliers`` or ``stop_score`` end it early."""

    estimator: object = None
    min_samples: int | float | None = None
    residual_threshold: float | None = None
    is_data_valid: Callable | None = None
    is_model_valid: Callable | None = None
    max_trials: int = 100
    max_skips: float = math.inf
    stop_n_inliers: float = math.inf
    stop_score: float = math.inf
    stop_probability: float = 0.99
    loss: str | Callable = "absolute_error"
    random_state: int = 0
    batch: int = 10

    def _error(self, y: str, prediction: Column) -> Column:
        if callable(self.loss):
            return self.loss(F.col(y), prediction)
        if self.loss not in ("absolute_error", "squared_error"):
            raise ValueError(f"unknown loss {self.loss!r}")
        gap = F.col(y) - prediction
        return F.abs(gap) if self.loss == "absolute_error" else gap * gap

    def _sample_size(self, n: int, d: int) -> int:
        m = self.min_samples
        if m is None:
            if self.estimator is not None:
                raise ValueError("min_samples is needed with an estimator")
            return d + 1
        m = math.ceil(m * n) if isinstance(m, float) and 0 < m < 1 else int(m)
        if not 1 <= m <= n:
            raise ValueError("min_samples is outside the number of rows")
        return m

    def _trial(self, df: DataFrame, cols: Sequence[str], y: str, x: np.ndarray, t: np.ndarray):
        if self.estimator is not None:
            rows = pd.DataFrame(x, columns=list(cols)).assign(**{y: t})
            return self.estimator.fit(df.sparkSession.createDataFrame(rows), cols, y)
        made = LinearRegression()._begin(cols)
        w = np.linalg.lstsq(np.concatenate([x, np.ones((len(x), 1))], 1), t, rcond=None)[0]
        made.coef_, made.intercept_ = w[:-1], float(w[-1])
        return made

    def _judge(self, df: DataFrame, y: str, center: float, models: list, limit: float) -> list[tuple[int, float]]:
        """Number of inliers and R2 over them of each model, in one aggregate."""
        names = [f"__p{k}" for k in range(len(models))]
        for name, model in zip(names, models):
            df = model.predict(df, name)
        t, parts = F.col(y) - center, []
        for name in names:
            within = self._error(y, F.col(name)) <= limit
            gap = F.col(y) - F.col(name)
            parts += [F.count_if(within), *[F.sum(F.when(within, v)) for v in (gap * gap, t, t * t)]]
        row = df.agg(*[p.alias(f"a{k}") for k, p in enumerate(parts)]).first()
        out = []
        for k in range(len(models)):
            n, rest, total, square = row[4 * k : 4 * k + 4]
            spread = square - total * total / n if n else 0.0
            out.append((n, -math.inf if n < 2 else 1 - rest / spread if spread > 0 else float(rest <= 1e-24)))
        return out

    def _trials_needed(self, inliers: int, n: int, m: int) -> float:
        miss, share = 1 - self.stop_probability, (inliers / n) ** m
        if share >= 1 or miss >= 1:
            return 0
        return math.inf if share <= 0 or miss <= 0 else math.ceil(math.log(miss) / math.log1p(-share))

    def fit(self, df: DataFrame, cols: Sequence[str], y: str, id_col: str) -> RANSACRegressor:
        made = self._begin(cols)
        n = check_finite(df, [*cols, y])
        m, limit = self._sample_size(n, len(cols)), self.residual_threshold
        center = df.agg(F.avg(y)).first()[0]
        if limit is None:
            mid = df.agg(F.median(y)).first()[0]
            limit = df.agg(F.median(F.abs(F.col(y) - mid))).first()[0]
        # places are drawn, so rows are numbered once in id order
        held = numbered(df.select(id_col, *cols, y), id_col).persist()
        rng = np.random.RandomState(self.random_state)
        best, tried, needed, ended = (1, -math.inf, None), 0, self.max_trials, False
        skips = {"no_inliers": 0, "invalid_data": 0, "invalid_model": 0}
        try:
            while tried < needed and not ended:
                draws = [places_drawn(rng, n, m) for _ in range(min(self.batch, self.max_trials - tried))]
                wanted = sorted({int(i) for x in draws for i in x})
                rows = {r["__at"]: [float(r[c]) for c in (*cols, y)] for r in held.where(F.col("__at").isin(wanted)).collect()}
                trials = []
                for places in draws:
                    a = np.array([rows[int(i)] for i in places], float)
                    x, t = a[:, :-1], a[:, -1]
                    if self.is_data_valid is not None and not self.is_data_valid(x, t):
                        trials.append("invalid_data")
                        continue
                    model = self._trial(held, cols, y, x, t)
                    refused = self.is_model_valid is not None and not self.is_model_valid(model, x, t)
                    trials.append("invalid_model" if refused else model)
                models = [k for k in trials if not isinstance(k, str)]
                judged = iter(self._judge(held, y, center, models, limit) if models else [])
                for trial in trials:
                    if tried >= needed or sum(skips.values()) > self.max_skips:
                        ended = True
                        break
                    tried += 1
                    if isinstance(trial, str):
                        skips[trial] += 1
                        continue
                    found = next(judged)
                    if found[0] < best[0]:
                        skips["no_inliers"] += 1
                    elif found[0] > best[0] or best[2] is None or found[1] >= best[1]:
                        best = (*found, trial)
                        needed = min(needed, self._trials_needed(found[0], n, m))
                        if found[0] >= self.stop_n_inliers or found[1] >= self.stop_score:
                            ended = True
                            break
            if best[2] is None:
                raise ValueError("no consensus set was found")
            made.consensus_, made.threshold_ = best[2], float(limit)
            final = (self.estimator or LinearRegression()).fit(made.inliers(held, y, "__in").where("__in").drop("__in"), cols, y)
        finally:
            held.unpersist()
        made.estimator_, made.n_trials_, made.n_inliers_, made.skips_ = final, tried, int(best[0]), skips
        for name in ("coef_", "intercept_"):
            if hasattr(final, name):
                setattr(made, name, getattr(final, name))
        return made

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        self._fitted()
        return self.estimator_.predict(df, out)

    def inliers(self, df: DataFrame, y: str, out: str = "inlier") -> DataFrame:
        held = self.consensus_.predict(df, "__p")
        return held.withColumn(out, self._error(y, F.col("__p")) <= self.threshold_).drop("__p")


@dataclass
class MBSGD:
    loss: str = "squared_error"
    penalty: str | None = "l2"
    alpha: float = 1e-4
    l1_ratio: float = 0.15
    fit_intercept: bool = True
    max_iter: int = 50
    tol: float = 1e-4
    learning_rate: str = "constant"
    eta0: float = 0.01
    power_t: float = 0.25
    epsilon: float = 0.1
    seed: int = 0

    def run(self, df: DataFrame, cols: Sequence[str], y: str, batches: int) -> tuple[np.ndarray, float, int]:
        """Mini-batches are seeded hash slices of the rows; a step is one sweep of its slice."""
        d = len(cols)
        held = df.select(*cols, y, F.pmod(F.xxhash64(*cols, y, F.lit(self.seed)), F.lit(batches)).alias("__b")).persist()
        w, b, t, before, calm = np.zeros(d), 0.0, 0, math.inf, 0
        try:
            for epoch in range(self.max_iter):
                total = 0.0
                for k in range(batches):
                    t += 1
                    eta = {"constant": self.eta0, "optimal": 1 / (self.alpha * (1 / (self.alpha * self.eta0) + t - 1)) if self.alpha else self.eta0, "invscaling": self.eta0 / t**self.power_t, "adaptive": self.eta0 / 5**calm}[self.learning_rate]
                    got = sweep(held.where(F.col("__b") == k) if batches > 1 else held, [*cols, y], lambda x: self._slope(x, d, w, b), d + 3)
                    n = max(got[-1], 1)
                    total += got[0]
                    if self.penalty in ("l2", "elasticnet"):
                        w = w * max(0.0, 1 - eta * self.alpha * (1 if self.penalty == "l2" else 1 - self.l1_ratio))
                    w = w - eta * got[1 : d + 1] / n
                    if self.penalty in ("l1", "elasticnet"):
                        cut = eta * self.alpha * (1 if self.penalty == "l1" else self.l1_ratio)
                        w = np.sign(w) * np.maximum(np.abs(w) - cut, 0)
                    b = b - eta * got[d + 1] / n * self.fit_intercept
                if total > before - self.tol:
                    calm += 1
                    if calm >= 5:
                        break
                before = min(before, total)
        finally:
            held.unpersist()
        return w, b, epoch + 1

    def _slope(self, x: np.ndarray, d: int, w: np.ndarray, b: float) -> np.ndarray:
        s, y = x[:, :d] @ w + b, x[:, d]
        if self.loss in ("squared_error", "squared_loss"):
            l, g = 0.5 * (s - y) ** 2, s - y
        elif self.loss == "epsilon_insensitive":
            l, g = np.maximum(0, np.abs(s - y) - self.epsilon), np.where(np.abs(s - y) > self.epsilon, np.sign(s - y), 0)
        elif self.loss == "squared_epsilon_insensitive":
            o = np.maximum(0, np.abs(s - y) - self.epsilon)
            l, g = o * o, 2 * o * np.sign(s - y)
        elif self.loss == "hinge":
            l, g = np.maximum(0, 1 - y * s), np.where(y * s < 1, -y, 0)
        elif self.loss == "squared_hinge":
            o = np.maximum(0, 1 - y * s)
            l, g = o * o, -2 * y * o
        elif self.loss in ("log", "log_loss"):
            l, g = np.logaddexp(0, -y * s), -y / (1 + np.exp(np.clip(y * s, -700, 700)))
        else:
            raise ValueError(f"unknown loss {self.loss!r}")
        return np.concatenate([[l.sum()], x[:, :d].T @ g, [g.sum(), len(x)]])


@dataclass
class MBSGDRegressor(Linear, MBSGD):
    batches: int = 4

    def fit(self, df: DataFrame, cols: Sequence[str], y: str) -> MBSGDRegressor:
        made = self._begin(cols)
        check_finite(df, [*cols, y])
        made.coef_, made.intercept_, made.n_iter_ = self.run(df, cols, y, self.batches)
        return made


@dataclass
class MBSGDClassifier(LinearClassifier, MBSGD):
    loss: str = "hinge"
    batches: int = 4

    def fit(self, df: DataFrame, cols: Sequence[str], label: str) -> MBSGDClassifier:
        made = self._begin(cols)
        check_finite(df, cols)
        made.classes_ = _classes(df, label)
        held, ys = _signs(df, label, made.classes_)
        found = [self.run(held, cols, y, self.batches) for y in ys]
        made.coef_, made.intercept_ = np.array([f[0] for f in found]), np.array([f[1] for f in found])
        return made

    def predict_proba(self, df: DataFrame, out: str = "probability") -> DataFrame:
        if self.loss not in ("log", "log_loss"):
            raise ValueError("probabilities need the logistic loss")
        p = [1 / (1 + F.exp(-d)) for d in self.decisions()]
        return df.withColumn(out, F.array(1 - p[0], p[0]) if len(p) == 1 else F.array(*[q / vec.total(p) for q in p]))
