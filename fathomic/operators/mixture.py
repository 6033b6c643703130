"""Gaussian mixtures: an Arrow sweep per EM round, parameters on the driver."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from ..functions.solve import logsumexp
from ..functions.special import digamma, lgamma
from ..plans.stats import check_finite, sweep
from .base import Estimator, by_rows
from .cluster import KMeans


def log_gauss(x: np.ndarray, means: np.ndarray, chol: np.ndarray) -> np.ndarray:
    """Log densities; ``chol`` are precision factors P with x -> x P (k x d x d)."""
    out = np.empty((len(x), len(means)))
    for k, (m, p) in enumerate(zip(means, chol)):
        out[:, k] = np.log(np.diag(p)).sum() - 0.5 * (((x - m) @ p) ** 2).sum(1)
    return out - 0.5 * x.shape[1] * math.log(2 * math.pi)


def precision_factors(cov: np.ndarray) -> np.ndarray:
    return np.array([np.linalg.inv(np.linalg.cholesky(c)).T for c in cov])


def shape_covariance(kind: str, s: np.ndarray, nk: np.ndarray, reg: float) -> np.ndarray:
    """Full covariance matrices (k x d x d) of a covariance type from full scatter matrices per unit weight."""
    d, eye = s.shape[1], np.eye(s.shape[1])
    if kind == "tied":
        s = np.broadcast_to((s * nk[:, None, None]).sum(0) / nk.sum(), s.shape)
    elif kind == "diag":
        s = s * eye
    elif kind == "spherical":
        s = np.trace(s, axis1=1, axis2=2)[:, None, None] / d * eye
    elif kind != "full":
        raise ValueError(f"unknown covariance type {kind!r}")
    return s + reg * eye


@dataclass
class GaussianMixture(Estimator):
    n_components: int = 1
    covariance_type: str = "full"
    tol: float = 1e-3
    reg_covar: float = 1e-6
    max_iter: int = 100
    init_params: str = "kmeans"
    means_init: np.ndarray | None = None
    random_state: int = 0
    warm_start: bool = False

    def _begin_state(self, held: DataFrame, cols: Sequence[str]) -> np.ndarray:
        if self.means_init is not None:
            return np.asarray(self.means_init, float)
        init = "random" if self.init_params.startswith("random") else "k-means++"
        start = KMeans(self.n_components, init, 1, 300 if self.init_params == "kmeans" else 1, random_state=self.random_state).fit(held, cols)
        return start.cluster_centers_

    def _sweep(self, held: DataFrame, cols: Sequence[str], log_resp, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Responsibility sums, weighted sums and scatter of shifted rows, and the summed log norm."""
        k, d = self.n_components, len(cols)

        def part(x: np.ndarray) -> np.ndarray:
            joint = log_resp(x)
            norm = logsumexp(joint, 1)
            r = np.exp(joint - norm[:, None])
            z = x - shift
            return np.concatenate([r.sum(0), (r.T @ z).ravel(), np.einsum("nk,ni,nj->kij", r, z, z).ravel(), [norm.sum()]])

        s = sweep(held, cols, part, k + k * d + k * d * d + 1)
        return s[:k], s[k : k + k * d].reshape(k, d), s[k + k * d : -1].reshape(k, d, d), s[-1]

    def fit(self, df: DataFrame, cols: Sequence[str]) -> GaussianMixture:
        made = self._begin(cols)
        n = check_finite(df, cols)
        held = df.select(*cols).persist()
        try:
            # a warm start goes on from the responsibilities of this model, if it is a fitted one
            again = self.warm_start and hasattr(self, "means_") and self.cols == list(cols)
            centers = np.asarray(self.means_) if again else made._begin_state(held, cols)
            shift = centers.mean(0)
            hard = lambda x: np.where(np.arange(self.n_components) == ((x[:, None] - centers) ** 2).sum(2).argmin(1)[:, None], 0.0, -1e300)
            bound, made.converged_ = -math.inf, False
            stats = made._sweep(held, cols, self._log_joint() if again else hard, shift)
            for it in range(self.max_iter):
                made._maximise(stats, shift, n)
                stats = made._sweep(held, cols, made._log_joint(), shift)
                new = made._bound(stats, n)
                if abs(new - bound) < self.tol:
                    bound, made.converged_ = new, True
                    break
                bound = new
        finally:
            held.unpersist()
        made.n_iter_, made.lower_bound_, made.n_ = it + 1, float(bound), n
        return made

    def _maximise(self, stats, shift: np.ndarray, n: int) -> None:
        nk, sums, scatter, _ = stats
        nk = nk + 10 * np.finfo(float).eps
        mean = sums / nk[:, None]
        s = scatter / nk[:, None, None] - np.einsum("ki,kj->kij", mean, mean)
        self.weights_, self.means_ = nk / n, mean + shift
        self.covariances_ = shape_covariance(self.covariance_type, s, nk, self.reg_covar)
        self.factors_ = precision_factors(self.covariances_)

    def _log_joint(self):
        w, m, p = np.log(self.weights_), self.means_, self.factors_
        return lambda x: w + log_gauss(x, m, p)

    def _bound(self, stats, n: int) -> float:
        return stats[3] / n

    def predict_proba(self, df: DataFrame, prefix: str = "p") -> DataFrame:
        joint = self._log_joint()
        f = lambda x: np.exp((j := joint(x)) - logsumexp(j, 1)[:, None])
        return by_rows(df, self.cols, f, [f"{prefix}{k}" for k in range(self.n_components)])

    def predict(self, df: DataFrame, out: str = "component") -> DataFrame:
        joint = self._log_joint()
        return (held := by_rows(df, self.cols, lambda x: joint(x).argmax(1), out)).withColumn(out, held[out].cast("int"))

    def score_samples(self, df: DataFrame, out: str = "log_density") -> DataFrame:
        joint = self._log_joint()
        return by_rows(df, self.cols, lambda x: logsumexp(joint(x), 1), out)

    def score(self, df: DataFrame) -> float:
        joint = self._log_joint()
        s = sweep(df, self.cols, lambda x: np.array([logsumexp(joint(x), 1).sum(), len(x)]), 2)
        return float(s[0] / s[1])

    def _parameters(self) -> int:
        k, d = self.n_components, len(self.cols)
        cov = {"full": k * d * (d + 1) // 2, "tied": d * (d + 1) // 2, "diag": k * d, "spherical": k}[self.covariance_type]
        return cov + k * d + k - 1

    def bic(self, df: DataFrame) -> float:
        n = df.count()
        return -2 * n * self.score(df) + self._parameters() * math.log(n)

    def aic(self, df: DataFrame) -> float:
        return -2 * df.count() * self.score(df) + 2 * self._parameters()

    def sample(self, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(seed)
        label = np.sort(rng.choice(self.n_components, n, p=self.weights_ / self.weights_.sum()))
        return np.array([rng.multivariate_normal(self.means_[k], self.covariances_[k]) for k in label]), label


@dataclass
class BayesianGaussianMixture(GaussianMixture):
    """Variational mixture with Normal-Wishart components (full covariances of every type are formed
    from the typed scatter) and a Dirichlet process or Dirichlet weight prior."""

    weight_concentration_prior_type: str = "dirichlet_process"
    weight_concentration_prior: float | None = None
    mean_precision_prior: float = 1.0
    mean_prior: np.ndarray | None = None
    degrees_of_freedom_prior: float | None = None
    covariance_prior: np.ndarray | None = None

    def fit(self, df: DataFrame, cols: Sequence[str]) -> BayesianGaussianMixture:
        from ..plans.stats import centered

        n, mean, c = centered(df, cols)
        prior = self.set_params()
        prior.cols = list(cols)
        prior._m0 = mean if self.mean_prior is None else np.asarray(self.mean_prior, float)
        prior._w0 = c / (n - 1) if self.covariance_prior is None else np.asarray(self.covariance_prior, float)
        prior._v0 = float(len(cols)) if self.degrees_of_freedom_prior is None else float(self.degrees_of_freedom_prior)
        prior._a0 = 1 / self.n_components if self.weight_concentration_prior is None else float(self.weight_concentration_prior)
        return GaussianMixture.fit(prior, df, cols)

    def _maximise(self, stats, shift: np.ndarray, n: int) -> None:
        nk, sums, scatter, _ = stats
        nk = nk + 10 * np.finfo(float).eps
        mean = sums / nk[:, None]
        s = shape_covariance(self.covariance_type, scatter / nk[:, None, None] - np.einsum("ki,kj->kij", mean, mean), nk, self.reg_covar)
        mean = mean + shift
        self._nk = nk
        if self.weight_concentration_prior_type == "dirichlet_process":
            rest = np.concatenate([np.cumsum(nk[::-1])[::-1][1:], [0]])
            self.concentration_ = (1 + nk, self._a0 + rest)
            stick = self.concentration_[0] / sum(self.concentration_)
            self.weights_ = stick * np.concatenate([[1], np.cumprod(1 - stick)[:-1]])
            self.weights_ = self.weights_ / self.weights_.sum()
        else:
            self.concentration_ = (self._a0 + nk,)
            self.weights_ = self.concentration_[0] / self.concentration_[0].sum()
        self.kappa_ = self.mean_precision_prior + nk
        self.means_ = (self.mean_precision_prior * self._m0 + nk[:, None] * mean) / self.kappa_[:, None]
        self.dof_ = self._v0 + nk
        gap = mean - self._m0
        spread = np.einsum("k,ki,kj->kij", nk * self.mean_precision_prior / self.kappa_, gap, gap)
        whole = self._w0 + nk[:, None, None] * s + spread
        eye = np.eye(whole.shape[1])
        if self.covariance_type == "diag":
            whole = whole * eye
        elif self.covariance_type == "spherical":
            whole = np.trace(whole, axis1=1, axis2=2)[:, None, None] / len(eye) * eye
        elif self.covariance_type == "tied":
            whole = np.broadcast_to(whole.mean(0), whole.shape)
        self.covariances_ = whole / self.dof_[:, None, None]
        self.factors_ = precision_factors(self.covariances_)

    def _log_weights(self) -> np.ndarray:
        if len(self.concentration_) == 1:
            return digamma(self.concentration_[0]) - digamma(self.concentration_[0].sum())
        a, b = self.concentration_
        whole = digamma(a + b)
        return digamma(a) - whole + np.concatenate([[0], np.cumsum(digamma(b) - whole)[:-1]])

    def _log_joint(self):
        d = len(self.cols)
        w, m, p = self._log_weights(), self.means_, self.factors_
        spin = digamma(0.5 * (self.dof_[:, None] - np.arange(d))).sum(1) + d * math.log(2) - d * np.log(self.dof_)
        extra = 0.5 * (spin - d / self.kappa_)
        return lambda x: w + log_gauss(x, m, p) + extra

    def _bound(self, stats, n: int) -> float:
        """Evidence bound up to a constant: expected log norm less the prior divergences of the parameters."""
        d = len(self.cols)
        det = np.array([np.log(np.diag(f)).sum() for f in self.factors_])
        log_det = det - 0.5 * d * np.log(self.dof_)
        wishart = -(self.dof_ * log_det + self.dof_ * d * 0.5 * math.log(2) + lgamma(0.5 * (self.dof_[:, None] - np.arange(d))).sum(1))
        if len(self.concentration_) == 1:
            a = self.concentration_[0]
            weight = float(lgamma(a.sum()) - lgamma(a).sum())
        else:
            a, b = self.concentration_
            weight = float(-(lgamma(a) + lgamma(b) - lgamma(a + b)).sum())
        return float((stats[3] - wishart.sum() - weight - 0.5 * d * np.log(self.kappa_).sum()) / n)
