"""Decompositions and covariances from one Gram pass; random projections from literals."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import solve, vec
from ..plans.stats import centered, check_finite, gram
from .base import Estimator, put


class Projection(Estimator):
    components_: np.ndarray

    def _offset(self) -> np.ndarray:
        return np.zeros(len(self.cols))

    def expressions(self, prefix: str = "pc") -> dict[str, Column]:
        self._fitted()
        m = self._offset()
        return {f"{prefix}{k}": vec.linear(self.cols, w, -float(m @ w)) for k, w in enumerate(self.components_)}

    def transform(self, df: DataFrame, prefix: str = "pc") -> DataFrame:
        return put(df, self.expressions(prefix))

    def inverse_transform(self, df: DataFrame, prefix: str = "pc", out: str = "inv_") -> DataFrame:
        names = [f"{prefix}{k}" for k in range(len(self.components_))]
        m = self._offset()
        return put(df, {f"{out}{c}": vec.linear(names, self.components_[:, j], m[j]) for j, c in enumerate(self.cols)})


@dataclass
class PCA(Projection):
    n_components: int | None = None

    def fit(self, df: DataFrame, cols: Sequence[str]) -> PCA:
        made = self._begin(cols)
        check_finite(df, cols)
        n, made.mean_, c = centered(df, cols)
        k = self.n_components or min(int(n), len(cols))
        if not 1 <= k <= min(n, len(cols)):
            raise ValueError("n_components is out of range")
        value, vector = np.linalg.eigh(c)
        value, vector = np.maximum(value[::-1], 0), vector.T[::-1]
        made.components_ = solve.flip_rows(vector)[:k]
        variance = value / (n - 1)
        made.explained_variance_ = variance[:k]
        made.explained_variance_ratio_ = variance[:k] / variance.sum() if variance.sum() else np.zeros(k)
        made.singular_values_ = np.sqrt(value[:k])
        return made

    def _offset(self) -> np.ndarray:
        return self.mean_


@dataclass
class TruncatedSVD(Projection):
    n_components: int = 2

    def fit(self, df: DataFrame, cols: Sequence[str]) -> TruncatedSVD:
        made = self._begin(cols)
        check_finite(df, cols)
        g = gram(df, cols)
        n, mean, c = g[0, 0], g[0, 1:] / g[0, 0], g[1:, 1:]
        value, vector = np.linalg.eigh(c)
        made.components_ = solve.flip_rows(vector.T[::-1])[: self.n_components]
        made.singular_values_ = np.sqrt(np.maximum(value[::-1], 0))[: self.n_components]
        cov = c / n - np.outer(mean, mean)
        made.explained_variance_ = np.einsum("kd,de,ke->k", made.components_, cov, made.components_)
        whole = np.trace(cov)
        made.explained_variance_ratio_ = made.explained_variance_ / whole if whole else np.zeros(self.n_components)
        return made


@dataclass
class IncrementalPCA(Projection):
    """Batch-wise PCA; ``partial_fit`` merges a batch's Gram statistics into the running factors.

    Order matters, so ``fit`` takes batches in id order."""

    n_components: int = 2
    whiten: bool = False
    batch_size: int | None = None

    def partial_fit(self, df: DataFrame, cols: Sequence[str]) -> IncrementalPCA:
        made = self._begin(cols)
        n, mean, c = centered(df, cols)
        seen = getattr(self, "n_samples_seen_", 0)
        if not seen:
            whole, made.mean_, var = c, mean, np.diag(c) / n
        else:
            total = seen + n
            gap = self.mean_ - mean
            held = (self.components_.T * self.singular_values_**2) @ self.components_
            whole = held + c + np.outer(gap, gap) * seen * n / total
            made.mean_ = (seen * self.mean_ + n * mean) / total
            var = (seen * self.var_ + np.diag(c) + gap**2 * seen * n / total) / total
        made.n_samples_seen_ = int(seen + n)
        made.var_ = var
        value, vector = np.linalg.eigh(whole)
        value, vector = np.maximum(value[::-1], 0), vector.T[::-1]
        k = self.n_components
        made.components_ = solve.flip_rows(vector)[:k]
        made.singular_values_ = np.sqrt(value[:k])
        made.explained_variance_ = value[:k] / (made.n_samples_seen_ - 1)
        made.explained_variance_ratio_ = value[:k] / (var * made.n_samples_seen_).sum()
        return made

    def fit(self, df: DataFrame, cols: Sequence[str], id_col: str) -> IncrementalPCA:
        n = check_finite(df, cols)
        size = self.batch_size or 5 * len(cols)
        cuts = df.agg(F.percentile(id_col, F.array(*[F.lit(min(1.0, k * size / max(n - 1, 1))) for k in range(1, math.ceil(n / size))]))).first()[0] if n > size else []
        made, low = self, None
        for high in [*cuts, None]:
            part = df
            if low is not None:
                part = part.where(F.col(id_col) >= low)
            if high is not None:
                part = part.where(F.col(id_col) < high)
            made, low = made.partial_fit(part, cols), high
        return made

    def _offset(self) -> np.ndarray:
        return self.mean_

    def expressions(self, prefix: str = "pc") -> dict[str, Column]:
        out = super().expressions(prefix)
        if not self.whiten:
            return out
        return {k: e / float(math.sqrt(v)) if v > 0 else e for (k, e), v in zip(out.items(), self.explained_variance_)}


def johnson_lindenstrauss_min_dim(n_samples: int, eps: float = 0.1) -> int:
    if not 0 < eps < 1 or n_samples < 1:
        raise ValueError("eps must lie between 0 and 1 and n_samples be positive")
    return int(4 * math.log(n_samples) / (eps**2 / 2 - eps**3 / 3))


@dataclass
class GaussianRandomProjection(Projection):
    n_components: int | str = "auto"
    eps: float = 0.1
    random_state: int = 0

    def _size(self, df: DataFrame, cols: Sequence[str]) -> int:
        return johnson_lindenstrauss_min_dim(df.count(), self.eps) if self.n_components == "auto" else int(self.n_components)

    def fit(self, df: DataFrame, cols: Sequence[str]) -> GaussianRandomProjection:
        made = self._begin(cols)
        k = self._size(df, cols)
        made.components_ = np.random.default_rng(self.random_state).normal(0, 1 / math.sqrt(k), (k, len(cols)))
        return made


@dataclass
class SparseRandomProjection(GaussianRandomProjection):
    density: float | str = "auto"

    def fit(self, df: DataFrame, cols: Sequence[str]) -> SparseRandomProjection:
        made = self._begin(cols)
        k = self._size(df, cols)
        made.density_ = 1 / math.sqrt(len(cols)) if self.density == "auto" else float(self.density)
        v = math.sqrt(1 / made.density_ / k)
        made.components_ = np.random.default_rng(self.random_state).choice([v, 0.0, -v], (k, len(cols)), p=[made.density_ / 2, 1 - made.density_, made.density_ / 2])
        return made


@dataclass
class EmpiricalCovariance(Estimator):
    assume_centered: bool = False
    store_precision: bool = True

    def _cov(self, df: DataFrame, cols: Sequence[str]):
        check_finite(df, cols)
        if self.assume_centered:
            g = gram(df, cols)
            return g[0, 0], np.zeros(len(cols)), g[1:, 1:] / g[0, 0]
        n, mean, c = centered(df, cols)
        return n, mean, c / n

    def fit(self, df: DataFrame, cols: Sequence[str]) -> EmpiricalCovariance:
        made = self._begin(cols)
        _, made.location_, made.covariance_ = self._cov(df, cols)
        made.precision_ = solve.inverse_psd(made.covariance_) if self.store_precision else None
        return made

    def mahalanobis(self, df: DataFrame, out: str = "mahalanobis") -> DataFrame:
        p = solve.inverse_psd(self.covariance_) if self.precision_ is None else self.precision_
        z = [F.col(c).cast("double") - float(m) for c, m in zip(self.cols, self.location_)]
        return df.withColumn(out, vec.total([z[i] * z[j] * float(p[i, j]) for i in range(len(z)) for j in range(len(z))]))


@dataclass
class LedoitWolf(EmpiricalCovariance):
    """Closed-form shrinkage; the fourth moments come from the Gram matrix of squared columns."""

    def fit(self, df: DataFrame, cols: Sequence[str]) -> LedoitWolf:
        made = self._begin(cols)
        n, made.location_, s = self._cov(df, cols)
        d = len(cols)
        squares = df.select(*[((F.col(c).cast("double") - float(m)) * (F.col(c).cast("double") - float(m))).alias(c) for c, m in zip(cols, made.location_)])
        mu = np.trace(s) / d
        beta = (gram(squares, cols)[1:, 1:].sum() / n - (s**2).sum()) / (d * n)
        delta = ((s**2).sum() - 2 * mu * np.trace(s) + d * mu**2) / d
        made.shrinkage_ = 0.0 if delta == 0 or beta <= 0 else float(min(beta, delta) / delta)
        made.covariance_ = (1 - made.shrinkage_) * s + made.shrinkage_ * mu * np.eye(d)
        made.precision_ = solve.inverse_psd(made.covariance_) if self.store_precision else None
        return made
