"""Naive Bayes: grouped sums to fit, a sum of literals per class to predict."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vec
from ..plans.stats import check_finite, class_sums, long_form, moments
from .base import Estimator, put


class NaiveBayes(Estimator):
    classes_: list
    log_prior_: np.ndarray

    def joint(self) -> list[Column]:
        """Joint log likelihood of each class as expressions over the feature columns."""
        raise NotImplementedError

    def _prior(self, counts: np.ndarray, given: Sequence[float] | None, learn: bool = True) -> np.ndarray:
        if given is not None:
            given = np.asarray(given, float)
            if len(given) != len(counts):
                raise ValueError("one prior per class is needed")
            return np.log(given)
        return np.log(counts / counts.sum()) if learn else np.full(len(counts), -math.log(len(counts)))

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        self._fitted()
        names = [f"__j{k}" for k in range(len(self.classes_))]
        held = put(df, dict(zip(names, self.joint())))
        return held.withColumn(out, vec.argbest([F.col(n) for n in names], self.classes_)).drop(*names)

    def predict_log_proba(self, df: DataFrame, out: str = "log_probability") -> DataFrame:
        self._fitted()
        names = [f"__j{k}" for k in range(len(self.classes_))]
        held = put(df, dict(zip(names, self.joint())))
        norm = vec.logsumexp([F.col(n) for n in names])
        return held.withColumn("__norm", norm).withColumn(out, F.array(*[F.col(n) - F.col("__norm") for n in names])).drop("__norm", *names)

    def predict_proba(self, df: DataFrame, out: str = "probability") -> DataFrame:
        return self.predict_log_proba(df, out).withColumn(out, F.transform(out, F.exp))


def _linear(cols, table: np.ndarray, bias: np.ndarray) -> list[Column]:
    return [vec.linear(cols, w, b) for w, b in zip(table, bias)]


@dataclass
class GaussianNB(NaiveBayes):
    var_smoothing: float = 1e-9
    priors: Sequence[float] | None = None

    def fit(self, df: DataFrame, cols: Sequence[str], label: str, weight: str | None = None) -> GaussianNB:
        made = self._begin(cols)
        check_finite(df, cols)
        whole = moments(df, cols)
        # sums of values shifted by the global mean: no cancellation in the variances
        shifted = df.select(F.col(label), *([F.col(weight)] if weight else []), *[(F.col(c).cast("double") - float(m)).alias(c) for c, m in zip(cols, whole["avg"])])
        made.classes_, n, (s1, s2) = class_sums(shifted, cols, label, weight, (1, 2))
        if self.priors is not None and abs(sum(self.priors) - 1) > 1e-6:
            raise ValueError("priors must sum to one")
        mean = s1 / n[:, None]
        made.theta_ = mean + whole["avg"]
        made.epsilon_ = self.var_smoothing * whole["var"].max()
        made.var_ = np.maximum(s2 / n[:, None] - mean**2, 0) + made.epsilon_
        made.log_prior_ = made._prior(n, self.priors)
        return made

    def joint(self) -> list[Column]:
        out = []
        for t, v, p in zip(self.theta_, self.var_, self.log_prior_):
            parts = [(F.col(c).cast("double") - float(m)) * (F.col(c).cast("double") - float(m)) / float(s) for c, m, s in zip(self.cols, t, v)]
            out.append(float(p - 0.5 * np.log(2 * np.pi * v).sum()) - 0.5 * vec.total(parts))
        return out


@dataclass
class MultinomialNB(NaiveBayes):
    alpha: float = 1.0
    fit_prior: bool = True
    class_prior: Sequence[float] | None = None

    def _counts(self, df, cols, label, weight):
        made = self._begin(cols)
        check_finite(df, cols)
        if (moments(df, cols)["min"] < 0).any():
            raise ValueError("features must not be negative")
        made.classes_, made.class_count_, (made.feature_count_,) = class_sums(df, cols, label, weight)
        made.log_prior_ = made._prior(made.class_count_, self.class_prior, self.fit_prior)
        return made

    def fit(self, df: DataFrame, cols: Sequence[str], label: str, weight: str | None = None) -> MultinomialNB:
        made = self._counts(df, cols, label, weight)
        smooth = made.feature_count_ + self.alpha
        made.log_p_ = np.log(smooth) - np.log(smooth.sum(1))[:, None]
        return made

    def joint(self) -> list[Column]:
        return _linear(self.cols, self.log_p_, self.log_prior_)


@dataclass
class ComplementNB(MultinomialNB):
    norm: bool = False

    def fit(self, df: DataFrame, cols: Sequence[str], label: str, weight: str | None = None) -> ComplementNB:
        made = self._counts(df, cols, label, weight)
        rest = made.feature_count_.sum(0) + self.alpha - made.feature_count_
        logged = np.log(rest / rest.sum(1)[:, None])
        made.log_p_ = logged / logged.sum(1)[:, None] if self.norm else -logged
        if len(made.classes_) > 1:
            made.log_prior_ = np.zeros(len(made.classes_))
        return made


@dataclass
class BernoulliNB(NaiveBayes):
    alpha: float = 1.0
    binarize: float | None = 0.0
    fit_prior: bool = True
    class_prior: Sequence[float] | None = None

    def _bits(self, cols) -> list[Column]:
        return [F.col(c).cast("double") if self.binarize is None else F.when(F.col(c) > self.binarize, 1.0).otherwise(0.0) for c in cols]

    def fit(self, df: DataFrame, cols: Sequence[str], label: str, weight: str | None = None) -> BernoulliNB:
        made = self._begin(cols)
        check_finite(df, cols)
        bits = df.select(F.col(label), *([F.col(weight)] if weight else []), *[b.alias(c) for c, b in zip(cols, self._bits(cols))])
        made.classes_, n, (ones,) = class_sums(bits, cols, label, weight)
        p = (ones + self.alpha) / (n[:, None] + 2 * self.alpha)
        made.log_p_ = np.log(p)
        made.log_q_ = np.log1p(-p)
        made.log_prior_ = made._prior(n, self.class_prior, self.fit_prior)
        return made

    def joint(self) -> list[Column]:
        return [vec.linear(self._bits(self.cols), p - q, float(c + q.sum())) for p, q, c in zip(self.log_p_, self.log_q_, self.log_prior_)]


@dataclass
class CategoricalNB(NaiveBayes):
    alpha: float = 1.0
    min_categories: int | Sequence[int] | None = None
    fit_prior: bool = True
    class_prior: Sequence[float] | None = None
    tables_: list[np.ndarray] = field(default_factory=list, init=False, repr=False)

    def fit(self, df: DataFrame, cols: Sequence[str], label: str, weight: str | None = None) -> CategoricalNB:
        made = self._begin(cols)
        check_finite(df, cols)
        m = moments(df, cols)
        if (m["min"] < 0).any():
            raise ValueError("categories must not be negative")
        made.classes_, n, _ = class_sums(df, [], label, weight)
        least = np.broadcast_to(np.asarray(self.min_categories or 0), len(cols))
        made.n_categories_ = np.maximum(m["max"].astype(int) + 1, least)
        w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
        cells = long_form(df.withColumn("__w", w), cols, [label, "__w"]).groupBy("feature", F.col("value").cast("int").alias("k"), label).agg(F.sum("__w").alias("n")).collect()
        counts = [np.zeros((len(n), k)) for k in made.n_categories_]
        at = {c: k for k, c in enumerate(made.classes_)}
        for r in cells:
            counts[r.feature][at[r[label]], r.k] = r.n
        made.tables_ = [np.log((c + self.alpha) / (n[:, None] + self.alpha * c.shape[1])) for c in counts]
        made.log_prior_ = made._prior(n, self.class_prior, self.fit_prior)
        return made

    def joint(self) -> list[Column]:
        out = []
        for k, prior in enumerate(self.log_prior_):
            parts = [F.get(F.array(*[F.lit(float(v)) for v in t[k]]), F.col(c).cast("int")) for c, t in zip(self.cols, self.tables_)]
            out.append(vec.total(parts) + float(prior))
        return out
