"""Scalers: one aggregate to fit, a pipelined projection to apply."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import norm_ppf
from ..plans.stats import exact_quantiles, moments
from .base import Estimator, put


class Affine(Estimator):
    """``x * scale + shift`` per column."""

    scale_: np.ndarray
    shift_: np.ndarray

    def expressions(self) -> dict[str, Column]:
        self._fitted()
        return {c: F.col(c).cast("double") * float(a) + float(b) for c, a, b in zip(self.cols, self.scale_, self.shift_)}

    def transform(self, df: DataFrame) -> DataFrame:
        return put(df, self.expressions())

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        self._fitted()
        return put(df, {c: (F.col(c) - float(b)) / float(a) for c, a, b in zip(self.cols, self.scale_, self.shift_)})


@dataclass
class StandardScaler(Affine):
    with_mean: bool = True
    with_std: bool = True

    def fit(self, df: DataFrame, cols: Sequence[str]) -> StandardScaler:
        made = self._begin(cols)
        m = moments(df, cols, finite=True)
        made.n_ = m["n"]
        made.mean_, made.var_ = m["avg"], m["var"]
        # a column that only rounding makes vary counts as constant
        eps = np.finfo(float).eps
        flat = m["var"] <= m["n"] * eps * m["var"] + (m["n"] * m["avg"] * eps) ** 2
        made.std_ = np.where(flat, 1.0, np.sqrt(np.where(flat, 1.0, m["var"])))
        made.scale_ = 1 / made.std_ if self.with_std else np.ones(len(cols))
        made.shift_ = -made.mean_ * made.scale_ if self.with_mean else np.zeros(len(cols))
        return made

    def expressions(self) -> dict[str, Column]:
        self._fitted()
        mean = self.mean_ if self.with_mean else np.zeros(len(self.cols))
        std = self.std_ if self.with_std else np.ones(len(self.cols))
        return {c: (F.col(c).cast("double") - float(m)) / float(s) for c, m, s in zip(self.cols, mean, std)}


@dataclass
class MinMaxScaler(Affine):
    low: float = 0.0
    high: float = 1.0
    clip: bool = False

    def fit(self, df: DataFrame, cols: Sequence[str]) -> MinMaxScaler:
        if self.low >= self.high:
            raise ValueError("low must be below high")
        made = self._begin(cols)
        m = moments(df, cols, finite=True)
        made.min_, made.max_ = m["min"], m["max"]
        span = np.where(m["max"] > m["min"], m["max"] - m["min"], 1.0)
        made.scale_ = (self.high - self.low) / span
        made.shift_ = self.low - m["min"] * made.scale_
        return made

    def expressions(self) -> dict[str, Column]:
        out = super().expressions()
        return {c: F.greatest(F.least(e, F.lit(self.high)), F.lit(self.low)) for c, e in out.items()} if self.clip else out


@dataclass
class MaxAbsScaler(Affine):
    def fit(self, df: DataFrame, cols: Sequence[str]) -> MaxAbsScaler:
        made = self._begin(cols)
        m = moments(df, cols, finite=True)
        made.max_abs_ = np.maximum(np.abs(m["min"]), np.abs(m["max"]))
        made.scale_ = 1 / np.where(made.max_abs_ > 0, made.max_abs_, 1.0)
        made.shift_ = np.zeros(len(cols))
        return made


@dataclass
class RobustScaler(Affine):
    with_centering: bool = True
    with_scaling: bool = True
    low: float = 25.0
    high: float = 75.0
    unit_variance: bool = False

    def fit(self, df: DataFrame, cols: Sequence[str]) -> RobustScaler:
        if not 0 <= self.low < self.high <= 100:
            raise ValueError("quantile range must ascend within 0 and 100")
        made = self._begin(cols)
        q = exact_quantiles(df, cols, [0.5, self.low / 100, self.high / 100])
        made.center_ = q[:, 0]
        gap = q[:, 2] - q[:, 1]
        gap = np.where(gap > 0, gap, 1.0)
        if self.unit_variance:
            gap = gap / (norm_ppf(self.high / 100) - norm_ppf(self.low / 100))
        made.range_ = gap
        made.scale_ = 1 / gap if self.with_scaling else np.ones(len(cols))
        made.shift_ = -made.center_ * made.scale_ if self.with_centering else np.zeros(len(cols))
        return made


@dataclass
class Normalizer(Estimator):
    """Rows to unit norm (l1, l2 or max); rows of norm zero stay."""

    norm: str = "l2"

    def transform(self, df: DataFrame, cols: Sequence[str]) -> DataFrame:
        x = [F.col(c).cast("double") for c in cols]
        if self.norm == "l2":
            size = F.sqrt(sum((v * v for v in x[1:]), x[0] * x[0]))
        elif self.norm == "l1":
            size = sum((F.abs(v) for v in x[1:]), F.abs(x[0]))
        elif self.norm == "max":
            size = F.greatest(*[F.abs(v) for v in x]) if len(x) > 1 else F.abs(x[0])
        else:
            raise ValueError(f"unknown norm {self.norm!r}")
        held = df.withColumn("__size", F.when(size > 0, size).otherwise(1.0))
        return put(held, {c: F.col(c).cast("double") / F.col("__size") for c in cols}).drop("__size")


@dataclass
class Binarizer(Estimator):
    threshold: float = 0.0

    def transform(self, df: DataFrame, cols: Sequence[str]) -> DataFrame:
        return put(df, {c: F.when(F.col(c) > self.threshold, 1.0).otherwise(0.0) for c in cols})
