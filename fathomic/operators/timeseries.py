"""ARIMA by exact Kalman likelihood, one series a group."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.solve import lbfgs


def difference(df: DataFrame, series: str | None, t: str, y: str, d: int) -> DataFrame:
    """d-th differences of each series as window expressions; the first d rows go."""
    w = (Window.partitionBy(series) if series else Window.partitionBy()).orderBy(t)
    for _ in range(d):
        df = df.withColumn(y, F.col(y) - F.lag(y).over(w)).where(F.col(y).isNotNull())
    return df


def state_space(ar: np.ndarray, ma: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    m = max(len(ar), len(ma) + 1)
    t = np.zeros((m, m))
    t[: len(ar), 0] = ar
    t[: m - 1, 1:] = np.eye(m - 1)
    return t, np.concatenate([[1.0], ma, np.zeros(m - 1 - len(ma))])


def start_covariance(t: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Stationary covariance of the state by doubling."""
    p, a = np.outer(r, r), t.copy()
    for _ in range(60):
        new = p + a @ p @ a.T
        if np.abs(new - p).max() <= 1e-14 * max(1.0, np.abs(new).max()):
            return new
        p, a = new, a @ a
    return p


def filtered(y: np.ndarray, ar: np.ndarray, ma: np.ndarray):
    """``(sum of squared scaled errors, sum of log variances, state, state covariance)`` with unit noise."""
    t, r = state_space(ar, ma)
    p, a, q = start_covariance(t, r), np.zeros(len(t)), np.outer(r, r)
    squares = logs = 0.0
    for v in y:
        f = p[0, 0]
        e = v - a[0]
        squares += e * e / f
        logs += math.log(f)
        k = p[:, 0] / f
        a = t @ (a + k * e)
        p = t @ (p - np.outer(k, p[0])) @ t.T + q
    return squares, logs, a, t


def log_likelihood(y: np.ndarray, ar, ma, sigma2: float | None = None) -> float:
    """Exact Gaussian log likelihood; the noise variance is its best value unless given."""
    squares, logs, _, _ = filtered(np.asarray(y, float), np.asarray(ar, float), np.asarray(ma, float))
    n = len(y)
    s = squares / n if sigma2 is None else sigma2
    return -0.5 * (n * math.log(2 * math.pi * s) + logs + squares / s)


def _stable(x: np.ndarray) -> np.ndarray:
    """Any real vector to the coefficients of a stationary polynomial (partial autocorrelations)."""
    r = x / np.sqrt(1 + x * x)
    out = np.zeros(0)
    for v in r:
        out = np.concatenate([out - v * out[::-1], [v]])
    return out


@dataclass
class ARIMA:
    """Zero-mean ARIMA(p, d, q)."""

    order: tuple[int, int, int] = (1, 0, 0)

    def fit_series(self, y: np.ndarray) -> ARIMA:
        p, d, q = self.order
        made = ARIMA(self.order)
        made.y_ = np.asarray(y, float)
        z = np.diff(made.y_, d) if d else made.y_
        n = len(z)
        if n <= p + q:
            raise ValueError("series is too short for the order")

        def unpack(x):
            return _stable(x[:p]), -_stable(x[p:])

        def value(x):
            squares, logs, _, _ = filtered(z, *unpack(x))
            return 0.5 * (math.log(max(squares / n, 1e-300)) + logs / n)

        def both(x):
            h = 1e-6
            return value(x), np.array([(value(x + h * e) - value(x - h * e)) / (2 * h) for e in np.eye(len(x))])

        x = lbfgs(both, np.full(p + q, 0.1), 100, 1e-7)[0] if p + q else np.zeros(0)
        made.ar_, made.ma_ = unpack(x)
        squares, _, made.state_, made.step_ = filtered(z, made.ar_, made.ma_)
        made.sigma2_ = squares / n
        made.llf_, k = log_likelihood(z, made.ar_, made.ma_), p + q + 1
        made.aic_, made.bic_ = -2 * made.llf_ + 2 * k, -2 * made.llf_ + k * math.log(n)
        made.aicc_ = made.aic_ + 2 * k * (k + 1) / (n - k - 1) if n > k + 1 else math.inf
        return made

    def forecast(self, steps: int) -> np.ndarray:
        a, out = self.state_.copy(), []
        for _ in range(steps):
            out.append(a[0])
            a = self.step_ @ a
        out = np.array(out)
        for k in range(self.order[1], 0, -1):
            out = np.diff(self.y_, k - 1)[-1] + np.cumsum(out)
        return out

    def fit_forecast(self, df: DataFrame, series: str, t: str, y: str, steps: int) -> DataFrame:
        """``(series, step, forecast, llf, aic, aicc, bic)``: every series is one group's local fit."""
        model = self

        def run(rows: pd.DataFrame) -> pd.DataFrame:
            m = model.fit_series(rows.sort_values(t)[y].to_numpy(float))
            return pd.DataFrame({"series": rows[series].iloc[0], "step": np.arange(1, steps + 1), "forecast": m.forecast(steps), "llf": m.llf_, "aic": m.aic_, "aicc": m.aicc_, "bic": m.bic_})

        kind = df.schema[series].dataType.simpleString()
        return df.select(series, t, y).groupBy(series).applyInPandas(run, f"series {kind}, step int, forecast double, llf double, aic double, aicc double, bic double")


@dataclass
class AutoARIMA:
    """Order with the least AICc; series and orders are spread as (series, p, q) groups."""

    d: int = 0
    max_p: int = 3
    max_q: int = 3

    def select(self, df: DataFrame, series: str, t: str, y: str) -> DataFrame:
        """``(series, p, d, q, aicc)``."""
        grid = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p in range(self.max_p + 1) for q in range(self.max_q + 1)])
        d = self.d

        def run(rows: pd.DataFrame) -> pd.DataFrame:
            p, q = int(rows["p"].iloc[0]), int(rows["q"].iloc[0])
            try:
                aicc = ARIMA((p, d, q)).fit_series(rows.sort_values(t)[y].to_numpy(float)).aicc_
            except (ValueError, np.linalg.LinAlgError):
                aicc = math.inf
            return pd.DataFrame({"series": [rows[series].iloc[0]], "p": [p], "q": [q], "aicc": [aicc]})

        kind = df.schema[series].dataType.simpleString()
        tried = df.select(series, t, y, F.inline(grid)).groupBy(series, "p", "q").applyInPandas(run, f"series {kind}, p int, q int, aicc double")
        best = tried.groupBy("series").agg(F.min(F.struct("aicc", "p", "q")).alias("b"))
        return best.select("series", "b.p", F.lit(d).alias("d"), "b.q", "b.aicc")
