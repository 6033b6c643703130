"""Row-vector expressions: feature lists of columns and ``array<double>`` columns."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def total(parts: Sequence[Column]) -> Column:
    """Sum of columns as a balanced tree, so that wide sums stay shallow."""
    parts = list(parts)
    while len(parts) > 1:
        parts = [parts[k] + parts[k + 1] if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return parts[0] if parts else F.lit(0.0)


def linear(cols: Sequence[str | Column], weights, bias: float = 0.0) -> Column:
    return total([col(c).cast("double") * float(w) for c, w in zip(cols, weights)] + [F.lit(float(bias))])


def argbest(scores: Sequence[Column], labels: Sequence, lowest: bool = False) -> Column:
    """Label of the largest (or smallest) score, the first one among equals."""
    top = (F.least if lowest else F.greatest)(*scores) if len(scores) > 1 else scores[0]
    return F.coalesce(*[F.when(s == top, F.lit(k)) for s, k in zip(scores, labels)])


def softmax(scores: Sequence[Column]) -> list[Column]:
    top = F.greatest(*scores) if len(scores) > 1 else scores[0]
    parts = [F.exp(s - top) for s in scores]
    return [p / total(parts) for p in parts]


def logsumexp(scores: Sequence[Column]) -> Column:
    top = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return top + F.log(total([F.exp(s - top) for s in scores]))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def distance(a: Column, b: Column, metric: str = "euclidean", p: float = 2.0) -> Column:
    """Distance of two ``array<double>`` columns under any metric of METRICS."""
    gap = lambda f: F.zip_with(a, b, f)
    if metric in ("sqeuclidean",):
        return _sum(gap(lambda x, y: (x - y) * (x - y)))
    if metric in ("euclidean", "l2") or metric == "minkowski" and p == 2:
        return F.sqrt(_sum(gap(lambda x, y: (x - y) * (x - y))))
    if metric in ("manhattan", "l1", "cityblock") or metric == "minkowski" and p == 1:
        return _sum(gap(lambda x, y: F.abs(x - y)))
    if metric in ("chebyshev", "infinity"):
        return F.aggregate(gap(lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: F.greatest(s, x))
    if metric == "minkowski":
        return F.pow(_sum(gap(lambda x, y: F.pow(F.abs(x - y), F.lit(float(p))))), F.lit(1.0 / p))
    if metric == "cosine":
        both = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
        return 1 - F.when(both > 0, dot(a, b) / both).otherwise(0.0)
    raise ValueError(f"unknown metric {metric!r}")


METRICS = ("euclidean", "l2", "sqeuclidean", "manhattan", "l1", "cityblock", "chebyshev", "infinity", "minkowski", "cosine")


def kernel(a: Column, b: Column, name: str = "linear", gamma: float | None = None, degree: float = 3, coef0: float = 1, size: int = 1) -> Column:
    """Pairwise kernel of two ``array<double>`` columns."""
    g = 1.0 / size if gamma is None else gamma
    if name == "linear":
        return dot(a, b)
    if name == "rbf":
        return F.exp(-g * distance(a, b, "sqeuclidean"))
    if name in ("poly", "polynomial"):
        return F.pow(g * dot(a, b) + coef0, F.lit(float(degree)))
    if name == "sigmoid":
        return F.tanh(g * dot(a, b) + coef0)
    if name == "laplacian":
        return F.exp(-g * distance(a, b, "manhattan"))
    if name == "cosine":
        return 1 - distance(a, b, "cosine")
    if name in ("chi2", "additive_chi2"):
        apart = _sum(F.zip_with(a, b, lambda x, y: F.when(x + y != 0, (x - y) * (x - y) / (x + y)).otherwise(0.0)))
        return F.exp(-(1.0 if gamma is None else gamma) * apart) if name == "chi2" else -apart
    raise ValueError(f"unknown kernel {name!r}")


def both(*conditions: Column) -> Column:
    return functools.reduce(lambda x, y: x & y, conditions)
