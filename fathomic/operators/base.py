"""Estimator conventions.

An estimator is a dataclass of parameters; ``fit(df, cols, ...)`` runs aggregates
and returns a fitted copy (attributes with a trailing underscore), never changing
the original.  ``transform``/``predict`` add columns as lazy expressions.
"""

from __future__ import annotations

import copy
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Estimator:
    cols: list[str]

    def _begin(self, cols: Sequence[str]):
        made = copy.copy(self)
        made.cols = list(cols)
        return made

    def _fitted(self) -> None:
        if not getattr(self, "cols", None):
            raise ValueError(f"{type(self).__name__} is not fitted")

    def get_params(self) -> dict:
        return {k: getattr(self, k) for k in self.__dataclass_fields__ if k not in STATE and not k.endswith("_")}

    def set_params(self, **params):
        made = copy.copy(self)
        for k, v in params.items():
            if k not in made.__dataclass_fields__:
                raise ValueError(f"unknown parameter {k}")
            setattr(made, k, v)
        return made


STATE = ("cols",)


def put(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return df.withColumns(columns)


def by_rows(df: DataFrame, cols: Sequence[str], f, out: str | Sequence[str]) -> DataFrame:
    """``df`` plus columns that NumPy computes from batches of the feature matrix (Arrow transfer)."""
    names = [out] if isinstance(out, str) else list(out)

    @F.pandas_udf("array<double>")
    def run(*parts: pd.Series) -> pd.Series:
        x = np.column_stack([p.to_numpy(float) for p in parts]) if len(parts[0]) else np.empty((0, len(parts)))
        return pd.Series(list(np.asarray(f(x), float).reshape(len(x), -1)))

    held = df.withColumn("__v", run(*[F.col(c).cast("double") for c in cols]))
    return held.withColumns({n: F.col("__v")[k] for k, n in enumerate(names)}).drop("__v")
