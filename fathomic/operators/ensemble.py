"""Voting and stacking: expressions over member columns, out-of-fold frames joined by row id."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vec
from .model_selection import check_cv


def weighted_mean(cols: Sequence[str | Column], weights: Sequence[float] | None = None) -> Column:
    w = [1.0] * len(cols) if weights is None else list(map(float, weights))
    return vec.total([vec.col(c) * v for c, v in zip(cols, w)]) / sum(w)


def hard_vote(cols: Sequence[str], labels: Sequence, weights: Sequence[float] | None = None) -> Column:
    """Label of most weight, the lowest among equals."""
    w = [1.0] * len(cols) if weights is None else list(map(float, weights))
    mass = [vec.total([F.when(F.col(c) == F.lit(k), v).otherwise(0.0) for c, v in zip(cols, w)]) for k in labels]
    return vec.argbest(mass, labels)


@dataclass
class VotingRegressor:
    members: list[tuple[str, object]]
    weights: Sequence[float] | None = None

    def fit(self, df: DataFrame, cols: Sequence[str], y: str) -> VotingRegressor:
        made = type(self)(**{k: getattr(self, k) for k in self.__dataclass_fields__})
        made.fitted_ = [(n, e.fit(df, cols, y)) for n, e in self.members if e is not None and e != "drop"]
        return made

    def transform(self, df: DataFrame) -> DataFrame:
        for name, model in self.fitted_:
            df = model.predict(df, out=name)
        return df

    def _weights(self) -> list[float]:
        kept = {n for n, _ in self.fitted_}
        return [w for (n, _), w in zip(self.members, self.weights or [1.0] * len(self.members)) if n in kept]

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        names = [n for n, _ in self.fitted_]
        return self.transform(df).withColumn(out, weighted_mean(names, self._weights())).drop(*names)


@dataclass
class VotingClassifier(VotingRegressor):
    voting: str = "hard"

    def fit(self, df: DataFrame, cols: Sequence[str], y: str) -> VotingClassifier:
        made = super().fit(df, cols, y)
        made.classes_ = made.fitted_[0][1].classes_
        return made

    def predict_proba(self, df: DataFrame, out: str = "probability") -> DataFrame:
        k, names = len(self.classes_), []
        for name, model in self.fitted_:
            df = _proba(model, df, name, k)
            names.append(name)
        return df.withColumn(out, F.array(*[weighted_mean([F.col(n)[i] for n in names], self._weights()) for i in range(k)])).drop(*names)

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        if self.voting == "soft":
            held = self.predict_proba(df, "__p")
            return held.withColumn(out, vec.argbest([F.col("__p")[i] for i in range(len(self.classes_))], self.classes_)).drop("__p")
        names = [n for n, _ in self.fitted_]
        return self.transform(df).withColumn(out, hard_vote(names, self.classes_, self._weights())).drop(*names)


def _proba(model, df: DataFrame, name: str, k: int) -> DataFrame:
    """Class probabilities of any classifier as one array column."""
    if "prefix" in model.predict_proba.__code__.co_varnames:
        parts = [f"{name}__{i}" for i in range(k)]
        return model.predict_proba(df, prefix=f"{name}__").withColumn(name, F.array(*parts)).drop(*parts)
    return model.predict_proba(df, out=name)


@dataclass
class StackingRegressor:
    """Members' out-of-fold predictions are the final model's columns (beside the inputs with ``passthrough``)."""

    members: list[tuple[str, object]]
    final: object
    cv: object = 5
    passthrough: bool = False

    def _columns(self, model, df: DataFrame, name: str) -> tuple[DataFrame, list[str]]:
        return model.predict(df, out=f"m_{name}"), [f"m_{name}"]

    def _kept(self) -> list[tuple[str, object]]:
        return [(n, e) for n, e in self.members if e is not None and e != "drop"]

    def fit(self, df: DataFrame, cols: Sequence[str], y: str, id_col: str) -> StackingRegressor:
        made = type(self)(**{k: getattr(self, k) for k in self.__dataclass_fields__})
        made.cols_ = list(cols)
        made.classes_ = getattr(self, "classes_", None)
        made.fitted_ = [(n, e if self.cv == "prefit" else e.fit(df, cols, y)) for n, e in self._kept()]
        made._classes(df, y)
        parts = None
        if self.cv == "prefit":
            parts, made.meta_ = made._hstack(df, made.fitted_)
        else:
            for train, test in check_cv(self.cv, isinstance(self, StackingClassifier)).split(df, id_col, y):
                part, made.meta_ = made._hstack(test, [(n, e.fit(train, cols, y)) for n, e in self._kept()])
                parts = part if parts is None else parts.unionByName(part)
        made.final_ = self.final.fit(parts, [*made.meta_, *(cols if self.passthrough else [])], y)
        return made

    def _classes(self, df: DataFrame, y: str) -> None:
        pass

    def _hstack(self, df: DataFrame, models) -> tuple[DataFrame, list[str]]:
        names = []
        for name, model in models:
            df, own = self._columns(model, df, name)
            names += own
        return df, names

    def transform(self, df: DataFrame) -> DataFrame:
        return self._hstack(df, self.fitted_)[0]

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        return self.final_.predict(self.transform(df), out=out).drop(*self.meta_)


@dataclass
class StackingClassifier(StackingRegressor):
    method: str = "auto"

    def _classes(self, df: DataFrame, y: str) -> None:
        self.classes_ = self.fitted_[0][1].classes_

    def _columns(self, model, df: DataFrame, name: str) -> tuple[DataFrame, list[str]]:
        k = len(self.classes_)
        how = self.method if self.method != "auto" else "predict_proba" if hasattr(model, "predict_proba") else "decision_function" if hasattr(model, "decision_function") else "predict"
        if how == "predict":
            return model.predict(df, out=f"m_{name}"), [f"m_{name}"]
        if how == "decision_function":
            held = model.decision_function(df, out="__d")
            if k == 2:
                return held.withColumnRenamed("__d", f"m_{name}"), [f"m_{name}"]
        else:
            held = _proba(model, df, "__d", k)
        keep = range(1, k) if k == 2 else range(k)  # of two probabilities one says all
        names = [f"m_{name}_{i}" for i in keep]
        return held.withColumns({n: F.col("__d")[i] for n, i in zip(names, keep)}).drop("__d"), names


__all__ = ["StackingClassifier", "StackingRegressor", "VotingClassifier", "VotingRegressor", "hard_vote", "weighted_mean"]
