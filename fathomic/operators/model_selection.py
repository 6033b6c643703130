"""Splits as fold columns and row filters, searches as loops of distributed fits.

Splitters number the rows in id order by ranges (no task sees all rows) and give
``(train, test)`` frames; NumPy's legacy generator on the driver makes shuffles
repeatable, in shuffled folds and permutation tests for up to ``MOST_SHUFFLED`` rows.
"""

from __future__ import annotations

import itertools
import math
import time
import warnings
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.stats import range_of
from . import metrics

MOST_SHUFFLED = 5_000_000


def numbered(df: DataFrame, id_col: str, name: str = "__at", within: str | None = None) -> DataFrame:
    """Row places from 0 in id order, of all rows or of the rows of each value of ``within`` (few
    values): places inside ranges whose bounds are drawn once, plus the ranges' offsets."""
    keys = [] if within is None else [within]
    held = df.withColumn("__part", range_of(df, id_col))
    inside = held.withColumn("__in", F.row_number().over(Window.partitionBy("__part", *keys).orderBy(id_col)) - 1)
    sizes = held.groupBy("__part", *keys).agg(F.count(F.lit(1)).alias("__size"))
    ahead = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    base = sizes.select(F.col("__part").alias("__of"), *[F.col(k).alias("__key") for k in keys], F.coalesce(F.sum("__size").over(ahead), F.lit(0)).alias("__base"))
    # null-safe, for null keys and because Spark would infer a filter of the bounds on the other side of a plain equality
    same = [F.col(own).eqNullSafe(F.col(other)) for own, other in zip(["__part", *keys], ["__of", "__key"])]
    return inside.join(F.broadcast(base), same).withColumn(name, F.col("__in") + F.col("__base")).drop("__part", "__in", "__of", "__key", "__base")


class Splitter:
    def folds(self, df: DataFrame, id_col: str, y: str | None = None, groups: str | None = None) -> DataFrame:
        """``(id, fold)``: the fold in which a row is tested."""
        raise NotImplementedError

    def split(self, df: DataFrame, id_col: str, y: str | None = None, groups: str | None = None) -> Iterator[tuple[DataFrame, DataFrame]]:
        held = df.join(self.folds(df, id_col, y, groups).withColumnRenamed("fold", "__fold"), id_col)
        for k in range(self.get_n_splits(df, groups)):
            yield held.where(F.col("__fold") != k).drop("__fold"), held.where(F.col("__fold") == k).drop("__fold")

    def get_n_splits(self, df: DataFrame | None = None, groups: str | None = None) -> int:
        return self.n_splits


def _permuted(df: DataFrame, id_col: str, seed) -> DataFrame:
    """Numbered ids with the place ``__at`` replaced by a seeded shuffle's place."""
    held = numbered(df.select(id_col), id_col)
    n = held.count()
    if n > MOST_SHUFFLED:
        raise ValueError(f"an exact shuffle is limited to {MOST_SHUFFLED} rows")
    order = np.arange(n)
    np.random.RandomState(seed).shuffle(order)
    place = pd.DataFrame({"__at": order, "__to": np.arange(n)})
    return held.join(df.sparkSession.createDataFrame(place), "__at").select(id_col, F.col("__to").alias("__at"))


def _block(at: Column, n: int, k: int) -> Column:
    """Fold of place ``at``: the first n % k folds have one row more."""
    small, more = divmod(n, k)
    edge = more * (small + 1)
    first = F.floor(at / (small + 1))
    return F.when(at < edge, first).otherwise(more + F.floor((at - edge) / max(small, 1))).cast("int")


@dataclass
class KFold(Splitter):
    n_splits: int = 5
    shuffle: bool = False
    random_state: int | None = None

    def folds(self, df, id_col, y=None, groups=None) -> DataFrame:
        held = _permuted(df, id_col, self.random_state) if self.shuffle else numbered(df.select(id_col), id_col)
        n = df.count()
        if not 2 <= self.n_splits <= n:
            raise ValueError("n_splits must lie between 2 and the number of rows")
        return held.select(id_col, _block(F.col("__at"), n, self.n_splits).alias("fold"))


@dataclass
class StratifiedKFold(Splitter):
    """Classes in order of first appearance; sorted classes dealt round the folds give each fold's
    share of a class, which its rows fill in blocks."""

    n_splits: int = 5
    shuffle: bool = False
    random_state: int | None = None

    def folds(self, df, id_col, y=None, groups=None) -> DataFrame:
        rows = df.groupBy(y).agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("first")).orderBy("first").collect()
        if all(r.n < self.n_splits for r in rows):
            raise ValueError("every class has fewer rows than folds")
        k = self.n_splits
        table, start = [], 0
        for r in rows:  # of places [start, start + n), those that leave f modulo k
            upto = lambda m, f: (m - f + k - 1) // k
            table.append((r[y], [upto(start + r.n, f) - upto(start, f) for f in range(k)]))
            start += r.n
        held = numbered(df.select(id_col, y), id_col, "__place", y)
        if self.shuffle:
            if start > MOST_SHUFFLED:
                raise ValueError(f"an exact shuffle is limited to {MOST_SHUFFLED} rows")
            rng, flat = np.random.RandomState(self.random_state), []
            for c, share in table:
                own = np.repeat(np.arange(k), share)
                rng.shuffle(own)
                flat.append(pd.DataFrame({y: c, "__place": np.arange(len(own)), "fold": own}))
            return held.join(df.sparkSession.createDataFrame(pd.concat(flat)), [y, "__place"]).select(id_col, F.col("fold").cast("int").alias("fold"))
        cases = []
        for c, share in table:
            ends = itertools.accumulate(share)
            cases.append(F.when(F.col(y) == F.lit(c), F.coalesce(*[F.when(F.col("__place") < e, f) for f, e in enumerate(ends)])))
        return held.select(id_col, F.coalesce(*cases).cast("int").alias("fold"))


@dataclass
class GroupKFold(Splitter):
    """Largest group first, each to the lightest fold; among equals the later group first."""

    n_splits: int = 5

    def folds(self, df, id_col, y=None, groups=None) -> DataFrame:
        sizes = df.groupBy(groups).count().orderBy(groups).collect()
        if len(sizes) < self.n_splits:
            raise ValueError("fewer groups than folds")
        load, table = [0] * self.n_splits, []
        for r in sorted(reversed(sizes), key=lambda r: -r["count"]):
            k = int(np.argmin(load))
            load[k] += r["count"]
            table.append((r[groups], k))
        own = df.sparkSession.createDataFrame(pd.DataFrame(table, columns=[groups, "fold"]))
        return df.select(id_col, groups).join(own, groups).select(id_col, F.col("fold").cast("int").alias("fold"))


@dataclass
class StratifiedGroupKFold(Splitter):
    """Groups by falling spread of their class counts, each to the fold that evens the class shares most."""

    n_splits: int = 5
    shuffle: bool = False
    random_state: int | None = None

    def folds(self, df, id_col, y=None, groups=None) -> DataFrame:
        cells = df.groupBy(groups, y).count().collect()
        classes, names = sorted({r[y] for r in cells}), sorted({r[groups] for r in cells})
        count = np.zeros((len(names), len(classes)))
        for r in cells:
            count[names.index(r[groups]), classes.index(r[y])] = r["count"]
        order = np.arange(len(names))
        if self.shuffle:
            np.random.RandomState(self.random_state).shuffle(order)
        order = order[np.argsort(-count[order].std(1), kind="stable")]
        load, whole, table = np.zeros((self.n_splits, len(classes))), count.sum(0), []
        for g in order:
            best = None
            for k in range(self.n_splits):
                load[k] += count[g]
                key = ((load / whole).std(0).mean(), load[k].sum(), k)
                load[k] -= count[g]
                best = key if best is None or (round(key[0], 12), key[1]) < (round(best[0], 12), best[1]) else best
            load[best[2]] += count[g]
            table.append((names[g], best[2]))
        own = df.sparkSession.createDataFrame(pd.DataFrame(table, columns=[groups, "fold"]))
        return df.select(id_col, groups).join(own, groups).select(id_col, F.col("fold").cast("int").alias("fold"))


@dataclass
class TimeSeriesSplit(Splitter):
    n_splits: int = 5
    max_train_size: int | None = None
    test_size: int | None = None
    gap: int = 0

    def bounds(self, n: int) -> list[tuple[int, int, int, int]]:
        size = self.test_size or n // (self.n_splits + 1)
        if n - self.gap - size * self.n_splits <= 0:
            raise ValueError("too few rows for the splits")
        out = []
        for start in range(n - self.n_splits * size, n, size):
            end = start - self.gap
            out.append((max(0, end - self.max_train_size) if self.max_train_size else 0, end, start, start + size))
        return out

    def split(self, df, id_col, y=None, groups=None):
        held = numbered(df, id_col)
        at = F.col("__at")
        for a, b, c, d in self.bounds(df.count()):
            yield held.where((at >= a) & (at < b)).drop("__at"), held.where((at >= c) & (at < d)).drop("__at")


@dataclass
class LeavePOut(Splitter):
    p: int = 1

    def get_n_splits(self, df=None, groups=None) -> int:
        return math.comb(df.count(), self.p)

    def split(self, df, id_col, y=None, groups=None):
        held = numbered(df, id_col)
        for out in itertools.combinations(range(df.count()), self.p):
            inside = F.col("__at").isin(list(out))
            yield held.where(~inside).drop("__at"), held.where(inside).drop("__at")


def LeaveOneOut() -> LeavePOut:
    return LeavePOut(1)


@dataclass
class LeavePGroupsOut(Splitter):
    n_groups: int = 1

    def _names(self, df, groups) -> list:
        return [r[0] for r in df.select(groups).distinct().orderBy(groups).collect()]

    def get_n_splits(self, df=None, groups=None) -> int:
        return math.comb(len(self._names(df, groups)), self.n_groups)

    def split(self, df, id_col, y=None, groups=None):
        for out in itertools.combinations(self._names(df, groups), self.n_groups):
            inside = F.col(groups).isin(list(out))
            yield df.where(~inside), df.where(inside)


def LeaveOneGroupOut() -> LeavePGroupsOut:
    return LeavePGroupsOut(1)


@dataclass
class PredefinedSplit(Splitter):
    fold_col: str = "fold"

    def split(self, df, id_col, y=None, groups=None):
        for r in df.select(self.fold_col).where(F.col(self.fold_col) != -1).distinct().orderBy(self.fold_col).collect():
            inside = F.col(self.fold_col) == r[0]
            yield df.where(~inside), df.where(inside)

    def get_n_splits(self, df=None, groups=None) -> int:
        return df.select(self.fold_col).where(F.col(self.fold_col) != -1).distinct().count()


def split_sizes(n: int, test_size: float | int | None, train_size: float | int | None, default: float = 0.1) -> tuple[int, int]:
    if test_size is None and train_size is None:
        test_size = default
    test = math.ceil(test_size * n) if isinstance(test_size, float) else test_size
    train = math.floor(train_size * n) if isinstance(train_size, float) else train_size
    test = n - train if test is None else test
    train = n - test if train is None else train
    if train <= 0 or test <= 0 or train + test > n:
        raise ValueError("sizes do not fit the rows")
    return train, test


def _permutation(n: int, rng: np.random.RandomState) -> np.ndarray:
    """``rng.permutation(n)`` in half its memory (a shuffle draws the same places whatever the items' width)."""
    order = np.arange(n, dtype=np.uint32 if n < 1 << 32 else np.int64)
    rng.shuffle(order)
    return order


def _sides(held: DataFrame, side: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """Rows whose place has side 1 and side 2; the sides, a byte a row, reach each worker once."""
    shared = held.sparkSession.sparkContext.broadcast(side)

    @F.pandas_udf("byte")
    def of(at: pd.Series) -> pd.Series:
        return pd.Series(shared.value[at.to_numpy()].astype(np.int8))

    dealt = held.withColumn("__side", of("__at"))
    return tuple(dealt.where(F.col("__side") == k).drop("__at", "__side") for k in (1, 2))


@dataclass
class ShuffleSplit(Splitter):
    """Seeded splits of any number of rows: NumPy's shuffle of the places runs on the driver (four bytes a row) and
    the rows look up the side of their place."""

    n_splits: int = 10
    test_size: float | int | None = None
    train_size: float | int | None = None
    random_state: int | None = None

    def _draw(self, n: int, rng: np.random.RandomState, codes: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        train, test = split_sizes(n, self.test_size, self.train_size)
        order = _permutation(n, rng)
        return order[test : test + train], order[:test]

    def split(self, df, id_col, y=None, groups=None):
        held = numbered(df, id_col)
        rng = np.random.RandomState(self.random_state)
        n = df.count()
        codes = None
        if isinstance(self, StratifiedShuffleSplit):
            labels = df.select(F.col(y).alias("__label")).distinct().orderBy("__label").coalesce(1)
            coded = F.broadcast(labels.withColumn("__code", (F.row_number().over(Window.orderBy("__label")) - 1).cast("int")))
            got = held.join(coded, F.col(y).eqNullSafe(F.col("__label"))).select("__at", "__code").toArrow()
            codes = np.empty(n, np.int32)
            codes[got.column(0).to_numpy()] = got.column(1).to_numpy()
        for _ in range(self.n_splits):
            side = np.zeros(n, np.uint8)
            for k, at in enumerate(self._draw(n, rng, codes)):
                side[at] = k + 1
            yield _sides(held, side)


@dataclass
class StratifiedShuffleSplit(ShuffleSplit):
    def _draw(self, n, rng, codes):
        train, test = split_sizes(n, self.test_size, self.train_size)
        count = np.bincount(codes)
        a = approximate_mode(count, train, rng)
        b = approximate_mode(count - a, test, rng)
        first, second = [], []
        for k in range(len(count)):
            own = np.flatnonzero(codes == k)[rng.permutation(count[k])]
            first.append(own[: a[k]])
            second.append(own[a[k] : a[k] + b[k]])
        return rng.permutation(np.concatenate(first)), rng.permutation(np.concatenate(second))


def approximate_mode(counts: np.ndarray, draws: int, rng: np.random.RandomState) -> np.ndarray:
    """Class draws nearest to the shares; left-over draws go to the largest remainders, ties by lot."""
    share = counts / counts.sum() * draws
    out = np.floor(share).astype(int)
    need = draws - out.sum()
    rest = share - out
    for value in np.sort(np.unique(rest))[::-1]:
        if need <= 0:
            break
        at = np.flatnonzero(rest == value)
        take = min(len(at), need)
        out[rng.choice(at, size=take, replace=False)] += 1
        need -= take
    return out


@dataclass
class GroupShuffleSplit(Splitter):
    n_splits: int = 5
    test_size: float | int | None = 0.2
    train_size: float | int | None = None
    random_state: int | None = None

    def split(self, df, id_col, y=None, groups=None):
        names = [r[0] for r in df.select(groups).distinct().orderBy(groups).collect()]
        rng = np.random.RandomState(self.random_state)
        train, test = split_sizes(len(names), self.test_size, self.train_size)
        for _ in range(self.n_splits):
            order = rng.permutation(len(names))
            pick = lambda at: F.col(groups).isin([names[i] for i in at])
            yield df.where(pick(order[test : test + train])), df.where(pick(order[:test]))


@dataclass
class Repeated(Splitter):
    kind: type = KFold
    n_splits: int = 5
    n_repeats: int = 10
    random_state: int | None = None

    def get_n_splits(self, df=None, groups=None) -> int:
        return self.n_splits * self.n_repeats

    def split(self, df, id_col, y=None, groups=None):
        rng = np.random.RandomState(self.random_state)
        for _ in range(self.n_repeats):
            yield from self.kind(self.n_splits, True, int(rng.randint(np.iinfo(np.int32).max))).split(df, id_col, y, groups)


def RepeatedKFold(n_splits: int = 5, n_repeats: int = 10, random_state: int | None = None) -> Repeated:
    return Repeated(KFold, n_splits, n_repeats, random_state)


def RepeatedStratifiedKFold(n_splits: int = 5, n_repeats: int = 10, random_state: int | None = None) -> Repeated:
    return Repeated(StratifiedKFold, n_splits, n_repeats, random_state)


def train_test_split(df: DataFrame, id_col: str, test_size=0.25, train_size=None, random_state=None, shuffle: bool = True, stratify: str | None = None) -> tuple[DataFrame, DataFrame]:
    if not shuffle:
        train, test = split_sizes(df.count(), test_size, train_size)
        held = numbered(df, id_col)
        return held.where(F.col("__at") < train).drop("__at"), held.where((F.col("__at") >= train) & (F.col("__at") < train + test)).drop("__at")
    kind = StratifiedShuffleSplit if stratify else ShuffleSplit
    return next(kind(1, test_size, train_size, random_state).split(df, id_col, stratify))


def check_cv(cv=5, classifier: bool = False):
    return (StratifiedKFold if classifier else KFold)(5 if cv is None else cv) if cv is None or isinstance(cv, int) else cv


class ParameterGrid:
    """All combinations, names sorted, the last name fastest."""

    def __init__(self, grid: dict | Sequence[dict]):
        self.grids = [grid] if isinstance(grid, dict) else list(grid)

    def __iter__(self):
        for g in self.grids:
            names = sorted(g)
            for values in itertools.product(*(g[k] for k in names)):
                yield dict(zip(names, values))

    def __len__(self) -> int:
        return sum(math.prod(len(v) for v in g.values()) for g in self.grids)


def parameter_sampler(space: dict, n_iter: int, random_state: int | None = None) -> list[dict]:
    """Draws without repetition from lists, or from objects with ``rvs``."""
    rng = np.random.RandomState(random_state)
    if all(not hasattr(v, "rvs") for v in space.values()):
        grid = list(ParameterGrid(space))
        return [grid[i] for i in rng.choice(len(grid), min(n_iter, len(grid)), replace=False)]
    return [{k: v.rvs(random_state=rng) if hasattr(v, "rvs") else v[rng.randint(len(v))] for k, v in sorted(space.items())} for _ in range(n_iter)]


def _labels(metric: Callable, sign: float = 1.0, **options) -> Callable:
    """A scorer of predicted values: ``metric(df, y, "prediction")`` as a number, one frame of one value or a float."""

    def score(model, df: DataFrame, y: str) -> float:
        got = metric(model.predict(df, "__p"), y, "__p", **options)
        return sign * float(got.first()[0] if isinstance(got, DataFrame) else got)

    return score


def _ranks(metric: Callable, **options) -> Callable:
    """A scorer of decision values, or of the second class's probability where a model has no decisions."""

    def score(model, df: DataFrame, y: str) -> float:
        if hasattr(model, "decision_function"):
            held = model.decision_function(df, "__p")
        else:
            held = model.predict_proba(df, "__p")
            held = held.withColumn("__p", F.col("__p1") if "__p1" in held.columns else F.col("__p")[1])
        got = metric(held, y, "__p", **options)
        return float(got.first()[0] if isinstance(got, DataFrame) else got)

    return score


def _log_loss(model, df: DataFrame, y: str) -> float:
    held = model.predict_proba(df, "__p")
    classes = model.classes_
    parts = {c: F.col(f"__p{k}") if f"__p{k}" in held.columns else F.col("__p")[k] for k, c in enumerate(classes)}
    names = {c: f"__l{k}" for k, c in enumerate(classes)}
    return -float(metrics.log_loss(held.withColumns({names[c]: v for c, v in parts.items()}), y, names).first()[0])


#: Scorers by name, larger being better.
SCORERS: dict[str, Callable] = {
    "r2": _labels(metrics.r2_score),
    "neg_mean_squared_error": _labels(metrics.mean_squared_error, -1.0),
    "neg_root_mean_squared_error": lambda model, df, y: -math.sqrt(-SCORERS["neg_mean_squared_error"](model, df, y)),
    "neg_mean_absolute_error": _labels(metrics.mean_absolute_error, -1.0),
    "accuracy": _labels(metrics.accuracy_score),
    "roc_auc": _ranks(metrics.roc_auc_score),
    "neg_log_loss": _log_loss,
}
for _name in ("precision", "recall", "f1"):
    _metric = getattr(metrics, f"{_name}_score")
    SCORERS[_name] = _labels(_metric)
    for _average in ("macro", "micro", "weighted"):
        SCORERS[f"{_name}_{_average}"] = _labels(_metric, average=_average)


def check_scoring(score) -> dict[str, Callable]:
    """Scorers by name from a name, a function ``(model, df, y) -> float``, a list of names or a dict of both;
    a single one is named ``score``."""

    def one(s) -> Callable:
        if callable(s):
            return s
        if s not in SCORERS:
            raise ValueError(f"unknown scorer {s!r}")
        return SCORERS[s]

    if isinstance(score, dict):
        found = {k: one(v) for k, v in score.items()}
    elif isinstance(score, (list, tuple, set)):
        found = {k: one(k) for k in sorted(score)}
    else:
        found = {"score": one(score)}
    if not found:
        raise ValueError("no scorers")
    return found


def fit_and_score(estimator, train: DataFrame, test: DataFrame, cols: Sequence[str], y: str, scorers: dict[str, Callable], error_score=float("nan"), train_score: bool = False) -> dict:
    """One fold: scores, seconds and the model.  A failing fit or score gives ``error_score`` and a warning, or
    is raised where ``error_score`` is ``raise``."""
    out: dict = {"estimator": None, "fit_time": 0.0, "score_time": 0.0}
    sides = {"test": test} | ({"train": train} if train_score else {})

    def failed(what: str, error: Exception) -> None:
        if error_score == "raise":
            raise error
        warnings.warn(f"{what} failed, its score is {error_score}: {error}", stacklevel=3)

    start = time.perf_counter()
    try:
        out["estimator"] = estimator.fit(train, cols, y)
    except (ValueError, ArithmeticError, np.linalg.LinAlgError) as error:
        failed("a fit", error)
    out["fit_time"] = time.perf_counter() - start
    start = time.perf_counter()
    for side, rows in sides.items():
        for name, scorer in scorers.items():
            value = error_score
            if out["estimator"] is not None:
                try:
                    value = scorer(out["estimator"], rows, y)
                except (ValueError, ArithmeticError) as error:
                    failed(f"scorer {name}", error)
            out[f"{side}_{name}"] = value
    out["score_time"] = time.perf_counter() - start
    return out


def _each(run: Callable, jobs: list, n_jobs: int | None) -> list:
    """Runs on ``n_jobs`` threads (-1: eight): Spark schedules their jobs side by side."""
    if n_jobs in (None, 1):
        return [run(*job) for job in jobs]
    with ThreadPoolExecutor(8 if n_jobs < 0 else n_jobs) as pool:
        return list(pool.map(lambda job: run(*job), jobs))


def cross_validate(estimator, df: DataFrame, cols: Sequence[str], y: str, id_col: str, score="r2", cv=5, groups: str | None = None, train_score: bool = False, error_score=float("nan"), n_jobs: int | None = None) -> dict:
    """Per fold ``test_<name>`` of every scorer (see ``check_scoring``), ``fit_time``, ``score_time`` and ``estimator``."""
    scorers = check_scoring(score)
    folds = list(check_cv(cv).split(df, id_col, y, groups))
    got = _each(lambda a, b: fit_and_score(estimator, a, b, cols, y, scorers, error_score, train_score), folds, n_jobs)
    return {k: [g[k] for g in got] if k == "estimator" else np.array([g[k] for g in got], float) for k in got[0]}


def cross_val_score(*args, **options) -> np.ndarray:
    got = cross_validate(*args, **options)
    if "test_score" not in got:
        raise ValueError("one scorer is needed")
    return got["test_score"]


def cross_val_predict(estimator, df: DataFrame, cols: Sequence[str], y: str, id_col: str, cv=5, groups: str | None = None, method: str = "predict") -> DataFrame:
    """Every row's prediction by the model that did not see it."""
    whole = None
    for train, test in check_cv(cv).split(df, id_col, y, groups):
        part = getattr(estimator.fit(train, cols, y), method)(test)
        whole = part if whole is None else whole.unionByName(part)
    return whole


def rank_scores(scores: np.ndarray) -> np.ndarray:
    """Ranks from 1, best first, ties to the lowest rank, NaN last."""
    s = np.where(np.isnan(scores), -np.inf, scores)
    return np.array([(s > v).sum() + 1 for v in s])


@dataclass
class GridSearchCV:
    """Every candidate on every fold.  With several scorers ``refit`` names the one that chooses (or is a function
    of ``cv_results_`` to an index); with ``refit=False`` nothing is fitted on all rows."""

    estimator: object
    grid: dict | Sequence[dict] | None = None
    score: object = "r2"
    cv: object = 5
    error_score: float | str = float("nan")
    refit: bool | str | Callable = True
    return_train_score: bool = False
    n_jobs: int | None = None

    def candidates(self) -> list[dict]:
        return list(ParameterGrid(self.grid))

    def _chosen(self) -> str | None:
        names = list(check_scoring(self.score))
        if isinstance(self.refit, str):
            if self.refit not in names:
                raise ValueError(f"refit names no scorer: {self.refit!r}")
            return self.refit
        if len(names) > 1 and self.refit is True:
            raise ValueError("with several scorers refit must name one")
        return names[0] if len(names) == 1 else None

    def fit(self, df: DataFrame, cols: Sequence[str], y: str, id_col: str, groups: str | None = None):
        self._chosen()
        folds = [(a.persist(), b.persist()) for a, b in check_cv(self.cv).split(df, id_col, y, groups)]
        try:
            self.cv_results_ = self._run(self.candidates(), folds, cols, y)
        finally:
            for a, b in folds:
                a.unpersist()
                b.unpersist()
        return self._finish(df, cols, y)

    def _finish(self, df: DataFrame, cols: Sequence[str], y: str):
        name, res = self._chosen(), self.cv_results_
        if callable(self.refit):
            self.best_index_ = int(self.refit(res))
        elif name is None:
            return self
        else:
            self.best_index_ = int(np.argmin(res[f"rank_test_{name}"]))
        self.best_params_ = res["params"][self.best_index_]
        if name is not None:
            self.best_score_ = float(res[f"mean_test_{name}"][self.best_index_])
        if self.refit:
            self.best_estimator_ = self.estimator.set_params(**self.best_params_).fit(df, cols, y)
        return self

    def _run(self, candidates: list[dict], folds, cols, y) -> dict:
        scorers = check_scoring(self.score)
        jobs = [(params, train, test) for params in candidates for train, test in folds]
        run = lambda params, train, test: fit_and_score(self.estimator.set_params(**params), train, test, cols, y, scorers, self.error_score, self.return_train_score)
        got = _each(run, jobs, self.n_jobs)
        table = lambda key: np.array([g[key] for g in got], float).reshape(len(candidates), len(folds))
        out: dict = {"params": candidates}
        for key in ("fit_time", "score_time"):
            out |= {f"mean_{key}": table(key).mean(1), f"std_{key}": table(key).std(1)}
        for side in ("test", *(["train"] if self.return_train_score else [])):
            for name in scorers:
                t = table(f"{side}_{name}")
                out |= {f"split{k}_{side}_{name}": t[:, k] for k in range(len(folds))}
                out |= {f"mean_{side}_{name}": t.mean(1), f"std_{side}_{name}": t.std(1)}
                if side == "test":
                    out[f"rank_test_{name}"] = rank_scores(t.mean(1))
        return out

    def predict(self, df: DataFrame, **options) -> DataFrame:
        return self.best_estimator_.predict(df, **options)


@dataclass
class RandomizedSearchCV(GridSearchCV):
    n_iter: int = 10
    random_state: int | None = None

    def candidates(self) -> list[dict]:
        return parameter_sampler(self.grid, self.n_iter, self.random_state)


@dataclass
class HalvingGridSearchCV(GridSearchCV):
    """Rounds on growing seeded row samples; the better 1/factor of the candidates go on."""

    factor: int = 3
    min_resources: int = 20
    random_state: int = 0

    def fit(self, df, cols, y, id_col, groups=None):
        n, now, name = df.count(), self.candidates(), self._chosen()
        if name is None or callable(self.refit):
            raise ValueError("halving needs one scorer to rank by")
        rounds = 1 + min(int(math.log(len(now), self.factor)) if len(now) > 1 else 0, int(math.log(max(n / self.min_resources, 1), self.factor)))
        size = max(self.min_resources, int(n / self.factor ** (rounds - 1)))
        self.history_ = []
        for r in range(rounds):
            rows = min(n, size * self.factor**r)
            part = df if rows >= n else df.orderBy(F.xxhash64(id_col, F.lit(self.random_state)), id_col).limit(rows)
            folds = [(a.persist(), b.persist()) for a, b in check_cv(self.cv).split(part, id_col, y, groups)]
            result = self._run(now, folds, cols, y)
            for a, b in folds:
                a.unpersist()
                b.unpersist()
            self.history_.append((rows, result))
            order = np.argsort(result[f"rank_test_{name}"], kind="stable")
            now = [now[i] for i in order[: math.ceil(len(now) / self.factor)]]
        self.cv_results_ = self.history_[-1][1]
        return self._finish(df, cols, y)


@dataclass
class HalvingRandomSearchCV(HalvingGridSearchCV):
    n_candidates: int = 9

    def candidates(self) -> list[dict]:
        return parameter_sampler(self.grid, self.n_candidates, self.random_state)


def learning_curve(estimator, df, cols, y, id_col, score, sizes=(0.1, 0.33, 0.55, 0.78, 1.0), cv=5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows, train_scores, test_scores, score = None, [], [], check_scoring(score)["score"]
    for train, test in check_cv(cv).split(df, id_col, y):
        held = numbered(train, id_col).persist()
        n = held.count()
        rows = [int(s * n) if isinstance(s, float) else s for s in sizes]
        a, b = [], []
        for r in rows:
            part = held.where(F.col("__at") < r).drop("__at")
            model = estimator.fit(part, cols, y)
            a.append(score(model, part, y))
            b.append(score(model, test, y))
        held.unpersist()
        train_scores.append(a)
        test_scores.append(b)
    return np.array(rows), np.array(train_scores).T, np.array(test_scores).T


def validation_curve(estimator, df, cols, y, id_col, score, name: str, values: Sequence, cv=5) -> tuple[np.ndarray, np.ndarray]:
    got = [cross_validate(estimator.set_params(**{name: v}), df, cols, y, id_col, score, cv, train_score=True) for v in values]
    return np.array([g["train_score"] for g in got]), np.array([g["test_score"] for g in got])


def permutation_test_score(estimator, df, cols, y, id_col, score, cv=5, n_permutations: int = 20, random_state: int = 0) -> tuple[float, np.ndarray, float]:
    """Score, permuted scores and p = (count at least as good + 1) / (permutations + 1)."""
    own = float(cross_val_score(estimator, df, cols, y, id_col, score, cv=cv).mean())
    held, out = numbered(df, id_col).persist(), []
    n, rng = df.count(), np.random.RandomState(random_state)
    if n > MOST_SHUFFLED:
        raise ValueError(f"an exact shuffle is limited to {MOST_SHUFFLED} rows")
    for _ in range(n_permutations):
        moved = df.sparkSession.createDataFrame(pd.DataFrame({"__at": rng.permutation(n), "__to": np.arange(n)}))
        labels = held.select("__at", y).join(moved, "__at").select(F.col("__to").alias("__at"), y)
        out.append(float(cross_val_score(estimator, held.drop(y).join(labels, "__at").drop("__at"), cols, y, id_col, score, cv=cv).mean()))
    held.unpersist()
    return own, np.array(out), (1 + sum(s >= own for s in out)) / (1 + n_permutations)


def apply_threshold(df: DataFrame, score: str, threshold: float, labels=(0, 1), out: str = "prediction") -> DataFrame:
    return df.withColumn(out, F.when(F.col(score) >= threshold, F.lit(labels[1])).otherwise(F.lit(labels[0])))


@dataclass
class FixedThresholdClassifier:
    threshold: float = 0.5
    labels: tuple = (0, 1)

    def predict(self, df: DataFrame, score: str, out: str = "prediction") -> DataFrame:
        return apply_threshold(df, score, self.threshold, self.labels, out)


@dataclass
class TunedThresholdClassifier:
    """Threshold with the best metric; all thresholds are judged in one aggregate per fold.

    ``metric(tp, fp, fn, tn)`` works on columns of counts; fold curves are averaged on the common grid."""

    metric: Callable = None
    thresholds: int | Sequence[float] = 100
    labels: tuple = (0, 1)

    def fit(self, df: DataFrame, y: str, score: str, fold: str | None = None) -> TunedThresholdClassifier:
        if isinstance(self.thresholds, int):
            low, high = df.agg(F.min(score), F.max(score)).first()
            grid = np.linspace(low, high, self.thresholds).tolist()
        else:
            grid = list(map(float, self.thresholds))
        rows = df.select((F.col(y) == F.lit(self.labels[1])).alias("t"), F.col(score).alias("s"), (F.lit(0) if fold is None else F.col(fold)).alias("f"))
        # cumulative counts by the grid cell of a score: one row a cell, not a row a threshold
        cell = F.size(F.filter(F.array(*[F.lit(g) for g in grid]), lambda g: g <= F.col("s")))
        counts = rows.groupBy("f", cell.alias("c")).agg(F.count_if("t").alias("p"), F.count_if(~F.col("t")).alias("n")).collect()
        folds = sorted({r.f for r in counts})
        curves = []
        for f in folds:
            p, n = np.zeros(len(grid) + 1), np.zeros(len(grid) + 1)
            for r in counts:
                if r.f == f:
                    p[r.c], n[r.c] = r.p, r.n
            tp, fp = p[::-1].cumsum()[::-1][1:], n[::-1].cumsum()[::-1][1:]
            curves.append([self.metric(a, b, p.sum() - a, n.sum() - b) for a, b in zip(tp, fp)])
        mean = np.mean(curves, 0)
        k = int(mean.argmax())
        self.best_threshold_, self.best_score_, self.curve_ = grid[k], float(mean[k]), (np.array(grid), mean)
        return self

    def predict(self, df: DataFrame, score: str, out: str = "prediction") -> DataFrame:
        return apply_threshold(df, score, self.best_threshold_, self.labels, out)
