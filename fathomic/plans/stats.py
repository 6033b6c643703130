"""Sufficient-statistics plans: every fit is one or a few aggregates over the rows.

Small statistics are Catalyst aggregates (partial and final, inside generated code);
wide ones are Arrow sweeps in which each task returns one partial vector and a
keyed sum adds them, so nothing but the statistic itself reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cross products up to this many become aggregate expressions; more go through Arrow.
MAX_EXPRESSIONS = 120


def _bad(c: str):
    x = F.col(c).cast("double")
    return F.count_if(F.col(c).isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def _raise_if_bad(row, cols: Sequence[str]) -> int:
    if wrong := [c for k, c in enumerate(cols) if row[f"bad{k}"]]:
        raise ValueError(f"input has null, NaN or infinite values in {wrong}")
    if not row["n"]:
        raise ValueError("input has no rows")
    return row["n"]


def check_finite(df: DataFrame, cols: Sequence[str]) -> int:
    """Number of rows; raises if a column holds null, NaN or an infinity."""
    return _raise_if_bad(df.agg(F.count(F.lit(1)).alias("n"), *[_bad(c).alias(f"bad{k}") for k, c in enumerate(cols)]).first(), cols)


def moments(df: DataFrame, cols: Sequence[str], finite: bool = False) -> dict[str, np.ndarray]:
    """Count, mean, population variance, min and max of each column in one pass; with ``finite`` the same
    pass checks the columns as ``check_finite`` does."""
    parts = [f(F.col(c).cast("double")).alias(f"{name}{k}") for k, c in enumerate(cols) for name, f in (("avg", F.avg), ("var", F.var_pop), ("min", F.min), ("max", F.max))]
    checks = [_bad(c).alias(f"bad{k}") for k, c in enumerate(cols)] if finite else []
    row = df.agg(F.count(F.lit(1)).alias("n"), *parts, *checks).first()
    if finite:
        _raise_if_bad(row, cols)
    out = {name: np.array([row[f"{name}{k}"] for k in range(len(cols))], float) for name in ("avg", "var", "min", "max")}
    return out | {"n": row["n"]}


def range_of(df: DataFrame, column: str, most: int = 4096) -> Column:
    """Number of the range, rising with ``column``, that a row's value lies in (null: 0; equal values share one).

    The bounds are drawn once, from about 20 sampled values a range, and become literals: unlike
    ``repartitionByRange``, whose every exchange samples bounds of its own, all uses of the column agree
    on every row, also where a lost executor's tasks run again. About a million rows a range, at least
    the session's shuffle partitions, at most ``most``; the bounds weigh only on balance, not on results."""
    rows = df.count()
    ranges = min(most, max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // 1_000_000 + 1))
    values = df.select(F.col(column).alias("v")).where("v is not null")
    if rows > 20 * ranges:
        values = values.sample(20.0 * ranges / rows, seed=0)
    drawn = values.agg(F.sort_array(F.collect_list("v"))).first()[0]
    bounds = list(dict.fromkeys(drawn[len(drawn) * k // ranges] for k in range(1, ranges))) if drawn else []
    if not bounds:
        return F.lit(0)
    kind, width = df.schema[column].dataType, int(np.ceil(np.sqrt(len(bounds))))
    rest = [F.array(*[F.lit(b).cast(kind) for b in bounds[k : k + width]]) for k in range(0, len(bounds), width)]
    firsts = F.array(*[F.lit(b).cast(kind) for b in bounds[::width]])
    passed = lambda held: F.size(F.filter(held, lambda b: b <= F.col(column)))
    # two steps of about the square root of the ranges each
    step = passed(firsts)
    return F.when(step > 0, (step - 1) * width + passed(F.get(F.array(*rest), step - 1))).otherwise(0)


def exact_quantiles(df: DataFrame, cols: Sequence[str], shares: Sequence[float], buckets: int = 256) -> np.ndarray:
    """Exact quantiles (linear between neighbours), columns x shares, of finite columns.

    Each pass counts the rows of ``buckets`` equal ranges between the bounds known of each wanted rank and takes
    the least and largest value of the range that holds it as new bounds, until they are one value: a few passes
    of partial aggregates, whose results are at most ``buckets`` rows a bound; no task sees a column's values."""
    m = moments(df, cols, finite=True)
    place = [s * (m["n"] - 1) for s in shares]
    ranks = sorted({int(f(p)) for p in place for f in (np.floor, np.ceil)})
    known: dict[tuple[int, int], float] = {}
    open_ = {(k, r): (m["min"][k], m["max"][k], 0) for k in range(len(cols)) for r in ranks}
    while True:
        known |= {at: lo for at, (lo, hi, _) in open_.items() if lo == hi}
        open_ = {at: x for at, x in open_.items() if at not in known}
        if not open_:
            break
        spans = sorted({(k, lo, hi) for (k, _), (lo, hi, _) in open_.items()})
        parts = []
        for g, (k, lo, hi) in enumerate(spans):
            x, half = F.col(cols[k]).cast("double"), float(hi / 2 - lo / 2)  # halves: a span may exceed a double
            cell = F.least(F.floor((x / 2 - float(lo / 2)) / half * buckets), F.lit(buckets - 1))
            parts.append(F.when((x >= float(lo)) & (x <= float(hi)), F.struct(F.lit(g).alias("g"), cell.cast("int").alias("cell"), x.alias("x"))))
        held = df.select(F.explode(F.array_compact(F.array(*parts))).alias("p")).select("p.*")
        table: dict[int, list] = {}
        for row in held.groupBy("g", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("g", "cell").collect():
            table.setdefault(row.g, []).append(row)
        index = {span: g for g, span in enumerate(spans)}
        for (k, r), (lo, hi, before) in list(open_.items()):
            for row in table[index[k, lo, hi]]:
                if before + row.n > r:
                    open_[k, r] = (row.lo, row.hi, before)
                    break
                before += row.n
    low = np.array([[known[k, int(np.floor(p))] for p in place] for k in range(len(cols))])
    high = np.array([[known[k, int(np.ceil(p))] for p in place] for k in range(len(cols))])
    return low + (high - low) * (np.array(place) - np.floor(place))


def sweep(df: DataFrame, cols: Sequence[str], f: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Sum over Arrow batches of ``f(X)`` (a vector of ``size``), X having the columns ``cols``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
                total += f(x).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], ["k", "v"])

    held = df.select(*[F.col(c).cast("double") for c in cols]).mapInArrow(run, "k int, v double")
    out = np.zeros(size)
    for row in held.groupBy("k").agg(F.sum("v").alias("v")).collect():
        out[row.k] = row.v
    return out


def gram(df: DataFrame, cols: Sequence[str], center: np.ndarray | None = None, weight: str | None = None) -> np.ndarray:
    """Cross-product matrix of the (shifted) columns with a leading column of ones:
    entry [0, 0] is the weight sum, row 0 the weighted sums."""
    d = len(cols)
    shift = np.zeros(d) if center is None else np.asarray(center, float)
    if (d + 1) * (d + 2) // 2 <= MAX_EXPRESSIONS:
        x = [F.lit(1.0), *[F.col(c).cast("double") - float(s) for c, s in zip(cols, shift)]]
        w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
        pairs = [(i, j) for i in range(d + 1) for j in range(i, d + 1)]
        row = df.agg(*[F.sum(w * x[i] * x[j]).alias(f"s{k}") for k, (i, j) in enumerate(pairs)]).first()
        out = np.zeros((d + 1, d + 1))
        for k, (i, j) in enumerate(pairs):
            out[i, j] = out[j, i] = row[k] or 0.0
        return out

    def part(x: np.ndarray) -> np.ndarray:
        w = x[:, -1:] if weight else np.ones((len(x), 1))
        z = np.concatenate([np.ones((len(x), 1)), x[:, :d] - shift], 1)
        return z.T @ (z * w)

    return sweep(df, [*cols, *([weight] if weight else [])], part, (d + 1) ** 2).reshape(d + 1, d + 1)


def centered(df: DataFrame, cols: Sequence[str], weight: str | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """``(weight sum, means, centered cross products)`` by a shifted second pass (no cancellation)."""
    first = gram_means(df, cols, weight)
    g = gram(df, cols, first, weight)
    n, s = g[0, 0], g[0, 1:]
    return n, first + s / n, g[1:, 1:] - np.outer(s, s) / n


def gram_means(df: DataFrame, cols: Sequence[str], weight: str | None = None) -> np.ndarray:
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    row = df.agg(*[(F.sum(w * F.col(c).cast("double")) / F.sum(w)).alias(f"m{k}") for k, c in enumerate(cols)]).first()
    return np.array(row, float)


def class_sums(df: DataFrame, cols: Sequence[str], label: str, weight: str | None = None, powers: Sequence[int] = (1,)) -> tuple[list, np.ndarray, list[np.ndarray]]:
    """``(labels, weight per class, one classes x columns matrix a power)``, labels ascending."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    parts = [F.sum(w * F.pow(F.col(c).cast("double"), F.lit(float(p)))).alias(f"s{p}_{k}") for p in powers for k, c in enumerate(cols)]
    rows = df.groupBy(label).agg(F.sum(w).alias("__w"), *parts).orderBy(label).collect()
    return [r[label] for r in rows], np.array([r["__w"] for r in rows]), [np.array([[r[f"s{p}_{k}"] for k in range(len(cols))] for r in rows]).reshape(len(rows), len(cols)) for p in powers]


def long_form(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Unpivoted rows ``(*keep, feature, value)``, feature being the column's position."""
    pairs = F.array(*[F.struct(F.lit(k).alias("feature"), F.col(c).cast("double").alias("value")) for k, c in enumerate(cols)])
    return df.select(*keep, F.inline(pairs))
