"""Metrics as Catalyst aggregates over a frame of truth and prediction columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.stats import range_of


def _w(weight: str | None) -> Column:
    return F.lit(1.0) if weight is None else F.col(weight).cast("double")


def _ratio(a: Column, b: Column, empty: Column | float | None = None) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(float("nan")) if empty is None else F.lit(empty) if isinstance(empty, float) else empty)


def accuracy_score(df: DataFrame, y: str, p: str, weight: str | None = None, normalize: bool = True) -> DataFrame:
    hit = F.sum(F.when(F.col(y) == F.col(p), _w(weight)).otherwise(0.0))
    return df.agg((_ratio(hit, F.sum(_w(weight))) if normalize else hit).alias("accuracy"))


def confusion_matrix(df: DataFrame, y: str, p: str, labels: Sequence | None = None, weight: str | None = None, normalize: str | None = None) -> DataFrame:
    """Every pair of labels as ``(truth, predicted, value)``, empty cells included."""
    cells = df.groupBy(F.col(y).alias("truth"), F.col(p).alias("predicted")).agg(F.sum(_w(weight)).alias("value"))
    if labels is None:
        known = df.select(F.col(y).alias("l")).unionAll(df.select(F.col(p).alias("l"))).where("l is not null").distinct()
    else:
        known = df.sparkSession.createDataFrame([(x,) for x in labels], ["l"])
    # labels squared: the matrix itself, not the rows
    grid = known.select(F.col("l").alias("truth")).crossJoin(known.select(F.col("l").alias("predicted")))
    full = grid.join(cells, ["truth", "predicted"], "left").na.fill(0.0, ["value"])
    over = {"true": Window.partitionBy("truth"), "pred": Window.partitionBy("predicted"), "all": Window.partitionBy()}
    if normalize is None:
        return full
    whole = F.sum("value").over(over[normalize])
    return full.withColumn("value", _ratio(F.col("value"), whole, 0.0))


def class_counts(df: DataFrame, y: str, p: str, weight: str | None = None) -> DataFrame:
    """``(label, tp, support, predicted)`` of every label that occurs."""
    w = _w(weight)
    sides = df.select(F.inline(F.array(
        F.struct(F.col(y).alias("label"), F.when(F.col(y) == F.col(p), w).otherwise(0.0).alias("tp"), w.alias("support"), F.lit(0.0).alias("predicted")),
        F.struct(F.col(p).alias("label"), F.lit(0.0).alias("tp"), F.lit(0.0).alias("support"), w.alias("predicted")),
    )))
    return sides.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted"))


def precision_recall_f1(df: DataFrame, y: str, p: str, average: str | None = "binary", pos_label=1, labels: Sequence | None = None, weight: str | None = None, zero_division: float = 0.0) -> DataFrame:
    """``(precision, recall, f1)``: one row, or one per label with ``average=None``."""
    counts = class_counts(df, y, p, weight)
    z = float(zero_division)
    if labels is not None:
        named = df.sparkSession.createDataFrame([(x,) for x in labels], ["label"])
        counts = named.join(counts, "label", "left").na.fill(0.0)
    if average == "binary":
        held = counts.where(F.col("label") == F.lit(pos_label)).agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("tp", "support", "predicted")])
    elif average == "micro":
        held = counts.agg(*[F.sum(c).alias(c) for c in ("tp", "support", "predicted")])
    else:
        held = counts
    tp, s, q = F.col("tp"), F.col("support"), F.col("predicted")
    each = {"precision": _ratio(tp, q, z), "recall": _ratio(tp, s, z), "f1": _ratio(2 * tp, s + q, z)}
    if average in ("binary", "micro"):
        return held.select(*[e.alias(n) for n, e in each.items()])
    if average is None:
        return held.select("label", *[e.alias(n) for n, e in each.items()], "support")
    if average == "macro":
        return held.agg(*[F.avg(e).alias(n) for n, e in each.items()])
    if average == "weighted":
        return held.agg(*[_ratio(F.sum(e * s), F.sum(s), z).alias(n) for n, e in each.items()])
    raise ValueError(f"unknown average {average!r}")


def precision_score(df, y, p, **options) -> DataFrame:
    return _only(precision_recall_f1(df, y, p, **options), "precision")


def recall_score(df, y, p, **options) -> DataFrame:
    return _only(precision_recall_f1(df, y, p, **options), "recall")


def f1_score(df, y, p, **options) -> DataFrame:
    return _only(precision_recall_f1(df, y, p, **options), "f1")


def _only(df: DataFrame, name: str) -> DataFrame:
    return df.select(*[c for c in df.columns if c in ("label", name)])


def log_loss(df: DataFrame, y: str, proba: str | dict, weight: str | None = None, eps: float = 2.220446049250313e-16, normalize: bool = True) -> DataFrame:
    """``proba``: the column of label 1, or one column a label (rows are scaled to sum one)."""
    if isinstance(proba, str):
        proba = {0: 1 - F.col(proba), 1: F.col(proba)}
    parts = {k: F.col(c) if isinstance(c, str) else c for k, c in proba.items()}
    whole = sum(list(parts.values())[1:], list(parts.values())[0])
    clip = lambda c: F.greatest(F.least(c / whole, F.lit(1 - eps)), F.lit(eps))
    own = F.coalesce(*[F.when(F.col(y) == F.lit(k), clip(c)) for k, c in parts.items()])
    loss = F.sum(-_w(weight) * F.log(own))
    return df.agg((loss / F.sum(_w(weight)) if normalize else loss).alias("log_loss"))


def _cumulative(df: DataFrame, truth: Column, score: Column, weight: str | None) -> DataFrame:
    """One row per distinct score, descending: cumulative true and false positives.

    The cumulative sums run over range-partitioned blocks and then over one row a
    block, so no task holds all scores."""
    w = _w(weight)
    per = df.select(score.cast("double").alias("s"), F.when(truth, w).otherwise(0.0).alias("t"), F.when(truth, 0.0).otherwise(w).alias("f")).groupBy("s").agg(F.sum("t").alias("t"), F.sum("f").alias("f"))
    per = per.withColumn("b", -range_of(per, "s"))
    inside = Window.partitionBy("b").orderBy(F.desc("s"))
    local = per.withColumns({"tp": F.sum("t").over(inside), "fp": F.sum("f").over(inside)})
    sums = per.groupBy("b").agg(F.sum("t").alias("bt"), F.sum("f").alias("bf"))
    ahead = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    base = sums.select(F.col("b").alias("of"), F.coalesce(F.sum("bt").over(ahead), F.lit(0.0)).alias("bt"), F.coalesce(F.sum("bf").over(ahead), F.lit(0.0)).alias("bf"))
    return local.join(F.broadcast(base), F.col("b").eqNullSafe(F.col("of"))).select("s", "t", "f", (F.col("tp") + F.col("bt")).alias("tp"), (F.col("fp") + F.col("bf")).alias("fp"))


def roc_curve(df: DataFrame, y: str, score: str, pos_label=1, weight: str | None = None) -> DataFrame:
    """``(threshold, fpr, tpr)``, thresholds descending from infinity."""
    rows = _cumulative(df, F.col(y) == F.lit(pos_label), F.col(score), weight)
    ends = rows.agg(F.max("tp").alias("P"), F.max("fp").alias("N"))
    out = rows.crossJoin(F.broadcast(ends)).select(F.col("s").alias("threshold"), (F.col("fp") / F.col("N")).alias("fpr"), (F.col("tp") / F.col("P")).alias("tpr"))
    first = df.sparkSession.createDataFrame([(float("inf"), 0.0, 0.0)], "threshold double, fpr double, tpr double")
    return out.unionAll(first)


def _auc_pair(df: DataFrame, truth: Column, score: Column, weight: str | None, max_fpr: float | None) -> float:
    """Tie-grouped trapezoid area; NaN where one class is missing."""
    rows = _cumulative(df, truth, score, weight)
    if max_fpr is None or max_fpr == 1:
        area = F.sum(F.col("f") * (F.col("tp") - F.col("t") / 2))
        row = rows.agg(area.alias("a"), F.max("tp").alias("P"), F.max("fp").alias("N")).first()
        return row.a / (row.P * row.N) if row.P and row.N else float("nan")
    row = rows.agg(F.max("tp").alias("P"), F.max("fp").alias("N")).first()
    if not row.P or not row.N:
        return float("nan")
    stop = max_fpr * row.N
    before = F.col("fp") - F.col("f")
    # the part of the step left of the stop; tp grows evenly along it
    part = F.when(F.col("f") > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.lit(stop) - before) / F.col("f")))).otherwise(0.0)
    area = F.sum(F.col("f") * part * (F.col("tp") - F.col("t") + F.col("t") * part / 2))
    a = rows.agg(area).first()[0] / (row.P * row.N)
    low = max_fpr * max_fpr / 2
    return 0.5 * (1 + (a - low) / (max_fpr - low))


def roc_auc_score(df: DataFrame, y: str, score: str | dict, weight: str | None = None, max_fpr: float | None = None, multi_class: str = "ovr", average: str = "macro") -> float:
    """Area under the ROC curve: a score column (label 1 against the rest), or one a label."""
    if isinstance(score, str):
        found = _auc_pair(df, F.col(y) == 1, F.col(score), weight, max_fpr)
        if found != found:
            raise ValueError("only one class is present")
        return found
    labels = sorted(score)
    if multi_class == "ovo":
        if weight is not None:
            raise ValueError("weights are not defined for one-versus-one")
        share = {r[0]: r[1] for r in df.groupBy(y).count().collect()}
        total, weights = 0.0, 0.0
        for i, a in enumerate(labels):
            for b in labels[i + 1 :]:
                two = df.where(F.col(y).isin([a, b]))
                area = (_auc_pair(two, F.col(y) == a, F.col(score[a]), None, None) + _auc_pair(two, F.col(y) == b, F.col(score[b]), None, None)) / 2
                v = 1.0 if average == "macro" else share.get(a, 0) + share.get(b, 0)
                total, weights = total + v * area, weights + v
        return total / weights
    if average == "micro":
        flat = df.select(F.inline(F.array(*[F.struct((F.col(y) == F.lit(k)).alias("t"), F.col(score[k]).cast("double").alias("s"), _w(weight).alias("w")) for k in labels])))
        return _auc_pair(flat, F.col("t"), F.col("s"), "w", None)
    areas = [_auc_pair(df, F.col(y) == F.lit(k), F.col(score[k]), weight, None) for k in labels]
    if average == "macro":
        return sum(areas) / len(areas)
    mass = {r[0]: r[1] for r in df.groupBy(y).agg(F.sum(_w(weight))).collect()}
    used = [(a, mass.get(k, 0.0)) for a, k in zip(areas, labels) if mass.get(k, 0.0)]
    return sum(a * m for a, m in used) / sum(m for _, m in used)


def precision_recall_curve(df: DataFrame, y: str, score: str, pos_label=1, weight: str | None = None, drop_intermediate: bool = False) -> DataFrame:
    """``(threshold, precision, recall)`` by threshold; the closing point (1, 0) has threshold null."""
    rows = _cumulative(df, F.col(y) == F.lit(pos_label), F.col(score), weight)
    if drop_intermediate:
        # a point between two with its own true positives tells nothing new
        w = Window.orderBy(F.desc("s"))
        rows = rows.withColumns({"__p": F.lag("tp").over(w), "__n": F.lead("tp").over(w)}).where("__p is null or __n is null or tp <> __p or tp <> __n")
    ends = F.broadcast(rows.agg(F.max("tp").alias("P")))
    out = rows.crossJoin(ends).select(F.col("s").alias("threshold"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), _ratio(F.col("tp"), F.col("P"), 1.0).alias("recall"))
    return out.unionAll(df.sparkSession.createDataFrame([(None, 1.0, 0.0)], "threshold double, precision double, recall double"))


def _outputs(y, p) -> list[tuple[str, str]]:
    return list(zip(y, p)) if isinstance(y, (list, tuple)) else [(y, p)]


def _mean_error(df: DataFrame, y, p, error, weight, multioutput) -> DataFrame:
    each = [F.sum(_w(weight) * error(F.col(a) - F.col(b))) / F.sum(_w(weight)) for a, b in _outputs(y, p)]
    if multioutput == "raw_values":
        return df.agg(F.array(*each).alias("error"))
    weights = [1.0] * len(each) if isinstance(multioutput, str) else list(map(float, multioutput))
    return df.agg((sum((e * v for e, v in zip(each[1:], weights[1:])), each[0] * weights[0]) / sum(weights)).alias("error"))


def mean_squared_error(df: DataFrame, y, p, weight: str | None = None, multioutput="uniform_average") -> DataFrame:
    return _mean_error(df, y, p, lambda e: e * e, weight, multioutput).withColumnRenamed("error", "mse")


def mean_absolute_error(df: DataFrame, y, p, weight: str | None = None, multioutput="uniform_average") -> DataFrame:
    return _mean_error(df, y, p, F.abs, weight, multioutput).withColumnRenamed("error", "mae")


def r2_score(df: DataFrame, y, p, weight: str | None = None, multioutput="uniform_average", force_finite: bool = True):
    """Coefficient of determination as a float (a list with ``raw_values``)."""
    pairs = _outputs(y, p)
    w = _w(weight)
    means = df.agg(*[F.sum(w * F.col(a)) / F.sum(w) for a, _ in pairs]).first()
    row = df.agg(*[F.sum(w * (F.col(a) - F.col(b)) * (F.col(a) - F.col(b))) for a, b in pairs], *[F.sum(w * (F.col(a) - float(m)) * (F.col(a) - float(m))) for (a, _), m in zip(pairs, means)]).first()
    k = len(pairs)
    left, whole = row[:k], row[k:]

    def one(n: float, d: float) -> float:
        if d:
            return 1 - n / d
        return (0.0 if n else 1.0) if force_finite else float("-inf") if n else float("nan")

    each = [one(n, d) for n, d in zip(left, whole)]
    if multioutput == "raw_values":
        return each
    weights = list(whole) if multioutput == "variance_weighted" and any(whole) else [1.0] * k if isinstance(multioutput, str) else list(multioutput)
    return sum(e * v for e, v in zip(each, weights)) / sum(weights)
