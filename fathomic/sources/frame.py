"""Frames in and out: typed matrices, column masks, row splits."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.stats import check_finite


def read(spark: SparkSession, path: str, kind: str = "parquet", **options) -> DataFrame:
    """Any source Spark reads; filters and column choices reach the scan."""
    return spark.read.format(kind).options(**options).load(path)


def matrix(df: DataFrame, cols: Sequence[str], id_col: str | None = None, check: bool = True) -> DataFrame:
    """Numeric and boolean columns as doubles (booleans 0 and 1) beside the row id."""
    for c in cols:
        kind = df.schema[c].dataType
        if not isinstance(kind, (T.NumericType, T.BooleanType)):
            raise TypeError(f"column {c} is {kind.simpleString()}, not numeric")
    out = df.select(*([id_col] if id_col else []), *[F.col(c).cast("double").alias(c) for c in cols])
    if check:
        check_finite(out, cols)
    return out


def from_numpy(spark: SparkSession, x: np.ndarray, names: Sequence[str] | None = None) -> DataFrame:
    import pandas as pd

    x = np.atleast_2d(np.asarray(x, float))
    names = list(names or [f"x{k}" for k in range(x.shape[1])])
    return spark.createDataFrame(pd.DataFrame(x, columns=names).assign(id=np.arange(len(x)))[["id", *names]])


def to_numpy(df: DataFrame, cols: Sequence[str], id_col: str = "id", most: int | None = 1_000_000) -> np.ndarray:
    """Rows in id order; raises beyond ``most`` rows (None: no bound), as the driver holds them all."""
    return to_numpy_with_ids(df, cols, id_col, most)[1]


def to_numpy_with_ids(df: DataFrame, cols: Sequence[str], id_col: str = "id", most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids in ascending order and their rows, from one read; raises beyond ``most`` rows (None: no bound)."""
    held = df.select(F.col(id_col).alias("__id"), *[F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(cols)])
    got = (held if most is None else held.limit(most + 1)).toArrow()
    if most is not None and got.num_rows > most:
        raise ValueError(f"more than {most} rows; keep them in a DataFrame")
    ids = got.column(0).to_numpy()
    order = np.argsort(ids, kind="stable")
    out = np.empty((len(ids), len(cols)))
    for k in range(len(cols)):
        out[:, k] = got.column(k + 1).to_numpy()[order]
    return ids[order], out


def take_columns(df: DataFrame, cols: Sequence[str], mask: Sequence[bool], keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, *[c for c, m in zip(cols, mask, strict=True) if m])


def restore_columns(df: DataFrame, cols: Sequence[str], mask: Sequence[bool], keep: Sequence[str] = ()) -> DataFrame:
    """The inverse: columns that the mask drops come back as zeros."""
    return df.select(*keep, *[F.col(c) if m else F.lit(0.0).alias(c) for c, m in zip(cols, mask, strict=True)])


def take_rows(df: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    return df.join(ids.select(id_col), id_col, "left_semi")


def drop_rows(df: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    return df.join(ids.select(id_col), id_col, "left_anti")
