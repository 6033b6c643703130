"""Shared pieces of the training-data operators: shared-folder handling, Arrow
batch slicing, vectorised word splitting and connected components."""

from __future__ import annotations

import contextlib
import ctypes
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.graph import components, cut, shared_dir

__all__ = ["components", "cut", "shared_dir"]


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder URI of the shared folder; it is made by whoever writes first."""
    return f"{shared_dir(spark).rstrip('/')}/fathomic-{name}-{uuid.uuid4().hex}"


def lean(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A ``mapInArrow`` function that gives its memory back when its partition is done: Python
    workers live on between tasks, and what they hold is lost to the executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # glibc only
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return run


def bound_batches(spark: SparkSession, size: str = "4m") -> None:
    """Cap the bytes of an Arrow batch, unless the session names a cap itself: the default counts
    rows only, and rows of long texts make batches of any size."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext.getConf().get(key) is None:
        spark.conf.set(key, size)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept_columns(docs: DataFrame, keep: list[str] | None, made: tuple[str, ...]) -> list[str]:
    """The columns to carry along: ``keep``, or all but those that have the name of a made one."""
    return [c for c in (docs.columns if keep is None else keep) if c not in made]


def spare_names(docs: DataFrame, *names: str) -> tuple[str, ...]:
    """The names, lengthened until ``docs`` has no column called so."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return tuple(out)


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 4_000_000, max_rows: int = 2_000) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` holds at most about ``max_bytes`` in each
    piece (a single longer text stays whole): bounds a Python worker's memory."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        at = 0
        while at < n:
            base = ends[at - 1] if at else 0
            stop = int(np.searchsorted(ends, base + max_bytes, side="right"))
            stop = min(max(stop, at + 1), at + max_rows, n)
            yield batch.slice(at, stop - at)
            at = stop


def crc_bucket(id_col: str, mod: int):
    """``crc32(<id as text>) mod m`` as a Column (null ids count as empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def split_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words between blanks and line feeds of an Arrow string array: ``(codes, vocabulary,
    offsets)`` where text i has the words ``vocabulary[codes[offsets[i]:offsets[i+1]]]``.
    Empty pieces are dropped; null texts have no words."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if lower:
        texts = pc.utf8_lower(texts)
    lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
    flat = lists.flatten()
    coded = flat.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    offsets = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = offsets - offsets[0]
    words = coded.dictionary
    blank = pc.index(words, pa.scalar("", words.type)).as_py()
    if blank >= 0:
        keep = codes != blank
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        codes = codes[keep]
    return codes, words, offsets


def remove_tree(spark: SparkSession, uri: str) -> None:
    """Delete a scratch folder, whatever file system it is on."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def tasks_for(df: DataFrame, bytes_each: int, most: int = 100_000) -> int:
    """Partitions for a shuffle of all of ``df``: the session's number, or more if the tables it reads are so
    large (by Spark's own statistics, where it has them) that a task would get more than ``bytes_each``."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    wanted = 0 if size >= 1 << 56 else -(-size // bytes_each)  # unknown sizes count as endless
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(wanted, most))


def worker_tag() -> str:
    """A name no other task attempt uses, for files that attempts may write twice."""
    return f"{os.getpid():x}-{uuid.uuid4().hex[:12]}"
