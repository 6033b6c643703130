"""Graph rounds over edge frames."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that driver and executors share (``spark.checkpoint.dir``).

    Where the session names none, a local session gets a temporary folder, once; on a
    cluster that would be a folder of one machine, so it is an error.
    """
    context = spark.sparkContext
    named, held = spark.conf.get("spark.checkpoint.dir", None), context._jsc.sc().getCheckpointDir()
    if named is None:
        if held.isDefined():
            return held.get()
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="fathomic-")
    if not held.isDefined():
        context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder of the session (survives lost executors)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def local_components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(node, root)`` of an edge list that is all in one task."""
    whole = pa.Table.from_batches(held) if (held := [x for x in batches if x.num_rows]) else None
    if whole is None:
        return
    ends = pa.chunked_array([*whole.column(0).chunks, *whole.column(1).chunks])
    coded = ends.combine_chunks().dictionary_encode()
    order = pa.compute.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    code = rank[coded.indices.to_numpy()]
    i, j = code[: whole.num_rows], code[whole.num_rows :]
    root = np.arange(len(order))
    while len(i):
        a, b = root[i], root[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root = up
    nodes = coded.dictionary.take(pa.array(order))
    yield pa.RecordBatch.from_arrays([nodes, nodes.take(pa.array(root))], ["node", "root"])


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, local_edges: int = 200_000) -> DataFrame:
    """Connected components of an edge list as rows ``(node, root)``.

    ``root`` is the smallest node of the component; nodes without an edge to a
    different node do not appear.  Alternating large-star and small-star rounds
    keep the edge count from growing and settle chains whose nodes are numbered in
    any order; a hub's edges meet only in partial aggregates and in joins whose
    skewed side Spark can split, never in one group.  An edge list of at most
    ``local_edges`` rows is solved by one task instead of rounds.
    """
    lo, hi = F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")
    now = cut(edges.select(lo, hi).where("lo <> hi").distinct())

    def mark(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()

    seen = mark(now)
    if seen[0] <= local_edges:
        kind = now.schema["lo"].dataType.simpleString()
        return now.coalesce(1).mapInArrow(local_components, f"node {kind}, root {kind}")
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = now.select(F.col("lo").alias("u"), F.col("hi").alias("v")).join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi"))
        # an upper end also keeps its own smallest neighbour, so no link is lost
        large = large.unionAll(least.where("m < u").select(F.col("m").alias("lo"), F.col("u").alias("hi"))).distinct()
        first = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(first, "hi").select(F.col("m").alias("lo"), F.when(F.col("lo") == F.col("m"), F.col("hi")).otherwise(F.col("lo")).alias("hi"))
        # (hi, m) is the row with lo = m; every other lower neighbour is tied to m instead
        after = cut(small.where("lo <> hi").distinct())
        found = mark(after)
        now, done, seen = after, found == seen, found
        if done:
            break
    else:
        raise RuntimeError("connected components did not settle")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionAll(now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
