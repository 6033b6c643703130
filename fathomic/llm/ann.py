"""Approximate nearest neighbours by inner product over balanced posting lists.

Inner product is made a distance: with M the largest norm, a vector becomes
``(x, sqrt(M^2 - |x|^2))`` and a query ``(q, 0)``, whose nearest rows by Euclid are
those of largest inner product.  Centroids are fitted on a bounded sample; every
row is filed under its nearest centroid and, near a boundary, under up to
``replicas`` centroids within ``(1 + closure)`` of the nearest distance.  A query
finds its centroids by beam search in a neighbour graph over them and keeps the
lists whose distance is within ``(1 + ratio)`` of the best.  The beam and the ratio
follow the data: a few queries are answered by brute force over all rows, the beam
is doubled (up to all lists) and the ratio widened until their lists hold the share
``recall`` of those answers (``probing``).  Lists longer than
``list_rows`` are cut into salted pieces, and so are the queries of a list, so a
piece pair is bounded whatever the skew; partial top-k rows meet in a window with
a map-side limit.  Of equal vectors only the ``k + 1`` smallest ids can be in any
answer (ties go to the smaller id), so the others are not filed: an exact reduction.

Bounds: the fit sample (``sample_rows`` distinct vectors, the ones of smallest hash)
and the centroids (``max_lists``, an eighth of the sample) are parameters; centroids
are broadcast, at most ``max_lists * (dim + 1)`` doubles.  Many centroids are fitted
in two levels, so the driver's work is about ``sample_rows * sqrt(max_lists)``.

Defined results: vectors that are null, zero, of another length than most, or that
hold null or non-finite components take no part; repeated equal rows count once; an
id with several vectors counts by the best of them, on either side; a query never
finds its own id; fewer than k candidates give all of them; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, lean


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Lloyd centroids whose oversized lists are split: a centroid with more than four
    times its share gives its place's neighbour, the smallest one, a row of its own."""
    if k > 1024:
        top = nearest(x, kmeans(x, math.isqrt(k), rounds, seed), 1)[0][:, 0]
        parts = [x[top == t] for t in np.unique(top)]
        return np.concatenate([kmeans(p, max(1, min(len(p), round(k * len(p) / len(x)))), rounds, seed) for p in parts])
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        label = nearest(x, centers, 1)[0][:, 0]
        size = np.bincount(label, minlength=k)
        total = np.zeros_like(centers)
        np.add.at(total, label, x)
        full = size > 0
        centers[full] = total[full] / size[full, None]
        big = np.flatnonzero(size > 4 * len(x) / k)
        small = np.argsort(size, kind="stable")[: len(big)]
        for b, s in zip(big, small):
            if size[s] < len(x) / k / 4:
                centers[s] = x[rng.choice(np.flatnonzero(label == b))]
    return centers


def nearest(x: np.ndarray, centers: np.ndarray, r: int, step: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """The r nearest centroids of each row, nearest first, and their distances."""
    r = min(r, len(centers))
    ids, dist = np.empty((len(x), r), np.int64), np.empty((len(x), r))
    norm = (centers**2).sum(1)
    for at in range(0, len(x), step):
        part = x[at : at + step]
        d = norm - 2 * part @ centers.T
        best = np.argpartition(d, r - 1, axis=1)[:, :r] if r < len(centers) else np.tile(np.arange(r), (len(part), 1))
        value = np.take_along_axis(d, best, 1)
        order = np.argsort(value, axis=1, kind="stable")
        ids[at : at + step] = np.take_along_axis(best, order, 1)
        dist[at : at + step] = np.sqrt(np.maximum(np.take_along_axis(value, order, 1) + (part**2).sum(1)[:, None], 0))
    return ids, dist


def centroid_graph(centers: np.ndarray, degree: int = 16, far: int = 4, seed: int = 11) -> np.ndarray:
    """Neighbours of every centroid: its nearest ones and a few far ones that keep the graph in one piece."""
    n = len(centers)
    near = nearest(centers, centers, min(degree + 1, n))[0]
    ring = (np.arange(n)[:, None] + 1 + np.arange(1)) % n
    return np.concatenate([near, ring, np.random.default_rng(seed).integers(0, n, (n, far))], axis=1)


def beam_search(queries: np.ndarray, centers: np.ndarray, graph: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of all queries at once: ``(ids, distances)`` of the ``beam`` nearest centroids met."""
    b, n = len(queries), len(centers)
    beam = min(beam, n)
    entry = np.unique(np.linspace(0, n - 1, min(n, max(beam, int(math.sqrt(n))))).astype(np.int64))
    seen = np.zeros((b, n), bool)
    seen[:, entry] = True
    norm, rows = (centers**2).sum(1), np.arange(b)

    def keep(ids, dist, done):
        order = np.argsort(dist, axis=1, kind="stable")[:, :beam]
        return tuple(np.take_along_axis(z, order, 1) for z in (ids, dist, done))

    ids = np.tile(entry, (b, 1))
    ids, dist, done = keep(ids, norm[entry] - 2 * queries @ centers[entry].T, np.zeros(ids.shape, bool))
    while True:
        open_ = np.where(done, np.inf, dist)
        pick = open_.argmin(1)
        live = np.isfinite(open_[rows, pick])
        if not live.any():
            break
        done[rows, pick] = True
        new = graph[ids[rows, pick]]
        fresh = ~seen[rows[:, None], new] & live[:, None]
        first = np.ones_like(fresh)
        order = np.argsort(new, axis=1, kind="stable")
        ranked = np.take_along_axis(new, order, 1)
        np.put_along_axis(first, order[:, 1:], ranked[:, 1:] != ranked[:, :-1], 1)
        fresh &= first
        seen[rows[:, None], new] |= fresh
        d = norm[new] - 2 * np.einsum("bmd,bd->bm", centers[new], queries)
        d = np.where(fresh, d, np.inf)
        ids, dist, done = keep(np.concatenate([ids, new], 1), np.concatenate([dist, d], 1), np.concatenate([done, ~fresh], 1))
    return ids, np.sqrt(np.maximum(dist + (queries**2).sum(1)[:, None], 0))


def best_of_ids(scores: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best score of each distinct id for every query: ``(queries x ids, ids)``."""
    order = np.argsort(ids, kind="stable")
    known, first = np.unique(ids[order], return_index=True)
    return (scores[:, order], known) if len(known) == len(ids) else (np.maximum.reduceat(scores[:, order], first, axis=1), known)


def probing(queries: np.ndarray, asked: np.ndarray, homes: np.ndarray, centers: np.ndarray, graph: np.ndarray, probes: int, ratio: float, recall: float) -> tuple[int, float]:
    """The least doubling of ``probes``, and the ratio, whose lists hold the share ``recall`` of known
    neighbours: neighbour i belongs to query ``asked[i]`` and is filed under the lists ``homes[i]`` (-1: none)."""
    while len(asked) and probes < len(centers):
        ids, dist = beam_search(queries, centers, graph, probes)
        met = (ids[asked][:, None, :] == homes[:, :, None]).any(1)
        far = dist / np.maximum(dist[:, :1], 1e-12) - 1
        need = np.where(met.any(1), far[asked, met.argmax(1)], np.inf)
        edge = np.sort(need)[math.ceil(recall * len(need)) - 1]
        if np.isfinite(edge):
            return probes, max(ratio, float(edge) + 1e-9)
        probes *= 2
    return (probes, ratio) if not len(asked) else (len(centers), math.inf)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def _lists(ids: np.ndarray, keep: np.ndarray) -> pa.Array:
    """The kept entries of each row as an Arrow list."""
    ends = np.concatenate([[0], np.cumsum(keep.sum(1))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(ids[keep].astype(np.int32)))


def search(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", list_rows: int = 512, sample_rows: int = 131_072, max_lists: int = 16_384, replicas: int = 4, closure: float = 0.15, ratio: float = 0.35, probes: int = 24, query_rows: int = 512, recall: float = 0.95, trial_rows: int = 128) -> DataFrame:
    """The k nearest other rows of each row for which the Column ``is_query`` holds:
    ``(query_id, rank, <id_col>, score)``, exact scores of what was found."""
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")
    kind = "float" if dict(vectors.dtypes)[vec_col] == "array<float>" else "double"  # floats are filed as floats
    held = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(f"array<{kind}>").alias("v"), is_query.alias("q"))
    inf = F.lit(float("inf"))
    fine = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)) & F.exists("v", lambda x: x != 0)
    held = held.where("id is not null").where(F.coalesce(fine, F.lit(False)))
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    length = held.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("rows"), F.max(norm2).alias("most")).orderBy(F.desc("rows"), "d").first()
    if length is None:
        return empty
    d, rows, most = length.d, length.rows, length.most
    held = held.where(F.size("v") == d)
    # the sample: distinct vectors of smallest hash, the same ones on every run
    place = F.pmod(F.xxhash64("v", F.lit(3)), F.lit(1 << 20))
    share = min(1.0, 1.5 * sample_rows / rows)
    picked = held.where(place < int(share * (1 << 20)) + 1).select("v").distinct().orderBy(place, "v").limit(sample_rows)
    x = _matrix(picked.toArrow().column("v"))
    lift = lambda m: np.concatenate([m, np.sqrt(np.maximum(most - (m**2).sum(1), 0))[:, None]], 1)
    if not len(x):
        x = np.array([held.first().v], np.float64)
    lists = max(1, min(max_lists, rows // (list_rows // 2), len(x) // 8))
    centers = kmeans(lift(x), lists)
    lists, graph = len(centers), centroid_graph(centers)
    held_centers = spark.sparkContext.broadcast((centers, graph))

    def aim(q: np.ndarray) -> np.ndarray:
        # a query's own length does not change its order of rows; scaled, it sits among them
        return np.concatenate([q * (math.sqrt(most) / np.sqrt((q**2).sum(1)))[:, None], np.zeros((len(q), 1))], 1)

    def file_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers, _ = held_centers.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                ids, dist = nearest(lift(_matrix(part.column(1))), centers, replicas)
                yield pa.RecordBatch.from_arrays([*part.columns, _lists(ids, dist <= dist[:, :1] * (1 + closure) + 1e-12)], ["id", "v", "lists"])

    filed_as = f"id long, v array<{kind}>, lists array<int>"
    copies = Window.partitionBy("v").orderBy("id")
    # rows that repeat id and vector fold in a partial aggregate before the copies of a vector meet
    kept = held.select("id", "v").distinct().withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1)
    filed = cut(kept.select("id", "v").mapInArrow(lean(file_rows), filed_as))
    queries = held.where("q").select("id", "v").distinct()

    if probes < lists:
        trial = queries.orderBy(F.xxhash64("id", F.lit(5)), "id", "v").limit(trial_rows).toArrow()
        if len(trial):
            asked_v, own = _matrix(trial.column("v")), trial.column("id").to_numpy()

            def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                best, ids, homes = np.full((len(own), 0), 0.0), np.zeros((len(own), 0), np.int64), np.zeros((len(own), 0, replicas), np.int64)
                for batch in batches:
                    for at in range(0, batch.num_rows, 4096):
                        part = batch.slice(at, 4096)
                        new = part.column(0).to_numpy(zero_copy_only=False)
                        s = np.where(own[:, None] == new[None, :], -np.inf, asked_v @ _matrix(part.column(1)).T)
                        near = np.argpartition(s, -k, axis=1)[:, -k:] if s.shape[1] > k else np.tile(np.arange(s.shape[1]), (len(own), 1))
                        in_ = np.full((len(new), replicas), -1, np.int64)
                        n = pc.list_value_length(part.column(2)).to_numpy(zero_copy_only=False)
                        in_[np.arange(replicas) < n[:, None]] = pc.list_flatten(part.column(2)).to_numpy(zero_copy_only=False)
                        best, ids = np.concatenate([best, np.take_along_axis(s, near, 1)], 1), np.concatenate([ids, new[near]], 1)
                        homes = np.concatenate([homes, in_[near]], 1)
                        if best.shape[1] > k:
                            top = np.argpartition(best, -k, axis=1)[:, -k:]
                            best, ids, homes = np.take_along_axis(best, top, 1), np.take_along_axis(ids, top, 1), np.take_along_axis(homes, top[:, :, None], 1)
                row, col = np.nonzero(np.isfinite(best))
                yield pa.RecordBatch.from_arrays([pa.array(row.astype(np.int32)), pa.array(ids[row, col]), pa.array(best[row, col]), pa.array(list(homes[row, col]), pa.list_(pa.int64()))], ["asked", "id", "score", "homes"])

            near = Window.partitionBy("asked").orderBy(F.desc("score"), "id")
            true = filed.mapInArrow(lean(brute), "asked int, id long, score double, homes array<long>").groupBy("asked", "id").agg(F.max("score").alias("score"), F.max_by("homes", "score").alias("homes"))
            # at most trial_rows * k rows
            told = true.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k).select("asked", "homes").toArrow()
            if len(told):
                probes, ratio = probing(aim(asked_v), told.column("asked").to_numpy(), _matrix(told.column("homes")), centers, graph, probes, ratio, recall)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers, graph = held_centers.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, dist = beam_search(aim(_matrix(part.column(1))), centers, graph, probes)
                order = np.argsort(dist, axis=1, kind="stable")
                ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
                yield pa.RecordBatch.from_arrays([*part.columns, _lists(ids, dist <= dist[:, :1] * (1 + ratio) + 1e-12)], ["id", "v", "lists"])

    asked = cut(queries.mapInArrow(lean(ask), filed_as))
    per_list = lambda rows, n: rows.select(F.explode("lists").alias("list")).groupBy("list").agg(F.count(F.lit(1)).alias(n))
    # at most max_lists rows: the number of pieces of each list and of its queries
    many = lambda n, size: F.ceil(F.col(n) / size).cast("int")
    pieces = F.broadcast(cut(per_list(filed, "n").join(per_list(asked, "m"), "list").select("list", many("n", list_rows).alias("pieces"), many("m", query_rows).alias("asks"))))
    salt = lambda n: F.pmod(F.xxhash64("id", "v"), F.col(n)).cast("int")
    opened = lambda rows: rows.select("id", "v", F.explode("lists").alias("list")).join(pieces, "list")
    left = opened(filed).select("list", salt("pieces").alias("piece"), F.explode(F.sequence(F.lit(0), F.col("asks") - 1)).alias("ask"), "id", "v")
    right = opened(asked).select("list", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), salt("asks").alias("ask"), "id", "v")

    def scan(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out = [pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})]
        if len(rows) and len(queries):
            v, ids = _matrix(rows.column("v")), rows.column("id").to_numpy()
            asked_v, asked_id = _matrix(queries.column("v")), queries.column("id").to_numpy()
            for at in range(0, len(queries), 128):
                q, own = asked_v[at : at + 128], asked_id[at : at + 128]
                s = np.where(own[:, None] == ids[None, :], -np.inf, q @ v.T)
                best, known = best_of_ids(s, ids)  # the cut-off counts ids, not rows
                edge = np.partition(best, -k, axis=1)[:, -k] if len(known) > k else np.full(len(q), -np.inf)
                slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(edge), edge, 0)))
                a, b = np.nonzero((s >= (edge - slack)[:, None]) & np.isfinite(s))
                out.append(pa.table({"query_id": own[a], "id": ids[b], "score": np.einsum("nd,nd->n", q[a], v[b])}))
        return pa.concat_tables(out)

    key = ["list", "piece", "ask"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(scan, "query_id long, id long, score double")
    found = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))  # a replica is met in several lists, an id may have several vectors
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
