"""SimHash near-duplicate detection over a Gray-order hierarchical index.

Fingerprints are made from word 3-shingles.  Two distinct fingerprints within
``max_bits`` = 2 differing bits agree on two of four 16-bit blocks, so shared
masked patterns (block pairs) are the upper nodes of the index: every
fingerprint is filed under its six patterns.  A pattern that holds more than
``crowd`` fingerprints is factored once more over its remaining 32 bits (two of
four 8-bit blocks), which leaves 16 free bits and so at most 65,536 distinct
fingerprints under one pattern, whatever the corpus.  Inside a pattern the
fingerprints are sorted by Gray rank and a tree of (mask, pattern) nodes is
built over them; a pair of groups is dropped as soon as the differences
accumulated in the bits both groups share exceed the threshold.

Defined results: null text, empty text and text of white space only have
fingerprint zero and link like any other; repeated rows give repeated result
rows; a null ``doc_id`` is never a component id unless the whole component has
no id (then the component id is null); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, components, cut, lean, slices, tasks_for

SEED = 42
BITS_OF = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | bytes | None, shingle: int = 3) -> int:
    """The 64-bit fingerprint of one text, unsigned."""
    raw = b"" if text is None else text.encode() if isinstance(text, str) else text
    words = raw.lower().split()  # bytes: A-Z only; splits on \x20 and \x09-\x0D
    if not words:
        return 0
    joined, n, h = b" ".join(words), len(words), xxhash.xxh64_intdigest
    if n < shingle:
        hashes = np.array([h(joined, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
        starts = (np.concatenate([[0], ends[:-1]])[: n - shingle + 1]).tolist()
        hashes = np.fromiter([h(joined[s:e], SEED) for s, e in zip(starts, (ends[shingle - 1 :] - 1).tolist())], np.uint64, n - shingle + 1)
    by_byte = hashes.view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(by_byte[:, k], minlength=256) @ BITS_OF for k in range(8)])
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """One row ``(id, fp)`` per row of ``docs``; ``fp`` is the fingerprint as a signed long.
    With ``digests`` also ``md5``, the text's (null for a null text)."""
    names = ["id", "fp", "md5"] if digests else ["id", "fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            fps = np.array([fingerprint(x.as_buffer().to_pybytes() if x.is_valid else None) for x in part.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view(np.int64)), *part.columns[2:]], names)

    bound_batches(docs.sparkSession)
    held = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    if digests:
        held = held.withColumn("md5", text_digest("text"))
    return held.mapInArrow(lean(run), "id long, fp long" + ", md5 binary" * digests)


def text_digest(text_col: str):
    return F.unhex(F.md5(F.col(text_col).cast("string").cast("binary")))


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray sequence."""
    out = codes.copy()
    for step in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(step)
    return out


class GrayIndex:
    """Trees of (mask, pattern) nodes over codes that are sorted by bucket, then Gray rank."""

    def __init__(self, bucket: np.ndarray, codes: np.ndarray, fanout: int = 8):
        self.levels = [(bucket, np.full(len(codes), ONES), codes, np.arange(len(codes)), np.ones(len(codes), np.int64))]
        while True:
            bucket, mask, pattern, _, _ = self.levels[-1]
            first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            if len(first) == len(bucket):
                break
            place = np.arange(len(bucket)) - np.repeat(first, np.diff(np.r_[first, len(bucket)]))
            start = np.flatnonzero(place % fanout == 0)
            both, either = np.bitwise_and.reduceat(pattern, start), np.bitwise_or.reduceat(pattern, start)
            shared = np.bitwise_and.reduceat(mask, start) & ~(both ^ either)
            self.levels.append((bucket[start], shared, both & shared, start, np.diff(np.r_[start, len(bucket)])))

    def pairs(self, max_bits: int, step: int = 40_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index pairs i < j of one bucket whose codes differ in at most ``max_bits`` bits, in pieces."""
        top = np.arange(len(self.levels[-1][0]))
        stack = [(len(self.levels) - 1, top, top)]
        while stack:
            level, p, q = stack.pop()
            if len(p) > step:
                stack += [(level, p[k : k + step], q[k : k + step]) for k in range(0, len(p), step)]
                continue
            if level == 0:
                apart = p < q
                if apart.any():
                    yield p[apart], q[apart]
                continue
            _, _, _, start, size = self.levels[level]
            _, mask, pattern, _, _ = self.levels[level - 1]
            many = size[p] * size[q]
            place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            wide = np.repeat(size[q], many)
            c = np.repeat(start[p], many) + place // wide
            d = np.repeat(start[q], many) + place % wide
            keep = c <= d
            c, d = c[keep], d[keep]
            differ = np.bitwise_count((pattern[c] ^ pattern[d]) & mask[c] & mask[d])
            near = differ <= max_bits
            if near.any():
                stack.append((level - 1, c[near], d[near]))


def local_roots(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest index reachable from each of n indices over the given links."""
    root = np.arange(n)
    for i, j in links:
        while True:
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := root[root], root):
                root = up
    return root


def bucket_links(batches: Iterator[pa.RecordBatch], max_bits: int, enough: int = 60_000) -> Iterator[pa.RecordBatch]:
    """Star links of each bucket; the batches are sorted by (mask, key), a bucket may span them."""

    def solve(part: pa.Table) -> pa.RecordBatch:
        mask, key, fp = (part.column(k).to_numpy() for k in ("mask", "key", "fp"))
        code = fp.view(np.uint64)
        bucket = np.cumsum(np.r_[False, (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])])
        order = np.lexsort((gray_rank(code), bucket))
        code = code[order]
        root = local_roots(len(code), GrayIndex(bucket[order], code).pairs(max_bits))
        linked = root != np.arange(len(code))
        return pa.RecordBatch.from_arrays([pa.array(code[linked].view(np.int64)), pa.array(code[root[linked]].view(np.int64))], ["a", "b"])

    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < enough:
            continue
        whole = pa.Table.from_batches(held)
        mask, key = whole.column("mask").to_numpy(), whole.column("key").to_numpy()
        same = (mask == mask[-1]) & (key == key[-1])
        last = int(np.argmax(same))  # the bucket that may go on in the next batch
        if last:
            yield solve(whole.slice(0, last))
        held = whole.slice(last).to_batches()
        rows = sum(x.num_rows for x in held)
    if rows:
        yield solve(pa.Table.from_batches(held))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(distinct: DataFrame, max_bits: int = 2, crowd: int = 4096) -> DataFrame:
    """Links ``(a, b)`` that connect exactly the distinct fingerprints (column ``fp``)
    reachable over pairs of at most ``max_bits`` differing bits.

    Every pattern class yields a spanning star per connected part, not all pairs.
    """
    if max_bits > 2:
        raise ValueError("the two-of-four block patterns cover at most 2 differing bits")
    block = [0xFFFF << (16 * k) for k in range(4)]
    upper = [block[i] | block[j] for i, j in combinations(range(4), 2)]
    lower = []
    for i, j in combinations(range(4), 2):
        rest = [k for k in range(4) if k not in (i, j)]
        small = [0xFF << (16 * k + s) for k in rest for s in (0, 8)]
        lower.append([block[i] | block[j] | small[x] | small[y] for x, y in combinations(range(4), 2)])

    def filed(df: DataFrame, masks) -> DataFrame:
        held = df.select("fp", F.explode(masks).alias("mask"))
        return held.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")

    def array_of(masks: list[int]):
        return F.array(*[F.lit(_signed(m)).cast("long") for m in masks])

    first = filed(distinct, array_of(upper))
    size = first.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    first = first.join(size, ["mask", "key"])
    finer = F.element_at(F.create_map(*[x for m, low in zip(upper, lower) for x in (F.lit(_signed(m)).cast("long"), array_of(low))]), F.col("mask"))
    crowded = first.where(F.col("n") > crowd).select("fp", F.explode(finer).alias("mask"))
    crowded = crowded.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    rows = first.where(F.col("n") <= crowd).select("mask", "key", "fp").unionAll(crowded)
    rows = rows.repartition(tasks_for(distinct, 1 << 27), "mask", "key").sortWithinPartitions("mask", "key")
    return rows.mapInArrow(lean(lambda batches: bucket_links(batches, max_bits)), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 2) -> DataFrame:
    """One row ``(id_col, fingerprint, component_id)`` per row of ``docs``."""
    prints = cut(fingerprints(docs, id_col, text_col))
    kinds = cut(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("rows")))
    labels = components(links(kinds.select("fp"), max_bits))
    named = labels.join(kinds, labels.node == kinds.fp).select("fp", "root", "least")
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = named.join(smallest, "root").select("fp", F.col("component_id").alias("via"))
    final = cut(kinds.join(linked, "fp", "left").select("fp", "rows", F.coalesce("via", "least").alias("component_id")))
    # a fingerprint that many rows share (at most 10,000 can have more than a 10,000th of them) is
    # broadcast, so its rows stay where they are; no other one is large enough to fill a task
    total = final.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    hot = F.col("rows") > max(total // 10_000, 100)
    told = prints.join(F.broadcast(final.where(hot).select("fp", F.lit(True).alias("hot"), "component_id")), "fp", "left")
    out = told.where("hot").drop("hot").unionByName(told.where("hot is null").drop("hot", "component_id").join(final.where(~hot).drop("rows"), "fp"))
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 2) -> DataFrame:
    """``docs`` with one row of each component: of its smallest id (nulls last), then smallest text digest."""
    prints = cut(fingerprints(docs, id_col, text_col, digests=True))
    row = F.struct(F.col("id").isNull().alias("none"), "id", "md5")
    kinds = cut(prints.groupBy("fp").agg(F.min(row).alias("least")))
    labels = components(links(kinds.select("fp"), max_bits))
    named = kinds.join(labels, kinds.fp == labels.node, "left").select(F.coalesce("root", "fp").alias("root"), "least")
    kept = named.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.id").alias("__id"), F.col("least.md5").alias("__kept"))
    held = docs.withColumn("__md5", text_digest(text_col))
    held = held.join(kept, F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & F.col("__md5").eqNullSafe(F.col("__kept")), "left_semi")
    # rows that repeat both id and text
    again = prints.groupBy("id", "md5").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    return (held.dropDuplicates([id_col, "__md5"]) if again else held).select(*docs.columns)
