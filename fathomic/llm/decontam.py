"""Benchmark decontamination by spaced-seed hashing.

Texts become lower-cased words without marks at their ends.  A fixed mask keeps some
positions and ignores the others, so a window hash survives substitutions at ignored
places.  A document is contaminated by an item when ``window`` consecutive aligned
words (or the whole item, when it is shorter) agree in at least ``share`` of the
places; items of so few words that the share allows no substitution match exactly.
The masks are derived from window and share (``seeds``): wherever the tolerated
substitutions fall, some mask misses them all, so no such overlap is lost.

Test and training windows meet in a join on their hashes.  Before it, a bitmap of the
benchmark's hashes (at most ``2 ** most_bits`` bits, broadcast) drops nearly all
training windows; a larger benchmark only fills it more, and the join stays exact.
Hits name alignments (document, item, diagonal); every distinct one is verified word
by word.  Equal texts, of documents as of items, are one throughout and spread out at
the end.  Benchmark tables are broadcast up to ``small_rows`` rows; beyond, joins are
salted, so a passage that a third of the corpus holds is not one task's.

Defined results: null and empty texts and items (and those of marks only) match
nothing, nor do items of fewer than ``least`` words (1: all are looked for); items of
equal text are all reported; items with a null id are reported as null ids, which
sort first; repeated documents repeat; texts of any length are compared whole; an
input column of a result's name gives way to the result (``names`` can rename those);
an empty table gives no rows.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut, kept_columns, lean, slices, split_words

_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
#: Odd multipliers of the kept positions, multiples of the golden ratio's bits.
_MIX = [np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) % (1 << 64) | 1) for k in range(13)]
#: Salts of joins on a hash or an item that very many documents may hold.
SALTS = 16


@functools.cache
def seeds(length: int, subs: int, most: int = 4, widest: int = 12) -> tuple[str, ...]:
    """Masks (1: kept, 0: ignored) of which one, somewhere inside ``length`` places, misses any ``subs``
    substitutions.  Of ``subs // 3 + 1`` equal parts one holds at most two of them, so the masks are those of
    a part: the heaviest that cover all places of the substitutions greedily, or a run of ones, which is
    always there (``subs`` places leave a run of ``(length - subs) / (subs + 1)``) and is long enough in
    long windows."""
    parts = subs // 3 + 1
    length, subs = length // parts, subs // parts
    run = -(-(length - subs) // (subs + 1))
    if subs == 0 or run >= 8:
        return ("1" * min(run, widest),)
    changed = np.array([sum(1 << p for p in places) for places in combinations(range(length), subs)], np.int64)
    for weight in range(length - subs, run, -1):
        masks, met = [], []
        for span in range(weight, min(length, widest) + 1):
            for inner in combinations(range(1, span - 1), weight - 2):
                mask = 1 | 1 << (span - 1) | sum(1 << p for p in inner)
                masks.append(f"{mask:0{span}b}")
                met.append(np.any([changed & (mask << at) == 0 for at in range(length - span + 1)], axis=0))
        open_, chosen = np.ones(len(changed), bool), []
        while masks and open_.any() and len(chosen) < most:
            best = int((np.array(met) & open_).sum(1).argmax())
            chosen.append(masks[best])
            open_ &= ~met[best]
        if not open_.any():
            return tuple(chosen)
    return ("1" * run,)


def masks_for(words: int, window: int, share: float) -> tuple[str, ...]:
    """The masks of an item of so many words.  Shorter items that tolerate as many substitutions as a still
    shorter length use that one's masks, so there are few masks in all."""
    allowed = lambda n: n - math.ceil(share * n - 1e-9)
    n = min(words, window)
    if n < window and allowed(n):
        n = next(m for m in range(1, n + 1) if allowed(m) == allowed(n))
    return seeds(n, allowed(n))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, offsets)``: normalised words of text i are ``hashes[offsets[i]:offsets[i+1]]``."""
    if pc.any(pc.match_substring_regex(texts, r"[\t\v\f\r]")).as_py():
        texts = pc.replace_substring_regex(texts, r"[\t\v\f\r]", " ")
    codes, vocabulary, offsets = split_words(texts, lower=True)
    table = np.zeros(len(vocabulary), np.uint64)
    for k, word in enumerate(vocabulary.to_pylist()):
        if bare := _EDGE.sub("", word):
            table[k] = xxhash.xxh3_64_intdigest(bare) | 1
    hashes = table[codes] if len(codes) else np.empty(0, np.uint64)
    keep = hashes != 0
    return hashes[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


def window_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    """Hash of every window of ``len(mask)`` words under the mask."""
    n = len(words) - len(mask) + 1
    out = np.full(max(n, 0), np.uint64(xxhash.xxh3_64_intdigest(mask)))
    if n > 0:
        for mix, p in zip(_MIX, (i for i, x in enumerate(mask) if x == "1")):
            out += words[p : p + n] * mix
            out ^= out >> np.uint64(29)
    return out


def slots(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two places of each hash in a bitmap of ``2 ** bits`` bits."""
    shift = np.uint64(64 - bits)
    return hashes >> shift, (hashes * _MIX[12]) >> shift


def _items(benchmark: DataFrame, item_id: str, item_text: str, least: int) -> DataFrame:
    """``(id, kind, words)`` of the items that have ``least`` words: kind is a digest of the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            words, offsets = word_hashes(part.column(1))
            size = np.diff(offsets)
            told = [words[s:e] for s, e in zip(offsets[:-1], offsets[1:])]
            kinds = [xxhash.xxh3_128_digest(w.tobytes()) for w in told]
            whole = pa.RecordBatch.from_arrays([part.column(0), pa.array(kinds, pa.binary()), pa.array([w.view(np.int64) for w in told], pa.list_(pa.int64()))], ["id", "kind", "words"])
            yield whole.filter(pa.array(size >= max(least, 1)))

    held = benchmark.select(F.col(item_id).cast("long").alias("id"), F.make_valid_utf8(F.col(item_text).cast("string")).alias("text"))
    return held.mapInArrow(lean(run), "id long, kind binary, words array<long>")


def _words_of(column: pa.Array) -> Iterator[np.ndarray]:
    flat, ends = column.values.to_numpy(zero_copy_only=False).view(np.uint64), column.offsets.to_numpy()
    return (flat[s:e] for s, e in zip(ends[:-1], ends[1:]))


def verify(rows: pa.RecordBatch, window: int, share: float) -> np.ndarray:
    """For each alignment of equally long pieces ``ours`` and ``theirs`` of an item of ``n`` words: how many
    words agree, 0 where no window of the item's agrees enough."""
    size = pc.list_value_length(rows.column("ours")).to_numpy(zero_copy_only=False).astype(np.int64)
    same = pc.list_flatten(rows.column("ours")).to_numpy(zero_copy_only=False) == pc.list_flatten(rows.column("theirs")).to_numpy(zero_copy_only=False)
    w = np.minimum(rows.column("n").to_numpy(zero_copy_only=False), window).astype(np.int64)
    upto = np.concatenate([[0], np.cumsum(same)])
    first = np.concatenate([[0], np.cumsum(size)])
    places = np.maximum(size - w + 1, 0)
    row = np.repeat(np.arange(len(size)), places)
    at = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(places) - places, places)
    best = np.zeros(len(size), np.int64)
    np.maximum.at(best, row, upto[at + w[row]] - upto[at])
    return np.where((places > 0) & (best >= share * w - 1e-9), upto[first[1:]] - upto[first[:-1]], 0)


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: float = 0.8, least: int = 1, keep: list[str] | None = None, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", names: tuple[str, str] = ("item_ids", "matched_words"), small_rows: int = 100_000, most_bits: int = 28) -> DataFrame:
    """``docs`` columns named in ``keep`` plus, as ``names``, the sorted ids of the items found in the text
    (empty for a clean one) and the most words that agree in one alignment."""
    spark = docs.sparkSession
    bound_batches(spark)
    keep = kept_columns(docs, keep, names)
    items = cut(_items(benchmark, item_id, item_text, least))
    kinds = cut(items.groupBy("kind").agg(F.first("words").alias("words")))
    members = items.select("kind", "id").distinct()

    def file_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, words in zip(batch.column(0).to_pylist(), _words_of(batch.column(1))):
                for mask in masks_for(len(words), window, share):
                    h = window_hashes(words, mask)
                    if len(h):
                        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array([kind] * len(h), pa.binary()), pa.array(np.arange(len(h), dtype=np.int32))], ["hash", "kind", "at"])

    filed = cut(kinds.mapInArrow(lean(file_windows), "hash long, kind binary, at int"))
    n, n_kinds, lengths = filed.count(), kinds.count(), [r.n for r in kinds.select(F.least(F.size("words"), F.lit(window)).alias("n")).distinct().collect()]
    masks = sorted({m for k in lengths for m in masks_for(k, window, share)})  # at most ``window`` lengths
    bits = min(most_bits, max(16, int(n * 256 - 1).bit_length()))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = np.concatenate(slots(batch.column(0).to_numpy().view(np.uint64), bits))
                word, which = np.unique(at >> np.uint64(6), return_inverse=True)
                value = np.zeros(len(word), np.uint64)
                np.bitwise_or.at(value, which, np.uint64(1) << (at & np.uint64(63)))
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(value.view(np.int64))], ["word", "value"])

    # at most 2 ** (most_bits - 6) rows
    marked = filed.select("hash").mapInArrow(lean(mark), "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toArrow()
    bitmap = np.zeros(1 << (bits - 6), np.uint64)
    bitmap[marked.column("word").to_numpy()] = marked.column("value").to_numpy().view(np.uint64)
    shared = spark.sparkContext.broadcast(bitmap.view(np.uint8))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = shared.value
        met = lambda at: (seen[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        for part in slices(batches, "__text"):
            words, offsets = word_hashes(part.column(1))
            for mask in masks:
                h = window_hashes(words, mask)
                at = np.flatnonzero(met(h >> np.uint64(64 - bits)))
                at = at[met(slots(h[at], bits)[1])]
                doc = np.searchsorted(offsets, at, "right") - 1
                inside = at + len(mask) <= offsets[doc + 1]  # windows across two texts are none
                at, doc = at[inside], doc[inside]
                if len(at):
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc)), pa.array(h[at].view(np.int64)), pa.array((at - offsets[doc]).astype(np.int32))], ["key", "hash", "place"])

    text = F.make_valid_utf8(F.col(text_col).cast("string"))
    key = F.unhex(F.md5(F.col(text_col).cast("string").cast("binary")))
    held = docs.where(F.col(text_col).isNotNull()).select(key.alias("__key"), text.alias("__text"))
    hits = held.mapInArrow(lean(probe), "key binary, hash long, place int").distinct()

    def meet(left: DataFrame, right: DataFrame, on: str, rows: int) -> DataFrame:
        """Join in which very many rows of the left may share a key: broadcast or salted."""
        if rows <= small_rows:
            return left.join(F.broadcast(right), on)
        left = left.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)))
        return left.join(right.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), [on, "salt"]).drop("salt")

    aligned = cut(meet(hits, filed, "hash", n).select("key", "kind", (F.col("place") - F.col("at")).alias("shift")).distinct())
    suspects = cut(aligned.select("key").distinct())

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "__text"):
            words, offsets = word_hashes(part.column(1))
            told = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(words.view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(0), told], ["key", "doc"])

    n_suspects = suspects.count()
    few = n_suspects <= small_rows
    texts = held.join(F.broadcast(suspects) if few else suspects, held["__key"] == suspects["key"], "left_semi").dropDuplicates(["__key"])
    spelled = texts.mapInArrow(lean(spell), "key binary, doc array<long>")
    pairs = meet(aligned, kinds.select("kind", "words", F.size("words").alias("n")), "kind", n_kinds).join(spelled, "key")
    begin, end = F.greatest(F.lit(0), -F.col("shift")), F.least(F.col("n"), F.size("doc") - F.col("shift"))
    pairs = pairs.withColumns({"begin": begin, "size": end - begin}).where("size > 0")
    pairs = pairs.select("key", "kind", "n", F.slice("words", F.col("begin") + 1, F.col("size")).alias("theirs"), F.slice("doc", F.col("begin") + F.col("shift") + 1, F.col("size")).alias("ours"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                agree = verify(batch, window, share)
                told = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(agree.astype(np.int32))], ["key", "kind", "agree"])
                yield told.filter(pa.array(agree > 0))

    sure = pairs.mapInArrow(lean(judge), "key binary, kind binary, agree int").groupBy("key", "kind").agg(F.max("agree").alias("agree"))
    named = sure.join(members, "kind").groupBy("key").agg(F.array_sort(F.collect_set(F.struct(F.col("id").isNotNull().alias("known"), "id"))).alias("found"), F.max("agree").alias("agree"))
    found = cut(named.select("key", F.transform("found", lambda x: x["id"]).alias("ids"), "agree"))
    # a row a contaminated text; small ones are broadcast, larger ones joined
    small = found.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()
    back = F.broadcast(found) if sum(small) <= small_rows else found
    ids, agree = names
    out = docs.select(*keep, key.alias("__key")).join(back.withColumnsRenamed({"key": "__found", "ids": "__ids", "agree": "__agree"}), F.col("__key") == F.col("__found"), "left")
    return out.select(*keep, F.coalesce("__ids", F.array().cast("array<bigint>")).alias(ids), F.coalesce("__agree", F.lit(0)).alias(agree))
