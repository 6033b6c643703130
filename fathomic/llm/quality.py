"""Text quality by a generalised additive model with pairwise interactions.

Features are shape statistics of the whole text (lengths, character-class shares,
word and line repetition).  Every feature is cut into quantile bins; boosting goes
round the features in a fixed cycle and adds a shallow tree (at most four leaves)
of one feature to that feature's lookup table, then does the same for the pairs
whose residual tables gain most.  A score is the logistic of a sum of table
look-ups, done for a whole batch by vectorised bin additions.

Bound: the model is fitted on at most ``sample_rows`` labelled rows, those with the
smallest id hashes.

Defined results: null and empty texts have all-zero statistics and are scored like
any other; rows with a null label are not learned from; without a labelled row of
each class the score is the share of label 1 (0.5 without any row); repeated rows
repeat; an input column of the result's name gives way to it; an id that several
rows have is learned from once (the least of its rows' statistics), and counts as 1 if
its labels differ; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, kept_columns, lean, slices, split_words

FEATURES = [
    "chars", "words", "lines", "word_bytes", "upper", "digit", "blank", "stop", "comma", "mark", "symbol", "pipe", "multibyte",
    "distinct_words", "top_word", "repeated_next", "distinct_lines", "top_line", "line_bytes", "end_mark", "caps_words", "sentence_words",
]
_BYTE = np.arange(256)
_CLASS = {
    "upper": (_BYTE >= 65) & (_BYTE <= 90),
    "digit": (_BYTE >= 48) & (_BYTE <= 57),
    "blank": np.isin(_BYTE, [9, 10, 11, 12, 13, 32]),
    "stop": np.isin(_BYTE, [33, 46, 63]),
    "comma": np.isin(_BYTE, [44, 58, 59]),
    "mark": _BYTE == 33,
    "symbol": np.isin(_BYTE, [35, 36, 37, 38, 42, 43, 60, 61, 62, 64, 92, 94, 95, 96, 123, 125, 126]),
    "pipe": _BYTE == 124,
    "multibyte": _BYTE >= 192,
}


def features(texts: pa.Array) -> np.ndarray:
    """Feature matrix of an Arrow string array, one row a text, columns as FEATURES."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    out = np.zeros((n, len(FEATURES)))
    at = {f: k for k, f in enumerate(FEATURES)}
    hist = np.zeros((n, 256))
    buffers, start = texts.buffers(), texts.offset
    bounds = np.frombuffer(buffers[1], np.int64)[start : start + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    for i in range(n):
        hist[i] = np.bincount(data[bounds[i] : bounds[i + 1]], minlength=256)
    size = np.maximum(np.diff(bounds), 1).astype(float)
    out[:, at["chars"]] = np.log1p(np.diff(bounds))
    for name, member in _CLASS.items():
        out[:, at[name]] = hist[:, member].sum(1) / size
    codes, vocabulary, offsets = split_words(texts)
    count = np.diff(offsets)
    some = np.maximum(count, 1)
    doc = np.repeat(np.arange(n), count)
    key = np.sort(doc * np.int64(len(vocabulary) + 1) + codes)
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    run, owner = np.diff(np.r_[first, len(key)]), (key[first] // (len(vocabulary) + 1)).astype(np.int64)
    top = np.zeros(n)
    np.maximum.at(top, owner, run)
    same = (codes[1:] == codes[:-1]) & (doc[1:] == doc[:-1]) if len(codes) else np.empty(0, bool)
    out[:, at["words"]] = np.log1p(count)
    out[:, at["distinct_words"]] = np.bincount(owner, minlength=n) / np.sqrt(some)
    out[:, at["top_word"]] = top / some
    out[:, at["repeated_next"]] = np.bincount(doc[1:][same], minlength=n) / some if len(codes) else 0
    length = pc.binary_length(vocabulary).to_numpy(zero_copy_only=False)
    caps = pc.utf8_is_upper(vocabulary).to_numpy(zero_copy_only=False)
    ends = pc.match_substring_regex(vocabulary, r"[.!?]$").to_numpy(zero_copy_only=False)
    if len(codes):
        out[:, at["word_bytes"]] = np.bincount(doc, length[codes], n) / some
        out[:, at["caps_words"]] = np.bincount(doc, caps[codes] & (length[codes] > 1), n) / some
        closed = np.bincount(doc, ends[codes], n)
        out[:, at["end_mark"]] = closed / some
        out[:, at["sentence_words"]] = np.log1p(some / (closed + 1))
    for i, text in enumerate(texts.to_pylist()):
        lines = text.split("\n")
        kinds: dict[str, int] = {}
        for x in lines:
            kinds[x] = kinds.get(x, 0) + 1
        out[i, at["lines"]] = np.log1p(len(lines))
        out[i, at["distinct_lines"]] = len(kinds) / len(lines)
        out[i, at["top_line"]] = max(kinds.values()) / len(lines)
        out[i, at["line_bytes"]] = np.log1p(size[i] / len(lines))
    return out


def small_tree(g: np.ndarray, h: np.ndarray, l2: float, depth: int = 2) -> np.ndarray:
    """Step function over bins, the tree of ``depth`` splits that lowers the loss most greedily."""
    if depth and len(g) > 1:
        gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gr, hr = g.sum() - gl, h.sum() - hl
        gain = np.where((hl > 2) & (hr > 2), gl**2 / (hl + l2) + gr**2 / (hr + l2), -np.inf)
        k = int(gain.argmax())
        if gain[k] > g.sum() ** 2 / (h.sum() + l2) + 1e-9:
            return np.concatenate([small_tree(g[: k + 1], h[: k + 1], l2, depth - 1), small_tree(g[k + 1 :], h[k + 1 :], l2, depth - 1)])
    return np.full(len(g), g.sum() / (h.sum() + l2))


def small_tree_pair(g: np.ndarray, h: np.ndarray, l2: float) -> np.ndarray:
    """The like over a two-way table: one split of an axis, then one of the other axis in each half."""
    best, found = -np.inf, None
    for axis in (0, 1):
        a, b = (g, h) if axis == 0 else (g.T, h.T)
        for k in range(1, len(a)):
            halves = [small_tree(x.sum(0), y.sum(0), l2, 1) for x, y in ((a[:k], b[:k]), (a[k:], b[k:]))]
            gain = sum((2 * x.sum(0) * t - (y.sum(0) + l2 / len(t)) * t * t).sum() for t, x, y in zip(halves, (a[:k], a[k:]), (b[:k], b[k:])))
            if gain > best:
                table = np.concatenate([np.tile(halves[0], (k, 1)), np.tile(halves[1], (len(a) - k, 1))])
                best, found = gain, table if axis == 0 else table.T
    return np.zeros_like(g) if found is None else found


@dataclass
class AdditiveModel:
    """Lookup tables of a boosted additive model over quantile bins."""

    edges: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, bins: int = 48, pair_bins: int = 8, rounds: int = 150, pair_rounds: int = 60, most_pairs: int = 10, rate: float = 0.1, l2: float = 2.0) -> AdditiveModel:
        share = float(np.clip(y.mean(), 1e-4, 1 - 1e-4)) if len(y) else 0.5
        self.base = float(np.log(share / (1 - share)))
        cuts = lambda c, k: np.unique(np.quantile(c, np.arange(1, k) / k)) if len(c) else np.empty(0)
        self.edges, self.coarse = ([cuts(c, k) for c in x.T] for k in (bins, pair_bins))
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        if not 0 < y.sum() < len(y):
            return self
        fine, rough = self._bin(x, self.edges), self._bin(x, self.coarse)
        score = np.full(len(y), self.base)

        def slopes() -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-score))
            return y - p, p * (1 - p)

        for _ in range(rounds):
            for f, table in enumerate(self.tables):
                if len(table) > 1:
                    g, h = slopes()
                    step = rate * small_tree(np.bincount(fine[f], g, len(table)), np.bincount(fine[f], h, len(table)), l2)
                    table += step
                    score += step[fine[f]]
        ranked = []
        g, h = slopes()
        for a in range(len(self.coarse)):
            for b in range(a):
                shape = (len(self.coarse[a]) + 1, len(self.coarse[b]) + 1)
                if min(shape) > 1:
                    cell = rough[a] * shape[1] + rough[b]
                    gs, hs = np.bincount(cell, g, shape[0] * shape[1]), np.bincount(cell, h, shape[0] * shape[1])
                    ranked.append(((gs**2 / (hs + l2)).sum(), a, b))
        self.pairs = [(a, b) for _, a, b in sorted(ranked, reverse=True)[:most_pairs]]
        self.pair_tables = [np.zeros((len(self.coarse[a]) + 1, len(self.coarse[b]) + 1)) for a, b in self.pairs]
        for _ in range(pair_rounds):
            for (a, b), table in zip(self.pairs, self.pair_tables):
                g, h = slopes()
                cell = rough[a] * table.shape[1] + rough[b]
                gs, hs = (np.bincount(cell, v, table.size).reshape(table.shape) for v in (g, h))
                step = rate * small_tree_pair(gs, hs, l2)
                table += step
                score += step[rough[a], rough[b]]
        return self

    @staticmethod
    def _bin(x: np.ndarray, edges: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)]

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 per row."""
        score = np.full(len(x), self.base)
        for table, k in zip(self.tables, self._bin(x, self.edges)):
            score += table[k]
        rough = self._bin(x, self.coarse)
        for (a, b), table in zip(self.pairs, self.pair_tables):
            score += table[rough[a], rough[b]]
        return 1 / (1 + np.exp(-score))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = 16_000) -> AdditiveModel:
    """Learn from the labelled documents for which ``learn`` (over ``id_col``) holds."""
    bound_batches(docs.sparkSession)
    marked = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), (F.col(label_col) > 0).cast("int").alias("y"))
    marked = marked.where(F.col("id").isNotNull()).groupBy("id").agg(F.max("y").alias("y"))
    texts = docs.where(learn).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    chosen = texts.select("id").distinct().join(marked, "id").orderBy(F.xxhash64(F.col("id").cast("string"), F.lit(4)), "id").limit(sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            x = features(part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(list(x), pa.list_(pa.float64()))], ["id", "y", "x"])

    held = texts.join(F.broadcast(chosen), "id").select("id", "text", "y")  # at most sample_rows ids
    told = held.mapInArrow(lean(run), held.select("id", "y").schema.add("x", T.ArrayType(T.DoubleType())))
    got = told.groupBy("id").agg(F.max("y").alias("y"), F.min("x").alias("x")).toPandas().sort_values("id", kind="stable")
    x = np.array(got["x"].tolist()).reshape(len(got), len(FEATURES))
    return AdditiveModel().fit(x, got["y"].to_numpy(float))


def score(docs: DataFrame, model: AdditiveModel, keep: list[str] | None = None, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` columns named in ``keep`` plus the score, as ``name``."""
    bound_batches(docs.sparkSession)
    keep = kept_columns(docs, keep, (name,))
    schema = docs.select(*keep).schema.add(name, "double")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "__text"):
            found = shared.value.predict(features(part.column(part.num_columns - 1)))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(found)], names=[f.name for f in schema.fields])

    return docs.select(*keep, F.col(text_col).cast("string").alias("__text")).mapInArrow(lean(run), schema)
