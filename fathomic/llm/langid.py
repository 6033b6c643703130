"""Language identification with a string kernel.

Kernel: blended-spectrum presence kernel, ``k(x, y) = |G(x) & G(y)| / sqrt(|G(x)||G(y)|)``
over the sets of character n-grams (n = 1..3) of the lower-cased texts.  Nystroem landmarks give the feature map
``k(x, L) K_LL^(-1/2)``; one-versus-rest kernel ridge regression on it gives one
column of dual weights a language.  A batch of texts is scored by two matrix
products: presence x landmarks, then kernel rows x weights.

The model is fitted on a bounded sample (``sample_total`` labelled rows, the ones
with the smallest id hashes, shared evenly by language); predicting reads every
text whole, in pieces of any length.

Defined results: a text that is null or has no letter is ``und`` with score 0; a
corpus without a labelled row gives ``und`` throughout; repeated rows repeat;
ids may be null (such rows count as the id of empty text for the fold); an input
column of a result's name gives way to the result (``names`` can rename those); of
equal scores the language that sorts first wins; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, kept_columns, lean, slices

BITS = 20
#: Odd multipliers of the three n-gram orders (a multiply-shift hash into BITS bits).
MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
PIECE = 1 << 19


def gram_codes(text: str) -> Iterator[np.ndarray]:
    """Codes of all n-grams of a lower-cased text, piece by piece with overlap."""
    for at in range(0, max(len(text), 1), PIECE):
        c = np.frombuffer(text[at : at + PIECE + 2].encode("utf-32-le", "surrogatepass"), np.uint32)
        one = c * MULTIPLIERS[0]
        yield one >> np.uint32(32 - BITS)
        two = (one[:-1] ^ np.uint32(0x2545F491)) * MULTIPLIERS[1] + c[1:] * MULTIPLIERS[2]
        yield two >> np.uint32(32 - BITS)
        three = (two[:-1] ^ np.uint32(0x6C8E9CF5)) * MULTIPLIERS[0] + c[2:] * MULTIPLIERS[1]
        yield three >> np.uint32(32 - BITS)


def gram_set(text: str) -> np.ndarray:
    flag = np.zeros(1 << BITS, bool)
    for codes in gram_codes(text):
        flag[codes] = True
    return np.flatnonzero(flag).astype(np.int32)


def _lower(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column.cast(pa.large_string()))


@dataclass
class LanguageModel:
    languages: list[str]
    column: np.ndarray  # n-gram code -> column, -1 outside the landmarks
    landmarks: np.ndarray  # columns x landmarks, each scaled to unit length
    weights: np.ndarray  # landmarks x languages
    bias: np.ndarray  # one per language

    def scores(self, texts: list[str], step: int = 128) -> np.ndarray:
        """One decision value per text and language."""
        width = self.landmarks.shape[0]
        out = np.empty((len(texts), len(self.languages)), np.float32)
        for at in range(0, len(texts), step):
            part = texts[at : at + step]
            present = np.zeros((len(part), width + 1), np.float32)  # column -1 takes the unknown
            grams = np.ones(len(part))
            flag = np.zeros(1 << BITS, bool)
            for k, text in enumerate(part):
                flag[:] = False
                for codes in gram_codes(text):
                    flag[codes] = True
                    present[k, self.column[codes]] = 1
                grams[k] = max(np.count_nonzero(flag), 1)  # also those that no landmark has
            present = present[:, :width]
            norm = np.sqrt(grams)
            out[at : at + step] = ((present @ self.landmarks) / norm[:, None]) @ self.weights + self.bias
        return out


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_total: int = 1600, landmarks: int = 96, ridge: float = 0.02) -> LanguageModel | None:
    """Fit on a sample of at most ``sample_total`` labelled rows for which ``learn`` holds."""
    bound_batches(docs.sparkSession)
    rows = docs.where(learn).where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    rows = rows.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    # ids first (no text is shuffled).  Salts of the hash thin a language's rows before its own
    # window sees them: its smallest hashes lie evenly over the salts.
    order, salts = F.xxhash64(F.col("id").cast("string"), F.lit(8)), 64
    hashed = rows.select("id", "lang", order.alias("h")).distinct().withColumn("salt", F.pmod("h", F.lit(salts)))
    thin = hashed.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy("h", "id"))).where(F.col("place") <= 4 * sample_total // salts + 32)
    spread = thin.select("id", "lang", "h").withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))).where(F.col("place") <= sample_total)
    ids = spread.orderBy("place", "h", "lang").limit(sample_total).select("id", "lang")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sets = [gram_set(x).tobytes() for x in _lower(part.column(2)).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sets, pa.binary())], ["id", "lang", "grams"])

    sample = rows.join(F.broadcast(ids), ["id", "lang"]).select("id", "lang", "text").mapInArrow(lean(grams), rows.select("id", "lang").schema.add("grams", "binary"))
    # rows that share id and language count once: at most sample_total rows come to the driver
    got = sorted(sample.groupBy("id", "lang").agg(F.min("grams").alias("grams")).collect(), key=lambda r: (str(r.lang), str(r.id)))
    if not got:
        return None
    languages = sorted({r.lang for r in got})
    sets = [np.frombuffer(r.grams, np.int32) for r in got]
    label = np.array([languages.index(r.lang) for r in got])
    # landmarks: in turn from each language, those with the most n-grams first (short texts span little)
    queues = [sorted(np.flatnonzero(label == k), key=lambda i: (-len(sets[i]), i)) for k in range(len(languages))]
    # every other one of the richer half, so that landmarks are not all the longest texts
    queues = [q[: max(1, len(q) // 2)][::2] for q in queues]
    chosen = [q[r] for r in range(max(map(len, queues))) for q in queues if r < len(q)][:landmarks]
    known = np.unique(np.concatenate([sets[i] for i in chosen]))
    column = np.full(1 << BITS, -1, np.int32)
    column[known] = np.arange(len(known))
    marks = np.zeros((len(known), len(chosen)), np.float32)
    for k, i in enumerate(chosen):
        marks[column[sets[i]], k] = 1 / np.sqrt(len(sets[i]))
    kernel = np.zeros((len(sets), len(chosen)))
    for row, s in zip(kernel, sets):
        inside = column[s]
        inside = inside[inside >= 0]
        row[:] = marks[inside].sum(0) / np.sqrt(max(len(s), 1))
    value, vector = np.linalg.eigh(kernel[chosen])
    usable = value > 1e-6 * value[-1]
    root = vector[:, usable] / np.sqrt(value[usable])
    phi = kernel @ root
    phi = np.concatenate([phi, np.ones((len(phi), 1))], 1)
    target = np.where(label[:, None] == np.arange(len(languages)), 1.0, -1.0)
    # rows weigh so that languages count alike
    w = (len(label) / (len(languages) * np.bincount(label, minlength=len(languages))))[label]
    solved = np.linalg.solve(phi.T @ (phi * w[:, None]) + ridge * np.eye(phi.shape[1]), phi.T @ (target * w[:, None]))
    return LanguageModel(languages, column, marks, (root @ solved[:-1]).astype(np.float32), solved[-1].astype(np.float32))


def predict(docs: DataFrame, model: LanguageModel | None, keep: list[str] | None = None, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` columns named in ``keep`` plus the prediction and its score, as ``names``."""
    keep = kept_columns(docs, keep, names)
    bound_batches(docs.sparkSession)
    held = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))
    schema = docs.select(*keep).schema.add(names[0], "string").add(names[1], "double")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part in slices(batches, "__text"):
            texts = part.column(part.num_columns - 1)
            letters = pc.fill_null(pc.match_substring_regex(texts.cast(pa.large_string()), r"\p{L}"), False).to_numpy(zero_copy_only=False)
            lang, score = np.full(len(texts), "und", object), np.zeros(len(texts))
            if model is not None and letters.any():
                s = model.scores(_lower(texts.filter(pa.array(letters))).to_pylist())
                best = s.argmax(1)
                lang[letters] = np.array(model.languages, object)[best]
                score[letters] = np.clip((1 + s[np.arange(len(s)), best].astype(float)) / 2, 0, 1)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(lang, pa.string()), pa.array(score)], names=[f.name for f in schema.fields])

    return held.mapInArrow(lean(run), schema)
