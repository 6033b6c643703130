"""Token-ID output as length-delimited binary records with a separate offset index.

Record file ``tokens-NNNNN-*.rec``: records one after another, each

    uint64 payload length | uint32 masked crc32 of these 8 bytes
    payload               | uint32 masked crc32 of the payload

all little-endian; the payload is ``int64 doc_id`` (0 and flag 1 where the id is
null), ``uint8 flags`` and the token ids as little-endian uint16 (vocabularies of
up to 65,536 ids) or uint32.  A mask keeps checksums of data that holds checksums
useful: ``((crc >> 15 | crc << 17) + 0xA282EAD8) mod 2**32``.
Index file ``tokens-NNNNN-*.idx``: per record ``int64 doc_id | uint64 record offset |
uint64 record length | uint64 tokens before it in the file``, for shuffled reads.

Files follow ascending ``doc_id`` order (file numbers are ranges of ids and the place
within them, as a file of ``roll_bytes`` or ``roll_records`` is followed by a new one;
records are sorted inside a file).  A task attempt writes under a name of its own and only
the names that the successful attempts report are read, so a lost executor's
half-written files are never seen.

Defined results: null text is empty; an empty text has the end id only; null
``doc_id`` sorts first; repeated ids sort next to each other (then by text
checksum), each with its own record; other columns are ignored; no documents give
no files and no rows.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, cut, lean, remove_tree, scratch, slices, split_words, tasks_for, worker_tag

INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("length", "<u8"), ("before", "<u8")])
MASK = 0xA282EAD8


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked_crc(size)), payload, struct.pack("<I", masked_crc(payload))))


def unframe(raw: bytes) -> bytes:
    """The payload of one whole record; raises on any damage."""
    size = raw[:8]
    if len(raw) < 16 or struct.unpack("<I", raw[8:12])[0] != masked_crc(size):
        raise ValueError("damaged record length")
    n = struct.unpack("<Q", size)[0]
    payload = raw[12 : 12 + n]
    if len(payload) != n or struct.unpack("<I", raw[12 + n : 16 + n])[0] != masked_crc(payload):
        raise ValueError("damaged record payload")
    return payload


class WordEncoder:
    """Encodes texts with a ``tokenizers`` model, one library call per new word.

    The models this serves never merge across white space (``splits_at_blanks``), so
    a text's ids are its words' ids in order; words already met come from a table.
    The table is kept small by two folds that change no id: the model lower-cases,
    so ASCII capitals are lowered first, and a run of common marks after a letter or
    digit is a token run of its own.  Words with a special token's opening are not
    folded.
    """

    MARKS = ".,!?;:%&*$#"
    #: Latin letters and digits that stay one letter when composed and lowered (U+0130 does not).
    LETTER_END = "[0-9a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]$"

    def __init__(self, path: str, most: int = 450_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.model, self.most = Tokenizer.from_file(path), most
        self.known: dict[str, int] = {}
        self._reset()

    def _reset(self) -> None:
        self.known.clear()
        self.ids = np.empty(1 << 16, np.int32)
        self.ends = np.zeros(1, np.int64)

    def _learn(self, words: list[str]) -> None:
        encoded = [e.ids for e in self.model.encode_batch_fast(words, add_special_tokens=False)]
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
        at, new = int(self.ends[-1]), np.fromiter((i for e in encoded for i in e), np.int32, int(sizes.sum()))
        if at + len(new) > len(self.ids):
            self.ids = np.concatenate([self.ids[:at], np.empty(max(len(new), at), np.int32)])
        self.ids[at : at + len(new)] = new
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words))))
        self.ends = np.concatenate([self.ends, at + np.cumsum(sizes)])

    def __call__(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, offsets)``: text i has ``ids[offsets[i]:offsets[i+1]]``, its last one ``end_id``."""
        codes, vocabulary, offsets = split_words(texts)
        if not len(codes):
            return np.full(len(texts), end_id, np.int32), np.arange(len(texts) + 1)
        plain = pc.invert(pc.match_substring(vocabulary, "<|"))
        lowered = pc.if_else(plain, pc.ascii_lower(vocabulary), vocabulary)
        stems = pc.utf8_rtrim(lowered, characters=self.MARKS)
        cut = pc.and_(plain, pc.match_substring_regex(stems, self.LETTER_END))
        stems = pc.if_else(cut, stems, lowered)
        # what the stem leaves of the word: marks are single bytes
        left = pc.subtract(pc.binary_length(lowered), pc.binary_length(stems)).to_numpy(zero_copy_only=False)
        ends = np.frombuffer(lowered.buffers()[1], np.int64)[lowered.offset : lowered.offset + len(lowered) + 1][1:]
        data = np.frombuffer(lowered.buffers()[2], np.uint8)
        bounds = np.concatenate([[0], np.cumsum(left)])
        bytes_ = data[np.repeat(ends - left - bounds[:-1], left) + np.arange(bounds[-1])]
        tails = pa.Array.from_buffers(pa.large_string(), len(left), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(bytes_.tobytes())])
        both = pa.concat_arrays([stems, tails]).dictionary_encode()
        words = both.dictionary.to_pylist()
        if len(self.known) + len(words) > self.most:
            self._reset()
        if fresh := [w for w in words if w not in self.known]:
            self._learn(fresh)
        place = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))[both.indices.to_numpy(zero_copy_only=False)]
        # a word's ids: its stem's and then its mark run's, put together once per distinct word
        begin, length = self.ends[:-1][place], (self.ends[1:] - self.ends[:-1])[place]
        n = len(stems)
        head, tail = length[:n], length[n:]
        done = np.concatenate([[0], np.cumsum(head + tail)])
        table = np.empty(done[-1], np.int32)
        for first, count, shift in ((begin[:n], head, 0), (begin[n:], tail, head)):
            ahead = np.cumsum(count) - count
            step = np.arange(count.sum())
            table[np.repeat(done[:-1] + shift - ahead, count) + step] = self.ids[np.repeat(first - ahead, count) + step]
        start, size = done[:-1][codes], (head + tail)[codes]
        total = np.concatenate([[0], np.cumsum(size)])
        bounds = total[offsets]
        source = np.repeat(start - total[:-1], size) + np.arange(total[-1])
        flat, n = table[source], len(offsets) - 1
        out = np.full(len(flat) + n, end_id, np.int32)
        keep = np.ones(len(out), bool)
        keep[bounds[1:] + np.arange(n)] = False
        out[keep] = flat
        return out, bounds + np.arange(n + 1)


_encoders: dict[tuple[str, bool], WordEncoder | TextEncoder] = {}


def encoder_for(path: str, by_word: bool) -> WordEncoder | TextEncoder:
    """One encoder per Python worker, so that its word table serves later tasks too."""
    if (path, by_word) not in _encoders:
        _encoders[path, by_word] = WordEncoder(path) if by_word else TextEncoder(path)
    return _encoders[path, by_word]


class TextEncoder:
    """Encodes whole texts, for models whose tokens may cross white space."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)

    def __call__(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids + [end_id] for e in self.model.encode_batch_fast([x or "" for x in texts.to_pylist()], add_special_tokens=False)]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)
        return np.fromiter((i for x in found for i in x), np.int32, int(offsets[-1])), offsets


def splits_at_blanks(path: str) -> bool:
    """Whether the model drops white space before it merges (so words are independent)."""
    import json

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [spec.get("pre_tokenizer") or {}]
    first = steps[0]
    rule = (first.get("pattern") or {}).get("Regex", "")
    special = [x for x in spec.get("added_tokens", []) if x.get("lstrip") or x.get("rstrip") or " " in x["content"] or "\n" in x["content"]]
    prefix = any(x.get("add_prefix_space") for x in steps)
    spaces_left = "\\s" in rule.replace("[^\\s", "") or " " in rule
    return first.get("type") == "Split" and first.get("behavior") == "Removed" and bool(first.get("invert")) and not (special or prefix or spaces_left)


def write_records(docs: DataFrame, out: str, tokenizer: str, end_id: int = 1, vocab_size: int = 49_408, id_col: str = "doc_id", text_col: str = "text", roll_bytes: int = 1 << 30, roll_records: int = 500_000) -> DataFrame:
    """Write every text of ``docs`` under the folder ``out``; the manifest comes back, one row
    ``(part, place, data, index, records, tokens)`` per file, already run and checkpointed."""
    kind = np.dtype("<u2") if vocab_size <= 1 << 16 else np.dtype("<u4")
    by_word = splits_at_blanks(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encoder, place = TaskContext.get().partitionId(), None, 0
        fs, base = pafs.FileSystem.from_uri(out)
        stream, name, rows, at, tokens = None, "", [], 0, 0

        def finish() -> pa.RecordBatch:
            stream.close()
            with fs.open_output_stream(f"{base}/{name}.idx") as file:
                file.write(np.array(rows, INDEX).tobytes())
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "place": pa.array([place], pa.int32()), "data": [f"{name}.rec"], "index": [f"{name}.idx"], "records": [len(rows)], "tokens": [tokens]})

        for piece in slices(batches, "text"):
            if stream is None:
                encoder = encoder_for(tokenizer, by_word)
                fs.create_dir(base, recursive=True)
                name, rows, at, tokens = f"tokens-{part:05d}-{place:04d}-{worker_tag()}", [], 0, 0
                stream = fs.open_output_stream(f"{base}/{name}.rec")
            ids, offsets = encoder(piece.column(1), end_id)
            flat = ids.astype(kind).tobytes()
            chunks = []
            for k, doc in enumerate(piece.column(0).to_pylist()):
                s, e = int(offsets[k]), int(offsets[k + 1])
                record = frame(struct.pack("<qB", doc or 0, doc is None) + flat[s * kind.itemsize : e * kind.itemsize])
                rows.append((doc or 0, at, len(record), tokens))
                chunks.append(record)
                at, tokens = at + len(record), tokens + e - s
            stream.write(b"".join(chunks))
            if at >= roll_bytes or len(rows) >= roll_records:
                yield finish()
                stream, place = None, place + 1
        if stream is not None:
            yield finish()

    spark = docs.sparkSession
    n = tasks_for(docs, 1 << 28)
    held = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    bound_batches(spark)
    ordered = held.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.crc32(F.col("text").cast("binary")))
    return cut(ordered.mapInArrow(lean(run), "part int, place int, data string, index string, records long, tokens long"))


def read_records(manifest: DataFrame, out: str, vocab_size: int = 49_408) -> DataFrame:
    """Read the files of a manifest back through their indexes: rows ``(doc_id, start,
    n_tokens, ids)``, ``ids`` as little-endian uint32 bytes, every checksum verified."""
    kind = np.dtype("<u2") if vocab_size <= 1 << 16 else np.dtype("<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(out)
        for batch in batches:
            for data, index, before in zip(*(batch.column(c).to_pylist() for c in ("data", "index", "before"))):
                with fs.open_input_stream(f"{base}/{index}") as file:
                    entries = np.frombuffer(file.read(), INDEX)
                with fs.open_input_file(f"{base}/{data}") as file:
                    k = 0
                    while k < len(entries):
                        stop = int(np.searchsorted(entries["offset"], entries["offset"][k] + np.uint64(2_000_000), side="left"))
                        stop = max(stop, k + 1)
                        first, last = entries[k], entries[stop - 1]
                        raw = file.read_at(int(last["offset"] + last["length"] - first["offset"]), int(first["offset"]))
                        docs, starts, sizes, blobs = [], [], [], []
                        for e in entries[k:stop]:
                            s = int(e["offset"] - first["offset"])
                            payload = unframe(raw[s : s + int(e["length"])])
                            doc, null = struct.unpack("<qB", payload[:9])
                            ids = np.frombuffer(payload, kind, offset=9).astype("<u4")
                            docs.append(None if null else doc)
                            starts.append(before + int(e["before"]))
                            sizes.append(len(ids))
                            blobs.append(ids.tobytes())
                        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(blobs, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])
                        k = stop

    # one row per file: the running sum is over files, not documents
    earlier = Window.orderBy("part", "place").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("before", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)))
    # a file a task, or a few
    n = max(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), manifest.count())
    return files.repartition(n, "data").mapInArrow(lean(run), "doc_id long, start long, n_tokens long, ids binary")


def encode_corpus(docs: DataFrame, tokenizer: str, end_id: int = 1, vocab_size: int = 49_408, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write ``docs`` in the record format to the shared folder and read it back: per document
    ``(doc_id, start, n_tokens, ids_crc32)``, all taken from the files, which are deleted at the end
    (``write_records`` and ``read_records`` keep theirs)."""
    out = scratch(docs.sparkSession, "tokens")
    manifest = write_records(docs, out, tokenizer, end_id, vocab_size, id_col, text_col)
    back = read_records(manifest, out, vocab_size)
    told = cut(back.select(F.col("doc_id").alias(id_col), "start", "n_tokens", F.crc32("ids").alias("ids_crc32")))
    remove_tree(docs.sparkSession, out)
    return told
