"""Training-data operators against brute force, with null, empty, long, tied and repeated rows."""

import hashlib
import itertools
import json
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from fathomic.llm import ann, chat, decontam, langid, lines, mixing, quality, queries, simhash, tokens, warc
from fathomic.llm.common import components, crc_bucket, scratch

DOC = "doc_id long, text string, lang string, source string, n_chars long"
TOKENIZER = __import__("public_tokenizers").path("word_bpe_49k.json")


def words(rng, n, kinds=400):
    return " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(7)
    base = [words(rng, 80) for _ in range(25)]
    rows = [(k, t, "en" if k % 2 else "de", f"src{k % 3}") for k, t in enumerate(base)]
    rows += [(100 + k, base[k], "en", "src0") for k in range(5)] + [(200, base[3] + " w1", "en", None), (201, None, None, None), (202, "", "en", "src1"), (203, " \n\t", "en", "src1"), (204, "x " * 30_000, "de", "src2"), (None, base[0], "en", "src0"), (7, base[7], "de", "src1")]
    # a clashing column of another type must do no harm
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], DOC).withColumn("fp", F.lit("x")), rows


def test_simhash_brute_force(spark, corpus):
    df, rows = corpus
    got = simhash.near_duplicates(df).toPandas()
    assert len(got) == len(rows)

    def fp(x):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
        s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << k for k in range(64) if sum(v >> k & 1 for v in h) * 2 > len(h)) if h else 0

    prints = [fp(r[1]) for r in rows]
    part = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            part[i] = min(part[j] for j in range(len(rows)) if (prints[i] ^ prints[j]).bit_count() <= 2)
    least = {p: min((r[0] for r, q in zip(rows, part) if q == p and r[0] is not None), default=None) for p in part}
    want = sorted((str(r[0]), f"{f:016x}", least[p]) for r, f, p in zip(rows, prints, part))
    assert sorted((str(None if pd.isna(a) else int(a)), b, int(c)) for a, b, c in got[["doc_id", "fingerprint", "component_id"]].itertuples(index=False)) == want
    assert simhash.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("crowd", [4096, 8])
def test_simhash_links_in_crowds(spark, crowd):
    rng = random.Random(crowd)
    codes = {0}
    while len(codes) < 300:  # one clump and scattered codes
        codes.add(rng.getrandbits(64) if rng.random() < 0.2 else rng.choice(sorted(codes)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    codes = sorted(codes)
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    got = components(simhash.links(spark.createDataFrame([(c,) for c in signed], "fp long"), 2, crowd)).toPandas()
    label = {r.node: r.root for r in got.itertuples()}
    root = list(range(len(codes)))
    for _ in range(20):
        root = [min(root[j] for j in range(len(codes)) if (codes[i] ^ codes[j]).bit_count() <= 2) for i in range(len(codes))]
    own = [label.get(c, c) for c in signed]
    assert len(set(own)) == len(set(root)) and all((own[i] == own[j]) == (root[i] == root[j]) for i in range(0, 300, 7) for j in range(300))


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(k, k + 1) for k in range(200)] + [(1000, k) for k in range(1001, 1400)]
    frame = spark.createDataFrame(edges + edges[:50] + [(7, 7), (5000, 5000)], "a long, b long")
    for local in (200_000, 0):  # in one task and in rounds
        got = components(frame, local_edges=local).toPandas()
        assert set(got[got.node <= 200].root) == {0} and set(got[got.node >= 1000].root) == {1000} and len(got) == 201 + 400
        names = components(frame.selectExpr("cast(a as string) a", "cast(cast(b as string) as string) b"), local_edges=local).toPandas()
        assert len(names) == 601 and set(names.root) == {"0", "1000"}
    assert components(frame.limit(0)).count() == 0


def test_warc_round_trip(spark):
    rows = [(k, f"http://h/{k}", f"<p>{k % 7}</p>" * (k % 5)) for k in range(60)] + [(100, None, None), (101, "u", ""), (None, "n", "<p>1</p>"), (59, "u", "<p>3</p>" * 4), (102, "long", "é" * 300_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha", F.lit(1))
    got = warc.archive_round_trip(df).toPandas()
    best = {}
    for i, _, h in rows:
        best[h or ""] = max(best.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in rows:
        top = best[h or ""]
        same = i == top
        want.append((str(i), len((h or "").encode()), warc.digest((h or "").encode()), "response" if same else "revisit", None if same else top))
    text = lambda v: None if pd.isna(v) else int(v)
    assert sorted((str(text(a)), b, c, d, text(e)) for a, b, c, d, e in got.itertuples(index=False)) == sorted(want, key=str) or sorted(map(str, ((str(text(a)), b, c, d, text(e)) for a, b, c, d, e in got.itertuples(index=False)))) == sorted(map(str, want))
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def test_warc_ranges_own_every_record_once():
    rng = random.Random(3)
    raw = [warc.record(i, "http://x", rng.randbytes(rng.randrange(4000)), None, False) for i in range(120)]
    blob = b"junk" + b"".join(map(warc.gzip_member, raw))
    file = pa.BufferReader(blob)
    for step in (len(blob), 997, 40_000):
        got = [(head["warc-record-id"], block) for s in range(0, len(blob), step) for _, head, block in warc.read_range(file, len(blob), s, min(len(blob), s + step), 4096)]
        assert [g[0] for g in got] == [f"<urn:page:{i}>" for i in range(120)]


def test_warc_long_urls_are_found(spark):
    rng = random.Random(5)
    urls = ["http://h/" + "".join(rng.choices("abcdefghij0123456789", k=n)) for n in (70_000, 300_000, 10)]
    raw = [warc.record(i, u, b"<p>", None, False) for i, u in enumerate(urls)]
    blob = b"".join(map(warc.gzip_member, raw))
    for step in (len(blob), 997):
        got = [head["warc-target-uri"] for s in range(0, len(blob), step) for _, head, _ in warc.read_range(pa.BufferReader(blob), len(blob), s, min(len(blob), s + step), 4096)]
        assert got == urls
    df = spark.createDataFrame([(i, u, f"<p>{i}</p>") for i, u in enumerate(urls)], "page_id long, url string, html string")
    assert {r.page_id for r in warc.archive_round_trip(df).collect()} == {0, 1, 2}


def test_warc_counts_are_checked(spark):
    manifest = spark.createDataFrame([("a", 9, 2), ("b", 9, 1)], "file string, bytes long, records long")
    read = spark.createDataFrame([("a",), ("a",), ("b",)], "file string")
    warc.check_counts(manifest, read)
    with pytest.raises(ValueError):
        warc.check_counts(manifest, read.where("file = 'a'"))


def test_ann_recall_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 16)) * rng.uniform(0.5, 2, (3000, 1))
    x[100:160] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [1.0]), (5004, [None] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(df, F.col("vec_id") % 20 == 0, list_rows=128).toPandas()
    hit = 0
    for q in range(0, 3000, 20):
        s = x @ x[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(3000), -s))[:20]
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21)) and np.allclose(own.score, s[own.vec_id])
        hit += len(set(want) & set(own.vec_id))
    assert hit / 3000 >= 0.9
    assert got[got.query_id == 100].sort_values("rank").vec_id.head(5).tolist() == [101, 102, 103, 104, 105] or x[100] @ x[100] < (x @ x[100]).max()
    few = ann.search(df.where("vec_id < 5 or vec_id > 4999"), F.col("vec_id") == 0).count()
    assert few == 4 and ann.search(df.limit(0), F.lit(True)).count() == 0


def test_ann_recall_with_many_lists(spark):
    x = np.random.default_rng(1).normal(size=(6000, 12))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.search(df, F.col("vec_id") % 40 == 0, list_rows=16).toPandas()  # 750 lists, about as a table of 192,000 rows has
    hit = 0
    for q in range(0, 6000, 40):
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(set(np.argsort(-s)[:20]) & set(got[got.query_id == q].vec_id))
    assert hit / 3000 >= 0.9


def test_quality_learns_and_scores_everything(spark):
    rng = random.Random(1)
    rows = [(k, words(rng, 60) if k % 3 else "!!! ### " * 30) for k in range(300)] + [(900, None), (901, ""), (902, "a" * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(300)] + [(5, None), (None, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels, crc_bucket("doc_id", 5) != 0)
    got = quality.score(docs.select("doc_id", "text"), model, ["doc_id"]).toPandas().set_index("doc_id").score
    assert len(got) == 303 and got.between(0, 1).all() and got[1] > 0.9 > 0.1 > got[3]
    bare = quality.fit(docs, labels.limit(0), F.lit(True))
    assert quality.score(docs.select("doc_id", "text"), bare, ["doc_id"]).select("score").distinct().count() == 1
    assert quality.score(docs.select("doc_id", "text").limit(0), model, ["doc_id"]).count() == 0


def test_token_records_round_trip(spark, corpus):
    from tokenizers import Tokenizer

    df, rows = corpus
    model, at = Tokenizer.from_file(TOKENIZER), 0
    got = tokens.encode_corpus(df, TOKENIZER).toPandas().sort_values("start")
    assert got.doc_id.isna().tolist() == [True] + [False] * (len(rows) - 1) and got.doc_id.dropna().is_monotonic_increasing
    want = {}
    for i, t, *_ in rows:
        want.setdefault(i, set()).add(zlib.crc32(np.array(model.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes()))
    for r in got.itertuples():
        assert r.start == at and r.ids_crc32 in want[None if pd.isna(r.doc_id) else int(r.doc_id)]
        at += r.n_tokens
    assert tokens.encode_corpus(df.limit(0), TOKENIZER).count() == 0


def test_word_encoder_equals_the_library():
    encoder = tokens.WordEncoder(TOKENIZER, most=500)
    rng = random.Random(5)
    parts = ["a", "B", "É", "é", ".", "|", "<|endoftext|>", "'s", "'LL", "!", "9", "ß", "Σ", "İ", "%", "́", "<|", "\t", "  ", "\n", " ", "中", "ﬁ", "…", "\x1c"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(4000)] + [None]
    for s in range(0, len(texts), 800):
        part = texts[s : s + 800]
        ids, offsets = encoder(pa.array(part, pa.string()), 1)
        for k, t in enumerate(part):
            assert ids[offsets[k] : offsets[k + 1]].tolist() == encoder.model.encode(t or "", add_special_tokens=False).ids + [1]


def test_records_detect_damage():
    raw = tokens.frame(b"payload")
    assert tokens.unframe(raw) == b"payload"
    for k in range(len(raw)):
        with pytest.raises(ValueError):
            tokens.unframe(raw[:k] + bytes([raw[k] ^ 1]) + raw[k + 1 :])


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("edits", [1, 2])
def test_line_links_brute_force(spark, edits):
    rng = random.Random(edits)
    kinds = {"".join(rng.choice("abcd ") for _ in range(rng.randint(10, 30))).strip() or "x" for _ in range(20)}
    while len(kinds) < 200:
        b = list(rng.choice(sorted(kinds)))
        for _ in range(rng.randint(1, 2)):
            k, way = rng.randrange(len(b) + 1), rng.random()
            b[k : k + (way < 0.7)] = [] if way > 0.9 else [rng.choice("abcdé")]
        if (x := "".join(b).strip()) and len(x) > 3:
            kinds.add(x)
    kinds = sorted(kinds)
    docs = spark.createDataFrame(list(enumerate(kinds)), "doc_id long, text string")
    _, found = lines.line_classes(docs, max_edits=edits, min_chars=12)
    at = {hashlib.md5(t.encode()).digest(): i for i, t in enumerate(kinds)}
    got = {tuple(sorted((at[bytes(r.a)], at[bytes(r.b)]))) for r in found.collect()}
    assert got == {(i, j) for i, a in enumerate(kinds) for j, b in enumerate(kinds) if i < j and min(len(a), len(b)) >= 12 and distance(a, b) <= edits}


def test_line_dedup_keeps_first_copies(spark):
    line = "this line occurs in several documents 1"
    rows = [(1, f"{line}\nown one\n\n{line}"), (2, f"{line[:-1]}2\nanother line here"), (3, None), (4, ""), (0, "first document line"), (5, f"  {line}  ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("line", F.lit(0))
    got = {r.doc_id: r for r in lines.line_decisions(df).collect()}
    assert len(got) == 6 and got[1].dropped == [3] and got[2].dropped == [0] and got[5].dropped == [0] and got[3].n_lines == 0 and got[0].n_dropped == 0
    out = {r.doc_id: r.text for r in lines.drop_near_copies(df).collect()}
    assert out[1] == f"{line}\nown one\n" and out[2] == "another line here" and out[3] is None
    assert lines.line_decisions(df.limit(0)).count() == 0


def test_line_dedup_near_copies_of_a_null_document(spark):
    line = "this line occurs in several documents 1"
    df = spark.createDataFrame([(None, line), (1, line), (2, f"{line[:-1]}2")], "doc_id long, text string")
    assert {r.doc_id: r.dropped for r in lines.line_decisions(df).collect()} == {None: [], 1: [0], 2: [0]}


def test_decontamination_tolerates_substitutions(spark):
    rng = random.Random(2)
    items = [(k, words(rng, 30, 5000)) for k in range(20)] + [(98, None), (99, "too short"), (None, words(rng, 20, 5000))]
    changed = items[3][1].split()
    changed[7] = changed[15] = changed[22] = "other"
    rows = [(0, words(rng, 60, 5000)), (1, words(rng, 40, 5000) + " " + items[2][1].upper() + ". " + words(rng, 20)), (2, "x " + " ".join(changed)), (3, " ".join(items[4][1].split()[5:18])), (4, None), (5, ""), (6, " ".join(items[5][1].split()[:6])), (7, items[22][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("x"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for small in (100_000, 0):  # broadcast and joined
        got = {r.doc_id: list(r.item_ids) for r in decontam.contaminated(df, bench, keep=["doc_id"], small_rows=small).collect()}
        assert got == {0: [], 1: [2], 2: [3], 3: [4], 4: [], 5: [], 6: [], 7: [None]}
    assert decontam.contaminated(df, bench.limit(0), keep=["doc_id"]).where("size(item_ids) > 0").count() == 0


@pytest.mark.parametrize("window,share", [(13, 0.8), (8, 0.6), (20, 0.9), (6, 1.0)])
def test_decontamination_finds_every_tolerated_overlap(spark, window, share):
    rng = random.Random(window)
    items = [(n, [f"w{n}_{k}" for k in range(n)]) for n in range(1, window + 3)]
    docs, allowed = [], lambda n: n - math.ceil(share * n - 1e-9)
    for n, item in items:
        w = min(n, window)
        for extra in (0, 1):
            for places in rng.sample(all_ := list(itertools.combinations(range(w), min(w, allowed(w) + extra))), min(len(all_), 80)):
                at = rng.randrange(n - w + 1)
                told = [f"x{k}" if k - at in places else word for k, word in enumerate(item)]
                if n > w:  # only the window itself may agree
                    told = [word if at <= k < at + w else f"y{k}" for k, word in enumerate(told)]
                docs.append((len(docs), "Before\tit\r\n" + "\t".join(told) + rng.choice(["", " . after", " after it"])))
    docs += [(len(docs) + k, t) for k, t in enumerate(["", "w1_0 w2_0 w2_1", "-", " ".join(items[-1][1]) + " " + " ".join(items[4][1])])]

    def brute(text, item):
        words_ = [x.strip(".-") for x in text.lower().split()]
        words_, w = [x for x in words_ if x], min(len(item), window)
        return any(sum(words_[i + k] == item[j + k] for k in range(w)) >= share * w - 1e-9 for i in range(len(words_) - w + 1) for j in range(len(item) - w + 1))

    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(n, " ".join(item)) for n, item in items], "item_id long, text string")
    got = {r.doc_id: list(r.item_ids) for r in decontam.contaminated(df, bench, window, share, keep=["doc_id"]).collect()}
    assert got == {i: [n for n, item in items if brute(t, item)] for i, t in docs} and any(got.values()) and not all(got.values())


def test_decontamination_masks_cover_all_substitutions():
    for length in range(1, 24):
        for subs in range(min(length, 4)):
            masks = decontam.seeds(length, subs)
            for places in itertools.combinations(range(length), subs):
                assert any(all(x == "0" or at + k not in places for k, x in enumerate(m)) for m in masks for at in range(length - len(m) + 1)), (length, subs, places)


def test_decontamination_of_equal_items_and_clashing_columns(spark):
    rng = random.Random(29)
    passage = words(rng, 40, 900)
    text = words(rng, 250, 900) + " " + passage + " " + words(rng, 250, 900)
    docs = spark.createDataFrame([(k, text, 1, "x", 2) for k in range(50)] + [(99, None, 1, "x", 2)], "doc_id long, text string, matched_words int, key string, kind int")
    bench = spark.createDataFrame([(k, passage) for k in range(300)] + [(7, passage), (None, passage), (400, "the " * 30)], "item_id long, text string")
    got = decontam.contaminated(docs, bench, names=("item_ids", "most"))
    assert got.columns == [*docs.columns, "item_ids", "most"]
    rows = {r.doc_id: (list(r.item_ids), r.most, r.matched_words, r.key) for r in got.collect()}
    assert rows[99] == ([], 0, 1, "x") and all(rows[k] == ([None, *range(300)], 40, 1, "x") for k in range(50))
    assert decontam.contaminated(docs, bench).columns == ["doc_id", "text", "key", "kind", "item_ids", "matched_words"]
    assert decontam.contaminated(docs.limit(0), bench).count() == 0


def test_language_identification(spark):
    rng = random.Random(4)
    stems = {"en": ["the", "and", "wh", "ing", "th", "ou"], "de": ["der", "sch", "ung", "ich", "ver", "ß"], "fr": ["é", "que", "eau", "ai", "le", "ç"]}
    rows = [(k, " ".join("".join(rng.choice(stems[g]) for _ in range(3)) for _ in range(rng.randint(3, 60))), g) for k, g in enumerate(rng.choices(list(stems), k=300))]
    rows += [(900, None, "en"), (901, "123 !!", None), (902, "", "fr"), (903, "the and " * 40_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = crc_bucket("doc_id", 4) == 2
    model = langid.fit(docs, ~held)
    got = langid.predict(docs.withColumn("score", F.lit("x")).select("doc_id", "text"), model, ["doc_id"]).toPandas().set_index("doc_id")
    out = [k for k, _, _ in rows[:300] if zlib.crc32(str(k).encode()) % 4 == 2]
    assert np.mean([got.lang_pred[k] == rows[k][2] for k in out]) > 0.95
    assert got.lang_pred[[900, 901, 902]].tolist() == ["und"] * 3 and got.lang_pred[903] == "en" and got.score.between(0, 1).all()
    assert langid.fit(docs.limit(0), F.lit(True)) is None
    assert langid.predict(docs, None, ["doc_id"]).where("lang_pred <> 'und'").count() == 0


def test_budgets_flow_down_the_tree():
    leaves = [(("a", "en", "s1"), 100), (("a", "en", "s2"), 1000), (("a", "de", "s3"), 1000), (("b", "en", "s4"), 1000)]
    weights = {("a",): 1.0, ("b",): 1.0, ("a", "en"): 1.0, ("a", "de"): 1.0, ("a", "en", "s1"): 1.0, ("a", "en", "s2"): 1.0, ("a", "de", "s3"): 1.0, ("b", "en"): 1.0, ("b", "en", "s4"): 1.0}
    tree = mixing.grow(leaves, weights, 1.0, 1.0)
    mixing.allot(tree, 2000)
    a = tree.children["a"].children
    assert a["en"].children["s1"].budget == 100 and a["en"].children["s2"].budget == 400 and a["de"].budget == 500 and tree.children["b"].budget == 1000
    mixing.allot(tree, 3000)  # b is full, its shortage goes to a
    assert tree.children["b"].budget == 1000 and tree.children["a"].budget == 2000


def test_mixing_brute_force(spark, corpus):
    df, rows = corpus
    counted, leaves = mixing.plan(df, share=1.3, max_epochs=3.0, seed=5)
    got = {(r.id, r.tokens, r.source): r.copies for r in mixing.decisions(df, 5, share=1.3, max_epochs=3.0).collect()}
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by = {}
    for i, t, lang, source in rows:
        n = re.search(r"(\d+)$", source or "")
        by.setdefault((f"d{int(n[1]) % 4}" if n else "d-", lang or mixing.NONE, source or mixing.NONE), []).append((i, size(t), source))
    plan = {(r.domain, r.lang, r.source): r for r in leaves.collect()}
    total = 0
    for path, own in by.items():
        leaf, used = plan[path], 0
        key = lambda i: hashlib.md5(f"5:{leaf.whole}:{'' if i is None else i}".encode()).hexdigest()  # noqa: E731, B023
        groups = {}
        for i, n, s in own:
            groups.setdefault(key(i), []).append((i, n, s))
        stopped = False
        for h in sorted(groups):
            used += sum(n for _, n, _ in groups[h])
            stopped = stopped or used > leaf.rest
            for i, n, s in groups[h]:
                c = leaf.whole + (0 if stopped or leaf.rest == 0 else 1)
                assert got.get((None if i is None else str(i), n, s), 0) == c
                total += c
    assert mixing.mix(df, 5, share=1.3, max_epochs=3.0).count() == total and mixing.mix(df, 5).columns == df.columns
    assert mixing.mix(df.limit(0)).count() == 0


def test_chat_links_orders_and_checks(spark):
    tool = json.dumps([{"name": "add", "parameters": {"type": "object", "properties": {"x": {"type": "integer"}, "y": {}}, "required": ["x"], "additionalProperties": False}}])
    call = lambda i, n, a: "<tool_call>" + json.dumps({"id": i, "name": n, "arguments": a}) + "</tool_call>"
    rows = [
        (1, 0, "system", f"be good <tools>{tool}</tools>"), (1, 1, "user", 'say "é"'), (1, 2, "assistant", "ok " + call("b", "add", {"x": {"$result": "a"}}) + call("a", "add", {"x": 1})),
        (1, 3, "tool", '{"tool_call_id": "a", "content": {"z": 1, "b": 2}}'), (1, 4, "tool", '{"tool_call_id": "b", "content": "3"}'), (1, 5, "tool", '{"tool_call_id": "zz", "content": 1}'),
        (2, 0, "assistant", call("c", "add", {"x": "no", "q": 1})), (2, 1, "assistant", "<tool_call>{broken</tool_call>"), (2, 2, None, None), (None, None, "user", "lost"),
        (3, 0, "assistant", call("p", "f", {"x": {"$result": "q"}}) + call("q", "f", {"x": {"$result": "p"}})), (3, 1, "assistant", call("p", "f", {})), (1, 1, "user", 'say "é"'),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("id", F.lit(1))
    got = chat.ordered(chat.format_chats(df)).collect()
    one = [(r.kind, r.id, r.linked_turn, r.problems) for r in got if r.conv_id == 1 and r.kind != "message"]
    assert one == [("call", "a", 3, []), ("result", "a", 2, []), ("call", "b", 4, []), ("result", "b", 2, []), ("result", "zz", None, ["no_call"])]
    assert '{"content":"say \\"é\\"","role":"user"}' in [r.json for r in got] and sum(r.json == '{"content":"say \\"é\\"","role":"user"}' for r in got) == 2
    assert '{"content":{"b":2,"z":1},"role":"tool","tool_call_id":"a"}' in [r.json for r in got]
    problems = {(r.conv_id, r.turn, r.place): r.problems for r in got}
    assert problems[2, 0, 0] == ["no_result", "unknown_tool"] and "bad_json" in problems[2, 1, 0]
    assert "circle" in problems[3, 0, 0] and "duplicate_id" in problems[3, 1, 0]
    place = {(r.kind, r.id): k for k, r in enumerate(got) if r.conv_id == 1}
    assert place["call", "a"] < place["call", "b"] < place["result", "b"] and place["call", "a"] < place["result", "a"]
    assert chat.format_chats(df.limit(0)).count() == 0


def test_schema_rules():
    schema = {"type": "object", "properties": {"x": {"type": "integer"}}, "required": ["x"], "additionalProperties": False}
    assert chat.check_schema({"x": 1}, schema) == [] and chat.check_schema({"x": True}, schema) and chat.check_schema({}, schema) == ["$.x: missing"] and chat.check_schema({"x": 1, "y": 2}, schema) == ["$.y: unknown"]
    assert chat.canonical({"b": 1, "a": "é"}) == '{"a":"é","b":1}'


def test_chat_long_chains_and_later_turns(spark):
    call = lambda i, b: "<tool_call>" + json.dumps({"id": i, "name": "f", "arguments": {"x": {"$result": b}} if b else {}}) + "</tool_call>"
    chain = "".join(call(f"c{k}", f"c{k - 1}" if k else None) for k in range(1200))
    rows = [(1, 0, "assistant", chain), (2, 0, "assistant", call("a", "b")), (2, 1, "assistant", call("b", None))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.format_chats(df).collect()
    assert {r.id: r.depth for r in got if r.conv_id == 1} == {f"c{k}": k for k in range(1200)} and not any("circle" in r.problems for r in got)
    assert {r.id: "waits_for_later" in r.problems for r in got if r.conv_id == 2} == {"a": True, "b": False}
    edges = [(1, "a", ["b"]), (1, "b", ["c"]), (1, "c", []), (1, "p", ["q"]), (1, "q", ["p"])]
    calls = spark.createDataFrame(edges, "conv_id long, id string, waits array<string>")
    want = {("a", 2), ("b", 1), ("c", 0), ("p", -1), ("q", -1)}
    for local in (0, 100):
        assert {(r.id, r.depth) for r in chat.call_depths(calls, local).collect()} == want


def test_schema_further_keywords():
    good = [(1, {"anyOf": [{"type": "integer"}, {"type": "string"}]}), (3, {"oneOf": [{"minimum": 2}, {"maximum": 1}]}), (0.3, {"multipleOf": 0.1}), ({"a1": 1}, {"patternProperties": {"^a": {"type": "integer"}}, "additionalProperties": False}), ([1, 2], {"minItems": 2, "uniqueItems": True, "description": "two"})]
    bad = [(None, good[0][1]), (1, {"oneOf": [{"minimum": 0}, {"maximum": 1}]}), (0.35, {"multipleOf": 0.1}), ({"a1": "x"}, good[3][1]), ([1], good[4][1]), ([1, 1], good[4][1]), (1, {"not": {"type": "integer"}}), (1, {"allOf": [{"minimum": 2}]}), (1, {"exclusiveMinimum": 1})]
    assert [chat.check_schema(*x) for x in good] == [[]] * 5 and all(chat.check_schema(*x) for x in bad)
    assert chat.check_schema(1, {"$ref": "#/x"}) == ["$: unchecked $ref"]


def test_pipeline_stages(spark, corpus, tmp_path):
    df, rows = corpus
    rng = random.Random(11)
    items = [(0, words(rng, 20, 9000))]
    extra = [(300, items[0][1] + " " + words(rng, 30), "en", "src1", 10)]
    docs = df.drop("fp").unionAll(spark.createDataFrame(extra, DOC))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    held, counts = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, held, str(tmp_path))
        assert after.columns == held.columns
        after.write.parquet(out := scratch(spark, name))
        held = spark.read.parquet(out)
        counts.append({r.doc_id for r in held.select("doc_id").collect()})
    assert counts[0] == {r[0] for r in rows if r[1] and re.search(r"[^\W\d_]", r[1])} | {300}
    assert not counts[1] & {100, 101, 102, 103, 104} and set(range(25)) <= counts[1] and None not in counts[1]
    assert counts[2] == counts[1] - {300} and counts[3] <= counts[2]
    final = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(final.doc_id) == counts[3] and (final.sort_values("start").n_tokens.cumsum().shift(fill_value=0).to_numpy() == final.sort_values("start").start.to_numpy()).all()


def test_pipeline_keeps_one_row_of_each_component(spark):
    rng = random.Random(13)
    a, b, c, d, e = (words(rng, 60) for _ in range(5))
    rows = [(None, a), (None, b), (None, b), (7, c), (7, d), (7, d), (3, c), (None, e), (9, e), (None, None)]
    df = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], DOC)
    got = corpus_pipeline.near_duplicates(spark, df, "").collect()
    assert sorted([(r.doc_id, r.text) for r in got], key=str) == sorted([(None, a), (None, b), (3, c), (7, d), (9, e), (None, None)], key=str)


def test_ann_gives_all_answers_where_rows_repeat(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 8))
    common = rng.normal(size=8) * 3
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(500, common.tolist())] * 40 + [(600 + i, common.tolist()) for i in range(11)]
    rows += [(700, (common * s).tolist()) for s in np.linspace(0.5, 1.5, 30)]  # one id with many vectors
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    got = ann.search(df, F.col("vec_id") % 20 == 0).toPandas()
    for q in {i for i, _ in rows if i % 20 == 0}:
        best = {}
        for _, a in (r for r in set((i, tuple(v)) for i, v in rows) if r[0] == q):
            for i, b in rows:
                if i != q:
                    best[i] = max(best.get(i, -np.inf), float(np.dot(a, b)))
        want = sorted(best.items(), key=lambda z: (-round(z[1], 9), z[0]))[:20]
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21)) and np.allclose(own.score, [s for _, s in want])
        assert own.vec_id.tolist() == [i for i, _ in want]


def test_ann_fits_many_centroids_in_two_levels():
    x = np.random.default_rng(2).normal(size=(12_000, 6))
    centers = ann.kmeans(x, 1500)
    assert 1350 <= len(centers) <= 1650 and np.bincount(ann.nearest(x, centers, 1)[0][:, 0]).max() < 80


def test_chat_reports_what_would_break_it(spark):
    call = lambda a, i="c": f'<tool_call>{{"id": "{i}", "name": "f", "arguments": {a}}}</tool_call>'
    tools = lambda p: f'<tools>[{{"name": "f", "parameters": {p}}}]</tools>'
    deep = "[" * 3000 + "]" * 3000
    schemas = [
        '{"properties": {"x": {"pattern": "("}}}', '{"properties": []}', '{"properties": {"x": {"minimum": "1"}}}', '{"type": {"a": 1}}', '{"required": 3}', '{"type": "thing"}', '{"multipleOf": 0}', '{"enum": 3}',
        '{"anyOf": {"a": 1}}', '{"items": 3}', '{"patternProperties": {"[": true}}', '{"minLength": "a"}', '{"allOf": [3]}', '{"required": [1]}', '"text"', '{"uniqueItems": 1}', '[]',
    ]
    rows = [
        (1, 0, "assistant", call('{"x": NaN}')), (2, 0, "tool", '{"tool_call_id": "c", "content": 1e999}'), (3, 0, "assistant", call('"\\ud800"')), (4, 0, "assistant", call(deep)), (5, 0, "assistant", call(json.dumps(deep))),
        (6, 0, "assistant", call(json.dumps('{"x": -Infinity}'))), (7, 0, "assistant", call("1" * 5000)), (8, 0, "assistant", '<tool_call>{"id": {"b": [1]}, "name": null, "arguments": {}}</tool_call>'), (9, 0, "system", "<tools>3</tools><tools>[1, {}]</tools>"),
        (10, 0, "tool", deep), (11, 0, "assistant", '<tool_call>{"id": "\\udc00", "name": "f"}</tool_call>'),
    ] + [x for k, p in enumerate(schemas) for x in ((100 + k, 0, "system", tools(p)), (100 + k, 1, "assistant", call('{"x": "aaaa"}')))]
    rows += [(200, 0, "system", tools('{"properties": {"x": {"pattern": "(a|aa)+$"}}}')), (200, 1, "assistant", call(json.dumps({"x": "a" * 60 + "!"})))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.format_chats(df, in_order=True).collect()
    problems = {r.conv_id: r.problems for r in got if r.kind != "message" or r.problems}
    said = {r.conv_id: json.loads(r.json) for r in got}
    assert {k: problems[k] for k in (1, 2, 3, 4, 7, 10, 11)} == {1: ["bad_json"], 2: ["bad_json"], 3: ["bad_text"], 4: ["bad_json"], 7: ["bad_json"], 10: ["bad_json"], 11: ["bad_text"]}
    assert said[1]["content"] == '{"id": "c", "name": "f", "arguments": {"x": NaN}}' and said[10] == {"role": "tool", "content": deep}
    assert said[5]["tool_call"]["arguments"] == deep and said[6]["tool_call"]["arguments"] == '{"x": -Infinity}' and problems[5] == problems[6] == ["no_result", "unknown_tool"]
    assert said[8]["tool_call"] == {"id": '{"b":[1]}', "name": None, "arguments": {}}
    assert [r.problems for r in got if r.conv_id == 9 and r.kind == "message"] == [["bad_json"], ["bad_json"]]
    assert all(problems[100 + k] == ["no_result", "bad_schema"] for k in range(len(schemas)))
    assert problems[200] in (["no_result", "arguments $.x: pattern"], ["no_result", "arguments $.x: unchecked pattern"])
    keys = [(r.conv_id, r.anchor, r.depth, r.anchor_place) for r in got]
    assert keys == sorted(keys)


def test_chat_json_of_any_kind_never_breaks_it():
    rng = random.Random(17)
    words_ = sorted(chat.KNOWN) + ["x", "$result", "$ref"]

    def value(depth):
        kind = rng.randrange(9 if depth else 6)
        if kind >= 6:
            return {rng.choice(words_): value(depth - 1) for _ in range(rng.randrange(4))} if kind < 8 else [value(depth - 1) for _ in range(rng.randrange(3))]
        return [None, True, rng.randrange(-3, 4), 0.5, rng.choice(["", "a", "(", "object", "integer", "^a"]), "string"][kind]

    checked = 0
    for _ in range(12_000):
        v, schema = value(3), value(4)
        if chat.well_formed(schema):
            assert isinstance(chat.check_schema(v, schema), list)
            checked += isinstance(schema, dict) and len(schema) > 0
        assert isinstance(chat.parse("assistant", f"<tool_call>{json.dumps(v)}</tool_call><tools>{json.dumps(schema)}</tools>"), list)
    assert checked > 100 and chat.check_schema(True, {"enum": [1]}) and chat.check_schema(1.0, {"enum": [1]}) == []


def test_chat_depths_of_long_chains_and_ladders(spark):
    edges = {f"c{k}": [f"c{k - 1}"] for k in range(1, 3000)} | {"c0": []}
    edges |= {f"l{k}": [f"l{k - 1}", f"c{10 * k}"] for k in range(1, 6)} | {"l0": ["c5"], "m": ["c7", "l5", "c2999"], "n": ["m"]}
    edges |= {"p": ["q"], "q": ["r"], "r": ["p"], "s": ["p"], "u": ["s", "c3"], "v": ["u"]}
    want = {}
    for name in sorted(edges, key=lambda n: (n[0] != "c", n[0] not in "l", int(n[1:] or 0), n)):
        want[name] = -1 if any(want.get(b, -1) < 0 for b in edges[name]) else max((want[b] + 1 for b in edges[name]), default=0)
    calls = spark.createDataFrame([(1, i, b) for i, b in edges.items()], "conv_id long, id string, waits array<string>")
    got = {r.id: r.depth for r in chat.call_depths(calls, 0).collect()}
    assert got == want == {r.id: r.depth for r in chat.call_depths(calls).collect()}


def test_budgets_reach_the_target_or_all_that_can_be_used():
    rng = random.Random(23)
    for _ in range(300):
        leaves, weights = [], {}
        for d in range(rng.randint(1, 3)):
            for lang in range(rng.randint(1, 3)):
                for s in range(rng.randint(1, 4)):
                    leaves.append(((f"d{d}", f"l{lang}", f"s{s}"), rng.choice([0, 1, 7, 1000, 12_345])))
        for path in sorted({p[:k] for p, _ in leaves for k in (1, 2, 3)}):
            if rng.random() < 0.5:
                weights[path] = rng.choice([0, 0, 1, 0.3, 50])
        epochs = rng.choice([1.0, 1.5, 4.0])
        tree = mixing.grow(leaves, weights, 0.7, epochs)
        node = lambda p: tree.children[p[0]].children[p[1]].children[p[2]]
        weight = lambda p, k: weights.get(p[:k], 1)
        usable = sum(n * epochs for p, n in leaves if all(weight(p, k) > 0 for k in (1, 2, 3)))
        target = rng.choice([1, 500, 5000, 10**6])
        mixing.allot(tree, target)
        nodes = [node(p) for p, _ in leaves]
        assert math.isclose(sum(n.budget for n in nodes), min(target, usable), rel_tol=1e-9, abs_tol=1e-6)
        whole = mixing.whole_tokens(nodes, tree.budget)
        assert all(0 <= w <= n.room + 1e-6 for w, n in zip(whole, nodes)) and (usable < target or sum(whole) == target)
    two = mixing.grow([(("a", "x", "s"), 10_000), (("a", "x", "t"), 10_000), (("b", "x", "u"), 10_000)], {("a", "x", "s"): 0.0, ("a",): 1.0, ("b",): 1.0}, 1.0, 0.11)
    mixing.allot(two, 2200)  # s is shut off: t can use 1,100 and u 1,100
    assert two.children["a"].budget == 1100 and two.children["b"].budget == 1100


def test_mixing_with_clashing_columns_and_another_count(spark):
    rows = [(k, "a b c", "en", "src1", k, 1, 2, "x") for k in range(40)] + [(k, "a " * 9, "de", "src2", 0, 1, 2, "y") for k in range(40, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, whole int, rest long, last int, domain string")
    got = mixing.mix(df, weights={("d1",): 1.0, ("d2",): 0.0}, target_tokens=60)
    assert got.columns == df.columns and got.count() == 20 and {r.lang for r in got.collect()} == {"en"}
    sized = mixing.decisions(df, size=F.length("text"), target_tokens=50, weights={("d1",): 1.0, ("d2",): 0.0})
    assert sized.count() == 10 and {r.tokens for r in sized.collect()} == {5}


def test_models_learn_from_repeated_ids_once(spark):
    rows = [(k, words(random.Random(k), 30), "en" if k % 2 else "de") for k in range(80)] + [(1, f"other text {k}", "en") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang_pred", F.lit("x")).withColumn("score", F.lit(1))
    labels = spark.createDataFrame([(k, k % 2) for k in range(80)] + [(1, 0)], "doc_id long, quality int")
    model = quality.fit(docs, labels, F.lit(True), sample_rows=50)
    got = quality.score(docs, model)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score"] and got.count() == 380 and dict(got.dtypes)["score"] == "double"
    found = langid.predict(docs, langid.fit(docs, F.lit(True), sample_total=20))
    assert sorted(found.columns) == ["doc_id", "lang", "lang_pred", "score", "text"] and found.count() == 380
    assert langid.predict(docs.limit(0), langid.fit(docs, F.lit(True), sample_total=20)).count() == 0


def test_line_links_of_short_and_numbered_lines(spark):
    kinds = sorted({"".join(x) for n in (1, 2, 3) for x in itertools.product("ab", repeat=n)} | {f"page {k:03d} of the book" for k in range(0, 400, 3)} | {"é", "ébé", "x" * 5000, "x" * 4999, "x" * 4998 + "y"})
    docs = spark.createDataFrame(list(enumerate(kinds)), "doc_id long, text string")
    classes, found = lines.line_classes(docs, min_chars=0)
    at = {hashlib.md5(t.encode()).digest(): i for i, t in enumerate(kinds)}
    far = {"x" * 5000, "x" * 4998 + "y"}  # two edits; other long ones are one apart
    near = lambda a, b: abs(len(a) - len(b)) < 2 and ({a, b} != far if len(a) > 100 else distance(a, b) <= 1)
    want = {(i, j) for i, a in enumerate(kinds) for j, b in enumerate(kinds) if i < j and near(a, b)}
    assert {tuple(sorted((at[bytes(r.a)], at[bytes(r.b)]))) for r in found.collect()} == want
    root = list(range(len(kinds)))
    for _ in kinds:
        for i, j in want:
            root[i] = root[j] = min(root[i], root[j])
    got = {at[bytes(r.id)]: r["first"].doc_id for r in classes.collect()}
    assert got == {i: root[i] for i in {k for pair in want for k in pair}}


def test_line_classes_of_numbered_lines_take_linear_work(spark):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.format_string("this is the line with the number %05d in a long list of them", F.col("id")).alias("text"))
    assert lines.line_classes(docs)[0].select("first").distinct().collect()[0]["first"].doc_id == 0


def test_pipeline_with_clashing_columns_and_without_rows(spark, corpus, tmp_path):
    df, rows = corpus
    clash = ["lang_pred", "score", "item_ids", "matched_words", "whole", "rest", "end_range", "last", "fp", "id", "component_id", "key", "kind", "range", "domain", "h"]
    docs = df.drop("fp").withColumns({c: F.lit(k) for k, c in enumerate(clash)})
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, words(random.Random(31), 20, 9000))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    held = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after, none = stage(spark, held, str(tmp_path)), stage(spark, held.limit(0), str(tmp_path))
        assert after.columns == none.columns == held.columns and after.count() > 20 and none.count() == 0, name
        assert after.select(clash).distinct().collect() == held.select(clash).distinct().collect()
    name, stage = corpus_pipeline.STAGES[-1]
    assert stage(spark, held, str(tmp_path)).count() == len(rows) and stage(spark, held.limit(0), str(tmp_path)).count() == 0


def test_pipeline_stages_take_nulls_everywhere(spark, tmp_path):
    rows = [(None, None, None, None, None), (1, None, "en", "s1", 1), (2, "some words here", None, None, None), (None, "other words there", "en", None, 2), (2, "some words here", None, None, None), (3, "x" * 300_000, "en", "s2", 3)]
    docs = spark.createDataFrame(rows, DOC)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(None, None), (1, ""), (None, "words there")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    count = {name: stage(spark, docs, str(tmp_path)).count() for name, stage in corpus_pipeline.STAGES}
    assert count["language_id"] == 4 and count["simhash_neardup"] == 4 and count["decontamination"] == 5 and count["mixing"] >= 1 and count["token_records"] == 6
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= 1


DATA = "/root/testdata/sf0.001"


def plain(frame):
    frame = frame[sorted(frame.columns)]
    key = lambda v: "null" if pd.isna(v) else f"{float(v):.6g}" if isinstance(v, (int, float)) else str(v)
    return list(frame.columns), sorted(tuple(key(v) for v in row) for row in frame.itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_against_duckdb(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "conversations"):
        con.execute(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    assert plain(queries.QUERIES[name](spark, DATA).toPandas()) == plain(con.execute(queries.ORACLE_SQL[name]).df())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_quality_query_brute_force(spark):
    docs = pd.read_parquet(f"{DATA}/documents.parquet").set_index("doc_id")
    got = queries.op4_quality_gam(spark, DATA).toPandas()
    assert sorted(got.doc_id) == sorted(docs.index) and list(got.columns) == ["doc_id", "held_out", "score", "predicted"]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got.itertuples())
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    model = quality.fit(df, spark.read.parquet(f"{DATA}/labels.parquet"), crc_bucket("doc_id", 5) != 0)
    texts = [docs.text[i] or "" for i in got.doc_id]
    x = quality.features(pa.array(texts))
    for text, row, score in zip(texts, x, got.score):
        value = model.base + sum(t[sum(e < v for e in edges)] for t, edges, v in zip(model.tables, model.edges, row))
        rough = [sum(e < v for e in edges) for edges, v in zip(model.coarse, row)]
        value += sum(t[rough[a], rough[b]] for (a, b), t in zip(model.pairs, model.pair_tables))
        assert math.isclose(score, 1 / (1 + math.exp(-value)), rel_tol=1e-9)
        at, raw, told, rows = dict(zip(quality.FEATURES, row)), text.encode(), [w for w in re.split("[ \n]", text) if w], text.split("\n")
        many = max(len(told), 1)
        assert math.isclose(at["chars"], math.log1p(len(raw))) and math.isclose(at["upper"], sum(65 <= c <= 90 for c in raw) / max(len(raw), 1))
        assert math.isclose(at["words"], math.log1p(len(told))) and math.isclose(at["distinct_words"], len(set(told)) / math.sqrt(many))
        assert math.isclose(at["top_word"], max(map(told.count, set(told)), default=0) / many) and math.isclose(at["repeated_next"], sum(a == b for a, b in zip(told, told[1:])) / many)
        assert math.isclose(at["distinct_lines"], len(set(rows)) / len(rows)) and math.isclose(at["end_mark"], sum(w[-1] in ".!?" for w in told) / many)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_language_query_brute_force(spark):
    docs = pd.read_parquet(f"{DATA}/documents.parquet").set_index("doc_id")
    got = queries.op8_language_id(spark, DATA).toPandas()
    assert sorted(got.doc_id) == sorted(docs.index) and list(got.columns) == ["doc_id", "held_out", "lang_pred", "score"]
    model = langid.fit(spark.read.parquet(f"{DATA}/documents.parquet"), crc_bucket("doc_id", 4) != 2)
    marks = [set(np.flatnonzero(m)) for m in model.landmarks.T]
    size = [1 / m.max() ** 2 for m in model.landmarks.T]  # n-grams of each landmark
    right = []
    for r in got.itertuples():
        text = docs.text[r.doc_id]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if text is None or not re.search(r"[^\W\d_]", text):
            assert r.lang_pred == "und" and r.score == 0
            continue
        grams = set(langid.gram_set(text.lower()).tolist())
        own = {int(model.column[g]) for g in grams} - {-1}
        kernel = np.array([len(own & m) / math.sqrt(len(grams) * n) for m, n in zip(marks, size)])
        value = kernel @ model.weights + model.bias
        assert r.lang_pred == model.languages[int(value.argmax())] and abs(r.score - np.clip((1 + value.max()) / 2, 0, 1)) < 1e-3
        if r.held_out and docs.lang[r.doc_id]:
            right.append(r.lang_pred == docs.lang[r.doc_id])
    assert np.mean(right) > 0.95
