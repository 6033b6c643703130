"""Line de-duplication by a segment-partition edit join, DataFrame functions only.

Lines (trimmed, blank ones ignored) are equal classes when their edit distance is
at most ``max_edits`` or a chain of such lines joins them; of a class the line with
the smallest (doc_id, line number) stays.  Equal lines are folded first, by digest,
so a line's copies meet in a partial aggregate only.

A line is split into ``max_edits + 1`` segments.  Lines within the threshold share a
segment, up to a shift that depends on the two lengths, so each line probes the
segment hashes of its own and the next shorter lengths.  With one edit the lines
that meet there are narrowed three times more: they must agree outside one of
``windows`` windows, then outside one stretch of ``stretch`` characters of it, then
outside one character.  Lines that share such a last key are one edit apart, all of
them, so each is tied to the least line of its group (a line with a character more to
the line that is left without it): as many pairs as keys, whatever the size of a group
of near copies.  Each pair is verified on the texts by a banded bit-parallel edit
distance (Hyyroe's diagonal band in the bits of a long).

Lines of fewer than ``min_chars`` characters match only equal ones: one edit turns a
short word into another one.  The default is 12, with 0 all lines take part.  More than
one edit works too, but then pairs come from the segments directly, so a segment that
very many different lines share costs their square.

Defined results: null text has no lines; blank lines are kept; repeated rows of one
doc_id are taken as one document with the lines of both (a line number that occurs
twice stays twice); a null doc_id sorts first; lines of any length are compared
whole; of equal lines the first one stays; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, cut


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, line_no, line, id)`` of all lines that are not blank; id is a 128-bit digest."""
    held = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.col(text_col).cast("string"), "\n")).alias("line_no", "line"))
    held = held.select("doc_id", "line_no", F.trim("line").alias("line")).where("line <> ''")
    return held.select("doc_id", "line_no", "line", F.unhex(F.md5(F.col("line").cast("binary"))).alias("id"))


def segment_keys(lines: DataFrame, max_edits: int, min_chars: int) -> tuple[DataFrame, list[tuple[str, int]]]:
    """``lines`` with one hash column per segment, and the columns' names with ``less``: hashes of the
    segments of the line's own length (less = 0) and of the substrings it may share with lines
    ``less`` characters shorter (null where there is none)."""
    parts, names = max_edits + 1, []
    held = lines.withColumn("__n", F.char_length("line"))
    for less in range(parts):
        length = F.col("__n") - less
        held = held.withColumns({f"__base{less}": F.floor(length / parts).cast("int"), f"__more{less}": F.pmod(length, F.lit(parts))})
    keys = {}
    for less in range(parts):
        length, base, longer = F.col("__n") - less, F.col(f"__base{less}"), F.col(f"__more{less}")
        for i in range(1, parts + 1):
            # the last ``longer`` segments have one character more
            extra = F.greatest(F.lit(0), i - 1 - (parts - longer))
            start = base * (i - 1) + extra + 1
            size = base + F.when(parts - longer < i, 1).otherwise(0)
            low = max(-(i - 1), less - (parts - i))
            high = min(i - 1, less + parts - i)
            for shift in range(low, high + 1):
                inside = (length >= min_chars) & (start + shift >= 1) & (start + shift + size - 1 <= F.col("__n"))
                key = F.xxhash64(F.lit(i), length, F.substring(F.col("line"), start + shift, size))
                names.append((f"k{len(names)}", less))
                keys[names[-1][0]] = F.when(inside, key)
    return held.withColumns(keys), names


def met(rows: DataFrame) -> DataFrame:
    """The rows whose key at least two of them share, one of them of the key's own length."""
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("less").alias("own")).where("n > 1 and own = 0").select("key")
    return rows.join(shared, "key")


def outside(level: int, line: Column, length: Column, start: Column, end: Column) -> Column:
    """Hash of what a line has outside characters [start, end) of a line of ``length``."""
    n = F.char_length(line)
    head = F.substring(line, F.lit(1), start.cast("int"))
    tail = F.substring(line, (n - (length - end) + 1).cast("int"), (length - end).cast("int"))
    return F.xxhash64(F.lit(level), length, start, head, tail)


def narrowed(texts: DataFrame, windows: int, stretch: int) -> DataFrame:
    """Rows ``(key, id, less, head, tail)`` of one-edit candidates, equal in the first ``head`` and the
    last ``tail`` characters."""
    n = F.char_length("line")
    wide = texts.select("id", "line", F.explode(F.array(F.lit(0), F.lit(1))).alias("less")).where(n - F.col("less") > 0)
    wide = wide.select("id", "line", "less", (n - F.col("less")).alias("length"), F.explode(F.sequence(F.lit(0), F.lit(windows - 1))).alias("w"))
    edge = lambda k: F.floor(F.col("length") * k / windows)
    wide = wide.select("id", "line", "less", "length", edge(F.col("w")).alias("start"), edge(F.col("w") + 1).alias("end")).where("start < end")
    wide = wide.select("id", "less", "length", "start", "end", outside(2, F.col("line"), F.col("length"), F.col("start"), F.col("end")).alias("key"))
    near = met(wide).select("id", "less", "length", "start", "end")
    fine = near.join(texts, "id").select("id", "line", "less", "length", "end", F.explode(F.sequence("start", F.col("end") - 1, F.lit(stretch).cast("long"))).alias("start"))
    fine = fine.withColumn("end", F.least("end", F.col("start") + stretch))
    return met(fine.select(outside(3, F.col("line"), F.col("length"), F.col("start"), F.col("end")).alias("key"), "id", "less", F.col("start").alias("head"), (F.col("length") - F.col("end")).alias("tail")))


def one_edit_keys(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows ``(key, id, less, head, tail)``: keys of the lines of ``narrowed`` without one character.
    ``less`` 0: one key for each character of the stretch, which lines of the same length share that
    differ in this character only; 1: a longer line's key without one of its characters; -1: the key
    of a whole line, which the latter may meet."""
    n, head = F.char_length("line"), F.col("head").cast("int")
    held = rows.select("id", "less", "head", "tail").distinct().join(texts, "id")
    # two hashes: a group's least line stands for the others, so no two groups may fall together
    both = lambda level, *x: F.struct(F.xxhash64(F.lit(level), *x).alias("h"), F.xxhash64(F.lit(100 + level), *x).alias("g"))
    same = held.where("less = 0").select("id", "line", n.alias("length"), F.explode(F.sequence(head, (n - F.col("tail") - 1).cast("int"))).alias("at"))
    without = lambda: (F.substring("line", F.lit(1), F.col("at")), F.substring("line", F.col("at") + 2, F.col("length")))
    same = same.select(both(4, "length", "at", *without()).alias("key"), "id", F.lit(0).alias("less"), F.col("at").alias("head"), (F.col("length") - F.col("at") - 1).alias("tail"))
    longer = held.where("less = 1").select("id", "line", n.alias("length"), F.explode(F.sequence(head, (n - 1 - F.col("tail")).cast("int"))).alias("at"))
    longer = longer.select(both(5, F.concat(*without())).alias("key"), "id", F.lit(1).alias("less"), F.col("at").alias("head"), (F.col("length") - 1 - F.col("at")).alias("tail"))
    whole = held.where("less = 0").select(both(5, F.col("line")).alias("key"), "id", F.lit(-1).alias("less"), F.lit(0).alias("head"), F.lit(0).alias("tail")).distinct()
    return same.unionAll(longer).unionAll(whole)


def one_edit_pairs(keys: DataFrame, stars: bool) -> DataFrame:
    """Pairs ``(a, b, head, tail)`` of ``one_edit_keys``: all of them, or with ``stars`` those of each
    line with the least one of its group, which connect the same lines."""
    same = keys.where("less = 0").select("key", "id", "head", "tail").distinct()
    if stars:
        least = same.groupBy("key").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "a")
        pairs = same.join(least, "key").where("id <> a").select("a", F.col("id").alias("b"), "head", "tail")
    else:
        pairs = same.select("key", F.col("id").alias("a")).join(same.withColumnRenamed("id", "b"), "key").where("a < b").select("a", "b", "head", "tail")
    longer = keys.where("less = 1").select("key", F.col("id").alias("b"), "head", "tail")
    grown = keys.where("less = -1").select("key", F.col("id").alias("a")).join(longer, "key").select("a", "b", "head", "tail")
    return pairs.unionAll(grown).groupBy("a", "b").agg(F.min(F.struct("head", "tail")).alias("at")).select("a", "b", "at.*")


def verified(pairs: DataFrame, texts: DataFrame, max_edits: int) -> DataFrame:
    """The pairs ``(a, b)`` whose texts are at most ``max_edits`` apart."""
    told = pairs.join(texts.select(F.col("id").alias("a"), F.col("line").alias("la")), "a").join(texts.select(F.col("id").alias("b"), F.col("line").alias("lb")), "b")
    # equal ends do not change an edit distance; they are compared as text, as hashes can collide
    head, tail = F.col("head").cast("int"), F.col("tail").cast("int")
    middle = lambda x: F.substring(x, head + 1, F.char_length(x) - head - tail)
    end = lambda x: F.substring(x, F.char_length(x) - tail + 1, tail)
    la, lb = F.col("la"), F.col("lb")
    told = told.where((F.substring(la, F.lit(1), head) == F.substring(lb, F.lit(1), head)) & (end(la) == end(lb)))
    return told.select("a", "b", middle(la).alias("ma"), middle(lb).alias("mb")).where(banded_distance(F.col("ma"), F.col("mb"), max_edits) <= max_edits).select("a", "b").distinct()


def banded_distance(a: Column, b: Column, max_edits: int) -> Column:
    """Edit distance of two strings whose lengths differ by at most ``max_edits``; any value
    above ``max_edits`` only says that the distance is above it."""
    k, top, full = max_edits, 2 * max_edits, (1 << (2 * max_edits + 1)) - 1
    p, t = F.split(a, ""), F.split(b, "")
    m = F.char_length(a)
    mask = lambda x: x.bitwiseAND(F.lit(full).cast("long"))
    bit = lambda x, at: F.shiftright(x, at).bitwiseAND(F.lit(1).cast("long"))

    def let(value: Column, body) -> Column:
        return F.element_at(F.transform(F.array(value), body), 1)

    def step(acc: Column, j: Column) -> Column:
        vp, vn, dist = acc["vp"], acc["vn"], acc["dist"]
        equal = F.lit(0).cast("long")
        for at in range(top + 1):
            row = j - k + at  # from 1; outside the string nothing is equal
            same = (row >= 1) & (row <= m) & (F.get(p, row - 1) == F.get(t, j - 1))
            equal = equal + F.when(same, F.lit(1 << at).cast("long")).otherwise(F.lit(0).cast("long"))

        def after(x: Column) -> Column:
            d0 = mask((x.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(x).bitwiseOR(vn))

            def moved(d: Column) -> Column:
                hp = mask(vn.bitwiseOR(F.bitwise_not(d.bitwiseOR(vp))))
                hn = d.bitwiseAND(vp)
                down = F.shiftright(d, 1)
                last = (m - j + k).cast("int")
                # bits of a fixed width: pick the last row's bit by comparing its place
                pick = lambda h: sum((F.when(last == at, bit(h, at)).otherwise(F.lit(0).cast("long")) for at in range(top)), F.lit(0).cast("long"))
                gone = F.when(j <= m - k, 1 - bit(d, top)).otherwise(pick(hp) - pick(hn))
                return F.struct(mask(hn.bitwiseOR(F.bitwise_not(down.bitwiseOR(hp)))).alias("vp"), down.bitwiseAND(hp).alias("vn"), (dist + gone).alias("dist"))

            return let(d0, moved)

        return let(equal, after)

    began = F.struct(F.lit(full & ~((1 << k) - 1)).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), F.least(F.lit(k), m).cast("long").alias("dist"))
    n = F.char_length(b)
    walked = F.aggregate(F.sequence(F.lit(1), n), began, step)["dist"]
    return F.when(n == 0, m.cast("long")).when(F.abs(m - n) > k, F.lit(k + 1).cast("long")).otherwise(walked)


def line_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_edits: int = 1, min_chars: int = 12, windows: int = 8, stretch: int = 4) -> tuple[DataFrame, DataFrame]:
    """``(classes, links)``: classes ``(id, copies, first)`` of the lines that have a copy or a near
    copy (first: smallest (doc_id, line_no) of the class), and the verified links ``(a, b)``, all of
    them; with one edit they are made only if they are asked for (the classes need stars)."""
    lines = lines_of(docs, id_col, text_col)
    place = F.struct("doc_id", "line_no")
    keyed, keys = segment_keys(lines, max_edits, min_chars)
    kinds = cut(keyed.groupBy("id").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("copies"), *(F.first(k).alias(k) for k, _ in keys)))
    probes = kinds.select("id", F.explode(F.array(*(F.struct(F.col(k).alias("key"), F.lit(less).alias("less")) for k, less in keys))).alias("k"))
    probes = probes.select("k.key", "id", "k.less").where("key is not null")
    candidates = met(probes)
    busy = candidates.select("id").distinct().join(kinds.select("id", "first.*"), "id")
    busy = busy.select(F.col("id").alias("busy"), F.col("doc_id").alias("of_doc"), F.col("line_no").alias("at"))
    first = (F.col("id") == F.col("busy")) & F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("line_no") == F.col("at"))
    texts = cut(lines.join(busy, first).select("id", "line").dropDuplicates(["id"]))
    if max_edits == 1:
        keys = cut(one_edit_keys(narrowed(texts, windows, stretch), texts))
        stars = cut(verified(one_edit_pairs(keys, True), texts, 1))
        links = verified(one_edit_pairs(keys, False), texts, 1)
    else:
        own = candidates.where("less = 0").select("key", F.col("id").alias("a"))
        other = candidates.select("key", F.col("id").alias("b"), "less")
        pairs = own.join(other, "key").where("(less = 0 and a < b) or (less > 0 and a <> b)").select("a", "b", F.lit(0).alias("head"), F.lit(0).alias("tail")).distinct()
        stars = links = cut(verified(pairs, texts, max_edits))
    roots = components(stars, local_edges=0)  # in rounds of joins, whatever their number: no Python on the executors
    named = kinds.select("id", "first", "copies").join(roots.withColumnRenamed("node", "id"), "id", "left").where("copies > 1 or root is not null")
    named = named.withColumn("root", F.coalesce("root", "id"))
    least = named.groupBy("root").agg(F.min("first").alias("of_class"))
    return named.join(least, "root").select("id", "copies", F.col("of_class").alias("first")), links


def line_decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: ``(doc_id, n_lines, n_dropped, dropped, kept_chars)``; ``dropped`` has the
    numbers (from 0) of the lines that are near copies of an earlier one, ``kept_chars`` counts the
    characters of the trimmed lines that stay."""
    classes, _ = line_classes(docs, id_col, text_col, **options)
    classes = cut(classes)
    slim = lines_of(docs, id_col, text_col).select("doc_id", "line_no", F.char_length("line").alias("chars"), "id")
    marked = slim.join(classes.select("id", "first"), "id", "left")
    gone = F.col("first").isNotNull() & ~(F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.line_no") == F.col("line_no")))
    marked = marked.select("doc_id", "line_no", "chars", gone.alias("gone"))
    found = marked.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if("gone").alias("n_dropped"), F.sort_array(F.collect_list(F.when(F.col("gone"), F.col("line_no")))).alias("dropped"), F.sum(F.when(~F.col("gone"), F.col("chars")).otherwise(0)).alias("kept_chars"))
    ids = docs.select(F.col(id_col).alias("own")).distinct()
    out = ids.join(found, F.col("own").eqNullSafe(F.col("doc_id")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return out.select(F.col("own").alias(id_col), zero("n_lines"), zero("n_dropped"), F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"), zero("kept_chars"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the near copies of earlier lines taken out of their texts."""
    told = line_decisions(docs, id_col, text_col, **options).select(F.col(id_col).alias("__own"), F.col("dropped").alias("__dropped"))
    held = docs.join(told, F.col(id_col).eqNullSafe(F.col("__own")), "left")
    parts = F.split(F.col(text_col), "\n")
    kept = F.filter(parts, lambda x, k: ~F.array_contains(F.col("__dropped"), k))
    text = F.when(F.size("__dropped") > 0, F.array_join(kept, "\n")).otherwise(F.col(text_col))
    return held.withColumn(text_col, text).select(*docs.columns)
