"""Mixing sources to target weights over a domain - language - source tree.

A budget of tokens flows down the tree: each node shares its budget among its
children by weight.  A child that cannot use its share (its tokens times
``max_epochs``, of leaves that no weight of zero shuts off) gives the rest to its
siblings by their weights; only what no sibling can use moves on at the level above.
The leaves' budgets are whole tokens whose sum is the target, or all that the tree
can use.  A leaf with a budget of e whole epochs and a remainder takes every document
e times and then the token-prefix of the next epoch, whose order is the md5 of seed,
epoch and id.  Tokens are words between white space unless ``size`` gives a Column of
another count, such as a tokenizer's.

The prefix is found without sorting a leaf in one place: totals of 4,096 hash
ranges give the range in which the prefix ends, and only that range is ordered.
The table of leaves is collected and broadcast, so it is checked against
``max_leaves``; a larger tree raises an error.

Defined results: null domain, language and source are leaves of their own; null
and empty texts have no tokens and are taken with the prefix they fall in; rows of
one id have one place in the order and are taken together; a leaf without tokens
takes its documents once; an empty table gives no rows; columns of ``docs`` may have
any name that does not begin with ``__mix_``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

RANGES = 4096
NONE = "\u0000none"


def default_domain(source: str = "source") -> Column:
    """Domain of a source name: its trailing number modulo 4, ``d0`` to ``d3`` (``d-`` without one)."""
    tail = F.regexp_extract(F.coalesce(F.col(source).cast("string"), F.lit("")), r"(\d{1,9})$", 1)
    return F.when(tail == "", F.lit("d-")).otherwise(F.concat(F.lit("d"), F.pmod(tail.try_cast("int"), F.lit(4)).cast("string")))


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


@dataclass
class Node:
    weight: float = 0.0
    tokens: int = 0
    room: float = 0.0
    budget: float = 0.0
    children: dict[str, Node] = field(default_factory=dict)


def grow(leaves: list[tuple[tuple[str, ...], int]], weights: dict[tuple[str, ...], float] | None, temperature: float, max_epochs: float) -> Node:
    """The tree of the leaves; a node without a given weight weighs tokens ** temperature."""
    root = Node(1.0)
    for path, tokens in leaves:
        node = root
        for step in path:
            node = node.children.setdefault(step, Node())
        node.tokens += tokens

    def settle(node: Node, path: tuple[str, ...]) -> None:
        for name, child in node.children.items():
            settle(child, (*path, name))
        if node.children:
            node.tokens = sum(c.tokens for c in node.children.values())
            node.room = sum(c.room for c in node.children.values() if c.weight > 0)
        else:
            node.room = node.tokens * max_epochs
        node.weight = (weights or {}).get(path, float(node.tokens) ** temperature if node.tokens else 0.0)
        if node.weight < 0:
            raise ValueError(f"weight below zero at {path}")

    settle(root, ())
    return root


def allot(node: Node, budget: float) -> None:
    """Give a node its budget and share it among its children."""
    node.budget = min(budget, node.room)
    left, open_ = node.budget, [c for c in node.children.values() if c.weight > 0 and c.room > 0]
    while open_ and left > 0:
        whole = sum(c.weight for c in open_)
        full = [c for c in open_ if left * c.weight / whole >= c.room]
        if not full:
            for c in open_:
                allot(c, left * c.weight / whole)
            return
        for c in full:
            allot(c, c.room)
        left -= sum(c.room for c in full)
        open_ = [c for c in open_ if c not in full]


def whole_tokens(leaves: list[Node], total: float) -> list[int]:
    """The leaves' budgets as whole numbers whose sum is ``total`` rounded: rounded down, what is left goes
    to the largest remainders (the first of equal ones) that have room for one more."""
    out = [int(n.budget + 1e-6) for n in leaves]
    left = round(total) - sum(out)
    order = sorted(range(len(out)), key=lambda k: (out[k] - round(leaves[k].budget, 6), k))
    while left > 0 and (open_ := [k for k in order if leaves[k].budget > 0 and out[k] + 1 <= leaves[k].room + 1e-6]):
        for k in open_[:left]:
            out[k] += 1
        left -= min(left, len(open_))
    return out


def plan(docs: DataFrame, target_tokens: float | None = None, share: float = 1.0, weights: dict[tuple[str, ...], float] | None = None, temperature: float = 0.7, max_epochs: float = 4.0, seed: int = 17, domain: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", size: Column | None = None, max_leaves: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """``(counted, leaves)``: ``counted`` has one row ``(id, domain, lang, source, tokens)`` per document;
    ``leaves`` one row per leaf with its whole epochs, the epoch of the prefix and the prefix's end."""
    spark = docs.sparkSession
    name = lambda c: F.coalesce(c.cast("string"), F.lit(NONE))
    path = ["domain", "lang", "source"]
    told = (default_domain(source_col) if domain is None else domain, F.col(lang_col), F.col(source_col))
    counted = cut(docs.select(F.col(id_col).cast("string").alias("id"), *(name(c).alias(p) for c, p in zip(told, path)), (word_count(text_col) if size is None else F.coalesce(size.cast("long"), F.lit(0))).alias("tokens")))
    totals = counted.groupBy(*path).agg(F.sum("tokens").alias("tokens")).limit(max_leaves + 1).collect()
    if len(totals) > max_leaves:
        raise ValueError(f"more than {max_leaves} leaves; name a coarser tree")
    tree = grow([((r.domain, r.lang, r.source), r.tokens) for r in totals], weights, temperature, max_epochs)
    allot(tree, tree.tokens * share if target_tokens is None else target_tokens)
    rows = []
    totals = sorted(totals, key=lambda r: (r.domain, r.lang, r.source))
    budgets = whole_tokens([tree.children[r.domain].children[r.lang].children[r.source] for r in totals], tree.budget)
    for r, budget in zip(totals, budgets):
        leaf = tree.children[r.domain].children[r.lang].children[r.source]
        whole = budget // leaf.tokens if leaf.tokens else 1
        rows.append((r.domain, r.lang, r.source, int(whole), budget - whole * leaf.tokens if leaf.tokens else 0))
    budgets = F.broadcast(spark.createDataFrame(rows, "domain string, lang string, source string, whole int, rest long"))
    ranked = counted.join(budgets, path).withColumn("h", order_hash(F.col("id"), F.lit(seed), F.col("whole")))
    ranked = ranked.withColumn("range", hash_range(F.col("h")))
    by_range = ranked.groupBy(*path, "range", "rest").agg(F.sum("tokens").alias("t")).where("t > 0")
    # at most RANGES rows a leaf
    ends = by_range.withColumn("upto", F.sum("t").over(Window.partitionBy(*path).orderBy("range"))).where("upto > rest")
    ends = ends.groupBy(*path).agg(F.min(F.struct("range", (F.col("upto") - F.col("t")).alias("before"))).alias("e")).select(*path, F.col("e.range").alias("end_range"), F.col("e.before").alias("before"))
    edge = ranked.join(ends, path).where("range = end_range")
    peers = edge.groupBy(*path, "rest", "before", "h").agg(F.sum("tokens").alias("t"))
    inside = peers.withColumn("upto", F.col("before") + F.sum("t").over(Window.partitionBy(*path).orderBy("h"))).where("upto <= rest")
    last = inside.groupBy(*path).agg(F.max("h").alias("last"))
    leaves = budgets.join(ends, path, "left").join(last, path, "left")
    return counted, cut(leaves)


def order_hash(id_: Column, seed: Column, epoch: Column) -> Column:
    return F.md5(F.concat_ws(":", seed.cast("string"), epoch.cast("string"), F.coalesce(id_, F.lit(""))).cast("binary"))


def hash_range(h: Column) -> Column:
    return F.conv(F.substring(h, 1, 3), 16, 10).cast("int")


def copies(id_: Column, seed: int, pre: str = "") -> Column:
    """How often a row is taken, given its leaf's columns from ``plan``, their names preceded by ``pre``."""
    whole, rest, end, last = (F.col(f"{pre}{c}") for c in ("whole", "rest", "end_range", "last"))
    h = order_hash(id_, F.lit(seed), whole)
    at = hash_range(h)
    before = end.isNull() | (at < end)
    upto = (at == end) & (h <= last)
    return whole + F.when((rest > 0) & (before | F.coalesce(upto, F.lit(False))), 1).otherwise(0)


def mix(docs: DataFrame, seed: int = 17, domain: Column | None = None, id_col: str = "doc_id", lang_col: str = "lang", source_col: str = "source", **options) -> DataFrame:
    """``docs`` (same columns), every row as often as its leaf's budget takes it."""
    _, leaves = plan(docs, seed=seed, domain=domain, id_col=id_col, lang_col=lang_col, source_col=source_col, **options)
    pre, path = "__mix_", ["domain", "lang", "source"]
    told = (default_domain(source_col) if domain is None else domain, F.col(lang_col), F.col(source_col))
    keyed = docs.select("*", *(F.coalesce(c.cast("string"), F.lit(NONE)).alias(pre + p) for c, p in zip(told, path)))
    # bounded by max_leaves, checked in plan
    leaf = F.broadcast(leaves.select(*(F.col(c).alias(pre + c) for c in (*path, "whole", "rest", "end_range", "last"))))
    taken = keyed.join(leaf, [pre + p for p in path]).withColumn(f"{pre}n", copies(F.col(id_col).cast("string"), seed, pre))
    return taken.where(f"{pre}n > 0").select(*[F.col(c) for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col(f"{pre}n"))).alias(f"{pre}k")).drop(f"{pre}k")


def decisions(docs: DataFrame, seed: int = 17, **options) -> DataFrame:
    """One row per document taken: ``(id, domain, lang, source, tokens, copies)``."""
    counted, leaves = plan(docs, seed=seed, **options)
    leaf = F.broadcast(leaves)
    path = ["domain", "lang", "source"]
    out = counted.join(leaf, path).withColumn("copies", copies(F.col("id"), seed)).where("copies > 0")
    back = lambda c: F.when(F.col(c) != NONE, F.col(c)).alias(c)
    return out.select("id", *(back(c) for c in path), "tokens", "copies")
