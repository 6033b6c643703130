"""Chat formatting with linked tool calls.

Messages are rows (conversation, turn, role, text).  In the texts, JSON in
``<tools>[...]</tools>`` declares tools (name and parameter schema), JSON in
``<tool_call>{...}</tool_call>`` is a call (id, name, arguments) and a message of
role ``tool``, or JSON in ``<tool_response>{...}</tool_response>``, answers one
(tool_call_id, content).  Calls and answers meet in a hash join on conversation and
identifier, call and schema in one on conversation and tool name.  A call whose
arguments hold ``{"$result": "<id>"}`` waits for that call.

Topological order: the depth of a call is one more than the deepest call it waits
for, an answer follows its call.  A message's order key is ``(turn, depth, place,
kind)`` with the call's turn for answers, so a conversation is put in order by
sorting on the key: no group of messages is ever collected.

Output: one row per item with its canonical JSON: keys sorted, no blanks, text as
UTF-8.  An item's ``problems`` lists what its links or its schema check found.

Defined results: null text is an empty message, null role ``unknown``; null
conversation ids or turns make an item that sorts first and links to nothing;
JSON that does not parse, holds NaN or numbers beyond a double, or is nested
deeper than ``DEEPEST`` stays text and is reported (``bad_json``), as is JSON with
lone surrogates, which no UTF-8 text can hold (``bad_text``); a call whose
arguments are text that is no such JSON keeps them as text; a parameter schema
that breaks the rules of schemas is reported with every call (``bad_schema``) and
checks nothing; repeated call ids in a conversation are all kept and reported
(``duplicate_id``), their answers link to the first by (turn, place); calls without
answer, answers without call, unknown tools, bad arguments, waiting in a circle and
for a call of a later turn (``waits_for_later``) are reported; repeated rows are
kept; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, cut, lean, slices

BLOCK = regex.compile(r"<(tools|tool_call|tool_response)>(.*?)</\1>", regex.S)
TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}
#: Levels of nesting that JSON may have; a deeper value is ``bad_json``.
DEEPEST = 100
#: Seconds that a schema's pattern may take on one string; beyond them the rule is reported as unchecked.
PATTERN_SECONDS = 2.0


def canonical(value) -> str:
    """JSON text with sorted keys and no blanks; NaN and infinity are refused."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _number(raw: str) -> float:
    if math.isinf(x := float(raw)):
        raise ValueError("number beyond a double")
    return x


def _refused(name: str):
    raise ValueError(f"{name} is no JSON")


def read_json(raw: str) -> tuple[object, str | None]:
    """``(value, problem)`` of JSON text: ``bad_json``, ``bad_text`` or None."""
    try:
        value = json.loads(raw, parse_float=_number, parse_constant=_refused)
    except (ValueError, RecursionError):
        return None, "bad_json"
    level, depth = [value], 0
    while level:
        depth += 1
        if depth > DEEPEST:
            return None, "bad_json"
        level = [y for x in level if isinstance(x, (dict, list)) for y in (x.values() if isinstance(x, dict) else x)]
    try:
        canonical(value).encode()
    except UnicodeEncodeError:
        return None, "bad_text"
    return value, None


def name_of(value) -> str | None:
    """An identifier as text: strings as they are, other JSON in its canonical form, null as null."""
    return value if value is None or isinstance(value, str) else canonical(value)


KNOWN = set("type enum const required properties additionalProperties patternProperties minProperties maxProperties items minItems maxItems uniqueItems minimum maximum exclusiveMinimum exclusiveMaximum multipleOf minLength maxLength pattern anyOf oneOf allOf not".split())
NOTES = set("title description default examples deprecated readOnly writeOnly format $schema $id $comment $defs definitions".split())


NUMBERS = ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf")
COUNTS = ("minLength", "maxLength", "minItems", "maxItems", "minProperties", "maxProperties")
NESTED = {"properties": dict, "patternProperties": dict, "anyOf": list, "oneOf": list, "allOf": list}


def is_number(value) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def _compiles(pattern) -> bool:
    try:
        regex.compile(pattern)
    except (regex.error, TypeError, ValueError, RecursionError, OverflowError):
        return False
    return True


def well_formed(schema) -> bool:
    """Whether the known keywords of a schema and of all schemas in it have values of the right kind."""
    todo = [schema]
    while todo:
        s = todo.pop()
        if isinstance(s, bool):
            continue
        if not isinstance(s, dict):
            return False
        kinds = s.get("type", [])
        kinds = kinds if isinstance(kinds, list) else [kinds]
        if not all(isinstance(k, str) and (k in TYPES or k in ("number", "integer")) for k in kinds):
            return False
        if any(k in s and not is_number(s[k]) for k in NUMBERS) or s.get("multipleOf", 1) <= 0:
            return False
        if any(k in s and not (is_number(s[k]) and s[k] >= 0 and s[k] == int(s[k])) for k in COUNTS):
            return False
        if not isinstance(s.get("enum", []), list) or not isinstance(s.get("uniqueItems", False), bool):
            return False
        required = s.get("required", [])
        if not isinstance(required, list) or not all(isinstance(k, str) for k in required):
            return False
        if any(not isinstance(s.get(k, kind()), kind) for k, kind in NESTED.items()):
            return False
        if not all(map(_compiles, [s.get("pattern", ""), *s.get("patternProperties", {})])):
            return False
        todo += [x for k, kind in NESTED.items() if k in s for x in (s[k].values() if kind is dict else s[k])]
        todo += [s[k] for k in ("additionalProperties", "items", "not") if k in s]
    return True


def _equal_key(value):
    """Equal for values that JSON holds equal: 1 and 1.0 are, 1 and true are not."""
    if isinstance(value, dict):
        return ("object", tuple((k, _equal_key(value[k])) for k in sorted(value)))
    if isinstance(value, list):
        return ("array", tuple(map(_equal_key, value)))
    return ("number", Fraction(value)) if is_number(value) else (type(value).__name__, value)


def fits_type(value, kind: str) -> bool:
    if kind in ("number", "integer"):
        return is_number(value) and (kind == "number" or value == int(value))
    return isinstance(value, TYPES[kind])


def matches(pattern: str, text: str) -> bool | None:
    """Whether the pattern occurs in the text; None if that took too long to tell."""
    try:
        return regex.search(pattern, text, timeout=PATTERN_SECONDS) is not None
    except TimeoutError:
        return None


def check_schema(value, schema, at: str = "$") -> list[str]:
    """What of a value breaks a well-formed JSON schema (the keywords ``KNOWN``); any other keyword that is
    not one of the ``NOTES``, which demand nothing, is reported as unchecked."""
    if isinstance(schema, bool):
        return [] if schema else [f"{at}: nothing is allowed"]
    if isinstance(value, dict) and set(value) == {"$result"}:
        return []  # known only after the call it waits for
    out, kinds = [f"{at}: unchecked {k}" for k in sorted(set(schema) - KNOWN - NOTES)], schema.get("type")
    if kinds is not None:
        if not any(fits_type(value, k) for k in (kinds if isinstance(kinds, list) else [kinds])):
            return [*out, f"{at}: not {kinds if isinstance(kinds, str) else ' or '.join(kinds)}"]
    if "enum" in schema and _equal_key(value) not in map(_equal_key, schema["enum"]):
        out.append(f"{at}: not in enum")
    if "const" in schema and _equal_key(value) != _equal_key(schema["const"]):
        out.append(f"{at}: not const")
    if is_number(value):
        low, high = schema.get("minimum"), schema.get("maximum")
        above, below = schema.get("exclusiveMinimum"), schema.get("exclusiveMaximum")
        if low is not None and value < low or high is not None and value > high:
            out.append(f"{at}: out of bounds")
        elif above is not None and value <= above or below is not None and value >= below:
            out.append(f"{at}: out of bounds")
        if (step := schema.get("multipleOf")) is not None:
            # as decimals: 0.3 is a multiple of 0.1
            whole = Fraction(str(value)) / Fraction(str(step))
            if whole.denominator != 1:
                out.append(f"{at}: not a multiple")
    if isinstance(value, str):
        if not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
            out.append(f"{at}: length")
        if "pattern" in schema and not (found := matches(schema["pattern"], value)):
            out.append(f"{at}: pattern" if found is False else f"{at}: unchecked pattern")
    if isinstance(value, list):
        if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", len(value)):
            out.append(f"{at}: length")
        if schema.get("uniqueItems") and not waits_for(value) and len(set(map(_equal_key, value))) < len(value):
            out.append(f"{at}: repeated items")
        if "items" in schema:
            out += [x for k, v in enumerate(value) for x in check_schema(v, schema["items"], f"{at}[{k}]")]
    if isinstance(value, dict):
        known, like = schema.get("properties", {}), schema.get("patternProperties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        if not schema.get("minProperties", 0) <= len(value) <= schema.get("maxProperties", len(value)):
            out.append(f"{at}: length")
        for k in sorted(value):
            hits = {p: matches(p, k) for p in like}
            out += [f"{at}.{k}: unchecked pattern" for hit in hits.values() if hit is None]
            rules = ([known[k]] if k in known else []) + [like[p] for p, hit in hits.items() if hit]
            for rule in rules or [schema.get("additionalProperties", True)]:
                out += [f"{at}.{k}: unknown"] if rule is False else check_schema(value[k], rule, f"{at}.{k}")
    out += [x for part in schema.get("allOf", []) for x in check_schema(value, part, at)]
    for word in ("anyOf", "oneOf", "not"):
        if word not in schema:
            continue
        found = [check_schema(value, part, at) for part in ([schema[word]] if word == "not" else schema[word])]
        unsure = [x for part in found for x in part if ": unchecked " in x]
        fit = sum(not part for part in found)
        out += sorted(set(unsure))
        # a part with unchecked keywords or a value not known yet can turn out either way
        open_ = bool(unsure) or bool(waits_for(value))
        if word == "not" and fit and not open_ or word == "anyOf" and not fit and not unsure or word == "oneOf" and (not fit and not unsure or fit > 1 and not open_):
            out.append(f"{at}: {word}")
    return out


def waits_for(value) -> set[str]:
    if isinstance(value, dict):
        if set(value) == {"$result"}:
            return {name_of(value["$result"]) or ""}
        return set().union(*map(waits_for, value.values())) if value else set()
    return set().union(*map(waits_for, value)) if isinstance(value, list) and value else set()


def parse(role: str, text: str) -> list[dict]:
    """Items of one message: dicts with ``kind`` (message, call, result, tool) and their parts."""
    items, rest, at = [], [], 0

    def loose(raw: str, kind: str) -> None:
        value, problem = read_json(raw)
        for one in value if kind == "tools" and isinstance(value, list) else [value]:
            if not isinstance(one, dict):
                items.append({"kind": "message", "content": raw, "problems": [problem or "bad_json"]})
            elif kind == "tools":
                items.append({"kind": "tool", "name": name_of(one.get("name")), "body": canonical(one.get("parameters", True))})
            elif kind == "tool_call":
                args = one.get("arguments", {})
                if isinstance(args, str):
                    inner, problem = read_json(args)
                    args = args if problem else inner
                items.append({"kind": "call", "id": name_of(one.get("id")), "name": name_of(one.get("name")), "body": canonical(args), "waits": sorted(waits_for(args))})
            else:
                items.append({"kind": "result", "id": name_of(one.get("tool_call_id")), "body": canonical(one.get("content"))})

    for m in BLOCK.finditer(text):
        rest.append(text[at : m.start()])
        loose(m[2], m[1])
        at = m.end()
    rest.append(text[at:])
    said = "".join(rest)
    if role == "tool" and not items:
        loose(said, "tool_response")
    elif said.strip() or not items:
        items.insert(0, {"kind": "message", "content": said})
    return items


ITEM = "conv_id long, turn long, place int, role string, kind string, id string, name string, body string, waits array<string>, problems array<string>"


def items_of(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    bound_batches(messages.sparkSession)
    held = messages.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.make_valid_utf8(F.col(role).cast("string")), F.lit("unknown")).alias("role"), F.coalesce(F.make_valid_utf8(F.col(text).cast("string")), F.lit("")).alias("text"))
    names = [x.split()[0] for x in ITEM.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.string()] * 5, pa.list_(pa.string()), pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            rows = []
            for c, t, r, x in zip(*(part.column(k).to_pylist() for k in range(4))):
                for k, i in enumerate(parse(r, x)):
                    rows.append((c, t, k, r, i["kind"], i.get("id"), i.get("name"), i.get("body", i.get("content")), i.get("waits", []), i.get("problems", [])))
            yield pa.RecordBatch.from_arrays([pa.array(col, kind) for col, kind in zip(zip(*rows), kinds)], names)

    return held.mapInArrow(lean(run), ITEM)


def local_depths(edges: pd.DataFrame) -> pd.DataFrame:
    """``(conv_id, id, depth)`` of one conversation's edges ``(id, before)``; -1 where a circle is waited for."""
    waits, after = {}, {}
    for i, b in zip(edges["id"], edges["before"]):
        waits[i] = waits.get(i, 0) + 1
        waits.setdefault(b, 0)
        after.setdefault(b, []).append(i)
    depth = dict.fromkeys(waits, -1)
    level, d = [i for i, n in waits.items() if not n], 0
    while level:
        nxt = []
        for b in level:
            depth[b] = d
            for i in after.get(b, ()):
                waits[i] -= 1
                if not waits[i]:
                    nxt.append(i)
        level, d = nxt, d + 1
    return pd.DataFrame({"conv_id": edges["conv_id"].iloc[0], "id": list(depth), "depth": list(depth.values())})


def chains(edges: DataFrame) -> DataFrame:
    """``(conv_id, id, up, steps)`` of the calls that wait for exactly one other: ``up`` is the first call
    back along such waits that does not, ``steps`` away.  Pointers double, so a chain of n calls takes log2(n)
    rounds; calls that lead into a circle of such waits have no row."""
    own = ["conv_id", "id"]
    now = cut(edges.groupBy(*own).agg(F.count(F.lit(1)).alias("n"), F.min("before").alias("up")).where("n = 1").select(*own, "up", F.lit(1).cast("long").alias("steps")))
    on = now.select("conv_id", F.col("id").alias("up")).distinct()
    for _ in range(now.count().bit_length() + 1):
        if not now.join(on, ["conv_id", "up"], "left_semi").head(1):
            break
        next_ = now.select("conv_id", F.col("id").alias("up"), F.col("up").alias("far"), F.col("steps").alias("more"))
        moved = now.join(next_, ["conv_id", "up"], "left")
        now = cut(moved.select(*own, F.coalesce("far", "up").alias("up"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")))
    return now.join(on, ["conv_id", "up"], "left_anti").select(*own, "up", "steps")


def spread_depths(edges: DataFrame) -> DataFrame:
    """``(conv_id, id, depth)`` of the ends of ``edges``, without gathering a conversation: chains are drawn
    together first, then calls whose waits all have a depth get theirs, round by round."""
    own = ["conv_id", "id"]
    nodes = cut(edges.select(*own).unionAll(edges.select("conv_id", F.col("before").alias("id"))).distinct())
    waiting = edges.select(*own).distinct()
    known = cut(nodes.join(waiting, own, "left_anti").withColumn("depth", F.lit(0).cast("long")))
    drawn = cut(chains(edges))
    many = edges.join(edges.groupBy(*own).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), own)
    far = drawn.select("conv_id", F.col("id").alias("before"), "up", "steps")
    open_ = cut(many.join(far, ["conv_id", "before"], "left").select(*own, "n", F.coalesce("up", "before").alias("before"), (1 + F.coalesce("steps", F.lit(0))).alias("w")))
    while open_.head(1):
        told = open_.join(known.select("conv_id", F.col("id").alias("before"), "depth"), ["conv_id", "before"])
        told = told.groupBy(*own).agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("n"), F.max(F.col("depth") + F.col("w")).alias("depth")).where("k = n")
        fresh = cut(told.select(*own, "depth"))
        if not fresh.head(1):
            break
        known = cut(known.unionAll(fresh))
        open_ = cut(open_.join(fresh, own, "left_anti"))
    ends = drawn.join(known.select("conv_id", F.col("id").alias("up"), "depth"), ["conv_id", "up"]).select(*own, (F.col("depth") + F.col("steps")).alias("depth"))
    known = cut(known.unionAll(ends))
    return nodes.join(known, own, "left").select(*own, F.coalesce("depth", F.lit(-1)).cast("int").alias("depth"))


def call_depths(calls: DataFrame, local_edges: int = 100_000) -> DataFrame:
    """``(conv_id, id, depth)`` of the calls that wait for others; depth -1 marks a circle. Conversations of at
    most ``local_edges`` dependencies are solved in one task each, larger ones in joins (``spread_depths``)."""
    own = calls.select("conv_id", "id").distinct()
    edges = calls.select("conv_id", "id", F.explode("waits").alias("before"))
    edges = cut(edges.join(own.withColumnRenamed("id", "before"), ["conv_id", "before"], "left_semi").distinct().select("conv_id", "id", "before"))
    large = cut(edges.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > local_edges).select("conv_id"))
    small = edges.join(large, "conv_id", "left_anti").groupBy("conv_id").applyInPandas(local_depths, "conv_id long, id string, depth int")
    if not large.head(1):
        return small
    return small.unionAll(spread_depths(cut(edges.join(large, "conv_id", "left_semi"))))


def format_chats(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", in_order: bool = False) -> DataFrame:
    """One row per item: ``(conv_id, turn, depth, place, kind, role, id, linked_turn, problems, json)``
    in the order of ``(conv_id, anchor, depth, anchor_place, kind, turn, place)``, see ``ordered``; with
    ``in_order`` the rows come sorted by it (they are sorted before they are formatted)."""
    items = cut(items_of(messages, conv, turn, role, text))
    tied = F.col("id").isNotNull() & F.col("conv_id").isNotNull()
    calls = items.where("kind = 'call'")
    known = calls.where(tied).groupBy("conv_id", "id").agg(F.min(F.struct("turn", "place")).alias("f"), (F.count(F.lit(1)) > 1).alias("twice"))
    homes = known.select("conv_id", "id", F.col("f.turn").alias("call_turn"), F.col("f.place").alias("call_place"), "twice")
    answers = items.where("kind = 'result'").where(tied).groupBy("conv_id", "id").agg(F.min("turn").alias("answer_turn"))
    schemas = items.where("kind = 'tool'").groupBy("conv_id", "name").agg(F.min_by("body", F.struct("turn", "place")).alias("schema"))
    # only calls and answers are joined; messages, most of a conversation, stay where they are
    links = items.where("kind in ('call', 'result')")
    linked = links.where(tied).join(homes, ["conv_id", "id"], "left")
    linked = linked.join(answers, ["conv_id", "id"], "left").join(call_depths(calls.where(tied)), ["conv_id", "id"], "left")
    linked = linked.unionByName(links.where(~tied), allowMissingColumns=True).join(schemas, ["conv_id", "name"], "left")
    # calls that wait for a call of a later turn: the order goes by turns, so they come out before it
    waiting = calls.select("conv_id", "turn", "place", F.explode("waits").alias("before"))
    later = waiting.join(homes.withColumnRenamed("id", "before"), ["conv_id", "before"]).where("call_turn > turn").select("conv_id", "turn", "place", F.lit("call").alias("kind"), F.lit(True).alias("later")).distinct()
    linked = linked.join(later, ["conv_id", "turn", "place", "kind"], "left").unionByName(items.where("kind = 'message'"), allowMissingColumns=True)
    home = (F.col("kind") == "result") & F.col("call_place").isNotNull()
    linked = linked.withColumns({"anchor": F.when(home, F.col("call_turn")).otherwise(F.col("turn")), "anchor_place": F.when(home, F.col("call_place")).otherwise(F.col("place")), "steps": F.greatest(F.coalesce("depth", F.lit(0)), F.lit(0))})
    columns = ["conv_id", "turn", "place", "role", "kind", "id", "name", "body", "problems", "call_turn", "call_place", "twice", "answer_turn", "depth", "schema", "later", "anchor", "anchor_place", "steps"]
    names = ["conv_id", "anchor", "depth", "anchor_place", "kind", "turn", "place", "role", "id", "linked_turn", "problems", "json"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules: dict[str, object] = {}  # schemas met in this task, None for a bad one
        for part in slices(batches, "body"):
            out = []
            if len(rules) > 1000:
                rules.clear()
            for r in part.to_pylist():
                problems, body, home = list(r["problems"] or []), r["body"], r["call_place"] is not None
                if r["kind"] == "message":
                    shown, link = {"role": r["role"], "content": body or ""}, None
                elif r["kind"] == "call":
                    args, link = json.loads(body), r["answer_turn"]
                    problems += ["no_id"] * (r["id"] is None) + ["duplicate_id"] * bool(r["twice"]) + ["no_result"] * (link is None) + ["circle"] * (r["depth"] == -1) + ["waits_for_later"] * bool(r["later"])
                    if r["schema"] is None:
                        problems.append("unknown_tool")
                    else:
                        if r["schema"] not in rules:
                            rule = json.loads(r["schema"])
                            rules[r["schema"]] = rule if well_formed(rule) else None
                        rule = rules[r["schema"]]
                        problems += ["bad_schema"] if rule is None else [f"arguments {x}" for x in check_schema(args, rule)]
                    shown = {"role": "assistant", "tool_call": {"id": r["id"], "name": r["name"], "arguments": args}}
                else:
                    link = r["call_turn"]
                    problems += ["no_call"] * (not home) + ["before_call"] * bool(home and r["turn"] is not None and r["call_turn"] is not None and (r["turn"], r["place"]) < (r["call_turn"], r["call_place"]))
                    shown = {"role": "tool", "tool_call_id": r["id"], "content": json.loads(body)}
                out.append((r["conv_id"], r["anchor"], r["steps"], r["anchor_place"], r["kind"], r["turn"], r["place"], r["role"], r["id"], link, problems, canonical(shown)))
            yield pa.RecordBatch.from_arrays([pa.array(col, kind) for col, kind in zip(zip(*out), kinds)], names)

    schema = "conv_id long, anchor long, depth int, anchor_place int, kind string, turn long, place int, role string, id string, linked_turn long, problems array<string>, json string"
    linked = linked.select(*columns)
    return (linked.orderBy(*_order("steps")) if in_order else linked).mapInArrow(lean(run), schema)


def _order(depth: str) -> list:
    kind = F.when(F.col("kind") == "message", 0).when(F.col("kind") == "call", 1).otherwise(2)
    return [F.col("conv_id"), F.col("anchor"), F.col(depth), F.col("anchor_place"), kind, F.col("turn"), F.col("place")]


def ordered(items: DataFrame) -> DataFrame:
    """Items of ``format_chats`` in their conversation's topological order (a distributed range sort)."""
    return items.orderBy(*_order("depth"))
