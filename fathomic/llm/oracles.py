"""SQL of the training-data queries that SQL can express."""

from __future__ import annotations

#: A digest of 40 hexadecimal digits as base32: ten digits are eight characters of five bits.
_BASE32 = "array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(s, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INTEGER, 1) FOR i IN range(32)], '')"

WARC = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s FROM pages),
    g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM p)
    SELECT page_id, strlen(h) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN page_id <> top THEN top END AS refers_to FROM g"""

#: Lines of one edit: of the shorter line's length b, the first half or what follows it is in both.  Equal lengths
#: differ in one place; a longer line is the shorter one when one of its characters is left out.
LINES = """WITH RECURSIVE parts AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents),
    l AS (SELECT doc_id, (i - 1)::INTEGER AS line_no, trim(x[i], ' ') AS line FROM parts, unnest(range(1, len(x) + 1)) AS t(i) WHERE trim(x[i], ' ') <> ''),
    k AS (SELECT line, length(line) AS n, min({'d': doc_id, 'l': line_no}) AS first FROM l GROUP BY line),
    h AS (SELECT line, n, n - less AS b FROM k, (SELECT unnest([0, 1]) AS less) WHERE n - less >= 12),
    e AS (SELECT line, n, b, 'head' AS side, left(line, b // 2) AS piece FROM h UNION ALL SELECT line, n, b, 'tail', right(line, b - b // 2) FROM h),
    c AS (SELECT DISTINCT x.line AS a, y.line AS b, x.n AS n, y.n AS m FROM e x JOIN e y USING (b, side, piece) WHERE x.n = x.b AND x.line <> y.line),
    near AS (SELECT a, b FROM c WHERE (n = m AND len(list_filter(range(1, n + 1), lambda p: substr(a, p, 1) <> substr(b, p, 1))) = 1)
        OR (m = n + 1 AND len(list_filter(range(0, m), lambda p: left(b, p) || substr(b, p + 2) = a)) > 0)),
    ties AS (SELECT a, b FROM near UNION SELECT b, a FROM near),
    reach AS (SELECT a, b FROM ties UNION SELECT r.a, t.b FROM reach r JOIN ties t ON r.b = t.a),
    f AS (SELECT k.line, least(any_value(k.first), coalesce(min(o.first), any_value(k.first))) AS first FROM k LEFT JOIN reach ON reach.a = k.line LEFT JOIN k o ON o.line = reach.b GROUP BY k.line),
    g AS (SELECT l.*, f.first <> {'d': doc_id, 'l': line_no} AS gone FROM l JOIN f ON l.line = f.line)
    SELECT d.doc_id, count(g.line) AS n_lines, count(*) FILTER (gone) AS n_dropped, coalesce(string_agg(line_no::VARCHAR, ',' ORDER BY line_no) FILTER (gone), '') AS dropped,
        coalesce(sum(length(line)) FILTER (NOT gone), 0)::BIGINT AS kept_chars FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id GROUP BY d.doc_id"""


def _level(name: str, source: str, keys: list[str], budget: str) -> str:
    """Shares of a budget among the children (last key) of each node: a child is full if what is left when all that
    need less of their weight are full gives it its room; the others share the rest by weight."""
    node = ", ".join(keys[:-1])
    per = f"PARTITION BY {node}" if node else ""
    join = f"JOIN (SELECT {node}, budget FROM {budget}) up USING ({node})" if node else f"CROSS JOIN {budget} up"
    return f"""{name}_n AS (SELECT {", ".join(keys)}, sum(t) AS t, 4.0 * sum(t) AS room, pow(sum(t)::DOUBLE, 0.7) AS w FROM {source} WHERE t > 0 GROUP BY {", ".join(keys)}),
    {name}_f AS (SELECT n.*, up.budget AS whole, (up.budget - coalesce(sum(room) OVER ({per} ORDER BY n.t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w / sum(w) OVER ({per} ORDER BY n.t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) >= room AS is_full FROM {name}_n n {join}),
    {name} AS (SELECT {", ".join(keys)}, room, t, CASE WHEN is_full THEN room ELSE (whole - coalesce(sum(room) FILTER (is_full) OVER ({per}), 0)) * w / sum(w) FILTER (NOT is_full) OVER ({per}) END AS budget FROM {name}_f)"""


_TAIL = "regexp_extract(coalesce(source, ''), '([0-9]{1,9})$', 1)"

MIXING = f"""WITH d AS (SELECT doc_id, lang, source, CASE WHEN {_TAIL} = '' THEN 'd-' ELSE 'd' || ({_TAIL}::BIGINT % 4) END AS domain, coalesce(lang, chr(1)) AS l, coalesce(source, chr(1)) AS s,
        len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS tokens FROM documents),
    leaf AS (SELECT domain, l, s, sum(tokens) AS t FROM d GROUP BY ALL),
    total AS (SELECT sum(t)::DOUBLE AS budget FROM leaf),
    {_level("a", "leaf", ["domain"], "total")},
    {_level("b", "leaf", ["domain", "l"], "a")},
    {_level("c", "leaf", ["domain", "l", "s"], "b")},
    low AS (SELECT *, floor(budget + 1e-6)::BIGINT AS least FROM c),
    placed AS (SELECT *, row_number() OVER (ORDER BY least + 1 > room + 1e-6, least - round(budget, 6), domain, l, s) AS place, (SELECT round(budget) FROM total) - sum(least) OVER () AS spare FROM low),
    told AS (SELECT domain, l, s, t, least + CASE WHEN place <= spare AND least + 1 <= room + 1e-6 THEN 1 ELSE 0 END AS budget FROM placed),
    plan AS (SELECT leaf.domain, leaf.l, leaf.s, CASE WHEN leaf.t > 0 THEN budget // leaf.t ELSE 1 END AS whole, CASE WHEN leaf.t > 0 THEN budget % leaf.t ELSE 0 END AS rest FROM leaf LEFT JOIN told USING (domain, l, s)),
    r AS (SELECT d.*, whole, rest, md5('17:' || whole::BIGINT || ':' || coalesce(doc_id::VARCHAR, '')) AS h FROM d JOIN plan USING (domain, l, s)),
    u AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, l, s ORDER BY h) AS upto FROM r),
    v AS (SELECT doc_id, domain, lang, source, tokens::BIGINT AS tokens, (whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END)::INTEGER AS copies FROM u)
    SELECT * FROM v WHERE copies > 0"""

#: Conversations without calls, as the tables hold them: every message is one item.  Where there are calls this
#: text stops with an error; the tests hold those against exact results.
CHATS = """SELECT conv_id, CASE WHEN regexp_matches(coalesce(text, ''), '<(tools|tool_call|tool_response)>') OR role = 'tool' THEN error('tool calls') ELSE turn END AS anchor, 0::INTEGER AS depth, 0::INTEGER AS anchor_place, 'message' AS kind,
    turn, 0::INTEGER AS place, coalesce(role, 'unknown') AS role, NULL::VARCHAR AS id, NULL::BIGINT AS linked_turn, '' AS problems,
    '{"content":' || to_json(coalesce(text, ''))::VARCHAR || ',"role":' || to_json(coalesce(role, 'unknown'))::VARCHAR || '}' AS json FROM conversations"""

ORACLE_SQL: dict[str, str] = {"op2_warc_archive": WARC, "op6_line_dedup": LINES, "op9_mixing": MIXING, "op10_chat_format": CHATS}
