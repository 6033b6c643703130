"""SQL text for queries that solve linear systems: moments by aggregates, Gauss-Jordan steps by recursion."""

from __future__ import annotations

from collections.abc import Sequence


def eliminated(name: str, matrix: str, size: int, wide: int, keys: Sequence[str] = (), carry: Sequence[str] = ()) -> str:
    """A recursive table ``name`` with ``m`` of ``matrix`` (``size`` rows, ``size + wide`` columns) brought to the
    identity on the left, step by step; the last step has ``k = size``."""
    kept = "".join(f"{c}, " for c in [*keys, *carry])
    step = "CASE WHEN i = k + 1 THEN m[k + 1][j] / m[k + 1][k + 1] ELSE m[i][j] - m[i][k + 1] * m[k + 1][j] / m[k + 1][k + 1] END"
    return f"""{name} AS (SELECT {kept}0 AS k, m FROM {matrix} UNION ALL
        SELECT {kept}k + 1, [[{step} FOR j IN range(1, {size + wide + 1})] FOR i IN range(1, {size + 1})] FROM {name} WHERE k < {size})"""


def ridge(name: str, source: str, cols: Sequence[str], target: str, alpha: str, keys: Sequence[str] = (), inverse: bool = False) -> str:
    """Tables up to ``name``: per key the weights ``w``, the intercept ``c`` and the means ``mx`` and ``my`` of a ridge
    regression on centered columns; with ``inverse`` also ``v``, the inverse of the penalised cross products."""
    d, kept = len(cols), "".join(f"{c}, " for c in keys)
    rows = [
        ", ".join([f"count(*) * covar_pop({a}, {b})" + (f" + {alpha}" if a == b else "") for b in cols] + [f"count(*) * covar_pop({a}, {target})"] + [f"{float(a == b)}" for b in cols if inverse])
        for a in cols
    ]
    by = f" GROUP BY {', '.join(keys)}" if keys else ""
    means = f"[{', '.join(f'avg({c})' for c in cols)}]::DOUBLE[] AS mx, avg({target})::DOUBLE AS my, count(*) AS n"
    more = f", [[m[i][j] FOR j IN range({d + 2}, {2 * d + 2})] FOR i IN range(1, {d + 1})] AS v" if inverse else ""
    return f"""{name}_m AS (SELECT {kept}{means}, [{', '.join(f'[{x}]' for x in rows)}]::DOUBLE[][] AS m FROM {source}{by}),
        {eliminated(name + '_r', name + '_m', d, 1 + d * inverse, keys, ('mx', 'my', 'n'))},
        {name} AS (SELECT *, my - list_dot_product(w, mx) AS c FROM (SELECT {kept}mx, my, n, [m[i][{d + 1}] FOR i IN range(1, {d + 1})] AS w{more} FROM {name}_r WHERE k = {d}))"""


def linear(cols: Sequence[str], weights: str = "w", intercept: str = "c") -> str:
    """A fitted model's value for a row."""
    return f"{intercept} + " + " + ".join(f"{weights}[{k + 1}] * {c}" for k, c in enumerate(cols))


def fold(order: str, k: int) -> str:
    """The fold of a row in the order: the first ``n % k`` folds have one row more."""
    at, n = f"(row_number() OVER (ORDER BY {order}) - 1)", "count(*) OVER ()"
    edge = f"(({n}) % {k}) * (({n}) // {k} + 1)"
    return f"CASE WHEN {at} < {edge} THEN {at} // (({n}) // {k} + 1) ELSE ({n}) % {k} + ({at} - {edge}) // (({n}) // {k}) END"


def centered(name: str, source: str, cols: Sequence[str], target: str) -> str:
    """A table ``name`` of one row: mean cross products ``g`` and ``r`` of centered columns, means ``mx`` and ``my``,
    the target's population variance ``yy`` and the row count ``n``."""
    rows = ", ".join("[" + ", ".join(f"covar_pop({a}, {b})" for b in cols) + "]" for a in cols)
    cross, means = (", ".join(f"{f}" for f in x) for x in ([f"covar_pop({a}, {target})" for a in cols], [f"avg({a})" for a in cols]))
    return f"""{name} AS (SELECT [{rows}]::DOUBLE[][] AS g, [{cross}]::DOUBLE[] AS r, [{means}]::DOUBLE[] AS mx, avg({target})::DOUBLE AS my,
        var_pop({target})::DOUBLE AS yy, count(*)::DOUBLE AS n FROM {source})"""


def descent(name: str, stats: str, d: int, l1: float, l2: float, sweeps: int) -> str:
    """A recursive table ``name`` of cyclic coordinate descent for the elastic net: one coordinate a step."""
    at, dot = f"(k % {d} + 1)", " + ".join(f"g[k % {d} + 1][{j}] * w[{j}]" for j in range(1, d + 1))
    own = f"g[{at}][{at}]"
    return f"""{name} AS (SELECT 0 AS k, [{", ".join(["0.0"] * d)}]::DOUBLE[] AS w, g, r, mx, my FROM {stats} UNION ALL
        SELECT k + 1, [CASE WHEN j = {at} THEN sign(q) * greatest(abs(q) - {l1}, 0) / ({own} + {l2}) ELSE w[j] END FOR j IN range(1, {d + 1})], g, r, mx, my
        FROM (SELECT *, r[{at}] - ({dot}) + {own} * w[{at}] AS q FROM {name}) WHERE k < {d * sweeps})"""


def axes(name: str, matrix: str, d: int, count: int, squarings: int = 40) -> str:
    """Recursive tables up to ``name`` (``i``, ``v``): the ``count`` leading unit eigenvectors of the symmetric ``m`` of
    ``matrix``, the entry of largest size positive.  Squaring a matrix again and again leaves its leading direction;
    the matrix then loses that direction."""
    span = f"range(1, {d + 1})"
    product = " + ".join(f"p[i][{t}] * p[{t}][j]" for t in range(1, d + 1))
    trace = lambda x: " + ".join(f"{x}[{t}][{t}]" for t in range(1, d + 1))
    out, before = [], matrix
    for c in range(count):
        q, v = f"{name}_q{c}", f"{name}_v{c}"
        image = " + ".join(f"m[i][{t}] * v[{t}]" for t in range(1, d + 1))
        out.append(f"""{q} AS (SELECT 0 AS k, m, [[m[i][j] / ({trace("m")}) FOR j IN {span}] FOR i IN {span}] AS p FROM {before} UNION ALL
            SELECT k + 1, m, [[p[i][j] / ({trace("p")}) FOR j IN {span}] FOR i IN {span}] FROM (SELECT k, m, [[{product} FOR j IN {span}] FOR i IN {span}] AS p FROM {q} WHERE k < {squarings}))""")
        out.append(f"""{v} AS (SELECT m, [x * sign(list_extract(u, list_position([abs(y) FOR y IN u], list_max([abs(y) FOR y IN u])))) / sqrt(list_dot_product(u, u)) FOR x IN u] AS v
            FROM (SELECT m, p[list_position([p[t][t] FOR t IN {span}], list_max([p[t][t] FOR t IN {span}]))] AS u FROM {q} WHERE k = {squarings}))""")
        out.append(f"""{v}n AS (SELECT [[m[i][j] - size * v[i] * v[j] FOR j IN {span}] FOR i IN {span}] AS m FROM (SELECT m, v, list_dot_product(v, [{image} FOR i IN {span}]) AS size FROM {v}))""")
        before = f"{v}n"
    return ", ".join(out) + f", {name} AS (" + " UNION ALL ".join(f"SELECT {c} AS i, v FROM {name}_v{c}" for c in range(count)) + ")"
