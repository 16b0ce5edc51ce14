"""DuckDB SQL equal to the registered queries (the driver's correctness oracle).

Written independently of the Spark code, from the same definitions: the rating
view, block arithmetic with integer division, the md5 hash init and order key.
Training runs over the whole table as a dataflow recursion: all visits are numbered in schedule
order and ranked per x and per y; each round applies every visit that is next for both its ids
(``USING KEY`` keeps one vector per id).
"""

from __future__ import annotations

from gridmf.plans.queries import DECAY, DIGITS, EPOCHS, HOLE_BLOCK, K, N, SEED, STEP

RV = """rv AS (
  SELECT CAST(o.o_custkey AS INTEGER) AS x_id, CAST(l.l_partkey AS INTEGER) AS y_id,
         CAST(l.l_quantity AS DOUBLE) / 10.0::DOUBLE AS rating
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)"""
DOM = "dom AS (SELECT CAST(max(x_id) + 1 AS BIGINT) AS nx, CAST(max(y_id) + 1 AS BIGINT) AS ny FROM rv)"


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join((RV,) + ctes) + "\n"


def bid(ident: str, n: str) -> str:
    """Balanced block of ``ident`` for ``n`` ids (``n`` a SQL expression)."""
    q, c = f"({n} // {N})", f"({n} % {N})"
    return (f"CAST(CASE WHEN {ident} >= ({q} + 1) * {c} "
            f"THEN ({ident} - ({q} + 1) * {c}) // greatest({q}, 1) + {c} "
            f"ELSE {ident} // ({q} + 1) END AS INTEGER)")


def boff(block: str, n: str) -> str:
    q, c = f"({n} // {N})", f"({n} % {N})"
    return (f"CAST(CASE WHEN {block} <= {c} THEN ({q} + 1) * {block} "
            f"ELSE ({q} + 1) * {c} + {q} * ({block} - {c}) END AS INTEGER)")


def bdim(block: str, n: str) -> str:
    q, c = f"({n} // {N})", f"({n} % {N})"
    return f"CAST({q} + CASE WHEN {block} < {c} THEN 1 ELSE 0 END AS INTEGER)"


def cdim(n: str) -> str:
    return f"greatest(({n} - 1 + {N}) // {N}, 1)"


def uni(matrix: str, ident: str, k: str) -> str:
    return (f"CAST(('0x' || substr(md5(concat_ws('|', '{SEED}', '{matrix}', CAST({ident} AS VARCHAR), "
            f"CAST({k} AS VARCHAR))), 1, 12))::BIGINT AS DOUBLE) / 281474976710656.0::DOUBLE")


ORD = (f"CAST(('0x' || substr(md5(concat_ws('|', '{SEED}', CAST(x_id AS VARCHAR), CAST(y_id AS VARCHAR), "
       f"CAST(CAST(round(rating * 1000000.0) AS BIGINT) AS VARCHAR))), 1, 13))::BIGINT AS BIGINT)")

GRID = f"""grid AS (
  SELECT rv.x_id, rv.y_id, rv.rating, {bid('rv.x_id', 'dom.nx')} AS bx, {bid('rv.y_id', 'dom.ny')} AS "by"
  FROM rv, dom)"""
GRIDS = f'grids AS (SELECT *, CAST(((("by" - bx) % {N}) + {N}) % {N} AS INTEGER) AS stratum FROM grid)'


def longf(matrix: str, n: str, signed: bool = False) -> str:
    val = uni(matrix, "i", "k")
    if signed:
        val = f"({val}) * 2.0 - 1.0"
    return (f"SELECT '{matrix}' AS matrix, CAST(i AS INTEGER) AS id, CAST(k AS INTEGER) AS k, {val} AS value "
            f"FROM (SELECT unnest(range(0, {n})) AS i FROM dom) ids, range(0, {K}) kk(k)")


INIT = f"""wl AS ({longf('W', 'nx')}),
hl AS ({longf('H', 'ny')})"""
INIT_LONG = f"SELECT matrix, id, k, round(value, {DIGITS}) AS value FROM (SELECT * FROM wl UNION ALL SELECT * FROM hl) f"
PRED = """pairs AS (SELECT DISTINCT x_id, y_id FROM rv),
pp AS (SELECT p.x_id, p.y_id, sum(w.value * h.value) AS prediction
       FROM pairs p JOIN wl w ON w.id = p.x_id JOIN hl h ON h.id = p.y_id AND h.k = w.k
       GROUP BY p.x_id, p.y_id),
scored AS (SELECT rv.x_id, rv.y_id, rv.rating, pp.prediction, rv.rating - pp.prediction AS residual,
                  (rv.rating - pp.prediction) * (rv.rating - pp.prediction) AS sq_error
           FROM rv JOIN pp ON rv.x_id = pp.x_id AND rv.y_id = pp.y_id)"""
SUMMARY = "summ AS (SELECT coalesce(sum(sq_error), 0.0) AS sse, count(*) AS n FROM scored)"


def perm(axis: str, n: str) -> str:
    key = f"md5(concat_ws('|', '{SEED}', '{axis}', CAST(i AS VARCHAR)))"
    return (f"SELECT '{axis}' AS axis, CAST(i AS INTEGER) AS old_id, "
            f"CAST(row_number() OVER (ORDER BY {key}, i) - 1 AS INTEGER) AS new_id "
            f"FROM (SELECT unnest(range(0, {n})) AS i FROM dom) ids")


def cell_line_sql(ctes: str) -> str:
    txt = "CAST(x_id AS VARCHAR) || ',' || CAST(y_id AS VARCHAR) || ',' || CAST(rating AS VARCHAR) || ';'"
    return (_with(DOM, GRID, f"""ro AS (SELECT *, {ORD} AS ord FROM grid)""",
                  f"""rk AS (SELECT *, row_number() OVER (PARTITION BY bx, "by" ORDER BY ord, x_id, y_id, rating) - 1 AS rnk FROM ro)""",
                  f"""lines AS (SELECT bx, "by", CAST(rnk // 100000 AS INTEGER) AS part,
                          string_agg({txt}, '' ORDER BY ord, x_id, y_id, rating) AS line
                   FROM rk GROUP BY bx, "by", rnk // 100000)""",
                  f"""allc AS (SELECT CAST(b // {N} AS INTEGER) AS bx, CAST(b % {N} AS INTEGER) AS "by" FROM range(0, {N * N}) t(b))""",
                  f"""cl AS (SELECT a.bx, a."by", coalesce(l.part, 0) AS part, coalesce(l.line, '') AS line
                   FROM allc a LEFT JOIN lines l ON a.bx = l.bx AND a."by" = l."by")""") + ctes)


def trained(name: str, epochs: int) -> str:
    """CTEs of the factors ``name(matrix, id, nxt, vec)`` after ``epochs`` over ``c`` (with ``e, pass`` and ``place``)."""
    lists = {m: "[" + ", ".join(uni(m, "i", str(k)) for k in range(K)) + "]" for m in "WH"}
    return f"""{name}_q AS MATERIALIZED (SELECT x_id, y_id, rating, {STEP!r} * pow({DECAY!r}, e) AS eta,
       row_number() OVER (PARTITION BY x_id ORDER BY t) AS rx, row_number() OVER (PARTITION BY y_id ORDER BY t) AS ry
       FROM (SELECT *, row_number() OVER (ORDER BY e, p1, p2, ord, x_id, y_id, rating) AS t FROM c, range(0, {epochs}) ep(e)) v),
{name}(matrix, id, nxt, vec) USING KEY (matrix, id) AS (
  (SELECT 'W' AS matrix, i AS id, CAST(1 AS BIGINT) AS nxt, {lists['W']} AS vec FROM (SELECT unnest(range(0, nx)) AS i FROM dom) w
   UNION ALL SELECT 'H', i, CAST(1 AS BIGINT), {lists['H']} FROM (SELECT unnest(range(0, ny)) AS i FROM dom) h)
  UNION
  (SELECT u.m, u.id, u.nxt, u.v FROM
    (SELECT *, list_transform(wv, lambda a, k: a + g * hv[k]) AS nw FROM
      (SELECT q.x_id, q.y_id, q.rx, q.ry, w.vec AS wv, h.vec AS hv, 2.0 * q.eta * (q.rating - list_dot_product(w.vec, h.vec)) AS g
       FROM {name}_q q JOIN recurring.{name} w ON w.matrix = 'W' AND w.id = q.x_id AND w.nxt = q.rx
                       JOIN recurring.{name} h ON h.matrix = 'H' AND h.id = q.y_id AND h.nxt = q.ry) a) b,
    LATERAL (SELECT 'W' AS m, b.x_id AS id, b.rx + 1 AS nxt, b.nw AS v
             UNION ALL SELECT 'H', b.y_id, b.ry + 1, list_transform(b.hv, lambda a, k: a + b.g * b.nw[k])) u))"""


def visits(sweep: bool = False, first_stratum: bool = False, hole: int | None = None) -> str:
    """CTE ``c``: every triple (of the first stratum, not of x-block ``hole``) with its order key and the two keys of its place in an epoch."""
    xb, yb = ((f"CAST(x_id // {cdim('nx')} AS INTEGER)", f"CAST(y_id // {cdim('ny')} AS INTEGER)") if sweep
              else (bid("x_id", "nx"), bid("y_id", "ny")))
    stratum = f"((yb - xb) % {N} + {N}) % {N}"
    keys = "xb AS p1, yb AS p2" if sweep else f"{stratum} AS p1, xb AS p2"
    wanted = [f"{stratum} = 0"] * first_stratum + ([f"xb <> {hole}"] if hole is not None else [])
    return f"""c AS MATERIALIZED (SELECT *, {keys} FROM (SELECT x_id, y_id, rating, {ORD} AS ord, {xb} AS xb, {yb} AS yb FROM rv, dom) b
       WHERE {' AND '.join(wanted) or 'true'})"""


def _train(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join((RV, DOM) + ctes) + "\n"


TRAINED_LONG = f"""SELECT matrix, CAST(id AS INTEGER) AS id, CAST(k AS INTEGER) AS k, round(vec[k + 1], {DIGITS}) AS value
    FROM st, range(0, {K}) kk(k)"""
EPOCH_LOG = " UNION ALL ".join(f"""SELECT CAST({e} AS INTEGER) AS iteration, round({STEP!r} * pow({DECAY!r}, {e}), 12) AS step_size,
    round(sum(pow(rating - list_dot_product(w.vec, h.vec), 2)), 4) AS sse, count(*) AS n,
    round(sqrt(sum(pow(rating - list_dot_product(w.vec, h.vec), 2)) / count(*)), 9) AS rmse
    FROM rv JOIN st{e} w ON w.matrix = 'W' AND w.id = x_id JOIN st{e} h ON h.matrix = 'H' AND h.id = y_id""" for e in range(EPOCHS))


ORACLE_SQL: dict[str, str] = {
    "ratings_view": _with() + "SELECT x_id, y_id, rating FROM rv",
    "ratings_scan": _with() + "SELECT x_id, y_id, rating FROM rv",
    "ratings_scan_extra_fields": _with() + "SELECT x_id, y_id, rating FROM rv",
    "id_domain": _with(DOM) + "SELECT nx AS num_x_ids, ny AS num_y_ids FROM dom",
    "block_ids": _with(DOM, GRID) + f"""SELECT a.axis, CAST(b AS INTEGER) AS block,
        CASE a.axis WHEN 'x' THEN {boff('b', 'nx')} ELSE {boff('b', 'ny')} END AS first_id,
        CASE a.axis WHEN 'x' THEN {bdim('b', 'nx')} ELSE {bdim('b', 'ny')} END AS dim,
        (SELECT count(*) FROM grid g WHERE CASE a.axis WHEN 'x' THEN g.bx ELSE g."by" END = b) AS n
        FROM (VALUES ('x'), ('y')) a(axis), range(0, {N}) t(b), dom""",
    "block_dim": _with(DOM) + f"""SELECT 'x' AS axis, CAST(b AS INTEGER) AS block, {bdim('b', 'nx')} AS dim FROM dom, range(0, {N}) t(b)
        UNION ALL SELECT 'y', CAST(b AS INTEGER), {bdim('b', 'ny')} FROM dom, range(0, {N}) t(b)""",
    "block_offset": _with(DOM) + f"""SELECT 'x' AS axis, CAST(b AS INTEGER) AS block, {boff('b', 'nx')} AS "offset" FROM dom, range(0, {N}) t(b)
        UNION ALL SELECT 'y', CAST(b AS INTEGER), {boff('b', 'ny')} FROM dom, range(0, {N}) t(b)""",
    "block_id": _with(DOM, GRID) + 'SELECT x_id, y_id, bx, "by" FROM grid',
    "ceil_block_id": _with(DOM) + f"""SELECT x_id, y_id, CAST(x_id // {cdim('nx')} AS INTEGER) AS bx,
        CAST(y_id // {cdim('ny')} AS INTEGER) AS "by" FROM rv, dom""",
    "local_index": _with(DOM, GRID) + f"""SELECT x_id, y_id, CAST(x_id - {boff('bx', 'nx')} AS INTEGER) AS x_local,
        CAST(y_id - {boff('"by"', 'ny')} AS INTEGER) AS y_local FROM grid, dom""",
    "grid_assign": _with(DOM, GRID, GRIDS) + 'SELECT x_id, y_id, rating, bx, "by", stratum FROM grids',
    "blockify": _with(DOM, GRID, GRIDS) + f'SELECT x_id, y_id, rating, bx, "by", stratum, {ORD} AS ord FROM grids',
    "stratum_cells": _with(DOM, GRID, GRIDS) + 'SELECT stratum, bx, "by", count(*) AS n FROM grids GROUP BY stratum, bx, "by"',
    "cell_counts": _with(DOM, GRID) + 'SELECT bx, "by", count(*) AS n FROM grid GROUP BY bx, "by"',
    "grid_sanity": _with(DOM, GRID) + """SELECT CAST(count(DISTINCT bx) AS BIGINT) AS x_blocks,
        CAST(count(DISTINCT (bx, "by")) AS BIGINT) AS cells, CAST(count(*) AS BIGINT) AS ratings FROM grid""",
    "rotate_h": _with(DOM) + f"""SELECT id, block, sub_epoch, pos, CAST(((pos - 1) % {N} + {N}) % {N} AS INTEGER) AS next_pos
        FROM (SELECT id, block, CAST(s AS INTEGER) AS sub_epoch, CAST(((block - s) % {N} + {N}) % {N} AS INTEGER) AS pos
              FROM (SELECT CAST(i AS INTEGER) AS id, {bid('i', 'ny')} AS block
                    FROM (SELECT unnest(range(0, ny)) AS i, ny FROM dom) u) h, range(0, {N}) t(s)) z""",
    "realign_h": _with(DOM, GRID) + f"""SELECT bx, "by", sub_epoch, CAST((("by" - sub_epoch) % {N} + {N}) % {N} AS INTEGER) AS pos
        FROM (SELECT DISTINCT bx, "by", CAST((("by" - bx) % {N} + {N}) % {N} AS INTEGER) AS sub_epoch FROM grid) c""",
    "replicate_h": _with(DOM) + f"""SELECT id, block, CAST(s AS INTEGER) AS sub_epoch,
        CAST(((block - s) % {N} + {N}) % {N} AS INTEGER) AS pos
        FROM (SELECT CAST(i AS INTEGER) AS id, {bid('i', 'ny')} AS block
              FROM (SELECT unnest(range(0, ny)) AS i, ny FROM dom) u) h, range(0, {N}) t(s)""",
    "init_factors": _with(DOM, INIT) + INIT_LONG,
    "init_factors_signed": _with(DOM, f"wl AS ({longf('W', 'nx', True)})", f"hl AS ({longf('H', 'ny', True)})") + INIT_LONG,
    "predict": _with(DOM, INIT, PRED) + f"SELECT x_id, y_id, rating, round(prediction, {DIGITS}) AS prediction FROM scored",
    "predict_grid": _with(DOM, INIT, PRED) + f"SELECT x_id, y_id, rating, round(prediction, {DIGITS}) AS prediction FROM scored",
    "residuals": _with(DOM, INIT, PRED) + f"""SELECT x_id, y_id, rating, round(residual, {DIGITS}) AS residual,
        round(sq_error, {DIGITS}) AS sq_error FROM scored""",
    "sse": _with(DOM, INIT, PRED, SUMMARY) + "SELECT round(sse, 4) AS sse, n FROM summ",
    "rmse": _with(DOM, INIT, PRED, SUMMARY) + "SELECT round(CASE WHEN n > 0 THEN sqrt(sse / n) END, 9) AS rmse FROM summ",
    "evaluate": _with(DOM, INIT, PRED, SUMMARY) + """SELECT round(sse, 4) AS sse, n,
        round(CASE WHEN n > 0 THEN sqrt(sse / n) END, 9) AS rmse FROM summ""",
    "ratings_join_w": _with(DOM, INIT, """ws AS (SELECT id, sum(value) AS w_sum, sum(value * value) AS w_sq FROM wl GROUP BY id)""")
        + f"""SELECT rv.x_id, rv.y_id, rv.rating, round(ws.w_sum, {DIGITS}) AS w_sum, round(ws.w_sq, {DIGITS}) AS w_sq
        FROM rv JOIN ws ON rv.x_id = ws.id""",
    "cell_factor_join": _with(DOM, INIT, PRED) +
        f"""SELECT {bid('s.x_id', 'dom.nx')} AS bx, {bid('s.y_id', 'dom.ny')} AS "by", round(sum(s.sq_error), 4) AS sse, count(*) AS n
        FROM scored s, dom GROUP BY 1, 2""",
    "embedding_predict": _with("""el AS (SELECT CAST(vec_id AS INTEGER) AS id, CAST(k - 1 AS INTEGER) AS k, CAST(embedding[k] AS DOUBLE) AS value
        FROM embeddings, range(1, 65) t(k) WHERE k <= len(embedding))""",
        """pairs AS (SELECT DISTINCT x_id, y_id FROM rv)""",
        """pp AS (SELECT p.x_id, p.y_id, sum(w.value * h.value) AS prediction FROM pairs p
            JOIN el w ON w.id = p.x_id JOIN el h ON h.id = p.y_id AND h.k = w.k GROUP BY p.x_id, p.y_id)""")
        + f"""SELECT rv.x_id, rv.y_id, rv.rating, round(pp.prediction, {DIGITS}) AS prediction
        FROM rv LEFT JOIN pp ON rv.x_id = pp.x_id AND rv.y_id = pp.y_id""",
    "sgd_matching_step": _with(DOM, INIT, f"ro AS (SELECT x_id, y_id, rating, {ORD} AS ord FROM rv)",
        """px AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY x_id ORDER BY ord, y_id, rating) AS rn FROM ro) WHERE rn = 1)""",
        """m AS (SELECT x_id, y_id, rating FROM (SELECT *, row_number() OVER (PARTITION BY y_id ORDER BY ord, x_id, rating) AS rn2 FROM px) WHERE rn2 = 1)""",
        f"""g AS (SELECT m.x_id, m.y_id, {2.0 * STEP!r} * (m.rating - sum(w.value * h.value)) AS g
              FROM m JOIN wl w ON w.id = m.x_id JOIN hl h ON h.id = m.y_id AND h.k = w.k GROUP BY m.x_id, m.y_id, m.rating)""",
        """w2 AS (SELECT g.x_id, g.y_id, w.k, w.value + g.g * h.value AS wv, h.value AS hv, g.g
               FROM g JOIN wl w ON w.id = g.x_id JOIN hl h ON h.id = g.y_id AND h.k = w.k)""")
        + f"""SELECT 'W' AS matrix, x_id AS id, k, round(wv, {DIGITS}) AS value FROM w2
        UNION ALL SELECT 'H', y_id, k, round(hv + g * wv, {DIGITS}) FROM w2""",
    "empty_cell_passthrough": _train(visits(first_stratum=True, hole=HOLE_BLOCK), trained("st", 1)) + TRAINED_LONG,
    "permute_ids": _with(DOM) + f"{perm('x', 'nx')} UNION ALL {perm('y', 'ny')}",
    "relabel_ids": _with(DOM, f"px AS ({perm('x', 'nx')})", f"py AS ({perm('y', 'ny')})")
        + """SELECT px.new_id AS x_id, py.new_id AS y_id, rv.rating FROM rv
        JOIN px ON rv.x_id = px.old_id JOIN py ON rv.y_id = py.old_id""",
    "relabeled_csv": _with(DOM, f"px AS ({perm('x', 'nx')})", f"py AS ({perm('y', 'ny')})")
        + """SELECT px.new_id AS x_id, py.new_id AS y_id, rv.rating FROM rv
        JOIN px ON rv.x_id = px.old_id JOIN py ON rv.y_id = py.old_id""",
    "step_schedule": _with() + f"""SELECT CAST(e AS INTEGER) AS iteration, round({STEP!r} * pow({DECAY!r}, e), 12) AS step_size,
        (SELECT count(*) FROM rv) AS updates FROM range(0, {EPOCHS}) t(e)""",
    "relabeled_cell_counts": _with(DOM, f"px AS ({perm('x', 'nx')})", f"py AS ({perm('y', 'ny')})",
        """rl AS (SELECT px.new_id AS x_id, py.new_id AS y_id FROM rv
                  JOIN px ON rv.x_id = px.old_id JOIN py ON rv.y_id = py.old_id)""")
        + f"""SELECT {bid('rl.x_id', 'dom.nx')} AS bx, {bid('rl.y_id', 'dom.ny')} AS "by", count(*) AS n
        FROM rl, dom GROUP BY 1, 2""",
    "cells_write_read": _with(DOM, GRID) + 'SELECT x_id, y_id, rating, bx, "by" FROM grid',
    "cells_csv_write_read": _with(DOM, GRID) + 'SELECT x_id, y_id, rating, bx, "by" FROM grid',
    "factor_lines": _with(DOM, INIT) + f"""SELECT matrix, block, part, string_agg(txt, '' ORDER BY id) AS line FROM (
        SELECT matrix, id, CASE matrix WHEN 'W' THEN {bid('id', 'nx')} ELSE {bid('id', 'ny')} END AS block, CAST(id // 100000 AS INTEGER) AS part,
               string_agg(CAST(u // {10**DIGITS} AS VARCHAR) || '.' || lpad(CAST(u % {10**DIGITS} AS VARCHAR), {DIGITS}, '0') || ',', '' ORDER BY k) || ';' AS txt
        FROM (SELECT matrix, id, k, CAST(round(value * {float(10**DIGITS)}::DOUBLE) AS BIGINT) AS u FROM (SELECT * FROM wl UNION ALL SELECT * FROM hl) f) v, dom
        GROUP BY matrix, id, nx, ny) r GROUP BY matrix, block, part""",
    "factor_lines_ceil_decode": _with(DOM, INIT) + INIT_LONG,
    "cell_lines": cell_line_sql('SELECT bx, "by", part, line FROM cl'),
    "cell_lines_decode": _with() + "SELECT x_id, y_id, rating FROM rv",
    "factor_lines_decode": _with(DOM, INIT) + INIT_LONG,
    "model_write_read": _with(DOM, INIT) + INIT_LONG,
    "dsgd_subepoch": _train(visits(first_stratum=True), trained("st", 1)) + TRAINED_LONG,
    "dsgd_train": _train(visits(), trained("st", EPOCHS)) + TRAINED_LONG,
    "sweep_train": _train(visits(sweep=True), trained("st", EPOCHS)) + TRAINED_LONG,
    "training_log": _train(visits(), *[trained(f"st{e}", e + 1) for e in range(EPOCHS)]) + EPOCH_LOG,
}
