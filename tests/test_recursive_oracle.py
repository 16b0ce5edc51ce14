"""Training checked against SQL: a DuckDB recursive CTE, one SGD sample per step.

Far too slow for whole tables (every step rewrites both factor lists), so it
runs on the small fixture of FIXTURES.md (sf0.01, x_id < 60 and y_id < 80:
105 triples, N = 3, K = 4, 2 epochs) and is not a registered query.
"""

import duckdb
import numpy as np

from conftest import SF_MID
from gridmf.plans import train
from gridmf.plans.oracle import ORD, uni

N, K, EPOCHS, STEP, DECAY = 3, 4, 2, 0.001, 0.99


def blk(ident: str, n: str) -> str:
    q, c = f"({n} // {N})", f"({n} % {N})"
    return (f"CAST(CASE WHEN {ident} >= ({q} + 1) * {c} THEN ({ident} - ({q} + 1) * {c}) // greatest({q}, 1) + {c} "
            f"ELSE {ident} // ({q} + 1) END AS INTEGER)")


def init_list(matrix: str, n: str) -> str:
    return (f"SELECT list(vec ORDER BY i) AS m FROM ("
            f"SELECT i, list({uni(matrix, 'i', 'k')} ORDER BY k) AS vec "
            f"FROM (SELECT unnest(range(0, {n})) AS i FROM dom) ids, range(0, {K}) kk(k) GROUP BY i)")


RECURSIVE_SQL = f"""
WITH RECURSIVE
rv AS (SELECT CAST(o_custkey AS INTEGER) AS x_id, CAST(l_partkey AS INTEGER) AS y_id,
              CAST(l_quantity AS DOUBLE) / 10.0::DOUBLE AS rating
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
rs AS (SELECT * FROM rv WHERE x_id < 60 AND y_id < 80),
dom AS (SELECT max(x_id) + 1 AS nx, max(y_id) + 1 AS ny FROM rs),
cells AS (SELECT x_id, y_id, rating, {ORD} AS ord, {blk('x_id', 'nx')} AS xb, {blk('y_id', 'ny')} AS yb
          FROM rs, dom),
seq AS (SELECT x_id, y_id, rating, {STEP!r} * pow({DECAY!r}, e) AS eta,
               row_number() OVER (ORDER BY e, (((yb - xb) % {N}) + {N}) % {N}, xb, ord, x_id, y_id, rating) AS t
        FROM cells, range(0, {EPOCHS}) ep(e)),
run(t, w, h) AS (
  SELECT 0, wl.m, hl.m FROM ({init_list('W', 'nx')}) wl, ({init_list('H', 'ny')}) hl
  UNION ALL
  SELECT t1,
         list_transform(w, lambda v, i: CASE WHEN i = xi THEN nw ELSE v END),
         list_transform(h, lambda v, i: CASE WHEN i = yi
                                           THEN list_transform(hv, lambda a, k: a + g * nw[k]) ELSE v END)
  FROM (SELECT *, list_transform(wv, lambda a, k: a + g * hv[k]) AS nw
        FROM (SELECT run.t + 1 AS t1, run.w, run.h, seq.x_id + 1 AS xi, seq.y_id + 1 AS yi,
                     run.w[seq.x_id + 1] AS wv, run.h[seq.y_id + 1] AS hv,
                     2.0 * seq.eta * (seq.rating - list_dot_product(run.w[seq.x_id + 1],
                                                                    run.h[seq.y_id + 1])) AS g
              FROM run JOIN seq ON seq.t = run.t + 1) z1) z2)
SELECT w, h FROM run WHERE t = (SELECT max(t) FROM seq)
"""


def test_fit_equals_recursive_cte(spark, ratings_small):
    con = duckdb.connect()
    for t in ("lineitem", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_MID}/{t}.parquet'")
    w_sql, h_sql = con.execute(RECURSIVE_SQL).fetchone()
    res = train.fit(ratings_small, rank=K, num_blocks=N, epochs=EPOCHS, step=STEP, decay=DECAY, seed=7)
    got = {(r.matrix, r.id): np.array(r.vec) for r in res.factors.collect()}
    assert len(got) == len(w_sql) + len(h_sql)
    W = np.array([got[("W", i)] for i in range(len(w_sql))])
    H = np.array([got[("H", i)] for i in range(len(h_sql))])
    assert np.allclose(W, np.array(w_sql), atol=1e-12)
    assert np.allclose(H, np.array(h_sql), atol=1e-12)
    assert ratings_small.count() == 105
