"""Block arithmetic of the id grid as Spark SQL expressions.

Ids ``0..n-1`` of one axis are cut into ``N`` contiguous ranges.  With
``q = n div N`` and ``c = n mod N`` the first ``c`` blocks hold ``q + 1`` ids and
the others ``q`` ids (the *balanced* split).  The out-of-core sweep uses a second,
*ceiling* split: every block holds ``(n - 1 + N) div N`` ids and the last blocks
may be short or empty.

Every builder takes the id (or block) as a SQL snippet - usually a column name -
and the two driver-side scalars ``n`` and ``N`` as Python ints, and returns a
``Column``.  All arithmetic is integral (``div``), so it stays inside whole-stage
codegen and matches the integer semantics of the original formulas.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _check(n: int, num_blocks: int) -> tuple[int, int]:
    if num_blocks < 1:
        raise ValueError("num_blocks must be >= 1")
    if n < 0:
        raise ValueError("number of ids must be >= 0")
    return n // num_blocks, n % num_blocks


def block_dim_sql(n: int, num_blocks: int, block: str) -> str:
    q, c = _check(n, num_blocks)
    return f"({q} + CASE WHEN ({block}) < {c} THEN 1 ELSE 0 END)"


def block_offset_sql(n: int, num_blocks: int, block: str) -> str:
    q, c = _check(n, num_blocks)
    return (f"(CASE WHEN ({block}) <= {c} THEN {q + 1} * ({block}) "
            f"ELSE {(q + 1) * c} + {q} * (({block}) - {c}) END)")


def block_id_sql(n: int, num_blocks: int, ident: str) -> str:
    q, c = _check(n, num_blocks)
    cut = (q + 1) * c
    # q = 0 only when n < N; then every id is below ``cut`` and the first
    # branch is never taken, but ANSI mode still wants a non-zero divisor.
    return (f"(CASE WHEN ({ident}) >= {cut} "
            f"THEN (({ident}) - {cut}) div {max(q, 1)} + {c} "
            f"ELSE ({ident}) div {q + 1} END)")


def ceil_block_dim(n: int, num_blocks: int) -> int:
    """Ids per block of the ceiling split: ``(max_id + N) div N``."""
    _check(n, num_blocks)
    return max((n - 1 + num_blocks) // num_blocks, 1)


def ceil_block_id_sql(n: int, num_blocks: int, ident: str) -> str:
    return f"(({ident}) div {ceil_block_dim(n, num_blocks)})"


def ceil_block_offset_sql(n: int, num_blocks: int, block: str) -> str:
    return f"(({block}) * {ceil_block_dim(n, num_blocks)})"


def block_dim(n: int, num_blocks: int, block: str) -> Column:
    return F.expr(block_dim_sql(n, num_blocks, block)).cast("int")


def block_offset(n: int, num_blocks: int, block: str) -> Column:
    return F.expr(block_offset_sql(n, num_blocks, block)).cast("int")


def block_id(n: int, num_blocks: int, ident: str) -> Column:
    return F.expr(block_id_sql(n, num_blocks, ident)).cast("int")


def ceil_block_id(n: int, num_blocks: int, ident: str) -> Column:
    return F.expr(ceil_block_id_sql(n, num_blocks, ident)).cast("int")


def ceil_block_offset(n: int, num_blocks: int, block: str) -> Column:
    return F.expr(ceil_block_offset_sql(n, num_blocks, block)).cast("int")


def stratum(bx: str, by: str, num_blocks: int) -> Column:
    """Sub-epoch in which cell (bx, by) is active: ``by = (bx + s) mod N``."""
    return F.expr(f"pmod(({by}) - ({bx}), {num_blocks})").cast("int")


def rotated_position(by: str, sub_epoch: int, num_blocks: int) -> Column:
    """Position (= x-block) that H block ``by`` meets in sub-epoch ``s``.

    The same expression serves the rotation between sub-epochs and the
    realignment for evaluation: it is derived from the H row's own block, so
    nothing is renumbered in place.
    """
    return F.expr(f"pmod(({by}) - {sub_epoch}, {num_blocks})").cast("int")
