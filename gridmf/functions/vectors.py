"""Vector arithmetic on ``ARRAY<DOUBLE>`` columns with higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 2**48: the init hash keeps 12 hex digits (48 bits) of an md5 digest.
HASH_SCALE = 281474976710656.0


def dot(w: Column, h: Column) -> Column:
    """Inner product of two equally long arrays."""
    return F.aggregate(F.zip_with(w, h, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)


def hash_uniform(*parts: Column) -> Column:
    """Uniform [0, 1) from md5 of ``seed|...`` - equal in Spark and DuckDB.

    Independent of partitioning, task order and cluster size, so factor
    initialization is reproducible anywhere.
    """
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    digits = F.substring(F.md5(text), 1, 12)
    return F.conv(digits, 16, 10).cast("bigint") / F.lit(HASH_SCALE)


def order_key(seed: int, x: Column, y: Column, rating: Column) -> Column:
    """Deterministic visiting order of a triple inside its cell (BIGINT, 52 bits).

    ``md5(seed|x|y|round(rating*1e6))``; ties are broken by (x, y, rating), and
    tied triples are then identical, so the order is total in effect.  52 bits
    keep the key exact where Arrow hands nullable integers over as doubles.
    """
    micro = F.round(rating * F.lit(1_000_000.0)).cast("bigint")
    text = F.concat_ws("|", F.lit(str(seed)), x.cast("string"), y.cast("string"),
                       micro.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")
