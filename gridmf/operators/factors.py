"""Factor matrices W and H as one DataFrame ``(matrix, id, block, vec)``.

One row per id, ``vec ARRAY<DOUBLE>`` of length K.  Initial values come from a
hash of ``(seed, matrix, id, k)``: uniform on [0, 1) (or [-1, 1) when
``signed``), reproducible on any cluster and in any SQL engine, and different
for every row - unlike per-block seeding, which makes equal-sized blocks equal.
Ids without ratings still get a row, since blocks are sized from ``max + 1``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmf.functions.vectors import hash_uniform
from gridmf.operators.blocks import BALANCED, _block_of

FACTOR_SCHEMA = "matrix STRING, id INT, block INT, vec ARRAY<DOUBLE>"


def _one_matrix(spark: SparkSession, matrix: str, n: int, rank: int, seed: int,
                num_blocks: int, split: str, signed: bool) -> DataFrame:
    ids = spark.range(n).select(F.col("id").cast("int").alias("id"))

    def value(k):
        u = hash_uniform(F.lit(seed), F.lit(matrix), F.col("id"), k)
        return u * 2.0 - 1.0 if signed else u

    return ids.select(
        F.lit(matrix).alias("matrix"),
        "id",
        _block_of(split, n, num_blocks, "id").alias("block"),
        F.transform(F.sequence(F.lit(0), F.lit(rank - 1)), value).alias("vec"),
    )


def init_factors(spark: SparkSession, num_x_ids: int, num_y_ids: int, rank: int,
                 num_blocks: int, seed: int, split: str = BALANCED,
                 signed: bool = False) -> DataFrame:
    if rank < 1:
        raise ValueError("rank must be >= 1")
    w = _one_matrix(spark, "W", num_x_ids, rank, seed, num_blocks, split, signed)
    h = _one_matrix(spark, "H", num_y_ids, rank, seed, num_blocks, split, signed)
    return w.unionByName(h)


def factors_long(factors: DataFrame, digits: int = 6) -> DataFrame:
    """``(matrix, id, k, value)`` rounded - the query form of a factor table."""
    return (factors.select("matrix", "id", F.posexplode("vec").alias("k", "value"))
                   .select("matrix", "id", F.col("k").cast("int").alias("k"),
                           F.round("value", digits).alias("value")))


def side(factors: DataFrame, matrix: str) -> DataFrame:
    return factors.where(F.col("matrix") == matrix).select("id", "vec")


def embeddings_as_factors(embeddings: DataFrame, num_blocks: int, n: int,
                          split: str = BALANCED) -> DataFrame:
    """Use an ``(vec_id, embedding ARRAY<FLOAT>)`` table as both W and H."""
    base = embeddings.select(F.col("vec_id").cast("int").alias("id"),
                             F.col("embedding").cast("array<double>").alias("vec"))
    blk = _block_of(split, n, num_blocks, "id").alias("block")
    return (base.select(F.lit("W").alias("matrix"), "id", blk, "vec")
                .unionByName(base.select(F.lit("H").alias("matrix"), "id", blk, "vec")))
