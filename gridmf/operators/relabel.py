"""Random relabeling of ids against block skew.

Contiguous id ranges hold very uneven shares of the ratings when ids follow
popularity or arrival.  An independent random bijection per axis, applied
before blocking, evens the cells out.  The permutation ranks all ids
``0..n-1`` (used or not) by ``md5(seed|axis|id)``.

Dense ranks without a global window (which would put all ids in one task):
ids fall into hash-prefix buckets - the prefix is the leading part of the same
digest, so bucket order is sort order - each bucket numbers its ids with a
window partitioned by bucket, and a prefix sum over the (small, size-bounded)
table of bucket counts gives each bucket's offset.  Ids are distinct and the
hash uniform, so buckets hold ``~ids_per_bucket`` ids each.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridmf.operators.score import DEFAULT_BROADCAST_LIMIT

IDS_PER_BUCKET = 1 << 20
PERMUTATION_SCHEMA = "axis STRING, old_id INT, new_id INT"


def _prefix_digits(n: int, ids_per_bucket: int) -> int:
    buckets_needed = max(1, math.ceil(n / ids_per_bucket))
    return min(8, max(1, math.ceil(math.log(buckets_needed, 16)) if buckets_needed > 1 else 1))


def permute_ids(spark: SparkSession, n: int, axis: str, seed: int,
                ids_per_bucket: int = IDS_PER_BUCKET,
                broadcast_limit: int = DEFAULT_BROADCAST_LIMIT) -> DataFrame:
    """``(axis, old_id, new_id)``: a bijection of ``0..n-1`` (every id, used or not)."""
    digits = _prefix_digits(n, ids_per_bucket)
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(axis), F.col("old_id").cast("string")))
    ids = (spark.range(n).select(F.col("id").cast("int").alias("old_id"))
           .withColumn("key", key)
           .withColumn("bucket", F.conv(F.substring("key", 1, digits), 16, 10).cast("bigint")))
    ranked = ids.withColumn(
        "rank_in_bucket",
        F.row_number().over(Window.partitionBy("bucket").orderBy("key", "old_id")) - 1)
    counts = ids.groupBy("bucket").agg(F.count(F.lit(1)).alias("cnt"))
    # At most 16**digits rows (about 16 * n / ids_per_bucket): a single ordered
    # window over it is cheap and bounded.
    offsets = counts.select(
        "bucket",
        (F.sum("cnt").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
        .alias("offset"))
    offsets = offsets.fillna(0, subset=["offset"])
    if (16 ** digits) * 32 <= broadcast_limit:
        offsets = F.broadcast(offsets)
    return (ranked.join(offsets, "bucket")
                  .select(F.lit(axis).alias("axis"), "old_id",
                          (F.col("offset") + F.col("rank_in_bucket")).cast("int").alias("new_id")))


def relabel(ratings: DataFrame, perm_x: DataFrame, perm_y: DataFrame, num_x_ids: int | None = None,
            num_y_ids: int | None = None,
            broadcast_limit: int = DEFAULT_BROADCAST_LIMIT) -> DataFrame:
    """Replace ``x_id``/``y_id`` by their new labels: two equi-joins."""

    def lookup(perm, n, old, new):
        side = perm.select(F.col("old_id").alias(old), F.col("new_id").alias(new))
        if n is not None and n * 16 <= broadcast_limit:
            side = F.broadcast(side)
        return side

    px = lookup(perm_x, num_x_ids, "x_id", "new_x")
    py = lookup(perm_y, num_y_ids, "y_id", "new_y")
    return (ratings.join(px, "x_id").join(py, "y_id")
                   .select(F.col("new_x").alias("x_id"), F.col("new_y").alias("y_id"), "rating"))


def shuffle_ids(ratings: DataFrame, seed: int, num_x_ids: int | None = None,
                num_y_ids: int | None = None,
                broadcast_limit: int = DEFAULT_BROADCAST_LIMIT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Relabel both axes of a rating table with independent seeded permutations.

    Returns ``(relabeled ratings, x permutation, y permutation)``; the
    permutations map results back (``new_id -> old_id``).  Every id up to the
    maximum is permuted, used or not, so the id domain is unchanged.
    """
    if num_x_ids is None or num_y_ids is None:
        from gridmf.operators.domain import domain_sizes

        num_x_ids, num_y_ids = domain_sizes(ratings)
    spark = ratings.sparkSession
    px = permute_ids(spark, num_x_ids, "x", seed, broadcast_limit=broadcast_limit)
    py = permute_ids(spark, num_y_ids, "y", seed, broadcast_limit=broadcast_limit)
    return relabel(ratings, px, py, num_x_ids, num_y_ids, broadcast_limit), px, py
