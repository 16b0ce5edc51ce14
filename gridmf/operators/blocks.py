"""Grid layout of the ratings (P5-P10, A3, A7, A8) and the block table.

The grid is a set of *columns* on the ratings - ``bx``, ``by``, ``stratum``,
``ord`` - one row per triple; nothing is nested per cell.  ``blockify`` lays the
triples out once, partitioned so that partition ``i`` holds x-block ``i``.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmf.functions import blockmath as bm
from gridmf.functions.vectors import order_key

BALANCED = "balanced"
CEIL = "ceil"


def _block_of(split: str, n: int, num_blocks: int, ident: str):
    if split == BALANCED:
        return bm.block_id(n, num_blocks, ident)
    if split == CEIL:
        return bm.ceil_block_id(n, num_blocks, ident)
    raise ValueError(f"unknown split {split!r}")


def _offset_of(split: str, n: int, num_blocks: int, block: str):
    if split == BALANCED:
        return bm.block_offset(n, num_blocks, block)
    return bm.ceil_block_offset(n, num_blocks, block)


def assign_grid(ratings: DataFrame, num_x_ids: int, num_y_ids: int, num_blocks: int,
                split: str = BALANCED) -> DataFrame:
    """Add ``bx``, ``by`` (block of each id) and ``stratum`` (active sub-epoch)."""
    return (ratings
            .withColumn("bx", _block_of(split, num_x_ids, num_blocks, "x_id"))
            .withColumn("by", _block_of(split, num_y_ids, num_blocks, "y_id"))
            .withColumn("stratum", bm.stratum("bx", "by", num_blocks)))


def with_order(ratings: DataFrame, seed: int) -> DataFrame:
    """Add the in-cell visiting order ``ord`` (see ``order_key``)."""
    return ratings.withColumn("ord", order_key(seed, F.col("x_id"), F.col("y_id"),
                                               F.col("rating")))


def local_index(cells: DataFrame, num_x_ids: int, num_y_ids: int, num_blocks: int,
                split: str = BALANCED) -> DataFrame:
    """Position of each id inside its block: ``id - offset(block)`` (P5)."""
    return (cells
            .withColumn("x_local", F.col("x_id") - _offset_of(split, num_x_ids, num_blocks, "bx"))
            .withColumn("y_local", F.col("y_id") - _offset_of(split, num_y_ids, num_blocks, "by")))


def blockify(ratings: DataFrame, num_x_ids: int, num_y_ids: int, num_blocks: int,
             seed: int, split: str = BALANCED, persist: bool = False) -> DataFrame:
    """Lay the triples out on the grid, x-block ``i`` in partition ``i`` (A3).

    ``repartitionById(N, 'bx')`` gives one block per partition with no hash
    collisions between the N keys.  This is the in-session form of the layout
    (optionally persisted, memory spilling to disk); training writes its own
    step-partitioned, bucketed copy instead (``plans.train.write_grid``).
    """
    cells = with_order(assign_grid(ratings, num_x_ids, num_y_ids, num_blocks, split), seed)
    cells = cells.repartitionById(num_blocks, "bx")
    if persist:
        cells = cells.persist(StorageLevel.MEMORY_AND_DISK)
    return cells


def stratum_cells(cells: DataFrame, sub_epoch: int) -> DataFrame:
    """Cells active in sub-epoch ``s``: ``by = (bx + s) mod N``."""
    return cells.where(F.col("stratum") == F.lit(sub_epoch))


def cell_counts(cells: DataFrame) -> DataFrame:
    """Samples per non-empty cell (A7); partial counts are combined map-side."""
    return cells.groupBy("bx", "by").agg(F.count(F.lit(1)).alias("n"))


def grid_sanity(cells: DataFrame) -> DataFrame:
    """Workers (x-blocks used), non-empty cells and ratings.

    Computed from the per-cell counts (at most N*N rows), so the distinct
    counts never see the full table.
    """
    counts = cell_counts(cells)
    return counts.agg(F.countDistinct("bx").cast("bigint").alias("x_blocks"),
                      F.count(F.lit(1)).cast("bigint").alias("cells"),
                      F.sum("n").cast("bigint").alias("ratings"))


def block_table(spark: SparkSession, num_x_ids: int, num_y_ids: int, num_blocks: int,
                split: str = BALANCED) -> DataFrame:
    """``(axis, block, dim, offset)`` for both axes (S3 block ids, P1, P2)."""
    ids = spark.range(num_blocks).select(F.col("id").cast("int").alias("block"))

    def axis(name: str, n: int) -> DataFrame:
        if split == BALANCED:
            dim = bm.block_dim(n, num_blocks, "block")
        else:
            d = bm.ceil_block_dim(n, num_blocks)
            dim = F.greatest(F.least(F.lit(n) - F.col("block") * d, F.lit(d)), F.lit(0)).cast("int")
        return ids.select(F.lit(name).alias("axis"), "block", dim.alias("dim"),
                          _offset_of(split, n, num_blocks, "block").alias("offset"))

    return axis("x", num_x_ids).unionByName(axis("y", num_y_ids))


def block_ratings(cells: DataFrame, num_x_ids: int, num_y_ids: int, num_blocks: int, split: str = BALANCED) -> DataFrame:
    """``(axis, block, first_id, dim, n)``: the blocks of both axes with their id range and ratings (S3), empty ones too."""
    ends = F.explode(F.array(F.struct(F.lit("x").alias("axis"), F.col("bx").alias("block")),
                             F.struct(F.lit("y").alias("axis"), F.col("by").alias("block"))))
    counts = cell_counts(cells).select(ends.alias("e"), "n").groupBy("e.axis", "e.block").agg(F.sum("n").alias("n"))
    table = block_table(cells.sparkSession, num_x_ids, num_y_ids, num_blocks, split)
    return (table.join(counts, ["axis", "block"], "left")
                 .select("axis", "block", F.col("offset").alias("first_id"), "dim", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))


def replicate_h_blocks(spark: SparkSession, num_blocks: int) -> DataFrame:
    """Every H block tagged with every sub-epoch and the position it meets (P10).

    One-to-many projection on block ids only: ``(block, sub_epoch, pos)``.
    """
    blocks = spark.range(num_blocks).select(F.col("id").cast("int").alias("block"))
    return (blocks
            .select("block", F.explode(F.sequence(F.lit(0), F.lit(num_blocks - 1))).alias("sub_epoch"))
            .withColumn("pos", F.expr(f"pmod(block - sub_epoch, {num_blocks})").cast("int")))
