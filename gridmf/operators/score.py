"""Scoring and evaluation.

Two forms, both one job over all triples:

* by join (``predict``, ``evaluate``): ``ratings ⋈ W on x_id ⋈ H on y_id``, a
  dot product per row, and a global aggregate with map-side partial sums, where
  both factor sides, bounded by ``rows * (8*K + overhead)``, are below
  ``broadcast_limit``.  Sizes that the caller does not give are read from the factor table (two
  rows reach the driver), so no call ships K-vectors with the ratings.
* on the grid (``predict_grid``, also ``predict`` past the bound; ``evaluate_grid``): triples already carrying their cell are
  grouped per cell, each group streaming narrow ``(x, y, rating)`` rows against
  its two factor blocks in numpy.  Factor rows are copied once per cell of their
  block (the reference's replication of H to every position, for both sides);
  ratings move once, without vectors.  Training logs use this form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmf.functions import blockmath as bm
from gridmf.functions.vectors import dot
from gridmf.operators.blocks import BALANCED, _offset_of
from gridmf.operators.factors import side

# Bytes per factor row beyond the K doubles (id, array header, row overhead).
ROW_OVERHEAD_BYTES = 48
DEFAULT_BROADCAST_LIMIT = 64 * 1024 * 1024
# A W block and an H block together, as a task of the grid form holds them.
GRID_TASK_BYTES = 192 * 1024 * 1024
# Ratings of a group of ``predict_grid``, and how many for each factor row that is sent with them.
GROUP_ROWS = 1 << 22
RATINGS_PER_FACTOR_ROW = 4


def factor_side_bytes(num_ids: int, rank: int) -> int:
    """Upper bound of one factor side's in-memory size."""
    return int(num_ids) * (8 * int(rank) + ROW_OVERHEAD_BYTES)


def _maybe_broadcast(df: DataFrame, num_ids: int | None, rank: int | None,
                     limit: int) -> DataFrame:
    if num_ids is None or rank is None:
        return df
    return F.broadcast(df) if factor_side_bytes(num_ids, rank) <= limit else df


def attach_factors(ratings: DataFrame, factors: DataFrame, *, num_x_ids: int | None = None,
                   num_y_ids: int | None = None, rank: int | None = None,
                   broadcast_limit: int = DEFAULT_BROADCAST_LIMIT) -> DataFrame:
    """Each triple with its W row ``w`` and H row ``h``."""
    w = _maybe_broadcast(side(factors, "W").withColumnRenamed("id", "x_id")
                         .withColumnRenamed("vec", "w"), num_x_ids, rank, broadcast_limit)
    h = _maybe_broadcast(side(factors, "H").withColumnRenamed("id", "y_id")
                         .withColumnRenamed("vec", "h"), num_y_ids, rank, broadcast_limit)
    return ratings.join(w, "x_id", "left").join(h, "y_id", "left")


def factor_sizes(factors: DataFrame) -> tuple[int, int, int]:
    """``(num_x_ids, num_y_ids, rank)`` of a factor table, from one aggregate."""
    rows = factors.groupBy("matrix").agg(F.max("id").alias("top"), F.max(F.size("vec")).alias("k")).collect()
    top = {r["matrix"]: int(r["top"]) + 1 for r in rows if r["top"] is not None}
    return top.get("W", 0), top.get("H", 0), max([int(r["k"] or 0) for r in rows], default=0)


NO_FACTOR = "rating refers to an id without a factor row"


def _check_missing(missing: str) -> None:
    if missing not in ("error", "null"):
        raise ValueError(f"missing must be 'error' or 'null', not {missing!r}")


def _or_missing(known, value, missing: str):
    """``value`` where ``known``; else NULL or a failing job."""
    _check_missing(missing)
    other = F.raise_error(F.lit(NO_FACTOR)).cast("double") if missing == "error" else F.lit(None).cast("double")
    return F.when(known, value).otherwise(other)


def predict(ratings: DataFrame, factors: DataFrame, *, num_x_ids: int | None = None,
            num_y_ids: int | None = None, rank: int | None = None,
            broadcast_limit: int = DEFAULT_BROADCAST_LIMIT,
            grid_blocks: int | None = None, missing: str = "error") -> DataFrame:
    """``prediction = w . h``, ``residual = rating - prediction``, ``sq_error``.

    By join with broadcast factor sides where both are under the size bound, else by ``predict_grid`` in
    ``grid_blocks`` blocks a side (by default as many as keep a pair of blocks under ``GRID_TASK_BYTES``),
    so rating rows never travel with K-vectors attached.  Sizes not given are read from ``factors``.

    Every triple is scored.  One that has no factor row for either id (NULL ids
    too) fails the job wherever its prediction is computed; with
    ``missing="null"`` it keeps its row with a NULL prediction.  Both forms
    follow the same rule.
    """
    if None in (num_x_ids, num_y_ids, rank):
        sizes = factor_sizes(factors)
        num_x_ids, num_y_ids, rank = (own if given is None else given
                                      for given, own in zip((num_x_ids, num_y_ids, rank), sizes))
    too_big = max(factor_side_bytes(num_x_ids, rank), factor_side_bytes(num_y_ids, rank)) > broadcast_limit
    if too_big:
        both = factor_side_bytes(num_x_ids, rank) + factor_side_bytes(num_y_ids, rank)
        grid_blocks = grid_blocks or max(1, -(-both // GRID_TASK_BYTES))
        base = predict_grid(ratings, factors, num_x_ids, num_y_ids, grid_blocks,
                            broadcast_limit=broadcast_limit, missing=missing)
    else:
        joined = attach_factors(ratings, factors, num_x_ids=num_x_ids, num_y_ids=num_y_ids,
                                rank=rank, broadcast_limit=broadcast_limit)
        known = F.col("w").isNotNull() & F.col("h").isNotNull()
        base = joined.select("x_id", "y_id", "rating",
                             _or_missing(known, dot(F.col("w"), F.col("h")), missing).alias("prediction"))
    return (base.withColumn("residual", F.col("rating") - F.col("prediction"))
                .withColumn("sq_error", F.col("residual") * F.col("residual")))


def error_summary(scored: DataFrame) -> DataFrame:
    """``(sse DOUBLE, n BIGINT, rmse DOUBLE)``; rmse NULL when n = 0.

    ``n`` counts the triples that have an error, so triples left unscored by
    ``missing="null"`` are in neither the sum nor the count.
    """
    return (scored.agg(F.coalesce(F.sum("sq_error"), F.lit(0.0)).alias("sse"),
                       F.count("sq_error").cast("bigint").alias("n"))
                  .withColumn("rmse", F.when(F.col("n") > 0,
                                             F.sqrt(F.col("sse") / F.col("n")))))


def evaluate(ratings: DataFrame, factors: DataFrame, **kw) -> DataFrame:
    """Squared error, count and RMSE of a model over any triples (T5), by join."""
    return error_summary(predict(ratings, factors, **kw))


def cell_groups(cells: DataFrame, num_blocks: int, rows_per_group: int = 1 << 24) -> tuple[DataFrame, int]:
    """Group ranges of the blocked evaluation: ``(bx, by, salts, base)`` per non-empty cell.

    A cell gets ``ceil(rows / rows_per_group)`` groups, numbered by (stratum, x-block): a running sum within
    each stratum on top of the strata before it, whose N totals are all that reaches the driver.
    Needs only ``bx``/``by`` (column pruning); at most N*N rows, written to the
    checkpoint folder so it is computed once and can be reused across epochs.
    """
    from pyspark.sql import Window

    n = int(num_blocks)
    info = (cells.groupBy("bx", "by").agg(F.count(F.lit(1)).alias("cnt"))
                 .withColumn("salts", F.greatest(F.lit(1), F.ceil(F.col("cnt") / F.lit(int(rows_per_group))))
                             .cast("int"))
                 .withColumn("s", F.expr(f"pmod(by - bx, {n})").cast("int"))
                 .withColumn("base", F.coalesce(F.sum("salts").over(
                     Window.partitionBy("s").orderBy("bx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
                 .select("bx", "by", "s", "salts", "base"))
    info = materialize_small(info)
    totals = {r["s"]: int(r["t"]) for r in info.groupBy("s").agg(F.sum("salts").alias("t")).collect()}
    before, starts = 0, []
    for s in range(n):
        starts.append(before)
        before += totals.get(s, 0)
    start = F.element_at(F.array(*[F.lit(x) for x in starts]), F.col("s") + 1)
    return info.select("bx", "by", "salts", (F.col("base") + start).cast("int").alias("base")), before


def _grouped_by_cell(cells: DataFrame, factors: DataFrame, n: int, info: DataFrame,
                     n_groups: int, broadcast_limit: int):
    """Ratings and replicated factor blocks keyed by cell group, one group per task."""
    from gridmf.operators.kernel import KERNEL_INPUT_COLUMNS, KIND_H, KIND_RATING, KIND_W

    if n * n * 32 <= broadcast_limit:
        info = F.broadcast(info)
    ratings = (cells.join(info, ["bx", "by"])
                    .select((F.col("base") + F.pmod(F.xxhash64("x_id", "y_id", "rating"), F.col("salts")))
                            .cast("int").alias("pos"),
                            F.lit(KIND_RATING).alias("kind"), F.col("x_id").alias("id"), "y_id", "rating",
                            F.lit(None).cast("bigint").alias("ord"), F.lit(None).cast("int").alias("block"),
                            F.array().cast("array<double>").alias("vec")))
    is_w = F.col("matrix") == F.lit("W")
    reps = factors.select("matrix", "id", "block", "vec",
                          F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("s"))
    reps = (reps.withColumn("bx", F.when(is_w, F.col("block")).otherwise(F.expr(f"pmod(block - s, {n})")))
                .withColumn("by", F.when(is_w, F.expr(f"pmod(block + s, {n})")).otherwise(F.col("block"))))
    fac = (reps.join(info, ["bx", "by"])
               .select(F.explode(F.sequence(F.col("base"), F.col("base") + F.col("salts") - 1)).alias("pos"),
                       F.when(is_w, F.lit(KIND_W)).otherwise(F.lit(KIND_H)).alias("kind"),
                       "id", F.lit(None).cast("int").alias("y_id"), F.lit(None).cast("double").alias("rating"),
                       F.lit(None).cast("bigint").alias("ord"), "block", "vec")
               .withColumn("pos", F.col("pos").cast("int")))
    return (fac.unionByName(ratings).select(*KERNEL_INPUT_COLUMNS)
               .repartitionById(n_groups, "pos")
               .sortWithinPartitions("pos", "kind", "id")
               .groupBy("pos"))


def group_rows(num_x_ids: int, num_y_ids: int, num_blocks: int) -> int:
    """Most ratings of a group: what a task reads is bounded, and copies of factor rows stay few beside the ratings."""
    return max(GROUP_ROWS, RATINGS_PER_FACTOR_ROW * -(-(num_x_ids + num_y_ids) // num_blocks))


def evaluate_grid(cells: DataFrame, factors: DataFrame, num_blocks: int,
                  rows_per_group: int = 1 << 24, groups: tuple[DataFrame, int] | None = None,
                  broadcast_limit: int = DEFAULT_BROADCAST_LIMIT) -> DataFrame:
    """Squared error, count and RMSE over triples already laid on the grid.

    One job, one group per (stratum, x-block) cell - or several for a large
    cell: evaluation does not depend on order, so a cell with more than
    ``rows_per_group`` triples is split by a hash of the triple into
    ``ceil(n / rows_per_group)`` groups (deterministic, so a retried task routes
    rows as before) and its two factor blocks are sent to each.  Every group streams its
    narrow ``(x, y, rating)`` rows against one W block and one H block in numpy;
    ratings move once and without vectors.  ``cells`` needs ``bx``/``by``
    consistent with the factors' ``block`` column; ``groups`` (from
    ``cell_groups``) may be passed to reuse the cell table across calls.
    """
    from gridmf.operators.kernel import make_error_kernel

    n = int(num_blocks)
    info, n_groups = groups if groups is not None else cell_groups(cells, n, rows_per_group)
    if n_groups == 0:
        return cells.sparkSession.createDataFrame([(0.0, 0, None)], "sse double, n bigint, rmse double")
    per_group = _grouped_by_cell(cells, factors, n, info, n_groups, broadcast_limit) \
        .applyInArrow(make_error_kernel(), "sse double, n long")
    return (per_group.agg(F.coalesce(F.sum("sse"), F.lit(0.0)).alias("sse"),
                          F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n"))
                     .withColumn("rmse", F.when(F.col("n") > 0, F.sqrt(F.col("sse") / F.col("n")))))


def predict_grid(ratings: DataFrame, factors: DataFrame, num_x_ids: int, num_y_ids: int,
                 num_blocks: int, rows_per_group: int | None = None,
                 broadcast_limit: int = DEFAULT_BROADCAST_LIMIT, missing: str = "error") -> DataFrame:
    """Per-triple ``prediction`` without shipping vectors with the ratings.

    The scale form of ``predict`` when factor sides are too big to broadcast:
    ratings and factor rows are both (re)blocked into ``num_blocks`` id ranges
    (any N: the factors' stored ``block`` is not used), each cell group streams
    its narrow rows against its two blocks in numpy and streams predictions
    out.  Choose N so that a W block plus an H block fits a task
    (``plans.train.min_num_blocks``); the factor rows are copied N times.  A cell of more than ``rows_per_group``
    triples (by default ``group_rows``) is dealt to several groups.
    Ids outside the domain (NULL too) have no cell and go by ``missing`` as in
    ``predict``, like ids inside it that lack a factor row.
    """
    from gridmf.operators.blocks import assign_grid
    from gridmf.operators.kernel import make_predict_kernel

    n = int(num_blocks)
    ratings = ratings.select("x_id", "y_id", "rating")
    inside = F.coalesce(F.col("x_id").between(0, int(num_x_ids) - 1)
                        & F.col("y_id").between(0, int(num_y_ids) - 1), F.lit(False))
    stray = ratings.where(~inside).select(
        F.col("x_id").cast("int").alias("x_id"), F.col("y_id").cast("int").alias("y_id"),
        F.col("rating").cast("double").alias("rating"),
        _or_missing(F.col("x_id").isNull() & F.col("x_id").isNotNull(), F.lit(None).cast("double"), missing)
        .alias("prediction"))
    cells = assign_grid(ratings.where(inside), num_x_ids, num_y_ids, n)
    w_block = bm.block_id(num_x_ids, n, "id")
    h_block = bm.block_id(num_y_ids, n, "id")
    reblocked = factors.select("matrix", "id", F.when(F.col("matrix") == F.lit("W"), w_block)
                               .otherwise(h_block).alias("block"), "vec")
    info, n_groups = cell_groups(cells, n, rows_per_group or group_rows(num_x_ids, num_y_ids, n))
    schema = "x_id int, y_id int, rating double, prediction double"
    if n_groups == 0:
        return stray
    return _grouped_by_cell(cells, reblocked, n, info, n_groups, broadcast_limit) \
        .applyInArrow(make_predict_kernel(missing), schema).unionByName(stray)


def evaluate_lines(cell_lines: DataFrame, factor_lines: DataFrame, num_x_ids: int, num_y_ids: int, num_blocks: int,
                   split: str = BALANCED) -> DataFrame:
    """``(bx, by, sse, n)`` of every cell that has ratings, from serialized blocks joined by line.

    Cell lines ``(bx, by, part, line)`` meet the W lines of block ``bx`` and the H lines of block ``by`` in one group
    per cell (the original's two nested cursors), where all three are decoded side by side; lines are copied
    once per cell of their block, ratings move once, as text.
    """
    from gridmf.operators.kernel import KIND_H, KIND_RATING, KIND_W, make_line_kernel

    n = int(num_blocks)
    all_blocks = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    w = factor_lines.where("matrix = 'W'").select(F.lit(KIND_W).alias("kind"), "part", F.col("block").alias("bx"), all_blocks.alias("by"), "line")
    h = factor_lines.where("matrix = 'H'").select(F.lit(KIND_H).alias("kind"), "part", all_blocks.alias("bx"), F.col("block").alias("by"), "line")
    rows = w.unionByName(h).unionByName(cell_lines.select(F.lit(KIND_RATING).alias("kind"), "part", "bx", "by", "line"))
    rows = rows.select((F.col("bx") * n + F.col("by")).cast("int").alias("pos"), "kind", F.col("part").cast("int").alias("part"),
                       F.col("bx").cast("int").alias("bx"), F.col("by").cast("int").alias("by"), "line")
    rows = (rows.withColumn("x0", _offset_of(split, num_x_ids, n, "bx")).withColumn("y0", _offset_of(split, num_y_ids, n, "by")))
    return (rows.repartitionById(n * n, "pos").sortWithinPartitions("pos", "kind", "part").groupBy("pos")
                .applyInArrow(make_line_kernel(), "bx int, by int, sse double, n long").where("n > 0"))


def materialize_small(df: DataFrame) -> DataFrame:
    """Cut the lineage of a small, bounded helper table (written to the checkpoint folder)."""
    from gridmf.session import scratch_path

    path = scratch_path(df.sparkSession, "cellinfo")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
