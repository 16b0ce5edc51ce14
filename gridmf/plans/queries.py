"""Registered queries: one per operator of the inventory, on the driver's tables.

Every query reads the whole ``lineitem ⋈ orders`` rating view (or data Spark
derives from it) so its work grows with the tables.  Fixed parameters of the
catalogue: ``N`` blocks, rank ``K``, ``SEED``; doubles are rounded to fixed
digits so results compare across engines.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gridmf.functions import blockmath as bm
from gridmf.functions.vectors import dot
from gridmf.operators import blocks
from gridmf.operators.domain import domain_sizes, id_domain
from gridmf.operators.factors import embeddings_as_factors, factors_long, init_factors, side
from gridmf.operators.relabel import permute_ids, relabel
from gridmf.operators.score import (DEFAULT_BROADCAST_LIMIT, _maybe_broadcast, attach_factors,
                                    error_summary, evaluate_grid, evaluate_lines, predict, predict_grid)
from gridmf.plans import train
from gridmf.session import scratch_path
from gridmf.sources import celltext, factortext, files
from gridmf.sources.ratings import ratings_view, read_ratings_csv, table, write_ratings_csv

N = 4
K = 8
SEED = 7
EPOCHS = 2
STEP = train.STEP_SIZE
DECAY = train.STEP_DECAY
HOLE_BLOCK = 1
LINE_BLOCKS, LINE_ROWS = 7, 1000
DIGITS = 6


def _rv(spark, sf):
    return ratings_view(spark, sf)


def _ctx(spark, sf):
    r = _rv(spark, sf)
    nx, ny = domain_sizes(r)
    return r, nx, ny


def _init(spark, nx, ny, signed=False, split=blocks.BALANCED):
    return init_factors(spark, nx, ny, K, N, SEED, split=split, signed=signed)


def _r6(c):
    return F.round(c, DIGITS)


# --- sources / sinks -------------------------------------------------------

def q_ratings_view(spark, sf):
    return _rv(spark, sf)


def q_ratings_scan(spark, sf):
    path = scratch_path(spark, "ratings-csv")
    write_ratings_csv(_rv(spark, sf), path)
    return read_ratings_csv(spark, path)


def q_ratings_scan_extra_fields(spark, sf):
    """CSV with a fourth field (as in 4-column rating files): extra fields are ignored."""
    path = scratch_path(spark, "ratings-csv4")
    r = _rv(spark, sf)
    (r.select("x_id", "y_id", "rating", (F.col("rating") * 2).alias("extra"))
      .write.option("header", "false").csv(path))
    return read_ratings_csv(spark, path)


def q_cells_write_read(spark, sf):
    r, nx, ny = _ctx(spark, sf)
    path = scratch_path(spark, "cells")
    files.write_cells(blocks.assign_grid(r, nx, ny, N), path)
    return files.read_cells(spark, path)


def q_cell_lines(spark, sf):
    r, nx, ny = _ctx(spark, sf)
    cells = blocks.with_order(blocks.assign_grid(r, nx, ny, N), SEED)
    return celltext.cell_lines(spark, cells, N)


def q_cell_lines_decode(spark, sf):
    return celltext.decode_cell_lines(q_cell_lines(spark, sf))


def q_cells_csv_write_read(spark, sf):
    """Cells through routed CSV files and their typed reader."""
    r, nx, ny = _ctx(spark, sf)
    path = scratch_path(spark, "cells-csv")
    files.write_cells(blocks.assign_grid(r, nx, ny, N), path, fmt="csv", rows_per_file=1 << 12)
    return files.read_cells(spark, path, fmt="csv")


def q_factor_lines(spark, sf):
    """Factor lines as text, with fixed decimals."""
    _, nx, ny = _ctx(spark, sf)
    return factortext.factor_lines(_init(spark, nx, ny), digits=DIGITS)


def q_factor_lines_ceil_decode(spark, sf):
    """Lossless lines of the ceiling split in ``LINE_BLOCKS`` blocks, through files and back."""
    _, nx, ny = _ctx(spark, sf)
    path = scratch_path(spark, "factor-lines")
    f = init_factors(spark, nx, ny, K, LINE_BLOCKS, SEED, split=blocks.CEIL)
    factortext.write_factor_lines(factortext.factor_lines(f, max_rows=LINE_ROWS), path)
    back = factortext.read_factor_lines(spark, path)
    return factors_long(factortext.decode_factor_lines(back, nx, ny, LINE_BLOCKS, LINE_ROWS, blocks.CEIL))


def q_factor_lines_decode(spark, sf):
    _, nx, ny = _ctx(spark, sf)
    lines = factortext.factor_lines(_init(spark, nx, ny))
    return factors_long(factortext.decode_factor_lines(lines, nx, ny, N))


def q_model_write_read(spark, sf):
    _, nx, ny = _ctx(spark, sf)
    path = scratch_path(spark, "model")
    files.write_model(_init(spark, nx, ny), path)
    return factors_long(files.read_model(spark, path))


# --- block arithmetic and layout ---------------------------------------------

def q_id_domain(spark, sf):
    return id_domain(_rv(spark, sf))


def q_block_ids(spark, sf):
    """The blocks of both axes: ids they begin with and hold, and their ratings."""
    r, nx, ny = _ctx(spark, sf)
    return blocks.block_ratings(blocks.assign_grid(r, nx, ny, N), nx, ny, N)


def q_block_dim(spark, sf):
    _, nx, ny = _ctx(spark, sf)
    return blocks.block_table(spark, nx, ny, N).select("axis", "block", "dim")


def q_block_offset(spark, sf):
    _, nx, ny = _ctx(spark, sf)
    return blocks.block_table(spark, nx, ny, N).select("axis", "block", "offset")


def q_block_id(spark, sf):
    r, nx, ny = _ctx(spark, sf)
    return blocks.assign_grid(r, nx, ny, N).select("x_id", "y_id", "bx", "by")


def q_ceil_block_id(spark, sf):
    r, nx, ny = _ctx(spark, sf)
    return blocks.assign_grid(r, nx, ny, N, blocks.CEIL).select("x_id", "y_id", "bx", "by")


def q_local_index(spark, sf):
    r, nx, ny = _ctx(spark, sf)
    g = blocks.assign_grid(r, nx, ny, N)
    return blocks.local_index(g, nx, ny, N).select("x_id", "y_id", "x_local", "y_local")


def q_grid_assign(spark, sf):
    r, nx, ny = _ctx(spark, sf)
    return blocks.assign_grid(r, nx, ny, N).select("x_id", "y_id", "rating", "bx", "by", "stratum")


def q_blockify(spark, sf):
    r, nx, ny = _ctx(spark, sf)
    return blocks.blockify(r, nx, ny, N, SEED).select(
        "x_id", "y_id", "rating", "bx", "by", "stratum", "ord")


def q_stratum_cells(spark, sf):
    r, nx, ny = _ctx(spark, sf)
    g = blocks.assign_grid(r, nx, ny, N)
    return g.groupBy("stratum", "bx", "by").agg(F.count(F.lit(1)).alias("n"))


def q_cell_counts(spark, sf):
    r, nx, ny = _ctx(spark, sf)
    return blocks.cell_counts(blocks.assign_grid(r, nx, ny, N))


def q_grid_sanity(spark, sf):
    r, nx, ny = _ctx(spark, sf)
    return blocks.grid_sanity(blocks.assign_grid(r, nx, ny, N))


def _h_ids(spark, ny):
    return spark.range(ny).select(F.col("id").cast("int").alias("id"),
                                  bm.block_id(ny, N, "id").alias("block"))


def q_rotate_h(spark, sf):
    _, _, ny = _ctx(spark, sf)
    h = _h_ids(spark, ny).withColumn("sub_epoch", F.explode(F.sequence(F.lit(0), F.lit(N - 1))))
    return (h.withColumn("pos", bm.rotated_position("block", "sub_epoch", N))
             .withColumn("next_pos", bm.rotated_position("block", "(sub_epoch + 1)", N)))


def q_realign_h(spark, sf):
    r, nx, ny = _ctx(spark, sf)
    g = blocks.cell_counts(blocks.assign_grid(r, nx, ny, N))
    return (g.withColumn("sub_epoch", bm.stratum("bx", "by", N))
             .withColumn("pos", bm.rotated_position("by", "sub_epoch", N))
             .select("bx", "by", "sub_epoch", "pos"))


def q_replicate_h(spark, sf):
    _, _, ny = _ctx(spark, sf)
    rep = blocks.replicate_h_blocks(spark, N)       # N*N rows
    if N * N * 16 <= DEFAULT_BROADCAST_LIMIT:
        rep = F.broadcast(rep)
    return _h_ids(spark, ny).join(rep, "block").select("id", "block", "sub_epoch", "pos")


# --- scoring ----------------------------------------------------------------

def _scored(spark, sf):
    r, nx, ny = _ctx(spark, sf)
    return predict(r, _init(spark, nx, ny), num_x_ids=nx, num_y_ids=ny, rank=K)


def q_predict(spark, sf):
    return _scored(spark, sf).select("x_id", "y_id", "rating", _r6(F.col("prediction")).alias("prediction"))


def q_predict_grid(spark, sf):
    """Per-triple predictions by the grid form (no vectors on rating rows)."""
    r, nx, ny = _ctx(spark, sf)
    out = predict_grid(r, _init(spark, nx, ny), nx, ny, N)
    return out.select("x_id", "y_id", "rating", _r6(F.col("prediction")).alias("prediction"))


def q_residuals(spark, sf):
    return _scored(spark, sf).select("x_id", "y_id", "rating", _r6(F.col("residual")).alias("residual"),
                                     _r6(F.col("sq_error")).alias("sq_error"))


def _summary(spark, sf):
    return error_summary(_scored(spark, sf))


def q_sse(spark, sf):
    return _summary(spark, sf).select(F.round("sse", 4).alias("sse"), "n")


def q_rmse(spark, sf):
    return _summary(spark, sf).select(F.round("rmse", 9).alias("rmse"))


def q_evaluate(spark, sf):
    """Blocked evaluation on the grid (the form training uses each epoch)."""
    r, nx, ny = _ctx(spark, sf)
    cells = blocks.assign_grid(r, nx, ny, N)
    return evaluate_grid(cells, _init(spark, nx, ny), N).select(
        F.round("sse", 4).alias("sse"), "n", F.round("rmse", 9).alias("rmse"))


def q_ratings_join_w(spark, sf):
    r, nx, ny = _ctx(spark, sf)
    w = side(_init(spark, nx, ny), "W").withColumnRenamed("id", "x_id").withColumnRenamed("vec", "w")
    j = r.join(_maybe_broadcast(w, nx, K, DEFAULT_BROADCAST_LIMIT), "x_id")
    return j.select("x_id", "y_id", "rating",
                    _r6(F.aggregate("w", F.lit(0.0), lambda a, v: a + v)).alias("w_sum"),
                    _r6(dot(F.col("w"), F.col("w"))).alias("w_sq"))


def q_cell_factor_join(spark, sf):
    """Cell lines joined with W and H lines by block, error per cell."""
    r, nx, ny = _ctx(spark, sf)
    cells = blocks.with_order(blocks.assign_grid(r, nx, ny, N), SEED)
    out = evaluate_lines(celltext.cell_lines(spark, cells, N), factortext.factor_lines(_init(spark, nx, ny)), nx, ny, N)
    return out.select("bx", "by", F.round("sse", 4).alias("sse"), "n")


def q_embedding_predict(spark, sf):
    """Embeddings as both factor matrices: 64-wide dot products; NULL where an id has no embedding."""
    f = embeddings_as_factors(table(spark, sf, "embeddings"), 1, 1)
    out = predict(_rv(spark, sf), f, missing="null")
    return out.select("x_id", "y_id", "rating", _r6(F.col("prediction")).alias("prediction"))


def q_sgd_matching_step(spark, sf):
    """One SGD step on a matching (each x and y once), as column expressions."""
    r, nx, ny = _ctx(spark, sf)
    ro = blocks.with_order(r, SEED)
    per_x = ro.groupBy("x_id").agg(F.min(F.struct("ord", "y_id", "rating")).alias("m")) \
        .select("x_id", "m.ord", "m.y_id", "m.rating")
    match = per_x.groupBy("y_id").agg(F.min(F.struct("ord", "x_id", "rating")).alias("m")) \
        .select("m.x_id", "y_id", "m.rating")
    f = _init(spark, nx, ny)
    j = attach_factors(match, f, num_x_ids=nx, num_y_ids=ny, rank=K)
    # g once per triple, then one row per k: the step is plain column arithmetic
    # (an expression used inside a per-element lambda would be re-evaluated per
    # element once Catalyst inlines it).
    g = F.lit(2.0 * STEP) * (F.col("rating") - dot(F.col("w"), F.col("h")))
    per_k = (j.withColumn("g", g)
              .select("x_id", "y_id", "g", F.posexplode(F.arrays_zip("w", "h")).alias("k", "wh")))
    w2 = F.col("wh.w") + F.col("g") * F.col("wh.h")
    h2 = F.col("wh.h") + F.col("g") * w2
    k = F.col("k").cast("int").alias("k")
    both = F.array(  # W and H rows from one pass over the join
        F.struct(F.lit("W").alias("matrix"), F.col("x_id").alias("id"), k, F.round(w2, DIGITS).alias("value")),
        F.struct(F.lit("H").alias("matrix"), F.col("y_id").alias("id"), k, F.round(h2, DIGITS).alias("value")))
    return per_k.select(F.explode(both).alias("r")).select("r.*")


def q_init_factors(spark, sf):
    _, nx, ny = _ctx(spark, sf)
    return factors_long(_init(spark, nx, ny))


def q_init_factors_signed(spark, sf):
    _, nx, ny = _ctx(spark, sf)
    return factors_long(_init(spark, nx, ny, signed=True))


# --- relabeling -------------------------------------------------------------

def q_permute_ids(spark, sf):
    _, nx, ny = _ctx(spark, sf)
    return permute_ids(spark, nx, "x", SEED).unionByName(permute_ids(spark, ny, "y", SEED))


def q_relabel_ids(spark, sf):
    r, nx, ny = _ctx(spark, sf)
    return relabel(r, permute_ids(spark, nx, "x", SEED), permute_ids(spark, ny, "y", SEED), nx, ny)


def q_relabeled_cell_counts(spark, sf):
    """Samples per cell after random relabeling (the skew measure against cell_counts)."""
    _, nx, ny = _ctx(spark, sf)
    return blocks.cell_counts(blocks.assign_grid(q_relabel_ids(spark, sf), nx, ny, N))


def q_relabeled_csv(spark, sf):
    """Relabeled ratings through the CSV sink and the typed scan (S9 + S1)."""
    path = scratch_path(spark, "relabeled-csv")
    write_ratings_csv(q_relabel_ids(spark, sf), path)
    return read_ratings_csv(spark, path)


# --- training ---------------------------------------------------------------

def q_step_schedule(spark, sf):
    """Step size of each epoch and the updates made at it (every triple once)."""
    n = _rv(spark, sf).agg(F.count(F.lit(1)).alias("updates"))
    sizes = train.step_schedule(_rv(spark, sf), EPOCHS, STEP, DECAY)
    per_epoch = n.select(F.explode(F.sequence(F.lit(0), F.lit(EPOCHS - 1))).alias("iteration"), "updates")
    return sizes.join(per_epoch, "iteration").select("iteration", F.round("step_size", 12).alias("step_size"), "updates")


def _fit(spark, sf, **kw):
    return train.fit(_rv(spark, sf), rank=K, num_blocks=N, epochs=kw.pop("epochs", EPOCHS),
                     step=STEP, decay=DECAY, seed=SEED, **kw)


def q_dsgd_subepoch(spark, sf):
    return factors_long(_fit(spark, sf, epochs=1, sub_epochs=1).factors)


def q_dsgd_train(spark, sf):
    return factors_long(_fit(spark, sf).factors)


def q_training_log(spark, sf):
    log = _fit(spark, sf).log
    return log.select("iteration", F.round("step_size", 12).alias("step_size"), F.round("sse", 4).alias("sse"), "n",
                      F.round("rmse", 9).alias("rmse"))


def q_sweep_train(spark, sf):
    return factors_long(_fit(spark, sf, schedule=train.SWEEP).factors)


def q_empty_cell_passthrough(spark, sf):
    """Ratings without x-block 1, after sub-epoch 0: the blocks that meet the empty cell (W 1, H 1) are
    as they were, all others trained."""
    r, nx, ny = _ctx(spark, sf)
    hole = r.where(bm.block_id(nx, N, "x_id") != HOLE_BLOCK)
    res = train.fit(hole, rank=K, num_blocks=N, epochs=1, step=STEP, decay=DECAY, seed=SEED,
                    sub_epochs=1, init=_init(spark, nx, ny))
    return factors_long(res.factors)


QUERIES = {
    "ratings_view": q_ratings_view,
    "ratings_scan": q_ratings_scan,
    "ratings_scan_extra_fields": q_ratings_scan_extra_fields,
    "id_domain": q_id_domain,
    "block_ids": q_block_ids,
    "block_dim": q_block_dim,
    "block_offset": q_block_offset,
    "block_id": q_block_id,
    "ceil_block_id": q_ceil_block_id,
    "local_index": q_local_index,
    "grid_assign": q_grid_assign,
    "blockify": q_blockify,
    "stratum_cells": q_stratum_cells,
    "cell_counts": q_cell_counts,
    "grid_sanity": q_grid_sanity,
    "rotate_h": q_rotate_h,
    "realign_h": q_realign_h,
    "replicate_h": q_replicate_h,
    "init_factors": q_init_factors,
    "init_factors_signed": q_init_factors_signed,
    "predict": q_predict,
    "predict_grid": q_predict_grid,
    "residuals": q_residuals,
    "sse": q_sse,
    "rmse": q_rmse,
    "evaluate": q_evaluate,
    "ratings_join_w": q_ratings_join_w,
    "cell_factor_join": q_cell_factor_join,
    "embedding_predict": q_embedding_predict,
    "sgd_matching_step": q_sgd_matching_step,
    "empty_cell_passthrough": q_empty_cell_passthrough,
    "permute_ids": q_permute_ids,
    "relabel_ids": q_relabel_ids,
    "relabeled_csv": q_relabeled_csv,
    "relabeled_cell_counts": q_relabeled_cell_counts,
    "cells_write_read": q_cells_write_read,
    "cells_csv_write_read": q_cells_csv_write_read,
    "cell_lines": q_cell_lines,
    "cell_lines_decode": q_cell_lines_decode,
    "factor_lines": q_factor_lines,
    "factor_lines_decode": q_factor_lines_decode,
    "factor_lines_ceil_decode": q_factor_lines_ceil_decode,
    "model_write_read": q_model_write_read,
    "step_schedule": q_step_schedule,
    "dsgd_subepoch": q_dsgd_subepoch,
    "dsgd_train": q_dsgd_train,
    "training_log": q_training_log,
    "sweep_train": q_sweep_train,
}
