"""Training: steps, schedules, step decay, epoch evaluation, restart.

The ratings are laid out once: grid columns and conflict levels added, then written to
the shared checkpoint folder partitioned by the step that uses them and bucketed by x-block.
Per step the plan is::

    cells of the step (bucketed scan)  ∪  W rows  ∪  H rows keyed by position
        -> one group per x-block, sorted by (kind, level)
        -> groupBy(bkey).applyInArrow(iterator kernel)  streams the cell

``resident``: after every step the factors are written as a table of their own, partitioned by
matrix and bucketed by the same key, so W is read where its cells are and only the H rows
are exchanged, about ``8*K*n_y`` bytes a step.  Otherwise up to ``checkpoint_every`` steps run as one job, each kernel
feeding the next step's exchange of W and H; that saves a job and a write per step where factors are small.
Both give the same bits.

Schedules (global step ``t``; each step has one cell per x-block, so all N run in parallel)

* ``stratified`` (DSGD): step ``t`` of epoch ``t div N`` runs the cells ``by = (bx + t) mod N``; H block ``by``
  meets position ``pmod(by - t, N)``.
* ``sweep``: the row-major pass over all N*N cells of the out-of-core program, with ceiling-split blocks.
  Cell (i, j) needs (i, j-1) and (i-1, j), and of the epoch before only W_i after (i, N-1) and H_j after
  (N-1, j).  So cell (i, j) of epoch e runs in step ``e*N + i + j``: wave N + k of one epoch together with wave k of the
  next, the cells ``by = (t - bx) mod N``, N steps an epoch and N - 1 more at the end, with the row-major order's result.
  W and H block k are an epoch's last values after its wave N - 1 + k; for the log they are put aside then.

A cut writes the factors; with ``resume`` also a one-row manifest naming them, the grid and the log so far.
"""

from __future__ import annotations

import json
import os
import time
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException, UnsupportedOperationException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmf.operators import blocks
from gridmf.operators.domain import domain_stats
from gridmf.operators.factors import FACTOR_SCHEMA, init_factors
from gridmf.operators.kernel import (KERNEL_INPUT_COLUMNS, KIND_H, KIND_RATING, KIND_W, make_error_kernel, make_level_kernel,
                                     make_sgd_kernel)
from gridmf.session import ensure_checkpoint_dir, scratch_path

# Fixed values of the original programs (results depend on them): the initial
# step size is 0.001 and it is multiplied by 0.99 after every epoch.
STEP_SIZE = 0.001
STEP_DECAY = 0.99

STRATIFIED = "stratified"
SWEEP = "sweep"
LOG_SCHEMA = "iteration INT, step_size DOUBLE, sse DOUBLE, n BIGINT, rmse DOUBLE"
GRID_SCHEMA = "x_id INT, y_id INT, rating DOUBLE, bx INT, by INT, bkey INT, level BIGINT"
# The order in which a step reads a cell's rows; files are written in it, so a step's sort finds them in order.
VISIT = ["level", "x_id", "y_id", "rating"]
ROWS_PER_FILE = 1 << 23
# W is kept resident where moving it in every step would cost more than a job and a write do.
RESIDENT_BYTES = 1 << 30
NO_BYTE_LIMIT = 2**31 - 1


def min_num_blocks(num_x_ids: int, num_y_ids: int, rank: int, task_memory_bytes: int,
                   copies: float = 3.0) -> int:
    """Smallest N for which one W block plus one H block fits a task's memory.

    A task holds ``8*K*(n_x + n_y) / N`` bytes of factors, ``copies`` times over
    while Arrow buffers and numpy matrices coexist; ratings stream and do not
    count.  Advice only: N fixes the visiting order, so ``fit`` never picks it.
    """
    need = copies * 8.0 * rank * (num_x_ids + num_y_ids)
    return max(1, int(-(-need // max(int(task_memory_bytes), 1))))


def step_size(step: float, decay: float, epoch: int) -> float:
    """Step of an epoch: ``step * decay**epoch``; epoch 0 runs at ``step`` (T4)."""
    return float(step) * float(decay) ** int(epoch)


def step_schedule(ratings: DataFrame, epochs: int, step: float = STEP_SIZE,
                  decay: float = STEP_DECAY) -> DataFrame:
    """``(iteration, step_size)`` for ``epochs`` epochs, as a column expression."""
    spark = ratings.sparkSession
    return (spark.range(epochs)
            .select(F.col("id").cast("int").alias("iteration"))
            .withColumn("step_size", F.lit(float(step)) * F.pow(F.lit(float(decay)), F.col("iteration"))))


def materialize(df: DataFrame, name: str, with_path: bool = False):
    """Write to the shared checkpoint folder and read back (reliable lineage cut).

    The schema is passed to the reader, so reading back starts no job.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    return (back, path) if with_path else back


def drop_table(spark, path: str) -> None:
    """Delete a superseded intermediate table from the checkpoint folder.

    Uses the Hadoop FileSystem of the folder (PySpark has no public file API);
    where that gateway is unavailable the table is simply left in place.
    """
    try:
        jvm = spark.sparkContext._jvm
        hpath = jvm.org.apache.hadoop.fs.Path(path)
        hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)
    except Exception:  # noqa: BLE001 - cleanup must never fail a training run
        pass


_BUCKET_KEYS: dict = {}


def bucket_keys(spark, num_blocks: int) -> list[int]:
    """Per x-block ``b`` an INT key whose hash bucket among ``N`` is ``b``.

    Bucketing (and ``repartition(N, col)``) place a row by ``pmod(hash(col), N)``;
    a key column built from these values puts x-block ``b`` into bucket ``b``,
    one cell per task.  Found with Spark's own ``hash`` over a small range (N
    rows reach the driver; remembered per session and N - the mapping depends
    on the hash function only).  Grouping is by the key itself, so the keys
    only affect balance, never results.
    """
    n = int(num_blocks)
    cache_key = (id(spark), n)
    if cache_key in _BUCKET_KEYS:
        return _BUCKET_KEYS[cache_key]
    m = 16 * n
    while True:
        found = (spark.range(m).select(F.col("id").cast("int").alias("c"))
                 .groupBy(F.expr(f"pmod(hash(c), {n})").alias("b")).agg(F.min("c").alias("c"))
                 .collect())
        if len(found) == n:
            keys = [int(r["c"]) for r in sorted(found, key=lambda r: r["b"])]
            _BUCKET_KEYS[cache_key] = keys
            return keys
        m *= 4


def _key_of(keys: list[int], block_col) -> Column:
    return F.element_at(F.array(*[F.lit(k) for k in keys]), block_col + 1)


@dataclass
class Grid:
    """The written grid: a bucketed, step-partitioned table in the checkpoint folder."""
    cells: DataFrame
    path: str
    table: str
    keys: list


def stored_step(schedule: str, num_blocks: int) -> Column:
    """The step directory of a cell: its stratum, or its wave modulo N."""
    sign = "-" if schedule == STRATIFIED else "+"
    return F.expr(f"pmod(by {sign} bx, {int(num_blocks)})").cast("int")


def write_grid(ratings: DataFrame, num_x_ids: int, num_y_ids: int, num_blocks: int, seed: int,
               schedule: str, rows_per_file: int = ROWS_PER_FILE) -> Grid:
    """Grid layout written once: partitioned by ``step`` and bucketed by x-block into ``N`` buckets.

    One shuffle routes every cell to a task of its own, which sorts it in visiting order and finds its conflict
    levels, streaming (``make_level_kernel``), and writes them with the rows, by level, in files of at most ``rows_per_file``.  A
    cell is in sequence here as in training and sorted here, once for all epochs.  Reading one step then yields its
    cells already placed one per task (a bucketed scan), so a training step exchanges only factor rows.  The
    table is registered (external, under a unique name) in the session catalog and dropped after training; where
    the catalog refuses it, plain files are written and steps exchange both sides instead.
    """
    spark = ratings.sparkSession
    n = int(num_blocks)
    split = blocks.BALANCED if schedule == STRATIFIED else blocks.CEIL
    keys = bucket_keys(spark, n)
    cells = blocks.with_order(blocks.assign_grid(ratings, num_x_ids, num_y_ids, n, split), seed)
    cells = blocks.local_index(cells, num_x_ids, num_y_ids, n, split)
    kept = ["x_id", "y_id", "rating", "bx", "by", "bkey", "step"]
    cells = (cells.withColumn("step", stored_step(schedule, n)).withColumn("bkey", _key_of(keys, F.col("bx")))
                  .withColumn("slot", (F.col("step") * n + F.col("bx")).cast("int"))
                  .select("slot", "ord", "x_local", "y_local", F.col("x_id").cast("int").alias("x_id"),
                          F.col("y_id").cast("int").alias("y_id"), F.col("rating").cast("double").alias("rating"),
                          *kept[3:])
                  .repartitionById(n * n, "slot").sortWithinPartitions("slot", "ord", "x_id", "y_id", "rating")
                  .groupBy("slot").applyInArrow(make_level_kernel(kept), GRID_SCHEMA.replace("level", "step INT, level")))
    path = scratch_path(spark, "grid")
    if catalog_takes_buckets(spark):
        table = _table_name(path)
        (cells.write.format("parquet").option("path", path).option("maxRecordsPerFile", int(rows_per_file))
              .partitionBy("step").bucketBy(n, "bkey").sortBy(*VISIT).saveAsTable(table))
        return Grid(spark.table(table), path, table, keys)
    (cells.sortWithinPartitions("step", "bkey", *VISIT)
          .write.option("maxRecordsPerFile", int(rows_per_file)).partitionBy("step").parquet(path))
    plain = spark.read.schema(cells.schema).option("basePath", path).parquet(path)
    return Grid(plain, path, None, None)


def open_grid(spark, path: str, num_blocks: int, bucketed: bool) -> Grid:
    """A grid written before, perhaps by another session."""
    columns = GRID_SCHEMA + ", step INT"
    if not bucketed:
        return Grid(spark.read.schema(columns).option("basePath", path).parquet(path), path, None, None)
    table = _table_name(path)
    if not spark.catalog.tableExists(table):
        spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet PARTITIONED BY (step) "
                  f"CLUSTERED BY (bkey) INTO {int(num_blocks)} BUCKETS LOCATION '{path}'")
        spark.catalog.recoverPartitions(table)
    return Grid(spark.table(table), path, table, bucket_keys(spark, num_blocks))


def _table_name(path: str) -> str:
    return "gridmf_" + os.path.basename(path).replace("-", "_")


def catalog_takes_buckets(spark) -> bool:
    """Whether the session catalog accepts an external bucketed table: an empty one is made and dropped.

    Only the catalog's refusal counts; every other failure, and any failure of the
    grid write itself, is raised.
    """
    path = scratch_path(spark, "grid-probe")
    table = "gridmf_probe_" + os.path.basename(path).replace("-", "_")
    try:
        spark.sql(f"CREATE TABLE {table} (bkey INT) USING parquet CLUSTERED BY (bkey) INTO 2 BUCKETS "
                  f"LOCATION '{path}'")
    except (AnalysisException, UnsupportedOperationException):
        return False
    spark.sql(f"DROP TABLE {table}")
    drop_table(spark, path)
    return True


def drop_grid(spark, grid: Grid) -> None:
    if grid.table:
        spark.sql(f"DROP TABLE IF EXISTS {grid.table}")
    drop_table(spark, grid.path)


def _rating_rows(cells: DataFrame, block: Column | None = None) -> DataFrame:
    extra = ["bkey"] if "bkey" in cells.columns else []
    return cells.select(
        F.col("pos").cast("int"), F.lit(KIND_RATING).alias("kind"),
        F.col("x_id").alias("id"), "y_id", "rating",
        F.col("level" if "level" in cells.columns else "ord").cast("bigint").alias("ord"),
        (F.lit(None) if block is None else block).cast("int").alias("block"),
        # An empty array, not NULL: NULL arrays make the JVM->Arrow transfer
        # of rating rows several times slower.
        F.array().cast("array<double>").alias("vec"), *extra)


def _factor_rows(factors: DataFrame, pos) -> DataFrame:
    is_w = F.col("matrix") == F.lit("W")
    extra = ["bkey"] if "bkey" in factors.columns else []
    return factors.select(
        pos.cast("int").alias("pos"),
        F.when(is_w, F.lit(KIND_W)).otherwise(F.lit(KIND_H)).alias("kind"),
        "id", F.lit(None).cast("int").alias("y_id"), F.lit(None).cast("double").alias("rating"),
        F.lit(None).cast("bigint").alias("ord"), "block", "vec", *extra)


@dataclass
class Resident:
    """Factors written as a table bucketed by the grid's key: W lies with its cells."""
    factors: DataFrame
    path: str
    table: str

    def side(self, matrix: str) -> DataFrame:
        rows = self.factors.where(F.col("matrix") == F.lit(matrix))
        return rows if matrix == "W" else rows.drop("bkey")


def write_resident(factors: DataFrame, num_blocks: int, keys: list, name: str) -> Resident:
    """Write ``factors`` partitioned by matrix and bucketed by block; no exchange."""
    spark = factors.sparkSession
    path = scratch_path(spark, name)
    table = _table_name(path)
    (factors.select("matrix", "id", "block", "vec", _key_of(keys, F.col("block")).alias("bkey"))
            .write.format("parquet").option("path", path).partitionBy("matrix").bucketBy(num_blocks, "bkey").saveAsTable(table))
    return Resident(spark.table(table), path, table)


def read_factors(spark, path: str) -> DataFrame:
    """A written factor table, resident or plain, by its path alone."""
    return spark.read.schema(FACTOR_SCHEMA).parquet(path).select("matrix", "id", "block", "vec")


def _drop_factors(spark, path: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {_table_name(path)}")
    drop_table(spark, path)


def _grouped(moved: DataFrame, still: list[DataFrame], num_blocks: int, keys: list | None, order: list[str]):
    """Rows by x-block, sorted: ``still`` lies where it is needed already if there are ``keys``, ``moved`` is exchanged."""
    if keys is None:
        union = moved.select(*KERNEL_INPUT_COLUMNS)
        for part in still:
            union = union.unionByName(part.select(*KERNEL_INPUT_COLUMNS))
        return union.repartitionById(num_blocks, "pos").sortWithinPartitions("pos", *order).groupBy("pos")
    union = moved.withColumn("bkey", _key_of(keys, F.col("pos"))).repartition(num_blocks, "bkey")
    for part in still:
        union = union.unionByName(part)
    return union.select(*KERNEL_INPUT_COLUMNS, "bkey").sortWithinPartitions("bkey", *order).groupBy("bkey")


def run_cells(factors: DataFrame | Resident, h_pos: Column, rating_rows: DataFrame, num_blocks: int,
              kernel, schema: str, keys: list | None = None) -> DataFrame:
    """One parallel step: every position ``p`` streams its cell through the kernel.

    ``h_pos`` is the position of an H row, from its ``block``; a W row's is its block.  With
    ``keys`` (ratings read from a written, bucketed grid) only factor rows are exchanged - of a ``Resident``
    only H's - hash-partitioned on the key the grid is bucketed by, and the union keeps that
    partitioning.  Without them, everything is exchanged with ``repartitionById(N, pos)``.
    """
    keys = keys if "bkey" in rating_rows.columns else None
    if isinstance(factors, Resident) and keys is not None:
        w = _factor_rows(factors.side("W"), F.col("block"))
        moved, still = _factor_rows(factors.side("H"), h_pos), [w, rating_rows]
    else:
        rows = factors.factors.drop("bkey") if isinstance(factors, Resident) else factors
        pos = F.when(F.col("matrix") == F.lit("W"), F.col("block")).otherwise(h_pos)
        moved, still = _factor_rows(rows, pos), [rating_rows]
    return _grouped(moved, still, num_blocks, keys, ["kind", "ord", "id", "y_id", "rating"]).applyInArrow(kernel, schema)


def _active(cells: DataFrame, step: int, derived) -> DataFrame:
    """Ratings of one step; a ``step`` column (written grid) prunes directories."""
    cond = F.col("step") == F.lit(step) if "step" in cells.columns else derived == F.lit(step)
    return cells.where(cond).withColumn("pos", F.col("bx"))


def dsgd_subepoch(cells: DataFrame, factors: DataFrame | Resident, sub_epoch: int, num_blocks: int,
                  eta: float, keys: list | None = None) -> DataFrame:
    """Stratified sub-epoch ``s`` (T2): all factor rows, the cells of stratum ``s``."""
    return stratum_step(cells, factors, sub_epoch, num_blocks, make_sgd_kernel(eta, "level" in cells.columns), FACTOR_SCHEMA, keys)


def stratum_step(cells: DataFrame, factors: DataFrame | Resident, sub_epoch: int, num_blocks: int,
                 kernel, schema: str, keys: list | None = None) -> DataFrame:
    """The cells of stratum ``s``, each with its W and H block, through ``kernel``."""
    active = _active(cells, sub_epoch, F.col("stratum") if "stratum" in cells.columns else None)
    return run_cells(factors, F.expr(f"pmod(block - {int(sub_epoch)}, {int(num_blocks)})"), _rating_rows(active),
                     num_blocks, kernel, schema, keys)


def sweep_step(cells: DataFrame, factors: DataFrame | Resident, t: int, num_blocks: int, etas: list[float],
               keys: list | None = None) -> DataFrame:
    """Step ``t`` of a sweep of ``len(etas)`` epochs (T6): wave ``t - e*N`` of every epoch ``e`` that has it.

    W block ``bx`` meets H block ``(t - bx) mod N``.  Up to position ``t mod N`` that is a wave of epoch ``t div N``, beyond
    it one of the epoch before, so the step size follows from the position; cells of epochs that do not exist rest.
    """
    n, s = int(num_blocks), int(t) % int(num_blocks)
    now, before = (etas[e] if 0 <= e < len(etas) else 0.0 for e in (t // n, t // n - 1))
    wave = F.col("bx") + F.col("by")
    active = _active(cells, s, F.pmod(wave, F.lit(n))).where((wave <= t) & (wave > t - n * len(etas)))
    kernel = make_sgd_kernel(lambda pos: now if pos <= s else before, "level" in cells.columns)
    return run_cells(factors, F.expr(f"pmod({int(t)} - block, {n})"), _rating_rows(active), n, kernel, FACTOR_SCHEMA, keys)


def num_steps(schedule: str, num_blocks: int, epochs: int) -> int:
    """N an epoch; a sweep's last waves take N - 1 more."""
    return num_blocks * epochs + (num_blocks - 1 if schedule == SWEEP and epochs else 0)


def epoch_ended(schedule: str, t: int, num_blocks: int) -> int | None:
    """The epoch whose last cell runs in step ``t``, if any."""
    if schedule == STRATIFIED:
        return t // num_blocks if (t + 1) % num_blocks == 0 else None
    epoch, rest = divmod(t + 2, num_blocks)
    return epoch - 2 if rest == 0 and epoch >= 2 else None


def evaluate_steps(cells: DataFrame, factors: DataFrame | Resident, num_blocks: int, keys: list | None = None) -> DataFrame:
    """``(sse, n, rmse)`` over all cells of a written grid: one job of N tasks.

    A task holds one W block and goes along its row of cells: the H blocks stream in one after another, each
    before the ratings of its cell, which are the bucketed scan of all steps, in the order they are stored in.  Only H is copied (to every task) and
    exchanged, and W once where it is not resident.
    """
    n = int(num_blocks)
    rows = factors.factors if isinstance(factors, Resident) else factors
    h = rows.where("matrix = 'H'").drop("bkey").withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    moved = _factor_rows(h, F.col("pos"))
    keys = keys if "bkey" in cells.columns else None
    resident = isinstance(factors, Resident) and keys is not None
    w = rows.where("matrix = 'W'")
    # before all H blocks
    w = _factor_rows(w if resident else w.drop("bkey"), F.col("block")).withColumn("block", F.lit(-1))
    ratings = _rating_rows(cells.withColumn("pos", F.col("bx")), F.col("by"))
    moved, still = (moved, [w, ratings]) if resident else (moved.unionByName(w), [ratings])
    errors = _grouped(moved, still, n, keys, ["block", "kind", "ord", "id", "y_id", "rating"]).applyInArrow(make_error_kernel(), "sse double, n long")
    return (errors.agg(F.coalesce(F.sum("sse"), F.lit(0.0)).alias("sse"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n"))
                  .withColumn("rmse", F.when(F.col("n") > 0, F.sqrt(F.col("sse") / F.col("n")))))


def save_cut(spark, folder: str, number: int, state: dict) -> None:
    """Write manifest ``number`` (one row) and drop the one before the last."""
    row = spark.createDataFrame([(number, json.dumps(state))], "number int, state string")
    row.coalesce(1).write.mode("overwrite").parquet(f"{folder}/cut-{number:08d}")
    if number > 1:
        drop_table(spark, f"{folder}/cut-{number - 2:08d}")


def last_cut(spark, folder: str) -> tuple[int, dict] | None:
    """The newest manifest of a folder, or None."""
    try:
        row = spark.read.schema("number int, state string").parquet(f"{folder}/cut-*").orderBy(F.desc("number")).first()
    except AnalysisException:
        return None
    return (row["number"], json.loads(row["state"])) if row else None


@dataclass
class FitResult:
    factors: DataFrame
    log: DataFrame
    num_x_ids: int
    num_y_ids: int
    seconds: list = field(default_factory=list)   # per epoch of the log, since the fit began


@contextmanager
def whole_batches(spark):
    """Arrow batches cut by rows alone in this block: Spark otherwise adds up a batch's bytes at every row, most of what a step costs.

    A batch's rows are a rating or a factor row each, so its bytes are bounded without that.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)  # None: not set in this session
    spark.conf.set(key, str(NO_BYTE_LIMIT))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def fit(ratings: DataFrame, rank: int, num_blocks: int, epochs: int, step: float = STEP_SIZE,
        decay: float = STEP_DECAY, seed: int = 7, schedule: str = STRATIFIED,
        init: DataFrame | None = None, signed_init: bool = False, evaluate_epochs: bool = True,
        sub_epochs: int | None = None, checkpoint_every: int = 8, verbose: bool = False,
        resident: bool | None = None, resume: str | None = None) -> FitResult:
    """Train ``ratings ≈ W·Hᵀ``.

    ``num_blocks`` fixes the visiting order and thus the result; it is always
    explicit, never derived from the cluster.  Size it so that one W block plus
    one H block, ``8*K*(n_x+n_y)/N`` bytes, fits a task's memory comfortably;
    ratings stream and do not count.  ``sub_epochs`` stops the first epoch after
    that many steps (to inspect a single sub-epoch).

    ``resident``: keep W with its cells, writing the factors after every step, so a step moves H only; by default where W has
    at least ``RESIDENT_BYTES``.  Otherwise ``checkpoint_every`` steps run as one Spark job before the factors
    are written (always at the end of an epoch): each kernel's output then feeds the next step's exchange
    directly.  Lineage and plan depth stay bounded; after a failure Spark replays at most that many steps' lost
    shuffle output.  The model does not depend on either, bit for bit.

    ``resume`` names a folder (shared, like ``spark.checkpoint.dir``) for manifests: every cut leaves one, and a fit that was
    killed or failed goes on from the last one when it is called again with the same arguments, to the same model.  A
    stratified fit may go on with more ``epochs``.  ``verbose`` prints one line per epoch as it finishes.
    """
    with whole_batches(ratings.sparkSession):
        return _fit(ratings, rank, num_blocks, epochs, step, decay, seed, schedule, init, signed_init, evaluate_epochs, sub_epochs,
                    checkpoint_every, verbose, resident, resume)


def _fit(ratings, rank, num_blocks, epochs, step, decay, seed, schedule, init, signed_init, evaluate_epochs, sub_epochs, checkpoint_every,
         verbose, resident, resume) -> FitResult:
    if checkpoint_every < 1:
        raise ValueError("checkpoint_every must be >= 1")
    if schedule not in (STRATIFIED, SWEEP):
        raise ValueError(f"unknown schedule {schedule!r}")
    if num_blocks < 1 or epochs < 0:
        raise ValueError("num_blocks must be >= 1 and epochs >= 0")
    spark = ratings.sparkSession
    ensure_checkpoint_dir(spark)
    n = int(num_blocks)
    nx, ny, n_ratings = domain_stats(ratings)
    run_epochs = epochs if sub_epochs is None else min(epochs, 1)
    total = num_steps(schedule, n, run_epochs) if sub_epochs is None else min(sub_epochs, num_steps(schedule, n, run_epochs))
    etas = [step_size(step, decay, e) for e in range(run_epochs)]
    logs_epochs = evaluate_epochs and sub_epochs is None
    params = {"rank": rank, "num_blocks": n, "step": step, "decay": decay, "seed": seed, "schedule": schedule,
              "signed_init": signed_init, "epochs": epochs if schedule == SWEEP else None, "sub_epochs": sub_epochs,
              "evaluate_epochs": evaluate_epochs, "num_x_ids": nx, "num_y_ids": ny, "num_ratings": n_ratings}
    found = last_cut(spark, resume) if resume else None
    number, saved = found if found else (-1, None)
    if saved and saved["params"] != params:
        raise ValueError("resume: the folder holds a fit with other parameters or other ratings")
    logs, seconds = ([tuple(r) for r in saved["log"]], saved["seconds"]) if saved else ([], [])
    snapshots = dict(saved["snapshots"]) if saved else {}
    started = time.time() - (saved["elapsed"] if saved else 0.0)
    grid, factors, current, old = None, None, saved["factors"] if saved else None, []
    done = saved["step"] if saved else 0

    def written(rows: DataFrame, name: str):
        """Cut the lineage: (factors, path), resident or plain."""
        if resident:
            out = write_resident(rows, n, grid.keys, name)
            return out, out.path
        return materialize(rows, name, with_path=True)

    def leave_manifest(at: int, keep_grid: bool = True):
        nonlocal number
        if resume:
            number += 1
            save_cut(spark, resume, number, {
                "params": params, "step": at, "factors": current, "grid": grid.path if keep_grid else None, "bucketed": bool(grid.table),
                "log": logs, "seconds": seconds, "snapshots": snapshots, "elapsed": time.time() - started})

    def log_epoch(epoch: int, model):
        row = evaluate_steps(grid.cells, model, n, grid.keys).first()
        logs.append((epoch, etas[epoch], row["sse"], row["n"], row["rmse"]))
        seconds.append(round(time.time() - started, 3))
        if verbose:
            names = [c.split()[0] for c in LOG_SCHEMA.split(", ")]
            print(*(f"{c}={v}" for c, v in zip(names, logs[-1])), f"seconds={seconds[-1]:.1f}", flush=True)

    failed = True
    try:
        if saved and saved["grid"]:
            grid = open_grid(spark, saved["grid"], n, saved["bucketed"])
        elif not saved or done < total:
            grid = write_grid(ratings, nx, ny, n, seed, schedule)
        if resident is None:
            resident = 8 * rank * nx >= RESIDENT_BYTES
        resident = bool(resident and grid is not None and grid.table)
        if saved:
            factors = read_factors(spark, current)
        else:
            if init is None:
                init = init_factors(spark, nx, ny, rank, n, seed, blocks.BALANCED if schedule == STRATIFIED else blocks.CEIL, signed_init)
            factors, current = written(init.select("matrix", "id", "block", "vec"), "factors-init")
            leave_manifest(0)
        cut_at = done
        for t in range(done, total):
            if schedule == STRATIFIED:
                factors = dsgd_subepoch(grid.cells, factors, t % n, n, etas[t // n], grid.keys)
            else:
                factors = sweep_step(grid.cells, factors, t, n, etas, grid.keys)
            ended = epoch_ended(schedule, t, n)
            # block k of both matrices is an epoch's last after its wave N - 1 + k; the last epoch's are the model itself
            of, k = divmod(t - (n - 1), n)
            aside = logs_epochs and schedule == SWEEP and 0 <= of < run_epochs - 1
            ends = schedule == STRATIFIED and ended is not None
            if not (resident or aside or ends or t + 1 - cut_at >= checkpoint_every or t + 1 == total):
                continue
            old.append(current)
            factors, current = written(factors, f"factors-{t}")
            cut_at = t + 1
            if aside:
                folder = snapshots.setdefault(str(of), scratch_path(spark, f"epoch-{of}"))
                whole = factors.factors if isinstance(factors, Resident) else factors
                whole.where(F.col("block") == F.lit(k)).select("matrix", "id", "block", "vec") \
                    .write.mode("overwrite").parquet(f"{folder}/part={k}")
            if logs_epochs and ended is not None:
                folder = snapshots.get(str(ended))
                log_epoch(ended, read_factors(spark, folder) if folder else factors)
                if folder:
                    drop_table(spark, snapshots.pop(str(ended)))
            leave_manifest(t + 1)
            # the table before this one goes when the next one is written
            while len(old) > 1:
                _drop_factors(spark, old.pop(0))
        if grid is not None and done < total:
            leave_manifest(total, keep_grid=False)
        failed = False
    finally:
        # intermediate tables go whether training finished or failed; what the last manifest names stays
        state = (last_cut(spark, resume) or (0, None))[1] if resume else None
        kept = {state["factors"], state["grid"], *state["snapshots"].values()} if state else set()
        for path in [*old, *([current, *snapshots.values()] if failed else [])]:
            if path and path not in kept:
                _drop_factors(spark, path)
        if grid is not None and grid.path not in kept:
            drop_grid(spark, grid)
    if current and resident:
        factors = read_factors(spark, current)
        spark.sql(f"DROP TABLE IF EXISTS {_table_name(current)}")   # external: the files stay
    log = spark.createDataFrame(logs, LOG_SCHEMA)
    return FitResult(factors=factors, log=log, num_x_ids=nx, num_y_ids=ny, seconds=seconds)
