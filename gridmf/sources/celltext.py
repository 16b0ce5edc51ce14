"""Cell-line text format (S5, S6): the grid as ``x,y,r;x,y,r;`` lines, row-major.

The out-of-core program writes one line per cell, empty cells as empty lines.
Here a line holds at most ``max_triples`` triples, so a cell spans
``ceil(count / max_triples)`` consecutive lines (with the default bound every
cell of a well-blocked table is one line, as in the original).  A single line
never has to hold an unbounded cell: a hot cell only adds lines.

Inside a cell triples follow the visiting order ``(ord, x, y, rating)``.  The
line of each triple comes from its rank in the cell, computed without putting
a cell into one task: identical triples are first counted (pre-aggregated),
the distinct triples are split into ``2**bits`` order-preserving buckets by the
leading bits of ``ord``, ranks are running sums inside a bucket plus a prefix
sum over the bucket totals of the cell (at most ``2**bits`` rows per cell).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DEFAULT_MAX_TRIPLES = 100_000
ORDER_BITS = 52
TRIPLES_PER_BUCKET = 1 << 16


def _triple_text(cnt_col) -> F.Column:
    one = F.concat(F.col("x_id").cast("string"), F.lit(","), F.col("y_id").cast("string"),
                   F.lit(","), F.col("rating").cast("string"), F.lit(";"))
    return F.repeat(one, cnt_col.cast("int"))


def cell_lines(spark: SparkSession, cells: DataFrame, num_blocks: int,
               max_triples: int = DEFAULT_MAX_TRIPLES) -> DataFrame:
    """``(bx, by, part, line)``: every cell of the N x N grid, empty ones included."""
    # Bucket bits from the largest cell's row count (an upper bound of its
    # distinct triples): a cheap partial aggregate over at most N*N cells.
    largest = cells.groupBy("bx", "by").count().agg(F.max("count")).first()[0] or 0
    runs = (cells.groupBy("bx", "by", "ord", "x_id", "y_id", "rating")
                 .agg(F.count(F.lit(1)).alias("dup")))
    bits = min(20, max(0, math.ceil(math.log2(max(largest, 1) / TRIPLES_PER_BUCKET))))
    runs = runs.withColumn("sub", F.shiftright(F.col("ord"), ORDER_BITS - bits) if bits else F.lit(0))
    in_bucket = Window.partitionBy("bx", "by", "sub").orderBy("ord", "x_id", "y_id", "rating") \
        .rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("start_in_sub", F.coalesce(F.sum("dup").over(in_bucket), F.lit(0)))
    per_cell = Window.partitionBy("bx", "by").orderBy("sub") \
        .rowsBetween(Window.unboundedPreceding, -1)
    sub_offsets = (runs.groupBy("bx", "by", "sub").agg(F.sum("dup").alias("tot"))
                       .withColumn("sub_start", F.coalesce(F.sum("tot").over(per_cell), F.lit(0)))
                       .drop("tot"))
    m = int(max_triples)
    placed = (runs.join(sub_offsets, ["bx", "by", "sub"])
                  .withColumn("start", F.col("sub_start") + F.col("start_in_sub"))
                  .withColumn("end", F.col("start") + F.col("dup"))
                  .withColumn("part", F.explode(F.sequence(
                      (F.col("start") / m).cast("bigint"), ((F.col("end") - 1) / m).cast("bigint"))))
                  .withColumn("cnt", F.least(F.col("end"), (F.col("part") + 1) * m)
                              - F.greatest(F.col("start"), F.col("part") * m)))
    lines = (placed.groupBy("bx", "by", "part")
                   .agg(F.array_sort(F.collect_list(F.struct(
                       "ord", "x_id", "y_id", "rating", _triple_text(F.col("cnt")).alias("text"))))
                       .alias("items"))
                   .select("bx", "by", F.col("part").cast("int").alias("part"),
                           F.array_join(F.transform("items", lambda s: s["text"]), "").alias("line")))
    grid = spark.range(num_blocks * num_blocks).select(
        (F.col("id") / num_blocks).cast("int").alias("bx"),
        F.pmod(F.col("id"), F.lit(num_blocks)).cast("int").alias("by"))
    return (grid.join(lines, ["bx", "by"], "left")
                .select("bx", "by", F.coalesce("part", F.lit(0)).alias("part"),
                        F.coalesce("line", F.lit("")).alias("line")))


def decode_cell_lines(lines: DataFrame, column: str = "line", keep: tuple[str, ...] = ()) -> DataFrame:
    """Triples of cell lines: strip, split on ``;``, drop blanks, split on ``,``; ``keep`` names columns of the line."""
    items = lines.select(*keep, F.explode(F.split(F.trim(F.col(column)), ";")).alias("item"))
    fields = F.split(F.col("item"), ",")
    return (items.where(F.col("item").rlike(r"\S"))
                 .select(*keep, fields.getItem(0).cast("int").alias("x_id"),
                         fields.getItem(1).cast("int").alias("y_id"),
                         fields.getItem(2).cast("double").alias("rating")))


def write_cell_lines(lines: DataFrame, path: str) -> None:
    """One text file set in row-major ``(bx, by, part)`` order; each line is ``bx,by,part``, a tab and the triples.

    The prefix keeps a cell's lines together however many ``max_triples`` makes of it.
    """
    lines.orderBy("bx", "by", "part").select(
        F.concat(F.concat_ws(",", "bx", "by", "part"), F.lit("\t"), "line")).write.text(path)


def read_cell_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(bx, by, part, x_id, y_id, rating)`` of written cell lines.

    Files without the prefix are read by ``decode_cell_lines(spark.read.text(path), "value")``.
    """
    halves = F.split(F.col("value"), "\t", 2)
    cell = F.split(halves.getItem(0), ",")
    lines = spark.read.text(path).select(
        *[cell.getItem(i).cast("int").alias(name) for i, name in enumerate(("bx", "by", "part"))],
        halves.getItem(1).alias("line"))
    return decode_cell_lines(lines, keep=("bx", "by", "part"))
