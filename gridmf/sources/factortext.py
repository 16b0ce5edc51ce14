"""Factor-line text format (S7, S8): ``v,v,;v,v,;`` - one factor row per ``;``.

A line holds the rows of one block in id order, at most ``max_rows`` of them
(``part = id div max_rows``), so a block of any size is written in bounded
pieces.  Values are written with Spark's lossless double-to-string cast and
read back exactly, or with ``digits`` fixed decimals, a text that every engine prints alike.  Row identity is positional: the ``k``-th row of the line
``(matrix, block, part)`` is id ``max(offset(block), part * max_rows) + k``;
the sink keeps ``matrix/block/part`` as Hive-style directories.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmf.operators.blocks import BALANCED, _offset_of

DEFAULT_MAX_ROWS = 100_000


def _fixed(v, digits: int):
    """``v`` with ``digits`` decimals, rounded half away from zero; from whole numbers, so without an engine's own printing."""
    units = F.round(F.abs(v) * F.lit(float(10**digits))).cast("bigint")
    sign = F.when((v < 0) & (units > 0), "-").otherwise("")
    return F.concat(sign, F.floor(units / F.lit(10**digits)).cast("string"), F.lit("."),
                    F.lpad(F.pmod(units, F.lit(10**digits)).cast("string"), digits, "0"))


def factor_lines(factors: DataFrame, max_rows: int = DEFAULT_MAX_ROWS, digits: int | None = None) -> DataFrame:
    """``(matrix, block, part, line)`` from ``(matrix, id, block, vec)``; lossless unless ``digits`` are given."""
    def text(v):
        return v.cast("string") if digits is None else _fixed(v, int(digits))

    row_text = F.concat(F.array_join(F.transform("vec", text), ","), F.lit(",;"))
    m = int(max_rows)
    return (factors.withColumn("part", (F.col("id") / m).cast("int"))
                   .groupBy("matrix", "block", "part")
                   .agg(F.array_sort(F.collect_list(F.struct("id", row_text.alias("text"))))
                        .alias("rows"))
                   .select("matrix", "block", "part",
                           F.array_join(F.transform("rows", lambda s: s["text"]), "").alias("line")))


def decode_factor_lines(lines: DataFrame, num_x_ids: int, num_y_ids: int, num_blocks: int,
                        max_rows: int = DEFAULT_MAX_ROWS, split: str = BALANCED) -> DataFrame:
    """Back to ``(matrix, id, block, vec)``; blanks between separators take no place.

    ``split`` says how the writer cut ids into blocks (``blocks.BALANCED`` or ``blocks.CEIL``, the
    sweep's).  Rows beyond the number of ids (padding of the last block) are skipped.
    """
    m = int(max_rows)
    is_w = F.col("matrix") == "W"
    offset = F.when(is_w, _offset_of(split, num_x_ids, num_blocks, "block")) \
        .otherwise(_offset_of(split, num_y_ids, num_blocks, "block"))
    start = F.greatest(offset, F.col("part") * m)
    filled = F.filter(F.split(F.col("line"), ";"), lambda r: r.rlike(r"\S"))
    rows = lines.select("matrix", "block", start.alias("start"), F.posexplode(filled).alias("k", "row"))
    vec = F.transform(F.filter(F.split(F.col("row"), ","), lambda e: e.rlike(r"\S")),
                      lambda e: e.cast("double"))
    return rows.select("matrix", (F.col("start") + F.col("k")).cast("int").alias("id"),
                       F.col("block").cast("int"), vec.alias("vec")) \
        .where(F.col("id") < F.when(is_w, F.lit(num_x_ids)).otherwise(F.lit(num_y_ids)))


def write_factor_lines(lines: DataFrame, path: str) -> None:
    lines.write.partitionBy("matrix", "block", "part").text(path)


def read_factor_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "line")
