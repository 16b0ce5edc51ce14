"""Partitioned cell files (S4) in Parquet or CSV, and model tables (S10) in Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmf.operators.score import materialize_small

CELL_SCHEMA = "x_id INT, y_id INT, rating DOUBLE, bx INT, by INT"
BROADCAST_CELLS = 1 << 20
SALT_PARTITIONS = 4096


def write_cells(cells: DataFrame, path: str, fmt: str = "parquet", rows_per_file: int = 1 << 23) -> None:
    """One directory per cell, ``bx=i/by=j`` - the Spark form of ``data-i-j.csv``.

    Rows are routed by cell and a salt (a hash of the triple, so a retried task routes alike) before the write: a cell of
    n rows is written as at most ``ceil(n / rows_per_file)`` files, by as many tasks, however many tasks
    read the input.  Costs one more pass over ``bx, by`` for the cells' counts (a row per cell, broadcast
    while they are at most ``BROADCAST_CELLS``).
    """
    spark = cells.sparkSession
    rows = cells.select("x_id", "y_id", "rating", "bx", "by")
    sizes = rows.groupBy("bx", "by").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / F.lit(int(rows_per_file)))).alias("files"))
    sizes = materialize_small(sizes)
    total = sizes.agg(F.count(F.lit(1)).alias("cells"), F.coalesce(F.sum("files"), F.lit(1)).alias("files")).first()
    if total["cells"] <= BROADCAST_CELLS:
        sizes = F.broadcast(sizes)
    salted = rows.join(sizes, ["bx", "by"]).withColumn("salt", F.pmod(F.xxhash64("x_id", "y_id", "rating"), F.col("files")))
    tasks = max(1, min(int(total["files"]), SALT_PARTITIONS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1) * 8))
    (salted.repartition(tasks, "bx", "by", "salt").drop("files", "salt")
           .write.partitionBy("bx", "by").format(fmt).save(path))


def read_cells(spark: SparkSession, path: str, bx: int | None = None, by: int | None = None, fmt: str = "parquet") -> DataFrame:
    """Read cells back, typed; a ``bx``/``by`` filter prunes whole directories.  A malformed CSV line fails the job."""
    reader = spark.read.schema(CELL_SCHEMA)
    df = reader.option("mode", "FAILFAST").csv(path) if fmt == "csv" else reader.format(fmt).load(path)
    if bx is not None:
        df = df.where(F.col("bx") == bx)
    if by is not None:
        df = df.where(F.col("by") == by)
    return df.select("x_id", "y_id", "rating", "bx", "by")


def write_model(factors: DataFrame, path: str) -> None:
    """Factors as Parquet, partitioned by matrix; vectors stay ``ARRAY<DOUBLE>``."""
    factors.select("matrix", "id", "block", "vec").write.partitionBy("matrix").parquet(path)


def read_model(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("matrix", "id", "block", "vec")
