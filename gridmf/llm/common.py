"""Tables, shared folders and small Spark helpers of the text operators."""

from __future__ import annotations

import os
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmf.session import scratch_path


ARROW_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``ARROW_ROWS`` rows in this session: rows here hold whole texts, sets or sketches."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder (``spark.checkpoint.dir``) and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    small_batches(spark)
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def workspace(spark: SparkSession, name: str):
    """A fresh name under which ``stored`` tables are put together; they are deleted when the block ends or fails."""
    path = scratch_path(spark, name)
    try:
        yield os.path.basename(path)
    finally:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def folded(col: str | object):
    """crc32 of a doc_id as text, the fold key of the contracts."""
    c = F.col(col) if isinstance(col, str) else col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame, col: str = "text") -> int:
    """Total bytes of a text column (one aggregate row)."""
    return int(docs.agg(F.coalesce(F.sum(F.octet_length(col).cast("long")), F.lit(0))).first()[0])


def unused(columns: list[str], *names: str) -> list[str]:
    """Names for internal columns that no column has, in any case, nor each other."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
